"""Chat formatting: a template compiler whose programs render conversations and their generation marks.

The template language has text, ``{{ expression }}``, ``if``/``elif``/``else``, ``for``,
``set`` and ``generation`` blocks; ``-`` beside a tag strips white space.  It is
sandboxed by construction: expressions read names, mapping keys, list items, literals,
operators and the fixed filters, and nothing can be called.  Source is parsed into a
syntax tree, constant parts are folded, and every node becomes a Python closure that
yields ``(text, generated)`` pieces.

Texts inside turns are escaped so that no control string can arise from them: a
backslash goes into every ``<|`` and ``<\\...\\|``; :func:`unescape` takes it out again.

Formatting: a template whose turns do not depend on each other is rendered row by row
without any shuffle, however long a conversation is.  Any other one is rendered as a
stream over rows ordered by conversation and turn, which holds two turns at a time.

Output rows: ``(conv_id, turn, part, formatted, from, to)``; ``from``/``to`` are the spans under
the loss mask in code points.  Rows of a conversation in order of ``(turn, part)`` are its text.

Defined results: null text and role are empty; rows with one turn number follow by role,
then text; a null turn comes first; a null conv_id is a conversation of its own; an empty
table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHATML = (
    "{% for message in messages %}<|im_start|>{{ message.role | escape_role }}\n"
    "{% if message.role == 'assistant' %}{% generation %}{{ message.text | escape }}{% endgeneration %}"
    "{% else %}{{ message.text | escape }}{% endif %}<|im_end|>\n{% endfor %}"
)
Piece = tuple[str, bool]


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def escape_role(role: str) -> str:
    """A role on one line: backslashes and line feeds are written out."""
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


FILTERS: dict[str, Callable[[Any], Any]] = {
    "escape": lambda v: escape(str(v)),
    "escape_role": lambda v: escape_role(str(v)),
    "trim": lambda v: str(v).strip(),
    "upper": lambda v: str(v).upper(),
    "lower": lambda v: str(v).lower(),
    "length": len,
}
BINARY: dict[str, Callable[[Any, Any], Any]] = {
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
    "in": lambda a, b: a in b,
    "+": lambda a, b: a + b,
    "-": lambda a, b: a - b,
    "%": lambda a, b: a % b,
    "~": lambda a, b: f"{a}{b}",
}
LEVELS = (("==", "!=", "<", "<=", ">", ">=", "in"), ("~",), ("+", "-"), ("%",))
TOKEN = re.compile(r"\s*(?:(?P<str>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<int>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|<=|>=|[-+%~<>|.\[\]()]))")
CONSTANTS = {"true": True, "false": False, "none": None}
KEYWORDS = {"and", "or", "not", "in", "if", "else"}


class TemplateError(ValueError):
    """The template is not in the language, or reads what is not there."""


class Expression:
    """Recursive descent over one expression; trees are tuples headed by their kind."""

    def __init__(self, source: str):
        self.tokens, at = [], 0
        source = source.rstrip()
        while at < len(source):
            m = TOKEN.match(source, at)
            if not m or m.end() == at:
                raise TemplateError(f"Cannot read {source[at:]!r}")
            self.tokens.append((m.lastgroup, m.group(m.lastgroup)))
            at = m.end()
        self.at = 0

    def peek(self) -> str | None:
        kind, text = self.tokens[self.at] if self.at < len(self.tokens) else (None, None)
        return None if kind in ("str", "int") else text

    def take(self, *wanted: str) -> bool:
        if self.peek() in wanted:
            self.at += 1
            return True
        return False

    def need(self, wanted: str) -> None:
        if not self.take(wanted):
            raise TemplateError(f"{wanted!r} is missing")

    def whole(self) -> tuple:
        tree = self.choice()
        if self.at < len(self.tokens):
            raise TemplateError(f"Left over: {self.tokens[self.at][1]!r}")
        return fold(tree)

    def choice(self) -> tuple:
        value = self.either()
        if self.take("if"):
            test = self.either()
            other = self.choice() if self.take("else") else ("const", "")
            return ("choice", test, value, other)
        return value

    def either(self) -> tuple:
        tree = self.both()
        while self.take("or"):
            tree = ("or", tree, self.both())
        return tree

    def both(self) -> tuple:
        tree = self.negation()
        while self.take("and"):
            tree = ("and", tree, self.negation())
        return tree

    def negation(self) -> tuple:
        return ("not", self.negation()) if self.take("not") else self.binary(0)

    def binary(self, level: int) -> tuple:
        if level == len(LEVELS):
            return self.postfix()
        tree = self.binary(level + 1)
        while self.peek() in LEVELS[level]:
            op = self.peek()
            self.at += 1
            tree = ("binary", op, tree, self.binary(level + 1))
        return tree

    def postfix(self) -> tuple:
        tree = self.atom()
        while True:
            if self.take("."):
                kind, text = self.tokens[self.at] if self.at < len(self.tokens) else (None, None)
                if kind != "name":
                    raise TemplateError("A key is missing after '.'")
                self.at += 1
                tree = ("item", tree, ("const", text))
            elif self.take("["):
                key = self.choice()
                self.need("]")
                tree = ("item", tree, key)
            elif self.take("|"):
                name = self.peek()
                if name not in FILTERS:
                    raise TemplateError(f"No filter {name!r}")
                self.at += 1
                tree = ("filter", name, tree)
            else:
                return tree

    def atom(self) -> tuple:
        if self.at >= len(self.tokens):
            raise TemplateError("An expression is missing")
        kind, text = self.tokens[self.at]
        self.at += 1
        if kind == "str":
            return ("const", re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), text[1:-1]))
        if kind == "int":
            return ("const", int(text))
        if text == "(":
            tree = self.choice()
            self.need(")")
            return tree
        if kind == "name" and text not in KEYWORDS:
            return ("const", CONSTANTS[text]) if text in CONSTANTS else ("name", text)
        raise TemplateError(f"Unexpected {text!r}")


def fold(tree: tuple) -> tuple:
    """Replace what does not depend on names by its value."""
    if tree[0] in ("const", "name"):
        return tree
    tree = tuple(fold(x) if isinstance(x, tuple) else x for x in tree)
    parts = [x for x in tree if isinstance(x, tuple)]
    if tree[0] == "choice" and tree[1][0] == "const":
        return tree[2] if tree[1][1] else tree[3]
    if all(x[0] == "const" for x in parts):
        return ("const", closure(tree)({}))
    return tree


def closure(tree: tuple) -> Callable[[dict], Any]:
    """The expression as a function of the names in scope."""
    kind = tree[0]
    if kind == "const":
        value = tree[1]
        return lambda scope: value
    if kind == "name":
        name = tree[1]

        def look_up(scope):
            if name not in scope:
                raise TemplateError(f"No name {name!r}")
            return scope[name]

        return look_up
    parts = [closure(x) for x in tree if isinstance(x, tuple)]
    if kind == "item":
        holder, key = parts

        def item(scope):
            held, at = holder(scope), key(scope)
            if isinstance(held, dict):
                return held.get(at, "")
            if isinstance(held, list | str) and isinstance(at, int):
                return held[at]
            raise TemplateError(f"No item {at!r}")

        return item
    if kind == "filter":
        apply, value = FILTERS[tree[1]], parts[0]
        return lambda scope: apply(value(scope))
    if kind == "binary":
        apply, left, right = BINARY[tree[1]], *parts
        return lambda scope: apply(left(scope), right(scope))
    if kind == "not":
        value = parts[0]
        return lambda scope: not value(scope)
    if kind == "and":
        left, right = parts
        return lambda scope: left(scope) and right(scope)
    if kind == "or":
        left, right = parts
        return lambda scope: left(scope) or right(scope)
    test, value, other = parts
    return lambda scope: value(scope) if test(scope) else other(scope)


def parse(source: str) -> list[tuple]:
    """The template as a list of nodes: text, output, if, for, set, generation."""
    marks = re.split(r"(\{\{.*?\}\}|\{%.*?%\}|\{#.*?#\})", source, flags=re.S)
    for i in range(1, len(marks), 2):
        if marks[i][2] == "-":
            marks[i - 1] = marks[i - 1].rstrip()
        if marks[i][-3] == "-":
            marks[i + 1] = marks[i + 1].lstrip()
    at = 0

    def block(ends: tuple[str, ...]) -> tuple[list[tuple], str]:
        nonlocal at
        nodes: list[tuple] = []
        while at < len(marks):
            mark, tag = marks[at], at % 2
            at += 1
            if not tag:
                if mark:
                    nodes.append(("text", mark))
                continue
            body = mark[2:-2].strip("-").strip()
            if mark.startswith("{#"):
                continue
            if mark.startswith("{{"):
                tree = Expression(body).whole()
                nodes.append(("text", str(tree[1])) if tree[0] == "const" else ("output", tree))
                continue
            word, _, rest = body.partition(" ")
            if word in ends:
                return nodes, body
            if word == "if":
                branches, test = [], Expression(rest).whole()
                while True:
                    inner, end = block(("elif", "else", "endif"))
                    branches.append((test, inner))
                    if end == "endif":
                        break
                    test = ("const", True) if end == "else" else Expression(end.partition(" ")[2]).whole()
                kept: list[tuple] = []
                for test, inner in branches:
                    if test[0] == "const" and not test[1]:
                        continue
                    kept.append((test, inner))
                    if test[0] == "const":
                        break
                if kept and kept[0][0][0] == "const":
                    nodes.extend(kept[0][1])
                elif kept:
                    nodes.append(("if", kept))
            elif word == "for":
                m = re.fullmatch(r"([A-Za-z_]\w*)\s+in\s+(.+)", rest, re.S)
                if not m:
                    raise TemplateError(f"Cannot read {body!r}")
                inner, _ = block(("endfor",))
                nodes.append(("for", m[1], Expression(m[2]).whole(), inner))
            elif word == "generation":
                inner, _ = block(("endgeneration",))
                nodes.append(("generation", inner))
            elif word == "set":
                m = re.fullmatch(r"([A-Za-z_]\w*)\s*=(?!=)\s*(.+)", rest, re.S)
                if not m:
                    raise TemplateError(f"Cannot read {body!r}")
                nodes.append(("set", m[1], Expression(m[2]).whole()))
            else:
                raise TemplateError(f"Unknown tag {word!r}")
        if ends:
            raise TemplateError(f"{ends[-1]!r} is missing")
        return nodes, ""

    return joined(block(())[0])


def joined(nodes: list[tuple]) -> list[tuple]:
    """Neighbouring texts as one."""
    out: list[tuple] = []
    for node in nodes:
        if node[0] == "text" and out and out[-1][0] == "text":
            out[-1] = ("text", out[-1][1] + node[1])
        else:
            out.append(node)
    return out


def program(nodes: list[tuple], generated: bool = False) -> Callable[[dict], Iterator[Piece | None]]:
    """Nodes as one closure; None comes after every turn of a loop over ``messages``."""
    steps = [step(node, generated) for node in joined(nodes)]

    def run(scope: dict) -> Iterator[Piece | None]:
        for own in steps:
            yield from own(scope)

    return run


def step(node: tuple, generated: bool) -> Callable[[dict], Iterator[Piece | None]]:
    kind = node[0]
    if kind == "text":
        piece = [(node[1], generated)]
        return lambda scope: iter(piece)
    if kind == "output":
        value = closure(node[1])
        return lambda scope: iter([(str(value(scope)), generated)])
    if kind == "set":
        name, value = node[1], closure(node[2])

        def assign(scope):
            scope[name] = value(scope)
            return iter(())

        return assign
    if kind == "generation":
        return program(node[1], True)
    if kind == "if":
        branches = [(closure(test), program(inner, generated)) for test, inner in node[1]]

        def branch(scope):
            for test, inner in branches:
                if test(scope):
                    yield from inner(scope)
                    return

        return branch
    name, over, inner = node[1], closure(node[2]), program(node[3], generated)
    turns = node[2] == ("name", "messages")

    def loop(scope):
        items, index = iter(over(scope)), 0
        item = next(items, None)
        while item is not None:
            following = next(items, None)
            own = {**scope, name: item, "loop": {"index0": index, "index": index + 1, "first": index == 0, "last": following is None}}
            yield from inner(own)
            if turns:
                yield None
            item, index = following, index + 1

    return loop


def names_in(tree: Any) -> set[str]:
    if isinstance(tree, list):
        return set().union(*map(names_in, tree)) if tree else set()
    if not isinstance(tree, tuple):
        return set()
    if len(tree) == 2 and tree[0] == "name":
        return {tree[1]}
    return set().union(*map(names_in, tree)) if tree else set()


class Template:
    """A compiled template."""

    def __init__(self, source: str):
        self.nodes = parse(source)
        self.run = program(self.nodes)
        loops = [n for n in self.nodes if n[0] == "for" and n[2] == ("name", "messages")]
        #: One loop over the messages and nothing else, whose body reads nothing but its message.
        self.by_turn = len(self.nodes) == len(loops) == 1 and names_in(loops[0][3]) <= {loops[0][1]} and not any(n[0] == "set" for n in loops[0][3])

    def render(self, messages: Iterable[dict]) -> Iterator[tuple[str, list[int], list[int]]]:
        """``(text, from, to)`` part by part: one for each turn and one for what follows the last."""
        texts, a, b, n = [], [], [], 0
        for piece in self.run({"messages": messages}):
            if piece is None:
                yield "".join(texts), a, b
                texts, a, b, n = [], [], [], 0
                continue
            text, generated = piece
            if text:
                if generated:
                    if b and b[-1] == n:
                        b[-1] = n + len(text)
                    else:
                        a.append(n)
                        b.append(n + len(text))
                texts.append(text)
                n += len(text)
        if texts:
            yield "".join(texts), a, b


def format_conversations(rows: DataFrame, template: str = CHATML, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``(conv_id, turn, part, formatted, from, to)`` of all conversations."""
    compiled = Template(template)  # errors show on the driver
    kinds = dict(rows.dtypes)
    own = rows.select(
        F.col(f"`{conv_id}`").alias("conv_id"),
        F.col(f"`{turn}`").alias("turn"),
        F.coalesce(F.col(f"`{role}`").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"),
    )
    by_turn = compiled.by_turn

    def out(records: list[tuple], batch: pa.RecordBatch) -> pa.RecordBatch:
        columns = list(zip(*records, strict=True))
        kinds = [batch.column(0).type, batch.column(1).type, pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32())]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["conv_id", "turn", "part", "formatted", "from", "to"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Template(template)
        for batch in batches:
            records = []
            for conv, at, who, what in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                records.extend((conv, at, 0, *part) for part in machine.render([{"role": who, "text": what}]))
            if records:
                yield out(records, batch)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, shape = Template(template), None

        def records():
            nonlocal shape
            for batch in batches:
                shape = batch
                yield from zip(*[c.to_pylist() for c in batch.columns], strict=True)

        source = records()
        head = next(source, None)
        ready: list[tuple] = []
        while head is not None:
            conv, seen = head[0], []

            def messages(conv=conv, seen=seen):
                nonlocal head
                while head is not None and head[0] == conv:
                    seen[:] = [head[1]]
                    message = {"role": head[2], "text": head[3]}
                    head = next(source, None)
                    yield message

            # Parts of one conversation are numbered through and carry no turn.
            for part, (written, a, b) in enumerate(machine.render(messages())):
                ready.append((conv, None, part, written, a, b))
                if len(ready) >= 512:
                    yield out(ready, shape)
                    ready = []
            for _ in messages():  # what the template did not read
                pass
        if ready:
            yield out(ready, shape)

    shape = f"conv_id {kinds[conv_id]}, turn {kinds[turn]}, part bigint, formatted string, `from` array<int>, `to` array<int>"
    if by_turn:
        # Ties of one turn number are ordered by role and text when parts are read.
        return own.mapInArrow(each, shape)
    ordered = own.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.mapInArrow(stream, shape)


TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.S)


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """Turns ``(role, text)`` of text in the default template."""
    turns, at = [], 0
    for m in TURN.finditer(formatted):
        if m.start() != at:
            raise TemplateError("Text between turns")
        turns.append((unescape_role(m[1]), unescape(m[2])))
        at = m.end()
    if at != len(formatted):
        raise TemplateError("Text after the last turn")
    return turns


def digests(formatted: DataFrame) -> DataFrame:
    """What the parts of each conversation in the default template say, read back as a stream.

    ``(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars)``.  A digest
    runs over a conversation in order, so one task reads it, one part at a time.
    """
    kind = dict(formatted.dtypes)["conv_id"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, done, shape = None, [], None

        def close():
            conv, n, turns, chars, loss, size = state
            done.append((conv, n, turns.hexdigest(), chars, loss.hexdigest(), size))

        def flush():
            columns = list(zip(*done, strict=True))
            kinds = [shape, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        for batch in batches:
            shape = batch.column(0).type
            for conv, text, a, b in zip(*[batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("conv_id", "formatted", "from", "to")], strict=True):
                if state is None or state[0] != conv:
                    if state is not None:
                        close()
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, own in read_turns(text):
                    state[1] += 1
                    state[2].update(f"{role}\n{own}\n".encode("utf-8", "surrogatepass"))
                for x, y in zip(a, b, strict=True):
                    own = unescape(text[x:y])
                    state[3] += len(own)
                    state[4].update(own.encode("utf-8", "surrogatepass"))
                state[5] += len(text)
            if len(done) >= 1000:
                yield flush()
                done.clear()
        if state is not None:
            close()
        if done:
            yield flush()

    ordered = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "part", "formatted")
    return ordered.mapInArrow(read, f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
