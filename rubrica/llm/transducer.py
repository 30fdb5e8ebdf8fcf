"""SentencePiece encoding and decoding by a weighted finite-state transducer.

A model file is compiled once into three machines: the normaliser (blanks become the
blank mark, one goes in front), the piece lexicon (a trie whose final states write a
piece at its cost) and byte fallback (each character to its bytes, at a cost above any
piece).  A text is composed with them as a lattice of arcs between its characters; the
encoding is the lattice's shortest path in the tropical semiring (min, +), ties going
to the longer last arc.  Decoding is the inverse machine.

Costs are the negated scores of a unigram model, so its encodings are the library's
own best paths.  A merge model has ranks instead of scores; a piece costs
``log(rank + 2)``, the code length of a Zipf law.  Its lexicon is composed with a fourth
machine, a filter over neighbouring pieces: two may follow each other if merging their
joined text gives them back.  The filter is compiled into what each piece was last merged
from, and at which rank, and walks both pieces back along their common edge.  The shortest
path through lattice and filter is the library's encoding, for the filter leaves one path.
Words of more than ``LONG`` characters are merged in the order of ranks instead, which
gives that path without a step for each character.

No piece of a usual model reaches over the start of a word, so the lattice falls into
words and equal words of a slice are composed once; a model with such pieces is
composed over whole texts.  Composition and relaxation run over all words of a slice
at a time.

Defined results: null and empty texts have no ids and decode to empty text; decoding
gives the normalised text back, which is the text itself unless it holds the blank mark
U+2581 (decoded as a blank); ids that are control pieces or out of range write nothing;
bytes that are not valid UTF-8 decode to U+FFFD.
"""

from __future__ import annotations

import heapq
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .base import bound_batches
from .memory import PieceMemory, process_store
from .token_arrays import expand, text_bytes, with_starts
from .words import Hasher, gather, lists, slices

SLICE = 1 << 20
WORDS = 10_000  # words composed at a time
SINGLE = 64  # symbols of a word that is merged by itself
LONG = 1024  # characters of a word that is merged instead of composed
MARK = 0x2581
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6  # piece kinds of the file format


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Fields of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        else:
            size = varint() if key & 7 == 2 else {1: 8, 5: 4}[key & 7]
            yield key >> 3, data[at : at + size]
            at += size


class Transducer:
    """The compiled machines of one model file."""

    def __init__(self, model: bytes):
        pieces, kind, spec = [], 1, {}
        for field, value in fields(model):
            if field == 1:
                own = dict(fields(value))
                pieces.append((own.get(1, b"").decode(), struct.unpack("<f", own[2])[0] if 2 in own else 0.0, own.get(3, NORMAL)))
            elif field == 2:
                kind = dict(fields(value)).get(3, 1)
            elif field == 3:
                spec = dict(fields(value))
        if kind not in (1, 2):
            raise ValueError("Only unigram and merge models have weighted pieces")
        if spec.get(2):
            raise ValueError("Only models without a character map are compiled")
        if spec.get(4, 1):
            raise ValueError("Only models that keep extra white space are compiled")
        self.prefix = bool(spec.get(3, 1))
        cost = [(-score if kind == 1 else float(np.log(max(-score, 0.0) + 2.0))) for _, score, _ in pieces]
        usable = [i for i, p in enumerate(pieces) if p[2] in (NORMAL, USER) and p[0]]
        self.unknown = next((i for i, p in enumerate(pieces) if p[2] == UNKNOWN), 0)
        self.byte_id = np.full(256, self.unknown, np.int32)
        for i, p in enumerate(pieces):
            if p[2] == BYTE:
                self.byte_id[int(p[0][3:5], 16)] = i
        self.fallback = max([cost[i] for i in usable], default=0.0) + 10.0
        # Lexicon: states are prefixes of pieces, arcs are keyed (state, character).
        states, arcs, final = {"": 0}, {}, {}
        for i in usable:
            text = pieces[i][0]
            for k in range(1, len(text) + 1):
                if text[:k] not in states:
                    states[text[:k]] = len(states)
                    arcs[states[text[: k - 1]] << 21 | ord(text[k - 1])] = states[text[:k]]
            at = states[text]
            if at not in final or cost[i] < cost[final[at]]:
                final[at] = i
        self.keys = np.array(sorted(arcs), np.int64)
        self.to = np.array([arcs[k] for k in self.keys.tolist()], np.int64)
        self.final = np.full(len(states), -1, np.int64)
        self.cost = np.full(len(states), np.inf)
        for at, i in final.items():
            self.final[at], self.cost[at] = i, cost[i]
        self.longest = max([len(pieces[i][0]) for i in usable], default=1)
        mark = chr(MARK)
        self.by_word = not any(mark in pieces[i][0].lstrip(mark) for i in usable)
        self.root = np.zeros(0x110000, np.int32)
        first = self.keys[self.keys < 1 << 21]
        self.root[first] = self.to[: len(first)]
        self.hasher, self.memory, self.merged = Hasher(np.ones(256, bool), lower=False), PieceMemory(), PieceMemory()
        self.merges = kind == 2
        self.piece_cost = np.array(cost)
        if self.merges:
            self.compile_merges(pieces, usable)
        # Inverse machine: bytes written by each id.
        out = [bytes([int(p[0][3:5], 16)]) if p[2] == BYTE else p[0].replace(mark, " ").encode() if p[2] in (NORMAL, USER) else b" \xe2\x81\x87 " if p[2] == UNKNOWN else b"" for p in pieces]
        self.out = np.frombuffer(b"".join(out), np.uint8)
        self.out_size = np.array([*map(len, out), 0], np.int64)
        self.out_start = np.cumsum(self.out_size) - self.out_size

    def compile_merges(self, pieces: list, usable: list[int]) -> None:
        """Pairs of symbols whose texts together are a piece, keyed (left, right), with what they become and its rank."""
        self.special = any(p[2] in (USER, UNUSED) for p in pieces)
        symbol = {}
        for i in usable:
            symbol.setdefault(pieces[i][0], i)
        for i in usable:  # characters of pieces that are no pieces themselves
            for c in pieces[i][0]:
                symbol.setdefault(c, len(pieces) + len(symbol))
        self.char_symbol = np.full(0x110000, -1, np.int64)
        for text, i in symbol.items():
            if len(text) == 1:
                self.char_symbol[ord(text)] = i
        order = {score: k for k, score in enumerate(sorted({pieces[i][1] for i in usable}, reverse=True))}
        pairs = {}
        for i in usable:
            text = pieces[i][0]
            for k in range(1, len(text)):
                if text[:k] in symbol and text[k:] in symbol:
                    pairs[symbol[text[:k]] << 24 | symbol[text[k:]]] = symbol[text]
        self.pair = np.array(sorted(pairs), np.int64)
        self.pair_to = np.array([pairs[k] for k in self.pair.tolist()], np.int64)
        self.pair_rank = np.array([order[pieces[i][1]] for i in self.pair_to.tolist()], np.int64)
        self.pairs = {k: (order[pieces[i][1]], i) for k, i in pairs.items()}
        if self.special:
            return
        # The neighbour filter: what each piece is merged from, when, and whether it is what its own text gives.
        texts = [pieces[i][0] for i in usable]
        last = np.full((len(texts), 2), -1, np.int64)
        ids, bounds, _ = self.merge_paths(texts, last)
        whole = (np.diff(bounds) == 1) & (ids[np.minimum(bounds[:-1], max(len(ids) - 1, 0))] == np.array(usable))
        many = len(pieces) + len(symbol) + 1
        self.formed, self.left, self.right, self.sound = np.full(many, -1, np.int64), np.arange(many), np.arange(many), np.zeros(many, bool)
        at, merged = np.array(usable), np.array([len(t) > 1 for t in texts])
        self.sound[at[whole]] = True
        self.formed[at[merged]] = [order[pieces[i][1]] for i in at[merged].tolist()]
        self.left[at[merged]], self.right[at[merged]] = last[merged, 0], last[merged, 1]
        # Pieces that are no later than their parts (runs of one character may share a rank), and what is made of those.
        self.odd, self.joined, self.text = np.zeros(many, bool), {}, {i: text for text, i in symbol.items()}
        parts = at[merged & whole]
        early = self.formed[parts] <= np.maximum(self.formed[self.left[parts]], self.formed[self.right[parts]])
        self.odd[parts[early]] = True
        while (grown := self.odd | self.odd[self.left] | self.odd[self.right]).sum() > self.odd.sum():
            self.odd = grown

    def neighbours(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether merging the joined text of two sound symbols gives both back.

        Walks back in time: at every moment, the symbols at the edge must not have merged with each other
        before the later of them was formed; of merges of one rank the left one comes first.  Where pieces are no
        later than their parts, the joined text is merged.
        """
        out = np.ones(len(left), bool)
        odd = (left >= 0) & (right >= 0) & (self.odd[np.maximum(left, 0)] | self.odd[np.maximum(right, 0)])
        for i in np.flatnonzero(odd).tolist():
            pair = int(left[i]), int(right[i])
            if pair not in self.joined:
                ids, _, _ = self.merge_paths(["".join(self.text[x] for x in pair)])
                apart = [[x] if x < len(self.piece_cost) else [int(self.byte_id[c]) for c in self.text[x].encode()] for x in pair]
                self.joined[pair] = ids.tolist() == apart[0] + apart[1]
            out[i] = self.joined[pair]
        at = np.flatnonzero((left >= 0) & (right >= 0) & ~odd)
        a, b = left[at], right[at]
        limit, from_right = np.full(len(at), np.iinfo(np.int64).max), np.zeros(len(at), bool)
        while len(at):
            key = a << 24 | b
            place = np.minimum(np.searchsorted(self.pair, key), max(len(self.pair) - 1, 0))
            known = self.pair[place] == key if len(self.pair) else np.zeros(len(key), bool)
            rank = np.where(known, self.pair_rank[place] if len(self.pair) else 0, np.iinfo(np.int64).max)
            met = known & ((rank < limit) | ((rank == limit) & from_right))
            out[at[met]] = False
            a_at, b_at = self.formed[a], self.formed[b]
            more = ~met & ((a_at >= 0) | (b_at >= 0))
            at, a, b, a_at, b_at = at[more], a[more], b[more], a_at[more], b_at[more]
            from_right = b_at >= a_at
            limit = np.maximum(a_at, b_at)
            a, b = np.where(from_right, a, self.right[a]), np.where(from_right, self.left[b], b)
        return out

    def merge_long(self, symbols: list[int]) -> tuple[list[int], list[int]]:
        """Symbols of one word after all merges, and where each begins: a heap of pairs."""
        n = len(symbols)
        after, before, heap = list(range(1, n + 1)), list(range(-1, n - 1)), []

        def offer(a: int) -> None:
            b = after[a]
            if b < n and symbols[a] >= 0 and symbols[b] >= 0 and (found := self.pairs.get(symbols[a] << 24 | symbols[b])):
                heapq.heappush(heap, (found[0], a, symbols[a], symbols[b], found[1]))

        for a in range(n):
            offer(a)
        while heap:
            _, a, left, right, to = heapq.heappop(heap)
            b = after[a]
            if symbols[a] != left or b >= n or symbols[b] != right:
                continue
            symbols[a], symbols[b], after[a] = to, -2, after[b]
            if after[b] < n:
                before[after[b]] = a
            offer(a)
            if before[a] >= 0:
                offer(before[a])
        places = [a for a in range(n) if symbols[a] != -2]
        return [symbols[a] for a in places], places

    def merge_paths(self, words: list[str], last: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(ids, bounds, costs)`` of every normalised word, merged in the order of ranks; ``last`` takes the symbols of each word's last merge."""
        if self.special:
            raise ValueError("Only merge models without user-defined and unused pieces are merged")
        point = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        size = np.fromiter(map(len, words), np.int64, len(words))
        begin = np.cumsum(size) - size
        of, where, what = [], [], []
        for i in np.flatnonzero(size > SINGLE).tolist():
            symbols, places = self.merge_long(self.char_symbol[point[begin[i] : begin[i] + size[i]]].tolist())
            of.append(np.full(len(symbols), i))
            where.append(begin[i] + np.array(places, np.int64))
            what.append(np.array(symbols, np.int64))
        short = size <= SINGLE
        at = np.flatnonzero(np.repeat(short, size))
        word, sym = np.repeat(np.arange(len(words)), size)[at], self.char_symbol[point[at]]
        while len(sym):
            # One merge in every word at a time, the leftmost of the best rank.
            key = np.append(np.where((word[:-1] == word[1:]) & (sym[:-1] >= 0) & (sym[1:] >= 0), sym[:-1] << 24 | sym[1:], -1), -1)
            place = np.minimum(np.searchsorted(self.pair, key), max(len(self.pair) - 1, 0))
            known = self.pair[place] == key if len(self.pair) else np.zeros(len(key), bool)
            rank = np.full(len(key), len(self.piece_cost))
            rank[known] = self.pair_rank[place[known]]
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            length = np.diff(np.append(first, len(word)))
            best = np.repeat(np.minimum.reduceat(rank, first), length)
            open_ = best < len(self.piece_cost)
            of.append(word[~open_])
            where.append(at[~open_])
            what.append(sym[~open_])
            chosen = np.flatnonzero(open_ & (rank == best))
            chosen = chosen[np.unique(word[chosen], return_index=True)[1]]
            if last is not None:
                last[word[chosen], 0], last[word[chosen], 1] = sym[chosen], sym[chosen + 1]
            sym[chosen] = self.pair_to[place[chosen]]
            open_[chosen + 1] = False
            word, at, sym = word[open_], at[open_], sym[open_]
        empty = np.zeros(0, np.int64)
        of, where, what = np.concatenate([empty, *of]), np.concatenate([empty, *where]), np.concatenate([empty, *what])
        order = np.argsort(where, kind="stable")
        of, where, what = of[order], where[order], what[order]
        # Characters that are no pieces write their bytes.
        spelled = (what < 0) | (what >= len(self.piece_cost))
        letters = point[where[spelled]]
        width = np.where(letters < 0x80, 1, np.where(letters < 0x800, 2, np.where(letters < 0x10000, 3, 4)))
        many, own = np.ones(len(what), np.int64), np.zeros(len(what))
        many[spelled], own[spelled] = width, self.fallback * width
        own[~spelled] = self.piece_cost[what[~spelled]]
        ids = np.repeat(np.where(spelled, -1, what), many)
        ids[ids < 0] = self.byte_id[np.frombuffer("".join(map(chr, letters.tolist())).encode("utf-8", "surrogatepass"), np.uint8)]
        count = np.bincount(of, many, minlength=len(words)).astype(np.int64)
        return ids.astype(np.int32), np.concatenate([[0], np.cumsum(count)]), np.bincount(of, own, minlength=len(words))

    def lattice(self, point: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(weight, written, width)``: ``weight[l, t]`` and what is written on the arc of length l + 1 that ends behind character t, and bytes of characters."""
        weight = np.full((self.longest, len(point)), np.inf)
        written = np.full((self.longest, len(point)), -1, np.int32)
        width = np.where(point < 0x80, 1, np.where(point < 0x800, 2, np.where(point < 0x10000, 3, 4)))
        if len(point):
            weight[0] = self.fallback * width
        at = np.arange(len(point))
        state = self.root[point].astype(np.int64)
        for length in range(self.longest):
            if length:
                inside = at + length < end[at]
                at, state = at[inside], state[inside]
                key = state << 21 | point[at + length]
                place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                known = self.keys[place] == key
                at, state = at[known], self.to[place[known]]
            else:
                at, state = at[state > 0], state[state > 0]
            if not len(at):
                break
            done = self.final[state] >= 0
            target, own = at[done] + length, state[done]
            better = self.cost[own] < weight[length, target]
            weight[length, target[better]] = self.cost[own[better]]
            written[length, target[better]] = self.final[own[better]]
        return weight, written, width

    def shortest_paths(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(ids, bounds, costs)`` of the cheapest path of every normalised word."""
        point = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        size = np.fromiter(map(len, words), np.int64, len(words))
        weight, written, width = self.lattice(point, np.repeat(np.cumsum(size), size))
        # Relaxation, character by character over all words: node t + 1 + word is the end of character t.
        begin = np.cumsum(size) - size
        node = begin + np.arange(len(words))
        best = np.zeros(len(point) + len(words))
        back = np.zeros(len(point), np.int64)
        order = np.argsort(-size, kind="stable")
        for k in range(int(size.max(initial=0))):
            live = order[: np.searchsorted(-size[order], -k)]
            t = begin[live] + k
            reach = np.arange(min(self.longest, k + 1))[::-1]  # longer arcs first: they win ties
            total = best[node[live][:, None] + k - reach] + weight[reach[None, :], t[:, None]]
            choice = np.argmin(total, axis=1)
            best[node[live] + k + 1] = total[np.arange(len(live)), choice]
            back[t] = reach[choice]
        cost = best[node + size]
        return self.spell(words, point, size, written, width, back, cost)

    def filtered_paths(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(ids, bounds, costs)`` of the cheapest path through lattice and neighbour filter of every normalised word.

        States are arcs: ``best[l, t]`` is the cheapest way to the arc of length l + 1 that ends behind character t.
        """
        if self.special:
            raise ValueError("Only merge models without user-defined and unused pieces are merged")
        long = np.array([len(w) > LONG for w in words], bool)
        if long.any():
            short, rest = [w for w, x in zip(words, long, strict=True) if not x], [w for w, x in zip(words, long, strict=True) if x]
            (ids, bounds, costs), (more, edges, other) = self.filtered_paths(short), self.merge_paths(rest)
            sizes, begins, cost = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), np.zeros(len(words))
            sizes[~long], sizes[long], cost[~long], cost[long] = np.diff(bounds), np.diff(edges), costs, other
            begins[~long], begins[long] = bounds[:-1], edges[:-1] + len(ids)
            return np.concatenate([ids, more])[expand(begins, sizes)], np.concatenate([[0], np.cumsum(sizes)]), cost
        point = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        size = np.fromiter(map(len, words), np.int64, len(words))
        weight, written, width = self.lattice(point, np.repeat(np.cumsum(size), size))
        symbol = np.where(written >= 0, written, -1).astype(np.int64)
        if len(point):
            symbol[0] = np.where(written[0] >= 0, written[0], self.char_symbol[point])
        weight[(symbol >= 0) & (written >= 0) & ~self.sound[np.maximum(symbol, 0)]] = np.inf
        begin = np.cumsum(size) - size
        best, before = np.full(weight.shape, np.inf), np.zeros(weight.shape, np.int8 if self.longest < 128 else np.int64)
        # How many arcs into each place are open, and the last of them.
        many, one = np.zeros(len(point), np.int64), np.zeros(len(point), np.int64)
        order = np.argsort(-size, kind="stable")
        for k in range(int(size.max(initial=0))):
            t = begin[order[: np.searchsorted(-size[order], -k)]] + k
            if k < self.longest:  # arcs from the start of the word
                best[k, t] = weight[k, t]
                whole = t[np.isfinite(weight[k, t])]
                many[whole], one[whole] = many[whole] + 1, k
            # Arcs from a node inside the word, after each arc that ends there.
            length, word = np.nonzero(np.isfinite(weight[: min(self.longest, k), t]))
            if not len(length):
                continue
            to = t[word]
            came = to - length - 1
            if many[came].max() <= 1:  # what the filter leaves
                arc = np.flatnonzero(many[came])
                earlier = one[came[arc]]
            else:
                earlier, arc = np.nonzero(np.isfinite(best[:, came]))
            length, to, came = length[arc], to[arc], came[arc]
            fits = self.neighbours(symbol[earlier, came], symbol[length, to])
            earlier, length, to, came = earlier[fits], length[fits], to[fits], came[fits]
            total = best[earlier, came] + weight[length, to]
            first = np.lexsort((-earlier, total, length, to))
            keep = first[np.concatenate([[True], (to[first][1:] != to[first][:-1]) | (length[first][1:] != length[first][:-1])])] if len(first) else first
            best[length[keep], to[keep]], before[length[keep], to[keep]] = total[keep], earlier[keep]
            np.add.at(many, to[keep], 1)
            one[to[keep]] = length[keep]
        # The last arc of each word, and from there the arcs before it.
        back, cost = np.zeros(len(point), np.int64), np.zeros(len(words))
        word = np.flatnonzero(size > 0)
        place = (begin + size - 1)[word]
        arc = best[:, place].argmin(axis=0) if len(word) else np.zeros(0, np.int64)
        cost[word] = best[arc, place]
        while len(word):
            back[place] = arc
            place, arc = place - arc - 1, before[arc, place]
            more = place >= begin[word]
            word, place, arc = word[more], place[more], arc[more]
        return self.spell(words, point, size, written, width, back, cost)

    def spell(self, words, point, size, written, width, back, cost) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Walk paths back from the ends of all words; ``back[t]`` is the length, less one, of the arc that ends behind character t."""
        begin = np.cumsum(size) - size
        word, place = np.flatnonzero(size > 0), (begin + size - 1)[size > 0]
        of, where, what = [], [], []
        while len(word):
            of.append(word)
            where.append(place)
            what.append(written[back[place], place])
            place = place - back[place] - 1
            more = place >= begin[word]
            word, place = word[more], place[more]
        if not of:
            return np.zeros(0, np.int32), np.zeros(len(words) + 1, np.int64), cost
        of, where, what = np.concatenate(of), np.concatenate(where), np.concatenate(what)
        order = np.lexsort((where, of))
        of, where, what = of[order], where[order], what[order]
        # Fallback arcs write the bytes of their character.
        many = np.where(what < 0, width[where], 1)
        ids = np.repeat(what, many)
        spell = np.flatnonzero(what < 0)
        if len(spell):
            data = np.frombuffer("".join(map(chr, point[where[spell]].tolist())).encode("utf-8", "surrogatepass"), np.uint8)
            ids[ids < 0] = self.byte_id[data]
        count = np.bincount(of, many, minlength=len(words)).astype(np.int64)
        return ids.astype(np.int32), np.concatenate([[0], np.cumsum(count)]), cost

    def encode(self, texts: pa.Array, by_merges: bool = False, filtered: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(ids, bounds, costs)`` of all texts.

        For merge models, ``filtered`` composes with the neighbour filter, and ``by_merges`` follows the ranks
        instead of a path, to the same end.
        """
        paths, memory = (self.merge_paths, None) if by_merges else (self.filtered_paths, self.merged) if filtered else (self.shortest_paths, self.memory)
        memory = PieceMemory() if memory is None else memory
        raw, docs = text_bytes(texts)
        if self.prefix:  # the blank in front of every text that is not empty
            full = np.flatnonzero(docs[1:] > docs[:-1])
            raw = np.insert(raw, docs[full], 32)
            docs = docs + np.concatenate([[0], np.cumsum(docs[1:] > docs[:-1])])
        cuts = np.zeros(0, np.int64)
        if self.by_word:
            cuts = np.flatnonzero(raw == 32)
            cuts = cuts[cuts > 0]
            cuts = cuts[(raw[cuts - 1] != 32) & (raw[cuts - 1] != 0x81)]  # 81: perhaps the blank mark's last byte
        starts = with_starts(cuts, docs, len(raw))
        ends = np.append(starts, len(raw))[1:]
        distinct, first, word = np.unique(self.hasher.bytes.runs(self.hasher.codes[raw], starts, ends), return_index=True, return_inverse=True)
        bounds = np.searchsorted(starts, docs)

        def fresh(new):
            words = gather(raw, starts[first[new]], ends[first[new]]).to_pylist()
            parts = [paths([w.replace(" ", chr(MARK)) for w in words[at : at + WORDS]]) for at in range(0, len(words), WORDS)]
            empty = (np.zeros(0, np.int32), np.zeros(1, np.int64), np.zeros(0))
            return tuple(np.concatenate(x) for x in zip(*[(ids, np.diff(edge), cost) for ids, edge, cost in [empty, *parts]], strict=True))

        flat, begin, size, cost = memory.resolve(distinct, fresh)
        word = word.ravel()
        closed = np.concatenate([[0], np.cumsum(size[word])])
        total = np.concatenate([[0.0], np.cumsum(cost[word])])[bounds]
        return flat[expand(begin[word], size[word])], closed[bounds], np.diff(total)

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> list[str]:
        """Texts of the id lists ``ids[bounds[i]:bounds[i + 1]]``."""
        known = np.where((ids >= 0) & (ids < len(self.out_size) - 1), ids, len(self.out_size) - 1)
        size = self.out_size[known]
        data = self.out[expand(self.out_start[known], size)].tobytes()
        edge = np.concatenate([[0], np.cumsum(size)])[bounds].tolist()
        texts = [data[a:b].decode("utf-8", "replace") for a, b in zip(edge[:-1], edge[1:], strict=True)]
        return [t[1:] if self.prefix and t.startswith(" ") else t for t in texts]


def _with(df: DataFrame, *added: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([*df.schema.fields, *[T.StructField(name, kind) for name, kind in added]])


def _model(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()  # a vocabulary, of fixed size


def encode(docs: DataFrame, model_file: str, text: str = "text", to: str = "ids", cost: str = "path_cost") -> DataFrame:
    """The documents with their piece ids and the cost of the path; no shuffle."""
    model = _model(model_file)
    bound_batches(docs.sparkSession)
    rows = docs.drop(to, cost)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = process_store(f"transducer {zlib.crc32(model)}", lambda: Transducer(model))
        for batch in slices(batches, text, SLICE):
            ids, bounds, costs = machine.encode(batch.column(batch.schema.get_field_index(text)), filtered=machine.merges)
            yield pa.RecordBatch.from_arrays([*batch.columns, lists(ids, bounds, pa.int32()), pa.array(costs)], names=[*batch.schema.names, to, cost])

    return rows.mapInArrow(read, _with(rows, (to, T.ArrayType(T.IntegerType())), (cost, T.DoubleType())))


def decode(df: DataFrame, model_file: str, ids: str = "ids", to: str = "decoded") -> DataFrame:
    """The rows with the text that their ids stand for; no shuffle."""
    model = _model(model_file)
    rows = df.drop(to)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = process_store(f"transducer {zlib.crc32(model)}", lambda: Transducer(model))
        for batch in id_slices(batches, ids):
            column = batch.column(batch.schema.get_field_index(ids))
            size = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            values = column.flatten().fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
            texts = machine.decode(values, np.concatenate([[0], np.cumsum(size)]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, to])

    return rows.mapInArrow(read, _with(rows, (to, T.StringType())))


def id_slices(batches: Iterator[pa.RecordBatch], ids: str, limit: int = 1 << 18) -> Iterator[pa.RecordBatch]:
    """Cut record batches into runs of rows of about ``limit`` ids."""
    for batch in batches:
        if batch.num_rows:
            size = batch.column(batch.schema.get_field_index(ids)).value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            run = (np.cumsum(size) - size) // limit
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(run)) + 1, [batch.num_rows]])
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                yield batch.slice(a, b - a)


def fallback_count(ids: str = "ids", first: int = 3):
    """Number of byte-fallback ids, for models whose 256 byte pieces start at ``first``."""
    return F.size(F.filter(ids, lambda i: (i >= first) & (i < first + 256))).cast("bigint")
