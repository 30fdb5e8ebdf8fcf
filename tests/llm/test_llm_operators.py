"""The training-data operators against brute force, on small and awkward tables."""

import hashlib
import itertools
import re
import struct
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rubrica.llm import chat_format, decontamination, ngram_join, personal_data, quality, secret_scan, substring_dedup, token_output, transducer, url_filter

ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACE_WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LETTER_WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
MODEL = public_tokenizers.path("piece_bpe_32k.model")
NAMES = "n", "doc", "text", "h", "k", "key", "part", "n_words", "kept", "a", "b"


def prose(seed, n, size=40):
    rng = np.random.default_rng(seed)
    return " ".join(f"w{i}" for i in rng.integers(0, size, n))


def awkward_texts():
    base = prose(1, 150, 5000)
    words = base.split()
    near = " ".join([*words[:70], "other", *words[71:]])
    return [
        base, base, base.upper(), near, " ".join([*words[:20], "x", *words[21:60], "y", *words[61:]]), None, "", " \t\n ", "one", "one two", "One two", "one two three", "one two three",
        "ünï çödé " * 20, base + "\n" + prose(2, 60, 5000), prose(2, 60, 5000), "same " * 300, "same " * 120, "a" * 50_000, prose(3, 4000, 9000),
        " ".join(prose(3, 4000, 9000).split()[100:220]) + " tail",
    ]


@pytest.fixture(scope="module")
def awkward(spark):
    """Extra columns whose names the operators use themselves; a repeated id and a null one."""
    rows = [(i if i < 18 else 3, t, "en" if i % 2 else None, "src", *range(len(NAMES) - 1)) for i, t in enumerate(awkward_texts())]
    rows.append((None, awkward_texts()[0], "xx", None, *range(len(NAMES) - 1)))
    extra = [x for x in NAMES if x != "text"]
    shape = "doc_id bigint, text string, lang string, source string, " + ", ".join(f"`{x}` int" for x in extra)
    return spark.createDataFrame(rows, shape).repartition(3)


@pytest.fixture(scope="module")
def empty(awkward):
    return awkward.limit(0)


def components(rows, words, percent):
    sets = []
    for _, text in rows:
        w = SPACE_WORDS.findall((text or "").translate(ASCII_LOWER))
        sets.append({tuple(w[i : i + words]) for i in range(max(len(w) - words + 1, 1 if w else 0))})
    label = list(range(len(rows)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
            label[find(j)] = find(i)
    out = []
    for i, (doc, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((doc, len(sets[i]), min(ids) if sets[i] and ids else doc))
    return sorted(out, key=str)


@pytest.mark.parametrize("words,percent,sizes", [(3, 90, {}), (5, 80, {}), (3, 60, {"list_rows": 2, "group_words": 400, "sketch_bits": 6})])
def test_jaccard_components(awkward, words, percent, sizes):
    rows = [(r.doc_id, r.text) for r in awkward.select("doc_id", "text").collect()]
    got = ngram_join.jaccard_components(awkward, words=words, percent=percent, **sizes).collect()
    assert sorted(map(tuple, got), key=str) == components(rows, words, percent)


def test_jaccard_clump_in_blocks(spark):
    """A clump of near copies, dealt to tasks as pairs of blocks, keeps every link."""
    base, rng, rows = prose(5, 60, 9999).split(), np.random.default_rng(3), []
    for i in range(60):
        own = list(base)
        for at in rng.integers(0, 60, 1 + i % 3):
            own[at] = f"edit{i}_{at}"
        rows.append((i, " ".join(own)))
    got = ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id bigint, text string"), words=3, percent=80, list_rows=8, group_words=2000)
    assert sorted(map(tuple, got.collect()), key=str) == components(rows, 3, 80)


def test_jaccard_empty(empty):
    assert ngram_join.jaccard_components(empty).collect() == []


def test_url_filter(spark):
    urls = [
        None, "", "no scheme", "http://net", "http://a.net/", "HTTP://WWW.Example.NET/en/x?q=1", "https://example.net/en", "https://badexample.com/de/", "http://example.com/de/a/b#c",
        "x://example.org/fr/?/en/", "http://example.org/FR/", "http://spam-farm.example.org/en/1", "http://h.example.org/a/login", "http://h.example.org/alogin", "ftp://u@host.net:80/p", "a://b://c.net/x",
        "http://example.net/en/\nx", "http://example.net/en/x", "http://example.net/en/x",
    ]
    rules = [url_filter.listed_rule(*r) for r in (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))]
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(urls)], "page_id bigint, url string, host string, token string")

    def judge(url):
        rest = url.partition("://")[2] if url and "://" in url else ""
        host = re.match(r"[^/?#]*", rest)[0].translate(ASCII_LOWER)
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        fit = [r for r in rules if (host == (h := r.name.partition("/")[0]) or host.endswith("." + h)) and path.startswith("/" + r.name.partition("/")[2])]
        if fit:
            best = max(fit, key=lambda r: len(r.name))
            return host, path, best.name, best.verdict
        return host, path, None, "block" if any(re.search(g.pattern, host + path) for g in url_filter.GENERAL) else "allow"

    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(pages, [*rules, *url_filter.GENERAL]).collect()}
    assert got == {i: judge(u) for i, u in enumerate(urls)}
    assert url_filter.filter_urls(pages.limit(0), rules).collect() == []


# ---- transducer ----


def unigram_model(pieces, byte_fallback=True):
    """A model file put together by hand: nothing is trained."""

    def varint(n):
        out = b""
        while True:
            out += bytes([n & 127 | (128 if n > 127 else 0)])
            n >>= 7
            if not n:
                return out

    def field(k, value):
        return varint(k << 3) + varint(value) if isinstance(value, int) else varint(k << 3 | 2) + varint(len(value)) + value

    def piece(text, score, kind):
        return field(1, field(1, text.encode()) + varint(2 << 3 | 5) + struct.pack("<f", score) + field(3, kind))

    out = piece("<unk>", 0, 2) + piece("<s>", 0, 3) + piece("</s>", 0, 3)
    if byte_fallback:
        out += b"".join(piece(f"<0x{i:02X}>", -50.0, 6) for i in range(256))
    out += b"".join(piece(t, s, 1) for t, s in pieces)
    return out + field(2, field(3, 1) + field(35, 1)) + field(3, field(1, b"identity") + field(3, 1) + field(4, 0) + field(5, 1))


def test_unigram_paths_are_the_librarys():
    import sentencepiece

    rng = np.random.default_rng(0)
    made = {"".join(rng.choice(list("▁abcé"), size=int(n))) for n in rng.integers(1, 5, 120)}
    made = sorted({p.lstrip("▁") and ("▁" if p.startswith("▁") else "") + p.replace("▁", "") for p in made} - {"", "▁"}) + ["▁", "a", "b", "c", "é"]
    made = list(dict.fromkeys(made))
    pieces = [(p, -1.0 - 0.37 * i - 0.011 * i * i / 7) for i, p in enumerate(made)]
    model = unigram_model(pieces)
    machine, library = transducer.Transducer(model), sentencepiece.SentencePieceProcessor(model_proto=model)
    texts = ["".join(rng.choice(list("abcé  "), size=int(n))) for n in rng.integers(0, 30, 200)]
    ids, bounds, _ = machine.encode(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == [library.encode(t) for t in texts]
    assert machine.decode(ids, bounds) == texts


def test_merge_model_paths_are_cheapest():
    with open(MODEL, "rb") as file:
        machine = transducer.Transducer(file.read())
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    cost = {library.id_to_piece(i): float(np.log(max(-library.get_score(i), 0) + 2)) for i in range(259, 32000)}

    def cheapest(text):
        best = [0.0] + [np.inf] * len(text)
        for j in range(1, len(text) + 1):
            best[j] = min([best[i] + cost[text[i:j]] for i in range(max(0, j - 16), j) if text[i:j] in cost] + [best[j - 1] + machine.fallback * len(text[j - 1].encode())])
        return best[-1]

    texts = ["hello world", "", None, "   ", "a  b\n c ", "zażółć 猫 🐈 \x00", "x" * 300, "Ünder-way, 12345!!", "supercalifragilistic"]
    ids, bounds, costs = machine.encode(pa.array(texts))
    for text, c in zip(texts, costs.tolist(), strict=True):
        assert c == pytest.approx(cheapest("▁" + text.replace(" ", "▁")) if text else 0.0)
    assert machine.decode(ids, bounds) == [t or "" for t in texts]


def test_merge_model_ids_are_the_librarys(spark, awkward):
    """The production file, through the operator that the queries use, with words short and long."""
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rng = np.random.default_rng(5)
    texts = ["hello world", "", None, "   ", "a  b\n c ", "zażółć 猫 🐈 \x00", "x" * 300, "Ünder-way, 12345!!", "supercalifragilistic", "\u2581 a\u2581b"]
    texts += ["".join(rng.choice(list("etaoinshrdlu  ß,é猫🐈0"), int(n))) for n in rng.integers(1, 400, 300)]
    texts += ["".join(rng.choice(list("etaoinshrdluab"), int(n))) for n in rng.integers(60, 400, 100)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = [r.ids for r in transducer.encode(docs, MODEL).orderBy("doc_id").collect()]
    assert got == [library.encode(t or "") for t in texts]
    assert all(r.ids == library.encode(r.text or "") for r in transducer.encode(awkward.select("text"), MODEL).collect())


def test_filtered_shortest_paths_are_the_librarys():
    """On all distinct words of a test table: shortest path behind the neighbour filter, merges by rank, and the library."""
    import os

    import duckdb
    import sentencepiece

    machine = transducer.Transducer(open(MODEL, "rb").read())
    folder = next((f for f in ("/root/testdata/sf0.1", "/root/testdata/sf0.01") if os.path.exists(f"{f}/documents.parquet")), None)
    words = [r[0] for r in duckdb.sql(f"SELECT DISTINCT unnest(string_split(text, ' ')) FROM '{folder}/documents.parquet'").fetchall()] if folder else []
    words = [w for w in words if w] + ["", "a" * 1500, "ünï" * 400, "🙂x🙂", "\u2581\u2581\u2581a", " " * 40, "x  y" + " " * 17 + "z", "\t\n  \t"]
    marked = [("\u2581" + w).replace(" ", "\u2581") for w in words]
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for at in range(0, len(words), 10_000):
        ids, bounds, cost = machine.filtered_paths(marked[at : at + 10_000])
        merged = machine.merge_paths(marked[at : at + 10_000])
        assert (ids == merged[0]).all() and (bounds == merged[1]).all() and np.allclose(cost, merged[2])
        if at == 0 or at + 10_000 >= len(words):
            got = [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            want = [library.encode(w) if w else machine.merge_paths(["\u2581"])[0].tolist() for w in words[at : at + 10_000]]
            assert got == want


def test_neighbour_filter():
    """A pair of pieces passes if merging its joined text gives it back."""
    machine = transducer.Transducer(open(MODEL, "rb").read())
    rng = np.random.default_rng(3)
    pieces = np.flatnonzero(machine.sound)
    near = np.array([i for i in pieces if len(machine.text[int(i)]) < 4])
    left, right = np.concatenate([rng.choice(pieces, 4000), rng.choice(near, 6000)]), np.concatenate([rng.choice(pieces, 4000), rng.choice(near, 6000)])
    ids, bounds, _ = machine.merge_paths([machine.text[int(a)] + machine.text[int(b)] for a, b in zip(left, right, strict=True)])
    want = np.array([ids[s:e].tolist() == [a, b] for a, b, s, e in zip(left, right, bounds[:-1], bounds[1:], strict=True)])
    assert (machine.neighbours(left, right) == want).all() and 100 < want.sum() < len(want) - 100


def test_transducer_round_trip(awkward, empty):
    out = transducer.decode(transducer.encode(awkward, MODEL), MODEL)
    assert out.where(F.col("decoded") != F.coalesce("text", F.lit(""))).count() == 0
    assert out.count() == awkward.count() and set(awkward.columns) <= set(out.columns)
    assert transducer.decode(transducer.encode(empty, MODEL), MODEL).collect() == []


# ---- substring dedup ----


def removed(rows, window):
    seen = {}
    words = [SPACE_WORDS.findall(t or "") for _, t in rows]
    for i, w in enumerate(words):
        for s in range(len(w) - window + 1):
            seen.setdefault(tuple(w[s : s + window]), []).append((i, s))
    gone = [set() for _ in rows]
    for places in seen.values():
        if len(places) > 1:
            for i, s in places:
                gone[i].update(range(s, s + window))
    return sorted([(d, len(w), len(g), " ".join(x for k, x in enumerate(w) if k not in g)) for (d, _), w, g in zip(rows, words, gone, strict=True)], key=str)


@pytest.mark.parametrize("window,sizes", [(35, {}), (12, {"gram": 3}), (35, {"group_rows": 2})])
def test_substring_dedup(awkward, window, sizes):
    rows = [(r.doc_id, r.text) for r in awkward.select("doc_id", "text").collect()]
    got = substring_dedup.remove_repeats(awkward, window=window, **sizes)
    assert set(awkward.columns) | {"n_removed"} <= set(got.columns)
    assert sorted([(r.doc_id, r.n_words, r.n_removed, r.kept) for r in got.collect()], key=str) == removed(rows, window)


def test_substring_dedup_empty(empty):
    assert substring_dedup.remove_repeats(empty).collect() == []


# ---- secrets ----


def test_secret_scan(spark):
    rng = np.random.default_rng(1)
    hexes = lambda n: "".join(rng.choice(list("0123456789abcdef"), n))
    keys = lambda n: "".join(rng.choice(list("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"), n))
    rows, held_out = [], []
    for i in range(160):
        secret = [f'token = "{hexes(40)}"', f"password={hexes(18)}", f"AKIA{keys(16)}"][i % 3]
        (rows if i < 120 else held_out).append((2 * i, f"some words here {secret} and more words", 1))
        (rows if i < 120 else held_out).append((2 * i + 1, f"thationmentandthewith wereforfromhave {prose(i, 30)} number 4539578763621486{i:03d}", 0))
    rows += [(None, None, 0), (None, "", 0)]
    docs = spark.createDataFrame([(i, t, "src", len(t or "")) for i, t, _ in rows + held_out], "doc_id bigint, text string, source string, n_chars bigint")
    got = {r.doc_id: r for r in secret_scan.scan(docs).collect()}
    assert sum((len(got[i].secrets) > 0) == bool(y) for i, _, y in held_out) >= 0.95 * len(held_out)
    for i, text, y in rows:
        if y and got[i].secrets:
            s = got[i].secrets[0]
            assert re.fullmatch(secret_scan.CANDIDATE, text[s.start : s.end])
    clean = secret_scan.redact(docs).collect()
    assert len(clean) == len(rows + held_out) and not any(re.search("AKIA[A-Z2-7]{16}", r.text or "") for r in clean)
    assert all(r.n_chars == len(r.text or "") for r in clean)
    assert secret_scan.scan(docs.limit(0)).collect() == []


# ---- token output ----


def test_token_output(spark, awkward, empty, tmp_path):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    more = spark.createDataFrame([(100 + i, t) for i, t in enumerate(["a  b", " a", "a ", "x\u00a0 y \u2003z \u3000 q", "it's  <|endoftext|> ok", "1 2\t 3\n\n 4", "\u0085 x \x1c y"])], "doc_id bigint, text string")
    docs = awkward.select("doc_id", "text").unionByName(more)
    token_output.write_tokens(docs, str(tmp_path / "t"), path)
    files = token_output.read_tokens(spark, str(tmp_path / "t"))
    got = token_output.with_crc(files).orderBy("start").collect()
    want = {}
    for r in docs.collect():
        ids = [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 2]
        want.setdefault(r.doc_id, []).append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    seen, at = {}, 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
        seen.setdefault(r.doc_id, []).append((r.n_tokens, r.ids_crc32))
    assert {k: sorted(v) for k, v in seen.items()} == {k: sorted(v) for k, v in want.items()}
    assert [r.doc_id for r in got] == sorted([r.doc_id for r in got], key=lambda x: -1 if x is None else x)
    token_output.write_tokens(empty, str(tmp_path / "e"), path)
    assert token_output.read_tokens(spark, str(tmp_path / "e")).collect() == []


def test_token_output_special_tokens(spark, tmp_path):
    """The query's encoding is the library's default: the name of a special token in a text is that token."""
    from tokenizers import Tokenizer

    from rubrica.llm.queries import op6

    end = "<|endoftext|>"
    texts = [f"a{end}b", end, f"{end}{end}", f"x  {end}  y", f"it'{end}s {end}'s\n{end}\n", f"<|endof{end}text|>", "<|endof", "text|> z", f"é{end}é 1{end}2 {end[:-1]}", "plain", "", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = [[*tokenizer.encode(t or "", add_special_tokens=False).ids, 2] for t in texts]
    assert want[0] == [64, 50256, 65, 2]
    got = sorted(op6(spark, str(tmp_path)).collect(), key=lambda r: r.doc_id)
    assert [(r.n_tokens, r.ids_crc32) for r in got] == [(len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for x in want]
    assert [r.start for r in got] == np.cumsum([0, *map(len, want)])[:-1].tolist()


# ---- personal data ----


def brute_spans(text):
    text, out = text or "", []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in re.sub("[^0-9]", "", m[0])][::-1]
        if 13 <= len(d) <= 19 and sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(d)) % 10 == 0:
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append(("phone", *m.span()))
    return out


def test_personal_spans(spark, awkward):
    texts = [
        "mail a.b@c.de, x@y and _q%z@s-t.u.vw. a@b@c.d a@b..c z@1.2.3.4", "a@b.c_x@d.e a@b.c.@f.g", "ip 1.2.3.4.5.6.7.8 256.1.1.1 0255.0.0.01 1.2.3", "é🙂 10.0.0.1 é", "card 4539 5787 6362 1486, 4539-5787-6362-1486 4539578763621486 453957876362148",
        "4539  5787 63621486 1 2 3 4", "+1 (555) 010-9999 +12 +49 30 1234567890123456 ++44 20 7946 0958", "1 " * 30_000, "a." * 30_000 + "@" + "b." * 30_000 + "c", "7" * 40_000, "\ue000\ue001 a\ue001b@c.d 1\ue0002", "+1" + " " * 20_000, None, "",
    ]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string").unionByName(awkward.select(F.col("doc_id") + 100, "text").toDF("doc_id", "text"))
    want = sorted([(r.doc_id, ",".join(f"{k}:{a}:{b}" for k, a, b in brute_spans(r.text))) for r in docs.collect()], key=str)
    got = personal_data.personal_spans(docs).select("doc", personal_data.span_text(personal_data.KINDS).alias("s")).collect()
    assert sorted(map(tuple, got), key=str) == want


def test_disclosing_terms(spark):
    """A word that stands by one address in several contexts, and nowhere else, tells who it is."""
    rows = [(i, f"{prose(i, 12, 900)} {"abcdef"[i] * 5} written by Zanzibarov x{i} boss@corp.example and {prose(i + 50, 9, 900)}") for i in range(6)]
    rows += [(10 + i, f"{chr(97 + i % 26) * 6} written by someone here a{i}@corp.example {prose(i + 90, 9, 900)}") for i in range(30)]
    rows += [(50, rows[20][1]), (51, rows[20][1]), (52, rows[20][1]), (53, None)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id bigint, text string, term string")
    got = {r.doc: [(s.start, s.end) for s in r.term] for r in personal_data.personal_spans(docs).collect()}
    for i, text in rows[:6]:
        at = text.index("Zanzibarov")
        assert got[i] == [(at, at + len("Zanzibarov"))]
    assert not any(got[i] for i, _ in rows[6:])
    clean = {r.doc_id: r.text for r in personal_data.sanitise(docs).collect()}
    assert "Zanzibarov" not in clean[0] and "[EMAIL]" in clean[0] and clean[53] is None and clean[10].count("[EMAIL]") == 1
    assert personal_data.personal_spans(docs.limit(0)).collect() == []


def test_disclosing_terms_of_rare_entities(spark):
    """An address in two texts, and one in a single text: names far from it, short ones, and in a text without it."""
    far = " common words between" * 10
    rows = [(0, f"Quillfeather and Bo{far} rare@corp.example"), (1, f"rare@corp.example{far} QUILLFEATHER, Bo"), (2, f"about Quillfeather{far}"), (3, f"Once Zanzibarov{far} once@corp.example"), (4, None)]
    rows += [(10 + i, f"common words between once and {'' if i % 2 else 'then '}{i}") for i in range(1500)]
    got = {r.doc: [rows[r.doc][1][s.start : s.end] for s in r.term] for r in personal_data.personal_spans(spark.createDataFrame(rows, "doc_id bigint, text string")).where("doc < 10").collect()}
    assert got == {0: ["Quillfeather", "Bo"], 1: ["QUILLFEATHER", "Bo"], 2: ["Quillfeather"], 3: ["Zanzibarov"], 4: []}


def brute_terms(rows, bar=personal_data.BAR, z=personal_data.Z):
    """Disclosing names by their definition: ``{(row, (start, end))}``."""
    import regex

    texts = sorted({t or "" for _, t in rows})
    own = {}
    for t in texts:
        blank, found = t, set()
        for kind, a, b in brute_spans(t):
            found.add(f"{kind}:{t[a:b].lower()}")
        for kind in personal_data.KINDS:
            for k, a, b in brute_spans(t):
                if k == kind:
                    blank = blank[:a] + " " * (b - a) + blank[b:]
        own[t] = (found, blank)
    plain = {t: re.sub(r"\S*@\S*", " ", t) for t in texts}
    names = {w.lower() for t in plain.values() for w in regex.findall(r"(?<=[\p{L}\p{N},;] )\p{Lu}\p{Ll}+(?!\p{L})", t)}
    names &= {w.lower() for found, blank in own.values() if found for w in regex.findall(r"(?<!\p{L})\p{Lu}\p{L}+", blank)}
    words = {t: regex.findall(r"\p{L}{2,}", plain[t]) for t in texts}
    names -= {w for t in texts for w in words[t] if w == w.lower()}
    capital = {t: {w.lower() for w in regex.findall(r"(?<!\p{L})\p{Lu}\p{L}+", blank)} for t, (_, blank) in own.items()}
    told = set()
    for name in names:
        having = [t for t in texts if any(w.lower() == name for w in words[t])]
        n = len(having)
        for e in {e for t in having for e in own[t][0]}:
            p = sum(e in own[t][0] and name in capital[t] for t in having) / n
            if (p + z * z / (2 * n) - z * (p * (1 - p) / n + z * z / (4 * n * n)) ** 0.5) / (1 + z * z / n) >= bar:
                told.add(name)
    out = set()
    for i, (_, t) in enumerate(rows):
        base = brute_spans(t)
        for m in regex.finditer(r"(?<!\p{L})\p{Lu}\p{L}+", t or ""):
            if m[0].lower() in told and not any(a < m.end() and m.start() < b for _, a, b in base):
                out.add((i, m.span()))
    return out


def test_disclosing_names_by_definition(spark):
    """Names that recur with and without their entities, copies, names also in lower case, and a long text of many names."""
    rng = np.random.default_rng(4)
    people = [f"{a}{b}" for a in ("Abel", "Bora", "Cyra", "Dina") for b in ("son", "ville", "mark", "stein")]
    mails = [f"{p.lower()}@corp.example" for p in people]
    rows = []
    for i in range(120):
        k = int(rng.integers(0, len(people)))
        said = [f"with {people[k]}"] + [mails[k]] * bool(rng.random() < 0.7) + [f"and {people[int(rng.integers(0, 16))]}, too"] * bool(rng.random() < 0.3)
        rows.append((i, f"{prose(i, 5, 900)} {' '.join(rng.permutation(said))} {prose(i + 500, 6, 900)} Nr {i % 40}"))
    rows += [(200 + i, rows[i][1]) for i in range(10)] + [(300, "so abelson was low"), (301, None), (302, ""), (303, "SHOUTED ABELSON AND CYRAMARK")]
    rows += [(304, " ".join(f"by N{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}x," for i in range(1500)) + " long@corp.example"), (305, "Én Ünïçode was Here, 10.1.2.3 and Éluard again.")]
    docs = spark.createDataFrame([(i, t, 5, "w") for i, t in enumerate(t for _, t in rows)], "doc_id bigint, text string, entities int, words string").repartition(3)
    found = personal_data.personal_spans(docs).collect()
    got = {(r.doc, (s.start, s.end)) for r in found for s in r.term}
    assert got == brute_terms(rows)
    assert len({i for i, _ in got}) > 60 and sum(i == len(rows) - 2 for i, _ in got) == 1500


def test_capital_words(spark):
    texts = ["", "a", "Ab", "Zé Ab cD aEf 1Gh X " * 400, "É Éa🙂Éb"]
    df = spark.createDataFrame([(t,) for t in texts], "text string").select("text", personal_data.capital_words(F.col("text")).alias("w"))
    for r in df.collect():
        want = [m.span() for m in re.finditer(r"(?<![^\W\d_])[A-ZÉ][^\W\d_]+", r.text)]
        assert [(w.start, w.end) for w in r.w] == want


# ---- decontamination ----


def contaminated(docs, items, n=10):
    words = lambda t: LETTER_WORDS.findall((t or "").translate(ASCII_LOWER))
    windows = {}
    for item, text in items:
        w = words(text)
        for i in range(max(len(w) - n + 1, 1 if w else 0)):
            windows.setdefault(tuple(w[i : i + n]), set()).add(item)
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for size in {len(x) for x in windows}:
            for i in range(len(w) - size + 1):
                if (own := windows.get(tuple(w[i : i + size]))) is not None:
                    hit.update(range(i, i + size))
                    found |= own
        out.append((doc, len(w), len(hit), sorted(str(x) for x in found if x is not None)))
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [2_000_000, 7])
def test_decontamination(spark, awkward, block):
    w = prose(1, 150, 5000).split()
    items = [(1, " ".join(w[10:22]).upper()), (2, "; ".join(w[15:40])), (3, "one"), (4, "two three"), (5, None), (6, " - "), (7, "never seen words at all in any of these texts here"), (8, " ".join(w[10:22])), (None, "ünï çödé ünï çödé")]
    table = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id bigint, text string, hash string")
    rows = [(r.doc_id, r.text) for r in awkward.select("doc_id", "text").collect()]
    got = decontamination.contamination(awkward, table, block_windows=block)
    out = got.select("doc_id", "n_words", decontamination.hit_words().cast("int"), "items").collect()
    assert sorted([(r[0], r[1], r[2], r[3]) for r in out], key=str) == contaminated(rows, items)
    clean = decontamination.decontaminate(awkward.drop("n_words"), table, remove="span", block_windows=block)
    assert clean.count() == len(rows)
    left = contaminated([(r.doc_id, r.text) for r in clean.collect()], [(i, t) for i, t in items if t and len(t) > 60])
    assert not any(r[2] for r in left if r[0] in (0, 1))
    kept = decontamination.decontaminate(awkward.drop("n_words"), table, block_windows=block)
    assert sorted([r.doc_id for r in kept.collect()], key=str) == sorted([d for d, _, n, _ in contaminated(rows, items) if not n], key=str)


def test_decontamination_empty(spark, awkward, empty):
    items = spark.createDataFrame([(1, "one two")], "item_id bigint, text string")
    assert decontamination.contamination(empty, items).collect() == []
    none = decontamination.contamination(awkward, items.limit(0))
    assert none.where(F.size("hit_from") > 0).count() == 0 and none.count() == awkward.count()


# ---- quality ----


def test_quality(spark, awkward, empty):
    texts = ["x y\nx y\n\n \nx  y\nx y", "# * a|b <c> 100% $&", prose(7, 40, 3) * 3, "\n".join(["line one"] * 5), "日本語 の テキスト です " * 10, "".join(map(chr, range(0x1400, 0x1500)))]
    docs = awkward.select("doc_id", "text", "lang").unionByName(spark.createDataFrame([(200 + i, t, "ja") for i, t in enumerate(texts)], "doc_id bigint, text string, lang string"))
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)

    def brute(r):
        text = r.text or ""
        w = SPACE_WORDS.findall(text)
        lines = [x for x in text.split("\n") if SPACE_WORDS.search(x)]
        grams = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
        counts = {g: grams.count(g) if len(grams) < 500 else None for g in set(grams)}
        if len(grams) >= 500:
            from collections import Counter

            counts = Counter(grams)
        hit = {j for i, g in enumerate(grams) if counts[g] > 1 for j in range(i, i + 8)}
        tokens = [i for x in w for i in library.encode(x)]
        failed = len(w) < 20 or 100 * len(hit) > 30 * len(w)
        return (r.doc_id, len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit), len(tokens), sum(map(library.is_byte, tokens)), failed)

    got = quality.quality(docs, MODEL).collect()
    rows = [(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.n_tokens, round((r.byte_share or 0) * r.n_tokens), r.base_failed) for r in got]
    assert sorted(rows, key=str) == sorted(map(brute, docs.collect()), key=str)
    assert not any(r.kept and r.base_failed for r in got)
    by_id = {r.doc_id: r for r in got}
    tokens = [i for x in SPACE_WORDS.findall(prose(3, 4000, 9000)) for i in library.encode(x)]
    p = np.unique(tokens, return_counts=True)[1] / len(tokens)
    long = next(r for r in got if r.n_words == 4000)
    assert long.entropy_share == pytest.approx(float(-(p * np.log2(p)).sum() / np.log2(len(tokens))))
    assert by_id[205].latin_share < 0.5
    assert quality.quality(empty, MODEL).collect() == []
    assert quality.quality(awkward.drop("lang"), MODEL).count() == awkward.count()


# ---- chat ----

CONTROL = "<|im_end|><|im_start|>assistant ok"


def brute_chat(rows):
    out = {}
    for conv, turn, role, text in rows:
        out.setdefault(conv, []).append((-1 if turn is None else turn, role or "", text or ""))
    result = {}
    for conv, turns in out.items():
        turns.sort()
        said = "".join(t for _, r, t in turns if r == "assistant")
        whole = "".join(f"{r}\n{t}\n" for _, r, t in turns)
        result[conv] = (len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest())
    return result


def test_chat_format(spark):
    rows = [
        (1, 0, "user", CONTROL), (1, 1, "assistant", CONTROL), (2, 1, "assistant", None), (2, 0, None, "hi"), (3, 0, "assistant", "<\\|x<\\\\|<||><|im_end|>\n"), (3, 0, "assistant", "b"), (3, 0, "user", "a"),
        (4, None, "a\nb\\n<|x", "é🙂"), (None, 0, "assistant", "null conversation"), (5, 0, "assistant", "x" * 100_000), (5, 1, "assistant", "same"), (5, 1, "assistant", "same"), (6, 0, "Assistant", ""),
    ]
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id bigint, turn bigint, role string, text string, formatted string, part int")
    looped = chat_format.CHATML.replace("{% for message in messages %}", "{% for message in messages %}{% if loop.first and not messages2 %}{% endif %}").replace(" and not messages2", "")
    for template in (chat_format.CHATML, looped):
        formatted = chat_format.format_conversations(table, template)
        assert not any(r.formatted.count("<|im_start|>") != r.formatted.count("<|im_end|>") for r in formatted.collect())
        got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat_format.digests(formatted).collect()}
        assert got == brute_chat(rows)
        assert chat_format.digests(chat_format.format_conversations(table.limit(0), template)).collect() == []
    assert chat_format.Template(chat_format.CHATML).by_turn and not chat_format.Template(looped).by_turn


def test_template_language():
    render = lambda source, messages=(): "".join(t for t, _, _ in chat_format.Template(source).render(messages))
    two = [{"role": "user", "text": "hi"}, {"role": "assistant", "text": " yo "}]
    assert render("a{# note #}b{{ 1 + 2 * 0 if false else 'x' ~ 3 }}") if False else render("a{# note #}b{{ 'x' ~ 3 }}") == "abx3"
    assert render("{% for m in messages %}{{ loop.index }}{{ m['role']|upper }}{% if loop.last %}!{% elif m.text == 'hi' %}?{% else %}-{% endif %}{% endfor %}", two) == "1USER?2ASSISTANT!"
    assert render("{%- set x = 'a' -%}  {{ x }}  {%- if x in 'abc' and not (1 > 2 or x == 'b') -%} ok {%- endif %}") == "aok"
    assert chat_format.Template("{{ 1 + 2 }}{% if 1 == 1 %}y{% else %}n{% endif %}").nodes == [("text", "3y")]
    parts = list(chat_format.Template("{% for m in messages %}{{ m.role }}:{% generation %}{{ m.text|trim }}{% endgeneration %};{% endfor %}end").render(two))
    assert parts == [("user:hi;", [5], [7]), ("assistant:yo;", [10], [12]), ("end", [], [])]
    for bad in ("{{ f() }}", "{{ x.__class__ }}", "{% if x %}", "{{ 1 | eval }}", "{% import os %}", "{{ }}"):
        with pytest.raises(chat_format.TemplateError):
            render(bad)
    for text in ("<|", "<\\|", "<\\\\|x", "a<|b|>", CONTROL):
        assert chat_format.unescape(chat_format.escape(text)) == text and "<|" not in chat_format.escape(text)


def test_quality_bands_reject(spark):
    """Documents that pass the base rules and differ in fertility only: a band of the language and length decides."""
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rng = np.random.default_rng(3)
    few = " ".join(rng.choice("this text says over and again one of some few words".split(), 400))
    pieces = (library.id_to_piece(i) for i in range(library.vocab_size()))
    many = " ".join(rng.choice([p[1:] for p in pieces if re.fullmatch("▁[a-z]{4,6}", p)], 400))
    odd = " ".join("".join(rng.choice(list("bcdfghjklmnpqrstvwxz"), 7)) for _ in range(400))
    docs = spark.createDataFrame([(i, t, lang) for lang in ("en", "fr", "de", "es", None) for i, t in enumerate([few, many, odd])], "doc_id bigint, text string, lang string")
    got = quality.quality(docs, MODEL).collect()
    assert not any(r.base_failed for r in got)
    assert {(r.doc_id, r.kept) for r in got} == {(0, False), (1, True), (2, False)}
    # The same entropy share is low for a short document and usual for a long one.
    kept = quality.quality(spark.createDataFrame([(0, few, "en")], "doc_id bigint, text string, lang string"), MODEL, bands={"en": (0.0, 8.0, 0.1, (0.9,) + (0.1,) * 8)}).collect()
    assert kept[0].kept
