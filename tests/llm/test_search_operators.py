"""Vector codes, ranked search and fingerprints against brute force, on small and awkward tables."""

import collections
import hashlib
import math
import re

import numpy as np
import pyarrow as pa
import pytest

from rubrica.llm import fingerprints, ranked_search, vector_codes
from rubrica.llm.search_queries import op11, op12, op13
from rubrica.llm.words import Hasher, space_words

ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# ---- vector codes ----


def brute_codes(rows, parts, entries, rounds):
    kept = sorted([r for r in rows if r[2] is not None and all(x is not None and math.isfinite(x) for x in r[2])], key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    whole = [[math.floor(256 * x) for x in r[2]] for r in kept]
    span = len(whole[0]) // parts
    cut = [[tuple(v[p * span : (p + 1) * span]) for p in range(parts)] for v in whole]
    books = [[cut[i][p] for i in range(min(entries, len(cut)))] for p in range(parts)]

    def nearest(part, p):
        return min((sum((a - b) ** 2 for a, b in zip(part, e, strict=True)), i) for i, e in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            held = collections.defaultdict(list)
            for v in cut:
                held[nearest(v[p], p)[1]].append(v[p])
            books[p] = [tuple(sum(x) // len(held[i]) for x in zip(*held[i], strict=True)) if held[i] else e for i, e in enumerate(books[p])]
    out, sums = [], collections.Counter()
    for r, v in zip(kept, cut, strict=True):
        found = [nearest(v[p], p) for p in range(parts)]
        error = sum(d for d, _ in found)
        sums[r[1]] += error
        out.append((r[0], r[1], "".join(f"{i:02x}" for _, i in found), error))
    digest = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    return sorted([(k, c, e, sums[label]) for k, label, c, e in out], key=str), digest


SHAPE = "vec_id bigint, embedding array<float>, label int, key int, code string, error int"


def vector_rows(n, width, seed):
    rng = np.random.default_rng(seed)
    values = np.float32(rng.normal(size=(n, width)) * 0.3)
    return [(int(i), values[i % (n - n // 5)].tolist(), None if i % 7 == 0 else 3 if i % 3 else int(i % 5), 1, "x", 2) for i in range(n)]


@pytest.mark.parametrize("n,width,parts,entries,block", [(90, 16, 4, 8, 1 << 18), (40, 32, 16, 64, 96), (1, 16, 16, 64, 16), (30, 16, 16, 5, 16)])
def test_vector_codes(spark, monkeypatch, n, width, parts, entries, block):
    monkeypatch.setattr(vector_codes, "BLOCK_VALUES", block)
    rows = vector_rows(n, width, n)
    bad = [(1000, None), (1001, [None] * width), (1002, [float("nan")] * width), (1003, [float("inf")] * width), (None, rows[0][1]), (0, rows[0][1]), (2, [-0.001] * width), (2, [float(2**17)] * width)]
    rows += [(i, v, 9, 1, "x", 2) for i, v in bad]
    got, books = vector_codes.compress(spark.createDataFrame(rows, SHAPE).repartition(3), parts=parts, entries=entries)
    want, digest = brute_codes([(r[0], r[2], r[1]) for r in rows], parts, entries, 2)
    assert sorted([(r.key, r.code, r.error, r.label_error) for r in got.collect()], key=str) == want
    assert books.digest() == digest


def test_vector_codes_of_misfits(spark):
    """Other widths stay without a code; the width is that of the smallest key whose vector fits."""
    rows = [(0, [], 1), (1, [1.0] * 15, 1), (2, [1.0] * 16, 1), (3, [2.0] * 32, 1), (4, [3e38] * 16, None), (5, [2.0] * 16, None), (6, None, 2)]
    got, _ = vector_codes.compress(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int"))
    assert sorted([(r.key, r.code and r.code[:2], r.error, r.label_error) for r in got.collect()]) == [(0, None, None, 0), (1, None, None, 0), (2, "00", 0, 0), (3, None, None, 0), (4, None, None, 0), (5, "01", 0, 0)]
    none, _ = vector_codes.compress(spark.createDataFrame([(1, [1.0], 1)], "vec_id bigint, embedding array<float>, label int"))
    assert [tuple(r) for r in none.collect()] == [(1, 1, None, None, None)]
    empty, books = vector_codes.compress(spark.createDataFrame([], "vec_id bigint, embedding array<float>, label int"))
    assert empty.collect() == [] and books.digest() == hashlib.sha256(b"").hexdigest()


# ---- ranked search ----

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def brute_search(docs, items, k):
    terms = lambda t: [w.translate(ASCII_LOWER) for w in TERM.findall(t or "")]
    counted = [(d, collections.Counter(terms(t))) for d, t in docs]
    n = sum(bool(c) for _, c in counted)
    total = sum(sum(c.values()) for _, c in counted)
    df = collections.Counter(t for _, c in counted for t in c)
    out = []
    for item, text in items:
        scored = []
        for doc, own in counted:
            m = 25 + 75 * sum(own.values()) * n // total if total else 0
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * own[t] // (1000 * own[t] + 8 * m)) for t in terms(text) if t in own)
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc))
        out += [(item, i + 1, s[3], -s[0]) for i, s in enumerate(sorted(scored, key=lambda s: s[:3])[:k])]
    return sorted(out, key=str)


def search_tables(spark):
    rng = np.random.default_rng(5)
    word = lambda: f"W{min(int(rng.zipf(1.3)), 400)}"
    docs = [(i, " ".join(word() for _ in range(int(rng.integers(1, 60))))) for i in range(300)]
    docs += [(i, docs[7][1]) for i in range(400, 425)] + [(7, docs[7][1]), (None, docs[7][1]), (None, docs[9][1]), (500, None), (501, ""), (502, " -- "), (503, "w1 " * 50_000), (504, "Ünï w3 w3·w4_w5")]
    items = [(i, " ".join(word() for _ in range(12))) for i in range(12)]
    items += [(20, docs[7][1]), (20, docs[7][1]), (21, "w1"), (22, None), (23, ""), (24, "no such terms"), (None, "W3 W3 w3 W4"), (25, "Ünï"), (26, docs[9][1] + " " + docs[10][1])]
    shape = "doc_id bigint, text string, rank int, score int, ids int, query int, salt int"
    return docs, items, spark.createDataFrame([(i, t, 1, 2, 3, 4, 5) for i, t in docs], shape), spark.createDataFrame([(i, t, "x") for i, t in items], "item_id bigint, text string, query string")


@pytest.mark.parametrize("k,postings,block", [(10, 1 << 20, 1 << 20), (3, 200, 1 << 20), (10, 64, 30), (1, 500, 1)])
def test_ranked_search(spark, monkeypatch, k, postings, block):
    docs, items, docs_df, items_df = search_tables(spark)
    monkeypatch.setattr(ranked_search.index_blocks, "__defaults__", (postings,))
    got = ranked_search.search(docs_df.repartition(3), items_df, k, block_words=block).collect()
    assert sorted(map(tuple, got), key=str) == brute_search(docs, items, k)


def test_ranked_search_stops_making_accumulators():
    """Common terms after rare ones only update the documents that are left."""
    n = 1000
    ids, lengths = pa.array(range(n)), pa.array([10] * n)
    docs, tf = pa.array([*range(20), *range(n)], pa.int32()), pa.array([5] * 20 + [1] * n, pa.int32())
    columns = [ids, lengths, pa.array([0, 1], pa.int32()), pa.array([20, n], pa.int32()), docs, tf]
    batch = pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in columns], ["ids", "lengths", "terms", "counts", "docs", "tf"])
    block = ranked_search.Block(batch, n, 10 * n)
    found = np.zeros(n, np.int64)
    best = ranked_search.best_of(block, [(0, 4000), (1, 10)], 10, 1, found)
    assert np.count_nonzero(found) == 20 and set(best) == set(range(20))
    assert (found[:20] == 4000 * block.scores[0] + 10 * block.scores[20]).all()


def test_ranked_search_empty(spark):
    _, _, docs, items = search_tables(spark)
    assert ranked_search.search(docs.limit(0), items).collect() == []
    assert ranked_search.search(docs, items.limit(0)).collect() == []
    assert ranked_search.search(docs, items.where("item_id in (22, 23)")).collect() == []


# ---- fingerprints ----


def generalised_jaccard(a, b):
    a, b = (collections.Counter(re.findall(r"[^\x20\x09-\x0D]+", t.translate(ASCII_LOWER))) for t in (a, b))
    most = sum((a | b).values())
    return sum((a & b).values()) / most if most else 1.0


def fingerprint_rows():
    rng = np.random.default_rng(11)
    prose = lambda n, size: " ".join(f"t{min(int(x), size)}" for x in rng.zipf(1.4, n))
    rows = [(i, prose(int(rng.integers(1, 300)), 500)) for i in range(60)]
    rows += [(70, rows[3][1]), (71, rows[3][1]), (72, None), (73, ""), (74, " \n "), (75, "x"), (76, "é🙂ü 🙂"), (77, "same " * 300), (78, "SAME " * 100), (79, prose(30_000, 4000)), (80, "a" * 50_000), (3, rows[5][1]), (3, rows[5][1]), (None, rows[6][1])]
    return rows


@pytest.mark.parametrize("parts", [1, 5])
def test_fingerprints(spark, parts):
    rows = fingerprint_rows()
    held = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame([(i, t, 1, "y", 2) for i, t in rows], "doc_id bigint, text string, part int, fingerprint string, doc int").repartition(3)
        got = fingerprints.against_next(df).collect()
        again = {r.doc: r.fingerprint for r in fingerprints.fingerprints(df).collect() if r.doc is not None and r.doc != 3}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", held)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    # Only the place of the three rows with id 3 among each other is left to the hash of their texts.
    order = sorted([(i, t or "") for i, t in rows], key=lambda r: (r[0] is None, r[0] or 0))
    threes = [r for r in order if r[0] == 3]
    best = None
    for own in ([threes[0], threes[1], threes[2]], [threes[1], threes[2], threes[0]]):
        line = [*[r for r in order if r[0] is not None and r[0] < 3], *own, *[r for r in order if r[0] is None or r[0] > 3]]
        want = {}
        for (doc, text), (_, after) in zip(line, [*line[1:], line[0]], strict=True):
            edited = text[: len(text) - len(text) // 4] + after[: len(text) // 4]
            want.setdefault((doc, len(text), hashlib.sha256(edited.encode()).hexdigest()), []).append((text, edited, after))
        if collections.Counter((r.doc, r.n_chars, r.edited_sha256) for r in got) == collections.Counter({k: len(v) for k, v in want.items()}):
            best = want
    assert best is not None
    by_text, off = {}, []
    for r in got:
        text, edited, after = best[r.doc, r.n_chars, r.edited_sha256][0]
        assert by_text.setdefault(text, r.fingerprint) == r.fingerprint
        assert len(r.fingerprint) == len(r.edited_fingerprint) == 4 * fingerprints.SAMPLES
        assert again.get(r.doc, r.fingerprint) == r.fingerprint
        off += [r.near_edited - generalised_jaccard(text, edited), r.near_next - generalised_jaccard(text, after)]
        assert (r.near_edited == 1) or text != edited
    # The draws are shared by all documents, so their errors are too; the collision rate itself is tested below.
    assert np.abs(off).max() < 0.2 and abs(np.mean(off)) < 0.03


def test_fingerprint_collision_rate():
    """The share of equal samples is the generalised Jaccard similarity, also for unequal weights."""
    hasher = Hasher(space_words(), True)
    pairs = [("a " * 10 + "b", "a " * 5 + "b"), ("a b c d", "a b"), ("a " * 7 + "b " * 2 + "c", "a " * 2 + "b " * 7 + "d"), ("one two", "three four")]
    for a, b in pairs:
        x = fingerprints.codes(pa.array([a, b]), hasher, 20_000)
        assert abs((x[0] == x[1]).mean() - generalised_jaccard(a, b)) < 0.015


def test_fingerprints_of_one_or_no_row(spark):
    shape = "doc_id bigint, text string"
    assert fingerprints.against_next(spark.createDataFrame([], shape)).collect() == []
    [one] = fingerprints.against_next(spark.createDataFrame([(4, "one two three")], shape)).collect()
    assert one.near_next == 1.0 and one.edited_sha256 == hashlib.sha256(b"one two thone").hexdigest()
    [row] = fingerprints.fingerprints(spark.createDataFrame([(1, None)], shape)).select(fingerprints.likeness("fingerprint", "fingerprint").alias("x")).collect()
    assert row.x == 1.0


def test_search_queries_on_small_tables(spark, tmp_path):
    rows = [(i, t) for i, t in fingerprint_rows() if i is not None and i != 3]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, rows[0][1]), (2, "t1 t2")], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([r[:3] for r in vector_rows(30, 64, 2)], "vec_id bigint, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    assert op11(spark, str(tmp_path)).columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(map(tuple, op12(spark, str(tmp_path)).collect()), key=str) == brute_search(rows, [(1, rows[0][1]), (2, "t1 t2")], 10)
    assert op13(spark, str(tmp_path)).count() == len(rows)
