"""Ranked lexical search: accumulator-limited term-at-a-time scoring over blocks of postings.

Documents are read once and stored as index blocks: for the words of the queries, which
documents of the block hold them and how often.  Document frequencies and lengths come from
columns of the blocks alone.  Then every block is searched for every query:

* the query's terms are taken rarest first; each adds its scores to the accumulators of the
  documents in its list, and makes new ones;
* before each term, the best that the remaining terms can add (their highest scores in this
  block) is held against the k-th partial score so far, of this block or of the blocks that
  the task searched before.  Once it is lower, a document without an accumulator can no
  longer come among the k best, and no more are made;
* the remaining terms only update the survivors, exactly.

Tasks return their k best of each query, which are merged in two steps, so no task meets
more than a share of the others' results.

Queries are read in blocks of at most ``BLOCK_WORDS`` words, each searched against all
documents; the driver holds one block of queries and one number for each of its terms.
Terms are told apart by 64-bit hashes.

    w(t) = floor(1000 ln((2N + 2) / (2 df + 1)))         m(d) = 25 + (75 n N) div L
    score = sum of w(t) ((10^9 tf) div (1000 tf + 8 m)) over the query's terms with repeats

Defined results: every row is a document or a query of its own, also with a repeated id;
equal scores go by ascending ``doc_id`` (cast to bigint), null ids last; only scores above 0
are returned; null texts and texts without words match nothing; an empty table of either
kind gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch_path
from .words import Hasher, distinct, letter_words, slices

K1000, B100, UNIT = 1000, 75, 10**9
BLOCK_WORDS = 1 << 20  # words of one block of queries
BLOCK_POSTINGS = 1 << 20  # postings after which an index block is closed
SALTS = 64


class Queries:
    """One block of queries: ids, and ``terms[bounds[q]:bounds[q + 1]]`` with ``repeats`` as places in the sorted ``hashes``."""

    def __init__(self, rows: list[tuple]):
        words = Hasher(letter_words(), lower=True).read(pa.array([text for _, text in rows], pa.string()))
        self.ids = [i for i, _ in rows]
        self.hashes = distinct(words.hash)
        row = np.repeat(np.arange(words.rows), words.counts)
        size = max(len(self.hashes), 1)
        own, self.repeats = np.unique(row * size + np.searchsorted(self.hashes, words.hash), return_counts=True)
        self.terms = own % size
        self.bounds = np.searchsorted(own, np.arange(words.rows + 1) * size)


def query_blocks(items: DataFrame, key: str, text: str, words: int) -> Iterator[Queries]:
    """Queries in blocks of at most ``words`` words (a longer query is one of its own), one block at a time on the driver."""
    held, size = [], 0
    for row in items.select(F.col(f"`{key}`"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))).toLocalIterator():
        more = len(row[1]) // 2 + 1  # words have a separator each
        if held and size + more > words:
            yield Queries(held)
            held, size = [], 0
        held.append((row[0], row[1]))
        size += more
    if held:
        yield Queries(held)


INDEX = "ids array<bigint>, lengths array<bigint>, terms array<int>, counts array<int>, docs array<int>, tf array<int>"


def index_blocks(docs: DataFrame, key: str, text: str, hashes: np.ndarray, postings: int = BLOCK_POSTINGS) -> DataFrame:
    """One row a block: ``ids`` and ``lengths`` of its documents, and for each of ``terms`` its ``counts`` places in ``docs`` and ``tf``."""

    def block(ids: list, lengths: list, found: list) -> pa.RecordBatch:
        doc, term, tf = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((doc, term))
        doc, term, tf = doc[order], term[order], tf[order]
        first = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]])) if len(term) else np.zeros(0, np.int64)
        columns = [
            pa.concat_arrays(ids), pa.array(np.concatenate(lengths), pa.int64()), pa.array(term[first], pa.int32()),
            pa.array(np.diff(np.append(first, len(term))), pa.int32()), pa.array(doc, pa.int32()), pa.array(tf, pa.int32()),
        ]
        one = [pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in columns]
        return pa.RecordBatch.from_arrays(one, ["ids", "lengths", "terms", "counts", "docs", "tf"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(letter_words(), lower=True)
        ids, lengths, found, rows, size = [], [], [], 0, 0
        for batch in slices(batches, "text"):
            words = hasher.read(batch.column(1))
            at = np.minimum(np.searchsorted(hashes, words.hash), len(hashes) - 1)
            hit = np.flatnonzero(hashes[at] == words.hash)
            row = np.repeat(np.arange(words.rows), words.counts)[hit]
            own, tf = np.unique(row * len(hashes) + at[hit], return_counts=True)
            ids.append(batch.column(0))
            lengths.append(words.counts)
            found.append((own // len(hashes) + rows, own % len(hashes), tf))
            rows, size = rows + words.rows, size + len(own)
            if size >= postings:
                yield block(ids, lengths, found)
                ids, lengths, found, rows, size = [], [], [], 0, 0
        if ids:
            yield block(ids, lengths, found)

    rows = docs.select(F.col(f"`{key}`").cast("bigint").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    return rows.mapInArrow(run, INDEX)


def statistics(index: DataFrame, terms: int) -> tuple[int, int, np.ndarray]:
    """``(N, L, df)``: documents with a word, words of all documents, and documents that hold each term."""
    long = lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda s, x: s + x)
    n, total = index.agg(F.sum(F.size(F.filter("lengths", lambda x: x > 0))), F.sum(long("lengths"))).first()
    pairs = index.select(F.explode(F.arrays_zip("terms", "counts")).alias("p")).groupBy("p.terms").agg(F.sum("p.counts").alias("n"))
    df = np.zeros(terms, np.int64)
    for r in pairs.collect():  # one row a term of this block of queries
        df[r["terms"]] = r["n"]
    return n or 0, total or 0, df


class Block:
    """Postings of one index block with their scores, before the weight of the term."""

    def __init__(self, block: pa.RecordBatch, documents: int, words: int):
        column = lambda name: block.column(block.schema.get_field_index(name)).flatten()
        self.ids, lengths = column("ids"), column("lengths").to_numpy()
        terms, counts = column("terms").to_numpy(), column("counts").to_numpy()
        self.docs, tf = column("docs").to_numpy(), column("tf").to_numpy().astype(np.int64)
        self.size = len(lengths)
        if B100 * int(lengths.max(initial=0)) * documents < 2**63:
            m = (100 - B100) + (B100 * documents * lengths) // max(words, 1)
        else:
            m = np.array([(100 - B100) + B100 * documents * x // words for x in lengths.tolist()], np.int64)
        self.scores = (UNIT * tf) // (K1000 * tf + 8 * m[self.docs])
        ends = np.cumsum(counts)
        self.place = {t: (int(e - c), int(e)) for t, c, e in zip(terms.tolist(), counts.tolist(), ends.tolist(), strict=True)}
        self.most = dict(zip(terms.tolist(), np.maximum.reduceat(self.scores, ends - counts).tolist() if len(terms) else [], strict=True))


def best_of(block: Block, terms: list[tuple[int, int]], k: int, floor: int, found: np.ndarray) -> np.ndarray:
    """Documents of the block that may be among the k best, scored exactly in ``found``.

    ``terms`` are ``(term, weight)``, rarest first; ``floor`` is a k-th score known before.
    """
    found[:] = 0
    terms = [(t, w) for t, w in terms if w > 0 and t in block.place]
    left = sum(w * block.most[t] for t, w in terms)
    done = n = 0
    for t, w in terms:
        # What has been added bounds every partial score, so the k-th is only looked up when it may suffice.
        if left < floor:
            break
        if left < done and block.size >= k and left < np.partition(found, -k)[-k]:
            break
        a, b = block.place[t]
        found[block.docs[a:b]] += w * block.scores[a:b]
        bound = w * block.most[t]
        left, done, n = left - bound, done + bound, n + 1
    alive = np.flatnonzero(found)
    if not len(alive):
        return alive
    for t, w in terms[n:]:
        a, b = block.place[t]
        docs = block.docs[a:b]
        at = np.minimum(np.searchsorted(docs, alive), b - a - 1)
        same = docs[at] == alive
        found[alive[same]] += w * block.scores[a:b][at[same]]
    if len(alive) > k:
        scores = found[alive]
        alive = alive[scores >= max(np.partition(scores, -k)[-k], floor)]
    return alive[found[alive] >= floor]


def search_blocks(index: DataFrame, queries: Queries, documents: int, words: int, df: np.ndarray, k: int) -> DataFrame:
    """``(query, salt, doc_id, score)``: the k best of every task for each query, by place of the query in its block."""
    weights = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)
    plans = []
    for q in range(len(queries.ids)):
        own = slice(queries.bounds[q], queries.bounds[q + 1])
        terms, repeats = queries.terms[own], queries.repeats[own]
        order = np.lexsort((terms, df[terms]))
        plans.append(list(zip(terms[order].tolist(), (weights[terms] * repeats)[order].tolist(), strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [(np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64))] * len(plans)
        for batch in batches:
            for i in range(batch.num_rows):
                block = Block(batch.slice(i, 1), documents, words)
                ids, none = block.ids.fill_null(0).to_numpy(), block.ids.is_null().to_numpy(zero_copy_only=False)
                found = np.zeros(block.size, np.int64)
                for q, terms in enumerate(plans):
                    scores, missing, names = best[q]
                    docs = best_of(block, terms, k, int(scores[-1]) if len(scores) == k else 1, found)
                    if len(docs):
                        scores = np.concatenate([scores, found[docs]])
                        missing, names = np.concatenate([missing, none[docs]]), np.concatenate([names, ids[docs]])
                        top = np.lexsort((names, missing, -scores))[:k]
                        best[q] = scores[top], missing[top], names[top]
        salt = TaskContext.get().partitionId() % SALTS
        sizes = [len(scores) for scores, _, _ in best]
        if sum(sizes):
            scores, missing, names = (np.concatenate(x) for x in zip(*best, strict=True))
            columns = [
                pa.array(np.repeat(np.arange(len(plans)), sizes), pa.int32()), pa.array(np.full(len(scores), salt), pa.int32()),
                pa.array(names, pa.int64(), mask=missing), pa.array(scores),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["query", "salt", "doc_id", "score"])

    return index.mapInArrow(run, "query int, salt int, doc_id bigint, score bigint")


def merged(found: DataFrame, k: int) -> DataFrame:
    """``(query, rank, doc_id, score)``: the k best of each query, first within a salt."""
    order = (F.desc("score"), F.asc_nulls_last("doc_id"))
    some = found.withColumn("rank", F.row_number().over(Window.partitionBy("query", "salt").orderBy(*order))).where(F.col("rank") <= k)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order))).where(F.col("rank") <= k).drop("salt")


def search(
    docs: DataFrame, items: DataFrame, k: int = 10, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", block_words: int = BLOCK_WORDS
) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the k best documents of every row of ``items``."""
    spark: SparkSession = docs.sparkSession
    kind = dict(items.dtypes)[item_id]
    out = None
    for queries in query_blocks(items, item_id, item_text, block_words):
        if not len(queries.hashes):
            continue
        path = scratch_path(spark, "search-index")
        index_blocks(docs, doc_id, text, queries.hashes).write.parquet(path)
        index = spark.read.parquet(path)
        documents, words, df = statistics(index, len(queries.hashes))
        names = spark.createDataFrame(list(enumerate(queries.ids)), f"query int, item_id {kind}")
        found = merged(search_blocks(index, queries, documents, words, df, k), k)
        found = found.join(F.broadcast(names), "query").select("item_id", "rank", "doc_id", "score")
        out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], f"item_id {kind}, rank int, doc_id bigint, score bigint")
