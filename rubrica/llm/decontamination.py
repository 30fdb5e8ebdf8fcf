"""Benchmark decontamination by a broadcast set of normalised test n-grams.

The test items give their word n-grams (lower case A-Z, ASCII marks are
separators).  Their 64-bit hashes are broadcast in blocks of at most
``block_windows`` rows each, a bound that does not grow with the benchmark: a
larger benchmark makes more blocks, each read against all documents.  Training
windows are looked up in a bitmap and a sorted table; every hit is verified word
by word.  The documents are never shuffled (with more than one block, only the
hits of a document are brought together).

Defined results: null or wordless text has no words and no hits; repeated rows
are judged one by one; an item without an id hits but is not listed; without
items nothing is hit; columns of the documents are kept, the result columns
replace columns of the same name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import bound_batches
from .words import Hasher, letter_words, lists, slices

WINDOW = 10
BLOCK_WINDOWS = 2_000_000  # about 200 MB of phrases a block at most
FOUND = "n_words bigint, hit_from array<int>, hit_to array<int>, items array<string>"


def benchmark_windows(items: DataFrame, item_id: str = "item_id", text: str = "text", n: int = WINDOW) -> DataFrame:
    """Distinct ``(item, hash, length, phrase)`` of the items; an item of fewer words is one window."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(letter_words(), lower=True)
        for batch in slices(batches, "text"):
            w = hasher.read(batch.column(1))
            hashes, first, row = w.grams(n, short=True)
            last = np.minimum(first + n, w.bounds[row + 1])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(row)),
                    pa.array(hashes.view(np.int64)),
                    pa.array((last - first).astype(np.int32)),
                    pa.array([w.phrase(a, b) for a, b in zip(first.tolist(), last.tolist(), strict=True)], pa.binary()),
                ],
                names=["item", "hash", "length", "phrase"],
            )

    rows = items.select(F.col(f"`{item_id}`").cast("string").alias("item"), F.col(f"`{text}`").cast("string").alias("text"))
    return rows.mapInArrow(read, "item string, hash bigint, length int, phrase binary").distinct()


def window_set(rows) -> dict[int, tuple]:
    """One block of test windows, ready for lookups: by length, sorted hashes, a bitmap and the items of each phrase."""
    by_length = {}
    for length in sorted({r["length"] for r in rows}):
        own = [r for r in rows if r["length"] == length]
        items: dict[tuple[int, bytes], list[str]] = {}
        for r in own:
            items.setdefault((r["hash"], bytes(r["phrase"])), []).append(r["item"])
        hashes = np.unique(np.array([r["hash"] for r in own], np.int64).view(np.uint64))
        bits = np.zeros(1 << 20, bool)
        bits[hashes & np.uint64((1 << 20) - 1)] = True
        by_length[length] = (hashes, bits, items)
    return by_length


def window_hits(words, length: int, hashes: np.ndarray, bits: np.ndarray, items: dict) -> Iterator[tuple[int, int, list[str]]]:
    """Verified ``(first word, row, items)`` of the windows of one length."""
    got, first, row = words.grams(length)
    near = np.flatnonzero(bits[got & np.uint64((1 << 20) - 1)])
    place = np.searchsorted(hashes, got[near])
    near = near[hashes[np.minimum(place, len(hashes) - 1)] == got[near]]
    for i in near.tolist():
        at = int(first[i])
        found = items.get((int(got[i].view(np.int64)), words.phrase(at, at + length)))
        if found is not None:
            yield at, int(row[i]), found


def _scan(rows: DataFrame, block, text: str) -> DataFrame:
    """Append FOUND to the rows."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, windows = Hasher(letter_words(), lower=True), block.value
        for batch in slices(batches, text):
            w = hasher.read(batch.column(batch.schema.get_field_index(text)))
            change = np.zeros(len(w.starts) + 1, np.int64)
            items: list[set[str]] = [set() for _ in range(w.rows)]
            for length, known in windows.items():
                for at, row, found in window_hits(w, length, *known):
                    change[at] += 1
                    change[at + length] -= 1
                    items[row].update(x for x in found if x is not None)
            hit = np.cumsum(change)[:-1] > 0
            edge = np.zeros(len(hit) + 1, bool)
            edge[w.bounds] = True
            begin = np.flatnonzero(hit & (edge[:-1] | ~np.concatenate([[False], hit[:-1]])))
            end = np.flatnonzero(hit & (edge[1:] | ~np.concatenate([hit[1:], [False]]))) + 1
            cut = np.searchsorted(begin, w.bounds)
            base = np.repeat(w.bounds[:-1], np.diff(cut))
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns,
                    pa.array(w.counts.astype(np.int64)),
                    lists((begin - base).astype(np.int32), cut, pa.int32()),
                    lists((end - base).astype(np.int32), cut, pa.int32()),
                    pa.array([sorted(x) for x in items], pa.list_(pa.string())),
                ],
                names=[*batch.schema.names, "n_words", "hit_from", "hit_to", "items"],
            )

    return rows.mapInArrow(scan, f"{_ddl(rows)}, {FOUND}")


def _ddl(rows: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)


def contamination(
    docs: DataFrame, items: DataFrame, text: str = "text", item_text: str = "text", item_id: str = "item_id",
    n: int = WINDOW, block_windows: int = BLOCK_WINDOWS,
) -> DataFrame:
    """The documents with ``n_words``, merged hit spans ``hit_from``/``hit_to`` (words, end exclusive) and ``items``."""
    spark = docs.sparkSession
    bound_batches(spark)
    windows = benchmark_windows(items, item_id, item_text, n)
    blocks = max(1, -(-windows.count() // block_windows))
    rows = docs.drop("n_words", "hit_from", "hit_to", "items")
    names = rows.columns
    number = "__row"

    def block(i: int):
        own = windows.where(F.pmod(F.xxhash64("hash", "item"), F.lit(blocks)) == i) if blocks > 1 else windows
        return spark.sparkContext.broadcast(window_set(own.collect()))

    if blocks == 1:
        return _scan(rows, block(0), text)
    # The content of a row names it; equal rows have equal hits.
    key = F.xxhash64(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\0")) for c in names])
    parts = [_scan(rows.withColumn(number, key).select(number, text), block(i), text).drop(text).dropDuplicates([number]) for i in range(blocks)]
    hits = parts[0]
    for part in parts[1:]:
        hits = hits.unionByName(part)
    merged = hits.groupBy(number).agg(
        F.first("n_words").alias("n_words"),
        F.sort_array(F.flatten(F.collect_list(F.arrays_zip("hit_from", "hit_to")))).alias("s"),
        F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"),
    )
    # Merge touching spans of different blocks.
    joined = F.aggregate(
        "s",
        F.array().cast("array<struct<hit_from:int,hit_to:int>>"),
        lambda done, x: F.when((F.size(done) > 0) & (F.element_at(done, -1)["hit_to"] >= x["hit_from"]),
            F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(F.struct(
                F.element_at(done, -1)["hit_from"].alias("hit_from"),
                F.greatest(F.element_at(done, -1)["hit_to"], x["hit_to"]).alias("hit_to"))))).otherwise(F.concat(done, F.array(x))),
    )
    merged = merged.withColumn("s", joined).select(
        number, "n_words", F.col("s.hit_from").alias("hit_from"), F.col("s.hit_to").alias("hit_to"), F.array_sort("items").alias("items")
    )
    return rows.withColumn(number, key).join(merged, number).drop(number)


def hit_words():
    """Number of hit words of a row of :func:`contamination`."""
    return F.aggregate(F.zip_with("hit_from", "hit_to", lambda a, b: (b - a).cast("bigint")), F.lit(0).cast("bigint"), lambda s, x: s + x)


def without_spans(df: DataFrame, text: str = "text") -> DataFrame:
    """Take the hit words, with the separators between them, out of the texts of :func:`contamination`."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(letter_words(), lower=True)
        for batch in slices(batches, text):
            at = batch.schema.get_field_index(text)
            w = hasher.read(batch.column(at), hashes=False)
            out = []
            values = batch.column(at)
            for row, (a, b) in enumerate(zip(batch.column("hit_from").to_pylist(), batch.column("hit_to").to_pylist(), strict=True)):
                if not a:
                    out.append(values[row].as_py())
                    continue
                first, pieces, last = w.bounds[row], [], w.docs[row]
                for x, y in zip(a, b, strict=True):
                    pieces.append(w.raw[last : w.starts[first + x]].tobytes())
                    last = w.ends[first + y - 1]
                out.append(b"".join([*pieces, w.raw[last : w.docs[row + 1]].tobytes()]).decode())
            columns = list(batch.columns)
            columns[at] = pa.array(out, values.type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return df.mapInArrow(cut, df.schema)


def decontaminate(docs: DataFrame, items: DataFrame, remove: str = "document", **options) -> DataFrame:
    """Documents without test material: contaminated ones go (``remove='document'``) or lose the hit words (``'span'``)."""
    found = contamination(docs, items, **options)
    if remove == "document":
        return found.where(F.size("hit_from") == 0).select(*[f"`{c}`" for c in docs.columns if c in found.columns])
    if remove != "span":
        raise ValueError("remove is 'document' or 'span'")
    return without_spans(found, options.get("text", "text")).select(*[f"`{c}`" for c in docs.columns])
