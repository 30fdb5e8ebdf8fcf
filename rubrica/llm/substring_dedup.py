"""Substring deduplication by prefix-partitioned suffix trees.

A repeat of ``window`` words is an inner node at least that deep in the suffix tree of
all texts.  The tree is cut into subtrees that fit a task:

* The variable-length prefix of a suffix runs from its start through its window's
  minimizer, the least of the hashed ``GRAM``-word runs in the window.  Equal windows
  have equal prefixes, so suffixes part by the minimizer that ends their prefix, and
  consecutive suffixes with one minimizer travel together as one short stretch of text.
* Minimizers seen once carry no repeat.  A first job finds those seen again (about one
  in fourteen word positions is a minimizer); only their stretches are shuffled.
* A prefix group above ``GROUP_ROWS`` stretches goes on to longer prefixes: its suffixes
  part by their first ``window`` words, so a part that is still large is one node.
* In a group the suffixes are sorted and their common prefixes measured.  Runs of
  neighbours that share ``window`` words or more are the deep inner nodes; each leaf
  below one is a repeat as long as its deepest node.

Map tasks pre-aggregate: a minimizer or a stretch that occurs twice in one record batch
is settled there and sent once.  Words are compared by 64-bit hashes, over every word of
a window.  Text reaches a shuffle only for documents that may hold repeats.

Defined results: words are maximal runs of other than ASCII white space; null or
wordless text has none; fewer words than a window means nothing to remove; repeated rows
are documents of their own, so their windows repeat; extra columns pass through, the
result columns replace columns of the same name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_path
from .base import bound_batches
from .ngram_join import SLOTS, _joined, runs, whole_groups
from .token_arrays import expand
from .words import Hasher, gather, lists, slices, space_words

WINDOW = 35
GRAM = 8
GROUP_ROWS = 100_000
BATCH_ROWS = 8_192
RESULTS = ("n_words", "n_removed", "kept")


def minimizers(w, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(gram hash, first word of the gram, row)`` of every window's leftmost least gram, by window.

    The window starts themselves are those of ``w.grams(window)``.
    """
    hashes, first, row = w.grams(gram)
    width = window - gram + 1
    at, reach = np.arange(len(hashes)), 1
    while reach < width and len(at):
        step = min(reach, width - reach)
        if len(at) <= step:
            return hashes[:0], first[:0], row[:0]
        left, right = at[:-step], at[step:]
        at = np.where(hashes[left] <= hashes[right], left, right)
        reach += step
    inside = row[: len(at)] == row[np.minimum(np.arange(len(at)) + width - 1, len(row) - 1)] if len(at) else np.zeros(0, bool)
    at = at[inside]
    return hashes[at], first[at], row[at]


def _twice(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(is the first of its value, occurs more than once)`` for every entry."""
    _, first, back, n = np.unique(values, return_index=True, return_inverse=True, return_counts=True)
    lead = np.zeros(len(values), bool)
    lead[first] = True
    return lead, n[back] > 1


def find_minimizers(docs: DataFrame, window: int, gram: int, kind: str) -> DataFrame:
    """``(key, doc, h, pos, sent, known)``: ``known`` ones occur twice in their batch, ``sent`` ones go on for all."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(space_words(), lower=False)
        for whole in batches:
            parts = []
            for batch in slices(iter([whole]), "text"):
                w = hasher.read(batch.column(2))
                key, at, row = minimizers(w, window, gram)
                new = np.ones(len(at), bool)
                new[1:] = (at[1:] != at[:-1]) | (row[1:] != row[:-1])
                key, at, row = key[new], at[new], row[new]
                parts.append((key, at - w.bounds[row], batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row))))
            if not parts:
                continue
            key = np.concatenate([p[0] for p in parts])
            lead, known = _twice(key)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(key.view(np.int64)), pa.concat_arrays([p[2] for p in parts]), pa.concat_arrays([p[3] for p in parts]),
                    pa.array(np.concatenate([p[1] for p in parts]).astype(np.int32)), pa.array(lead), pa.array(known),
                ],
                names=["key", "doc", "h", "pos", "sent", "known"],
            )

    return docs.mapInArrow(read, f"key bigint, doc {kind}, h bigint, pos int, sent boolean, known boolean")


def _met_again(sent: DataFrame) -> DataFrame:
    """Of the sent minimizers those that other batches have too, and are not known to repeat already."""

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, before = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            joined = batch if held is None else _joined([held, batch])
            key = joined.column(0).to_numpy()
            next_ = key[:-1] == key[1:]
            keep = np.concatenate([[before == key[0]], next_]) | np.concatenate([next_, [False]])
            keep &= ~joined.column(5).to_numpy(zero_copy_only=False)
            if len(key) > 1:  # the last row waits for its successor
                yield joined.slice(0, len(key) - 1).filter(pa.array(keep[:-1]))
                before = key[-2]
            held = joined.slice(len(key) - 1)
        if held is not None and before == held.column(0)[0].as_py() and not held.column(5)[0].as_py():
            yield held

    return sent.repartition("key").sortWithinPartitions("key").mapInArrow(shared, sent.schema)


def stretches(docs: DataFrame, window: int, gram: int, kind: str) -> DataFrame:
    """Stretches of the wanted minimizers (column ``pos``) of each text.

    ``(key, doc, h, first, size, words, settled)``: ``size`` suffixes start at word
    ``first`` and after.  A settled stretch occurs twice in its batch; it is reported for
    its document once more without words.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(space_words(), lower=False)
        for whole in batches:
            for batch in slices(iter([whole]), "text"):
                w = hasher.read(batch.column(2))
                key, at, row = minimizers(w, window, gram)
                if not len(at):
                    continue
                start = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (row[1:] != row[:-1])]))
                size = np.diff(np.append(start, len(at)))
                # Windows are numbered row by row; their first words follow from the row's number of windows.
                per = np.maximum(w.counts - (window - 1), 0)
                first = w.bounds[row[start]] + start - (np.cumsum(per) - per)[row[start]]
                key, at, row = key[start], at[start], row[start]
                wanted = batch.column(3)
                flat = wanted.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                of = np.repeat(np.arange(w.rows), wanted.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
                asked = np.isin(at, flat + w.bounds[of])
                key, row, first, size = key[asked], row[asked], first[asked], size[asked]
                last = first + size + window - 1
                content = hasher.grams.runs(w.hash, first, last)
                lead, settled = _twice(content ^ key)
                words = gather(w.raw, w.starts[first], w.ends[last - 1])
                base = [pa.array(key.view(np.int64)), batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row)), pa.array((first - w.bounds[row]).astype(np.int32)), pa.array(size.astype(np.int32))]
                names = ["key", "doc", "h", "first", "size", "words", "settled"]
                out = pa.RecordBatch.from_arrays([*base, words.cast(pa.string()), pa.array(np.zeros(len(key), bool))], names=names)
                yield out.filter(pa.array(lead))
                done = pa.RecordBatch.from_arrays([*base, pa.nulls(len(key), pa.string()), pa.array(np.ones(len(key), bool))], names=names)
                yield done.filter(pa.array(settled))

    return docs.mapInArrow(read, f"key bigint, doc {kind}, h bigint, first int, size int, words string, settled boolean")


def deep_leaves(codes: np.ndarray, group: np.ndarray, start: np.ndarray, length: np.ndarray, window: int) -> np.ndarray:
    """Depth of the deepest inner node above each suffix, 0 where it is shallower than ``window``.

    Suffix i of tree ``group[i]`` is ``codes[start[i] : start[i] + length[i]]``; codes are positive.
    """
    depth = int(length.max(initial=0))
    table = np.zeros((len(start), depth + 1), ">u4")
    table[:, 0] = group
    step = np.arange(depth)
    inside = step[None, :] < length[:, None]
    table[:, 1:][inside] = codes[(start[:, None] + step)[inside]]
    order = np.argsort(table.view(f"S{4 * (depth + 1)}").ravel(), kind="stable")
    table = table[order]
    same = table[1:] == table[:-1]
    same[:, 1:] &= table[1:, 1:] != 0
    common = np.where(same.all(axis=1), depth + 1, np.argmin(same, axis=1)) - 1  # words shared with the next leaf
    common = np.maximum(common, 0)
    above = np.maximum(np.append(common, 0), np.append(0, common)) if len(order) else np.zeros(0, int)
    out = np.zeros(len(order), np.int64)
    out[order] = np.where(above >= window, above, 0)
    return out


def repeats_in_trees(groups: DataFrame, window: int, kind: str) -> DataFrame:
    """``(doc, h, a, b)``: word spans below deep inner nodes of each ``(key, part)``."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(space_words(), lower=False)
        for batch in whole_groups(batches, ["key", "part"], BATCH_ROWS, most=GROUP_ROWS):
            if batch.num_rows < 2:
                continue
            get = lambda c: batch.column(batch.schema.get_field_index(c))
            w = hasher.read(get("words"))
            size = get("size").to_numpy().astype(np.int64)
            codes = np.unique(w.hash, return_inverse=True)[1] + 1
            row = np.repeat(np.arange(batch.num_rows), size)
            start = expand(w.bounds[:-1], size)
            group = runs(batch, ["key", "part"])
            found = np.zeros(len(row), np.int64)
            # Trees are built side by side, a bounded number of suffixes at a time.
            edges = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
            suffixes = np.concatenate([[0], np.cumsum(size)])
            at = 0
            while at < len(edges):
                to = max(at + 1, int(np.searchsorted(suffixes[np.append(edges, len(group))], suffixes[edges[at]] + (1 << 17))) - 1)
                a, b = suffixes[edges[at]], suffixes[edges[to] if to < len(edges) else len(group)]
                found[a:b] = deep_leaves(codes, group[row[a:b]] + 1, start[a:b], w.bounds[row[a:b] + 1] - start[a:b], window)
                at = to
            change = np.zeros(len(codes) + 1, np.int64)
            deep = found > 0
            np.add.at(change, start[deep], 1)
            np.add.at(change, start[deep] + found[deep], -1)
            hit = np.cumsum(change)[:-1] > 0
            edge = np.zeros(len(hit) + 1, bool)
            edge[w.bounds] = True
            a = np.flatnonzero(hit & (edge[:-1] | ~np.concatenate([[False], hit[:-1]])))
            b = np.flatnonzero(hit & (edge[1:] | ~np.concatenate([hit[1:], [False]]))) + 1
            of = np.searchsorted(w.bounds, a, side="right") - 1
            shift = get("first").to_numpy().astype(np.int64)[of] - w.bounds[of]
            yield pa.RecordBatch.from_arrays(
                [get("doc").take(pa.array(of)), get("h").take(pa.array(of)), pa.array((a + shift).astype(np.int32)), pa.array((b + shift).astype(np.int32))],
                names=["doc", "h", "a", "b"],
            )

    return groups.mapInArrow(search, f"doc {kind}, h bigint, a int, b int")


def longer_prefixes(heavy: DataFrame, window: int) -> DataFrame:
    """One row per suffix, parted by its first ``window`` words."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(space_words(), lower=False)
        for batch in slices(batches, "words"):
            get = lambda c: batch.column(batch.schema.get_field_index(c))
            w = hasher.read(get("words"))
            hashes, at, row = w.grams(window)
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [
                    get("key").take(take), get("doc").take(take), get("h").take(take),
                    pa.array((get("first").to_numpy()[row] + at - w.bounds[row]).astype(np.int32)), pa.array(np.ones(len(row), np.int32)),
                    gather(w.raw, w.starts[at], w.ends[at + window - 1]).cast(pa.string()), pa.array(hashes.view(np.int64)),
                ],
                names=["key", "doc", "h", "first", "size", "words", "part"],
            )

    return heavy.mapInArrow(part, heavy.schema)


def repeated_spans(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, group_rows: int = GROUP_ROWS) -> DataFrame:
    """``(doc, h, spans)`` of the rows ``(doc, h, text)``: word spans ``{a, b}`` covered by windows that occur elsewhere too."""
    spark = docs.sparkSession
    kind = dict(docs.dtypes)["doc"]

    def stored(df: DataFrame, name: str) -> DataFrame:
        path = scratch_path(spark, f"substring-{name}")
        df.write.parquet(path)
        return spark.read.parquet(path)

    seen = stored(find_minimizers(docs, window, gram, kind), "minimizers")
    again = _met_again(seen.where("sent")).unionByName(seen.where("known")).select("doc", "h", "pos")
    # A document's minimizers are bounded by its own length.
    asked = stored(again.groupBy("doc", "h").agg(F.collect_set("pos").alias("pos")), "asked")
    near, _ = split_by_slot(docs, asked)
    joined = near.join(asked.select(F.col("doc").alias("d"), F.col("h").alias("g"), "pos"), F.col("doc").eqNullSafe(F.col("d")) & (F.col("h") == F.col("g")))
    found = stored(stretches(joined.select("doc", "h", "text", "pos"), window, gram, kind), "stretches")
    open_ = found.where("not settled").drop("settled").withColumn("part", F.lit(0).cast("bigint"))
    heavy = stored(open_.groupBy("key").count().where(F.col("count") > group_rows).select("key", F.lit(True).alias("heavy")), "heavy")
    marked = open_.join(heavy, "key", "left")
    light = marked.where("heavy is null").drop("heavy")
    long = longer_prefixes(marked.where("heavy").drop("heavy"), window)
    groups = light.unionByName(long).repartition("key", "part").sortWithinPartitions("key", "part")
    spans = repeats_in_trees(groups, window, kind).unionByName(
        found.where("settled").select("doc", "h", F.col("first").alias("a"), (F.col("first") + F.col("size") + F.lit(window - 1)).alias("b"))
    )
    return spans.groupBy("doc", "h").agg(F.collect_set(F.struct("a", "b")).alias("spans"))


def split_by_slot(docs: DataFrame, some: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``docs`` that may be in ``some`` and those that surely are not, by at most SLOTS broadcast numbers."""
    slot = F.pmod(F.xxhash64("doc", "h"), F.lit(SLOTS))
    slots = F.broadcast(some.select(slot.alias("__slot")).distinct())
    return docs.join(slots, slot == F.col("__slot"), "left_semi"), docs.join(slots, slot == F.col("__slot"), "left_anti")


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, **sizes) -> DataFrame:
    """The documents with ``n_words``, ``n_removed`` and ``kept`` (the words left, joined by one blank)."""
    spark = docs.sparkSession
    bound_batches(spark)
    rows = docs.drop(*RESULTS)
    keyed = rows.select(F.col(f"`{doc_id}`").alias("doc"), F.xxhash64(F.col(f"`{text}`").cast("string")).alias("h"), F.col(f"`{text}`").cast("string").alias("text"), F.struct(*[f"`{c}`" for c in rows.columns if c != text]).alias("rest"))
    path = scratch_path(spark, "substring-spans")
    repeated_spans(keyed.select("doc", "h", "text"), window, **sizes).write.parquet(path)
    spans = spark.read.parquet(path)
    near, far = split_by_slot(keyed, spans)
    held = near.join(spans.select(F.col("doc").alias("d"), F.col("h").alias("g"), "spans"), F.col("doc").eqNullSafe(F.col("d")) & (F.col("h") == F.col("g")), "left")
    none = F.lit(None).cast("array<struct<a:int,b:int>>")
    columns = ["rest", "text"]
    return cut_spans(held.select(*columns, "spans").unionByName(far.select(*columns, none.alias("spans")))).select(
        *[F.col(f"rest.`{c}`") if c != text else F.col("text").alias(text) for c in rows.columns], *RESULTS
    )


def cut_spans(df: DataFrame) -> DataFrame:
    """Take the words of ``spans`` out of ``text``."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(space_words(), lower=False)
        for batch in slices(batches, "text"):
            w = hasher.read(batch.column(1), hashes=False)
            spans = batch.column(2)
            flat = spans.flatten()
            of = np.repeat(np.arange(w.rows), spans.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            change = np.zeros(len(w.starts) + 1, np.int64)
            np.add.at(change, flat.field("a").to_numpy(zero_copy_only=False) + w.bounds[of], 1)
            np.add.at(change, flat.field("b").to_numpy(zero_copy_only=False) + w.bounds[of], -1)
            stay = np.cumsum(change)[:-1] <= 0
            starts, ends = w.starts[stay], w.ends[stay]
            length = ends - starts
            place = np.concatenate([[0], np.cumsum(length + 1)])
            out = np.full(place[-1], 32, np.uint8)
            out[expand(place[:-1], length)] = w.raw[expand(starts, length)]
            bounds = np.concatenate([[0], np.cumsum(stay)])[w.bounds]
            begin = place[bounds[:-1]]
            kept = gather(out, begin, np.maximum(place[bounds[1:]] - 1, begin))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(w.counts.astype(np.int64)), pa.array((w.counts - np.diff(bounds)).astype(np.int64)), kept.cast(pa.string())],
                names=["rest", "text", *RESULTS],
            )

    results = [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())]
    shape = T.StructType([*[df.schema[c] for c in ("rest", "text")], *results])
    return df.select("rest", "text", "spans").mapInArrow(cut, shape)
