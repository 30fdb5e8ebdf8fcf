"""N-gram Jaccard join: which documents share at least a given part of their word shingles.

The steps, each a Spark job over all documents:

1. A frequency sketch of the shingles: ``2**sketch_bits`` counters, filled per
   partition in numpy and added up block by block.  Its size is a parameter and
   does not grow with the data.  It only orders shingles (rare first, then by
   hash), so a crowded counter costs work and never a link.
2. Every document becomes its set size, a digest of its set, its prefix (the
   ``n - ceil(t n) + 1`` rarest shingles) and a histogram of its shingles over
   ``BUCKETS`` ranges.  Documents with one set are one class from here on.
3. Classes meet on prefix shingles.  A pair stays if it passes the length filter,
   the positional filter and the suffix filter (the histograms bound the symmetric
   difference from below, as the recursive partitioning of suffixes does).  A task
   reports a spanning forest of what stayed among its own rows, never all pairs.
   A list longer than ``LIST_ROWS`` is dealt to tasks as pairs of blocks.
4. The components of step 3 hold every link.  The sets of a component meet in one
   task (or, above ``GROUP_WORDS``, as pairs of blocks) and each pair is verified
   at most once, and only while its two sides are not connected yet.

Shingles are compared by 64-bit hashes.

Defined results: words are maximal runs of other than ASCII white space, A-Z
lower-cased; a document with fewer words than a shingle has its whole sequence as
one; a null or wordless text has an empty set and no link; repeated rows with one
id are judged one by one, each by its own text; a null id never names a component
that has another id.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.similarity import connected_components
from ..session import scratch_path
from .base import bound_batches
from .words import Hasher, distinct, lists, slices, space_words

SKETCH_BITS = 22
SKETCH_BLOCK = 1 << 14
BUCKETS = 64
LIST_ROWS = 512
GROUP_WORDS = 2_000_000
SLOTS = 1 << 20


def required(n, percent: int):
    """Least size of a set that can link with a set of size n."""
    return -(-n * percent // 100)


def overlap(a, b, percent: int):
    """Least intersection of linked sets of sizes a and b: 100 i >= percent (a + b - i)."""
    return -(-(a + b) * percent // (100 + percent))


def shingle_sketch(docs: DataFrame, words: int, bits: int) -> np.ndarray:
    """Counters of the shingles of all documents (saturating at 2**31), added up by blocks of counters."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, counters, any_rows = Hasher(space_words(), lower=True), np.zeros(1 << bits, np.uint32), False
        for batch in slices(batches, "text"):
            hashes, _, _ = hasher.read(batch.column(0)).grams(words, short=True)
            np.add.at(counters, hashes >> np.uint64(64 - bits), np.uint32(1))
            any_rows = any_rows or len(hashes) > 0
        if any_rows:
            for k, part in enumerate(counters.reshape(-1, min(SKETCH_BLOCK, 1 << bits))):
                if part.any():
                    yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([_pack(part)], pa.binary())], names=["block", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                old = sums.get(k)
                new = _unpack(part).astype(np.uint64)
                sums[k] = new if old is None else old + new
        for k, part in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([_pack(np.minimum(part, 1 << 31).astype(np.uint32))], pa.binary())], names=["block", "counts"])

    shape = "block int, counts binary"
    parts = docs.select("text").mapInArrow(count, shape).repartition("block").mapInArrow(add, shape)
    out = np.zeros(1 << bits, np.uint32)
    size = min(SKETCH_BLOCK, 1 << bits)
    for row in parts.collect():  # at most 2**bits counters, whatever the input
        out[row["block"] * size : (row["block"] + 1) * size] = _unpack(bytes(row["counts"]))
    return out


def _pack(counts: np.ndarray) -> bytes:
    import zstandard

    small = counts.astype(np.uint8) if counts.max(initial=0) < 256 else counts
    return zstandard.ZstdCompressor(level=1).compress(bytes([small.dtype.itemsize]) + small.tobytes())


def _unpack(data: bytes) -> np.ndarray:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(data)
    return np.frombuffer(raw, np.uint8 if raw[0] == 1 else np.uint32, offset=1)


def set_digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def histogram(shingles: np.ndarray) -> np.ndarray:
    """Counts over BUCKETS ranges, at most 255 each (which keeps the bound a bound)."""
    return np.minimum(np.bincount(shingles & np.uint64(BUCKETS - 1), minlength=BUCKETS), 255).astype(np.uint8)


def prefixes(docs: DataFrame, words: int, percent: int, sketch, bits: int) -> DataFrame:
    """``(doc, n, digest, prefix, histogram)`` of every document."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, counters = Hasher(space_words(), lower=True), sketch.value
        for batch in slices(batches, "text"):
            hashes, _, row = hasher.read(batch.column(1)).grams(words, short=True)
            cut = np.searchsorted(row, np.arange(batch.num_rows + 1))
            sizes, digests, tokens, hists = [], [], [], []
            for d in range(batch.num_rows):
                own = distinct(hashes[cut[d] : cut[d + 1]])
                n = len(own)
                order = np.argsort(counters[own >> np.uint64(64 - bits)], kind="stable")[: n - required(n, percent) + 1 if n else 0]
                sizes.append(n)
                digests.append(set_digest(own))
                tokens.append(own[order])
                hists.append(histogram(own).tobytes())
            bounds = np.concatenate([[0], np.cumsum([len(x) for x in tokens])])
            flat = np.concatenate(tokens).view(np.int64) if tokens else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int32()), pa.array(digests, pa.binary()), lists(flat, bounds, pa.int64()), pa.array(hists, pa.binary())],
                names=["doc", "n", "digest", "prefix", "hist"],
            )

    return docs.select("doc", "text").mapInArrow(read, f"doc {dict(docs.dtypes)['doc']}, n int, digest binary, prefix array<bigint>, hist binary")


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of n nodes over the edges (a, b)."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while True:
            jump = new[new]
            if (jump == new).all():
                break
            new = jump
        if (new == label).all():
            break
        label = new
        keep = label[a] != label[b]
        a, b = a[keep], b[keep]
    return label


def list_links(key, side, doc, n, pos, hist, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Row pairs of equal ``key`` that pass the length, positional and suffix filters.

    Rows come sorted by (key, n).  ``side`` is 0 or 1 for the rows of two blocks and
    2 for one block against itself.
    """
    out_a, out_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    active = np.arange(len(key))
    k = 0
    while True:
        k += 1
        active = active[active + k < len(key)]
        active = active[key[active] == key[active + k]]
        active = active[n[active] >= required(n[active + k], percent)]  # n grows with k: no later partner fits either
        if not len(active):
            return np.concatenate(out_a), np.concatenate(out_b)
        a, b = active, active + k
        ok = (doc[a] != doc[b]) & ((side[a] == 2) | (side[a] != side[b]))
        least = overlap(n[a], n[b], percent)
        ok &= 1 + np.minimum(n[a] - pos[a] - 1, n[b] - pos[b] - 1) >= least
        a, b, least = a[ok], b[ok], least[ok]
        for at in range(0, len(a), 1 << 14):
            x, y, z = a[at : at + (1 << 14)], b[at : at + (1 << 14)], least[at : at + (1 << 14)]
            differ = np.abs(hist[x].astype(np.int16) - hist[y]).sum(axis=1, dtype=np.int64)
            good = n[x] + n[y] - differ >= 2 * z
            out_a.append(x[good])
            out_b.append(y[good])


def candidate_links(lists_: DataFrame, percent: int) -> DataFrame:
    """Spanning links of the classes that meet in a list and pass the filters."""

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole_groups(batches, ["token", "left", "right"], 1 << 16):
            if batch.num_rows < 2:
                continue
            doc, names = codes(batch.column(batch.schema.get_field_index("doc")))
            get = lambda c: batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False)
            hist = np.frombuffer(b"".join(batch.column(batch.schema.get_field_index("hist")).to_pylist()), np.uint8).reshape(-1, BUCKETS)
            a, b = list_links(runs(batch, ["token", "left", "right"]), get("side"), doc, get("n").astype(np.int64), get("pos").astype(np.int64), hist, percent)
            label = roots(len(names), doc[a], doc[b])
            tied = np.flatnonzero(label != np.arange(len(names)))
            if len(tied):
                yield pa.RecordBatch.from_arrays([names.take(pa.array(tied)), names.take(pa.array(label[tied]))], names=["a", "b"])

    return lists_.mapInArrow(link, "a bigint, b bigint")


def codes(values: pa.Array) -> tuple[np.ndarray, pa.Array]:
    coded = values.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def runs(batch: pa.RecordBatch, keys: list[str]) -> np.ndarray:
    """Number of the run of equal keys that each row belongs to."""
    change = np.zeros(batch.num_rows, bool)
    for key in keys:
        values = batch.column(batch.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
        change[1:] |= values[1:] != values[:-1]
    return np.cumsum(change)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int, most: int | None = None) -> Iterator[pa.RecordBatch]:
    """Regroup sorted batches so that no run of equal keys is cut.

    With ``most``, a run beyond that many rows is cut, and each part starts with the last row of the part before.
    """
    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        count += batch.num_rows
        if count >= rows:
            joined = _joined(held)
            run = runs(joined, keys)
            cut = int(np.searchsorted(run, run[-1]))
            if cut:
                yield joined.slice(0, cut)
                joined = joined.slice(cut)
            elif most is not None and count > most:
                yield joined
                joined = joined.slice(count - 1)
            held, count = [joined], joined.num_rows
    if held:
        yield _joined(held)


def _joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return batches[0] if len(batches) == 1 else pa.Table.from_batches(batches).combine_chunks().to_batches()[0]


def _shared_lists(tokens: DataFrame) -> DataFrame:
    """Rows whose token occurs in at least two classes, with the length of its list in blocks of rows."""

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, began = None, False
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            joined = batch if held is None else _joined([held, batch])
            token = joined.column(0).to_numpy()
            same = np.concatenate([[began and last == token[0]], token[1:] == token[:-1]])
            keep = same | np.concatenate([token[1:] == token[:-1], [False]])
            # The last row waits for its successor.
            last, began = (token[-2], True) if len(token) > 1 else (last, began)
            if len(token) > 1:
                yield joined.slice(0, len(token) - 1).filter(pa.array(keep[:-1]))
            held = joined.slice(len(token) - 1)
        if held is not None and began and last == held.column(0)[0].as_py():
            yield held

    return tokens.repartition("token").sortWithinPartitions("token").mapInArrow(shared, tokens.schema)


def verified_links(sets: DataFrame, percent: int, words: int) -> DataFrame:
    """Spanning links ``(a, b)`` of the true links inside each ``(comp, left, right)`` of texts.

    Where a component is ``whole`` in its task, ``b`` is one root for each true component.
    """

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(space_words(), lower=True)

        def flush(group):
            ids, sides, own, hists = group
            order = sorted(range(len(own)), key=lambda i: len(own[i]))
            n = np.array([len(own[i]) for i in order], np.int64)
            hist = np.stack([hists[i] for i in order])
            side = np.array([sides[i] for i in order])
            parent = list(range(len(order)))

            def find(x):
                while parent[x] != x:
                    parent[x] = parent[parent[x]]
                    x = parent[x]
                return x

            for i in range(len(order) - 1):
                # Partners are at least as large: n[i] must reach their length bound.
                top = i + 1 + int(np.searchsorted(required(n[i + 1 :], percent), n[i], side="right"))
                near = np.arange(i + 1, top)
                near = near[(side[near] == 2) | (side[near] != side[i])]
                differ = np.abs(hist[near].astype(np.int16) - hist[i]).sum(axis=1, dtype=np.int64)
                least = overlap(n[i], n[near], percent)
                for j, need in zip(near[n[i] + n[near] - differ >= 2 * least].tolist(), least[n[i] + n[near] - differ >= 2 * least].tolist(), strict=True):
                    x, y = find(i), find(j)
                    if x != y and common(own[order[i]], own[order[j]]) >= need:
                        parent[max(x, y)] = min(x, y)
            pairs = [(ids[order[i]], ids[order[find(i)]]) for i in range(len(order)) if find(i) != i]
            if pairs:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([p[0] for p in pairs], pa.binary()), pa.array([p[1] for p in pairs], pa.binary()), pa.array([key[3]] * len(pairs))],
                    names=["a", "b", "whole"],
                )

        group, key = ([], [], [], []), None
        for batch in slices(batches, "text"):
            hashes, _, row = hasher.read(batch.column(batch.schema.get_field_index("text"))).grams(words, short=True)
            cut = np.searchsorted(row, np.arange(batch.num_rows + 1))
            rows = zip(*[batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("comp", "left", "right", "whole", "side", "digest")], strict=True)
            for d, (*at, side, digest) in enumerate(rows):
                if at != key:
                    if len(group[0]) > 1:
                        yield from flush(group)
                    group, key = ([], [], [], []), at
                own = distinct(hashes[cut[d] : cut[d + 1]])
                # Rows that share the id of the class but not its text, or repeat it, are not the class.
                if set_digest(own) == digest and digest not in group[0]:
                    for values, value in zip(group, (digest, side, own, histogram(own)), strict=True):
                        values.append(value)
        if len(group[0]) > 1:
            yield from flush(group)

    return sets.mapInArrow(verify, "a binary, b binary, whole boolean")


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    return int((both[1:] == both[:-1]).sum())


def in_blocks(df: DataFrame, key: str, rows: str, most: int, weight) -> DataFrame:
    """Deal each group of ``key`` to pairs of blocks of about ``most`` weight; lighter groups stay whole.

    Adds ``left``, ``right`` (the pair of blocks) and ``side`` (0 or 1, or 2 inside one block).
    Heavy groups are at most the total weight over ``most``; they are stored first, so that
    Spark knows their size and broadcasts them only where they are small.
    """
    path = scratch_path(df.sparkSession, "heavy-groups")
    df.groupBy(key).agg(F.sum(weight).alias("__weight")).where(F.col("__weight") > most).write.parquet(path)
    heavy = df.sparkSession.read.parquet(path)
    own = F.pmod(F.xxhash64(rows, F.lit(1)), F.col("__blocks")).cast("int")
    last = F.sequence(F.lit(0), (F.col("__blocks") - 1).cast("int"))
    return (
        df.join(heavy, key, "left")
        .withColumn("__blocks", F.coalesce(F.ceil(F.col("__weight") / F.lit(float(most))), F.lit(1)).cast("bigint"))
        .withColumn("__own", own)
        .withColumn("__other", F.explode(last))
        .withColumn("left", F.least("__own", "__other"))
        .withColumn("right", F.greatest("__own", "__other"))
        .withColumn("side", F.when(F.col("__own") == F.col("__other"), 2).otherwise((F.col("__own") > F.col("__other")).cast("int")))
        .withColumn("whole", F.col("__blocks") == 1)
        .drop("__weight", "__blocks", "__own", "__other")
    )


def jaccard_components(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 3, percent: int = 90,
    sketch_bits: int = SKETCH_BITS, list_rows: int = LIST_ROWS, group_words: int = GROUP_WORDS,
) -> DataFrame:
    """``(doc_id, n_shingles, component_id)``: the smallest id reachable over links, one row per document row.

    Two documents link when 100 * |A and B| >= percent * |A or B|.
    """
    spark = docs.sparkSession
    bound_batches(spark)

    def stored(df: DataFrame, name: str) -> DataFrame:
        path = scratch_path(spark, f"ngram-{name}")
        df.write.parquet(path)
        return spark.read.parquet(path)

    read = docs.select(F.col(f"`{doc_id}`").alias("doc"), F.col(f"`{text}`").cast("string").alias("text"))
    sketch = spark.sparkContext.broadcast(shingle_sketch(read, words, sketch_bits))
    known = stored(prefixes(read, words, percent, sketch, sketch_bits), "prefixes")
    # One class per set.  ``node`` is half of its digest: two classes with one node only meet as candidates.
    node = F.conv(F.hex(F.substring("digest", 1, 8)), 16, -10).cast("bigint")
    classes = stored(
        known.where("n > 0").groupBy("digest").agg(F.min("doc").alias("doc"), F.first("n").alias("n"), F.first("prefix").alias("prefix"), F.first("hist").alias("hist")).withColumn("node", node),
        "classes",
    )
    tokens = classes.select(F.posexplode("prefix").alias("pos", "token"), F.col("node").alias("doc"), "n").select("token", "doc", "n", "pos")
    shared = stored(_shared_lists(tokens), "lists")
    ready = in_blocks(shared, "token", "doc", list_rows, F.lit(1)).join(classes.select(F.col("node").alias("doc"), "hist"), "doc")
    ready = ready.repartition("token", "left", "right").sortWithinPartitions("token", "left", "right", "n", "doc")
    near = connected_components(candidate_links(ready, percent)).select("node", F.col("component").alias("comp"))
    near = stored(near.join(classes.select("node", "digest", "doc", "n"), "node").drop("node"), "candidates")
    # Texts are read again, only those of candidates: the slots are at most SLOTS numbers.
    slot = F.pmod(F.xxhash64("doc"), F.lit(SLOTS))
    wanted = read.join(F.broadcast(near.select(slot.alias("__slot")).distinct()), slot == F.col("__slot"), "left_semi")
    dealt = in_blocks(near, "comp", "digest", group_words, F.greatest("n", F.lit(200)).cast("bigint")).withColumnRenamed("doc", "id")
    sets = wanted.join(dealt, F.col("doc").eqNullSafe(F.col("id"))).drop("id", "doc")
    sets = sets.repartition("comp", "left", "right").sortWithinPartitions("comp", "left", "right")
    links = stored(verified_links(sets, percent, words), "links")
    tied = links.where("whole").select(F.col("a").alias("digest"), F.col("b").alias("root"))
    apart = links.where("not whole")
    if not apart.isEmpty():
        tied = tied.unionByName(connected_components(apart.select("a", "b")).select(F.col("node").alias("digest"), F.col("component").alias("root")))
    rooted = classes.select("digest", "doc").join(tied, "digest", "left").withColumn("root", F.coalesce("root", "digest"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("doc").alias("component_id")), "root").select("digest", "component_id")
    return known.select("doc", "n", "digest").join(named, "digest", "left").select(
        F.col("doc").alias(doc_id), F.col("n").cast("bigint").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc")).alias("component_id"),
    )
