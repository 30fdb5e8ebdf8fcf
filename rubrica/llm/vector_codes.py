"""Vector code compression: product codes found through per-dimension value dictionaries.

Components become integers, ``floor(scale * x)``.  Rows are stored in blocks, each with one
dictionary a dimension (its distinct integers, sorted) and the rows' codes into it.  To
measure a block against a codebook, the squared differences of every dictionary value to
all entries are tabulated once a dimension; the distance of a part to every entry is then
a sum of gathered table rows, one gather and one add a dimension.  A block's dictionary
never has more values than the block has rows, so memory is bounded whatever the data are.

Codebooks start as the parts of the ``entries`` smallest keys.  Every round assigns all
parts, adds up counts and integer sums of each entry over all rows, and replaces used
entries by ``floor(sum / count)``.  Sums are whole numbers, so neither partitioning nor a
lost executor changes a result.  The driver holds the codebooks and ``entries`` rows.

Defined results:

* a null vector, and one with a null, NaN or infinite component, is dropped;
* the width is that of the smallest kept key with a fitting vector; a vector of another
  width, of one that does not divide into the parts (none at all included), or with a
  component so large that its distances may leave 64 bits, stays with a null code and error;
* repeated keys are rows of their own, and the smaller vector comes first among the first
  ``entries``; a null key comes last; of equally near entries the lower index wins;
* fewer rows than ``entries`` make a smaller codebook; an empty table gives no rows;
* other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
BLOCK_VALUES = 1 << 18  # components of one block
HEAVY = 1024  # labels with more than one row in so many are broadcast


@dataclass
class Codebooks:
    """``values[part, entry, position]``, whole numbers."""

    values: np.ndarray

    def digest(self) -> str:
        """SHA-256 of all integers by part, entry and position, comma-joined."""
        return hashlib.sha256(",".join(map(str, self.values.ravel().tolist())).encode()).hexdigest()


def largest(width: int) -> int:
    """Components up to this size keep every distance of ``width`` dimensions in 64 bits."""
    return int((2**63 / (4 * width)) ** 0.5) - 1


def kept_vectors(df: DataFrame, key: str, vector: str, label: str, parts: int, scale: int) -> tuple[DataFrame, int]:
    """``(key, label, vector, fits)`` of the rows that are not dropped, and the common width (0 if no row fits)."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    rows = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{label}`").alias("label"), F.col(f"`{vector}`").cast("array<double>").alias("vector"))
    rows = rows.where(F.col("vector").isNotNull() & F.forall("vector", finite))
    size = F.size("vector")
    near = lambda limit: F.forall("vector", lambda x: F.abs(x) < limit / scale)
    whole = (size > 0) & (size % parts == 0) & near(F.lit(2.0**30.5) / F.sqrt(size))
    first = rows.where(whole).orderBy(F.asc_nulls_last("key"), "vector").select(size.alias("n")).first()
    width = first["n"] if first else 0
    return rows.withColumn("fits", (size == width) & near(largest(width)) if width else F.lit(False)), width


def whole_numbers(vectors: pa.Array, width: int, scale: int) -> np.ndarray:
    values = vectors.flatten().to_numpy(zero_copy_only=False)
    return np.floor(values * scale).astype(np.int64).reshape(-1, width)


def encode_blocks(rows: DataFrame, width: int, scale: int) -> DataFrame:
    """``(keys, labels, dictionary, sizes, codes)``: blocks of rows, each dimension as codes into its own dictionary."""
    kinds = dict(rows.dtypes)
    limit = max(1, BLOCK_VALUES // width)
    places = np.arange(width)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, limit):
                block = batch.slice(start, limit)
                n, values = block.num_rows, whole_numbers(block.column(2), width, scale)
                order = np.argsort(values, axis=0, kind="stable")
                ordered = np.take_along_axis(values, order, axis=0)
                new = np.ones((n, width), bool)
                new[1:] = ordered[1:] != ordered[:-1]
                codes = np.empty((width, n), np.int32)
                codes[places[None, :], order] = np.cumsum(new, axis=0) - 1
                one = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)
                yield pa.RecordBatch.from_arrays(
                    [
                        one(block.column(0)), one(block.column(1)), one(pa.array(ordered.T[new.T])),
                        one(pa.array(new.sum(axis=0), pa.int32())), one(pa.array(codes.ravel())),
                    ],
                    ["keys", "labels", "dictionary", "sizes", "codes"],
                )

    shape = f"keys array<{kinds['key']}>, labels array<{kinds['label']}>, dictionary array<bigint>, sizes array<int>, codes array<int>"
    return rows.select("key", "label", "vector").mapInArrow(encode, shape)


def assign(block: pa.RecordBatch, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry of every part, ``[rows, parts]``, and the squared distances, by gathers and adds over the block's tables."""
    parts, entries, span = books.shape
    column = lambda name: block.column(block.schema.get_field_index(name)).flatten().to_numpy()
    dictionary, codes = column("dictionary"), column("codes").reshape(parts * span, -1)
    ends = np.cumsum(column("sizes"))
    reach = max(int(np.abs(dictionary).max()), 0) + int(np.abs(books).max())
    kind = np.int32 if span * reach * reach < 2**31 else np.int64
    n = codes.shape[1]
    nearest, distance = np.empty((n, parts), np.int64), np.empty((n, parts), np.int64)
    for p in range(parts):
        total = None
        for j in range(span):
            d = p * span + j
            values = dictionary[ends[d - 1] if d else 0 : ends[d]]
            table = ((values[:, None] - books[p, None, :, j]) ** 2).astype(kind)
            gathered = table[codes[d]]
            total = gathered if total is None else np.add(total, gathered, out=total)
        nearest[:, p] = total.argmin(axis=1)
        distance[:, p] = total[np.arange(n), nearest[:, p]]
    return nearest, distance


def block_values(block: pa.RecordBatch, width: int) -> np.ndarray:
    """The whole numbers of a block, ``[width, rows]``, read back through its dictionaries."""
    column = lambda name: block.column(block.schema.get_field_index(name)).flatten().to_numpy()
    sizes = column("sizes")
    return column("dictionary")[column("codes").reshape(width, -1) + (np.cumsum(sizes) - sizes)[:, None]]


def entry_sums(blocks: DataFrame, books: np.ndarray) -> DataFrame:
    """``(place, total, n)``: sum and count of every entry's component over all rows; partial sums are one set a task."""
    parts, entries, span = books.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((parts, span, entries), np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                block = batch.slice(i, 1)
                nearest, _ = assign(block, books)
                values = block_values(block, parts * span)
                for p in range(parts):
                    count[p] += np.bincount(nearest[:, p], minlength=entries)
                    order = np.argsort(nearest[:, p], kind="stable")
                    at = nearest[order, p]
                    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
                    total[p][:, at[first]] += np.add.reduceat(values[p * span : (p + 1) * span, order], first, axis=1)
        used = np.broadcast_to(count[:, :, None], (parts, entries, span)).ravel()
        place = np.flatnonzero(used)
        yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(total.transpose(0, 2, 1).ravel()[place]), pa.array(used[place])], ["place", "total", "n"])

    found = blocks.select("dictionary", "sizes", "codes").mapInArrow(sums, "place bigint, total bigint, n bigint")
    return found.groupBy("place").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))


def train(blocks: DataFrame, start: np.ndarray, rounds: int = ROUNDS) -> Codebooks:
    """Rounds of assignment and replacement over all rows; unused entries stay."""
    books = start
    for _ in range(rounds):
        flat = books.ravel().copy()
        for r in entry_sums(blocks, books).collect():  # one row for each integer of the codebooks at most
            flat[r["place"]] = r["total"] // r["n"]
        books = flat.reshape(books.shape)
    return Codebooks(books)


def encode(blocks: DataFrame, books: Codebooks) -> DataFrame:
    """``(key, label, code, error)`` of every stored row; ``code`` has two hex digits a part."""
    values = books.values
    kinds = {c: k[len("array<") : -1] for c, k in blocks.dtypes}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                block = batch.slice(i, 1)
                nearest, distance = assign(block, values)
                text = nearest.astype(np.uint8).tobytes().hex()
                step = 2 * values.shape[0]
                codes = [text[k : k + step] for k in range(0, len(text), step)]
                columns = [block.column(0).flatten(), block.column(1).flatten(), pa.array(codes, pa.string()), pa.array(distance.sum(axis=1))]
                yield pa.RecordBatch.from_arrays(columns, ["key", "label", "code", "error"])

    return blocks.mapInArrow(run, f"key {kinds['keys']}, label {kinds['labels']}, code string, error bigint")


def with_label_errors(rows: DataFrame) -> DataFrame:
    """Adds ``label_error``, the error summed over equal labels, nulls together.

    Labels with more than one row in ``HEAVY`` (fewer than ``HEAVY`` labels) are broadcast, so a hot
    label meets in no task; the others are joined by a shuffle.
    """
    sums = rows.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("__n"))
    path = scratch_path(rows.sparkSession, "label-errors")
    sums.write.parquet(path)
    sums = rows.sparkSession.read.parquet(path)
    least = sums.agg(F.sum("__n")).first()[0] or 0
    heavy = sums.where(F.col("__n") * HEAVY > least).select(F.struct("label").alias("__l"), "label_error")
    light = sums.where(F.col("__n") * HEAVY <= least).select(F.struct("label").alias("__l"), "label_error")
    keyed = rows.withColumn("__l", F.struct("label"))
    hot = keyed.join(F.broadcast(heavy), "__l")
    rest = keyed.join(F.broadcast(heavy.select("__l")), "__l", "left_anti").join(light, "__l")
    return hot.unionByName(rest).drop("__l")


def compress(
    df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE
) -> tuple[DataFrame, Codebooks]:
    """``(key, label, code, error, label_error)`` of all kept rows, and the codebooks they were coded with.

    ``entries`` is at most 256, so that a code fits its two digits.
    """
    if not 0 < entries <= 256:
        raise ValueError("entries must be 1 to 256")
    spark = df.sparkSession
    rows, width = kept_vectors(df, key, vector, label, parts, scale)
    misfits = rows.where(~F.col("fits")).select("key", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("bigint").alias("error"))
    if not width:
        return misfits.withColumn("label_error", F.lit(None).cast("bigint")), Codebooks(np.zeros((parts, 0, 0), np.int64))
    fitting = rows.where("fits")
    path, coded = scratch_path(spark, "vector-blocks"), scratch_path(spark, "vector-codes")
    encode_blocks(fitting, width, scale).write.parquet(path)
    blocks = spark.read.parquet(path)
    first = fitting.orderBy(F.asc_nulls_last("key"), "vector").limit(entries).select("vector").collect()
    start = np.floor(np.array([r["vector"] for r in first]) * scale).astype(np.int64)
    books = train(blocks, np.ascontiguousarray(start.reshape(len(first), parts, -1).transpose(1, 0, 2)), rounds)
    encode(blocks, books).unionByName(misfits).write.parquet(coded)
    return with_label_errors(spark.read.parquet(coded)), books
