"""Token ids in Parquet files: list columns, controlled encodings, row groups and pages.

``write_tokens`` orders documents by id over range partitions, encodes the texts in
the ordered partitions (so only texts are shuffled, never ids) and lets Spark write
one file a partition: dictionary pages for the ids, delta encoding for the integer
columns (data pages of version 2), row groups and pages of stated sizes, page
indexes on ``doc_id``.  ``read_tokens`` gives every document its offset in the
whole token stream; a reader that leaves ``ids`` out touches metadata columns only.

A text is cut at places where the vocabulary's own splitting pattern always cuts, and
each distinct piece that a worker process meets is encoded once by the tokenizers library
(pieces are told apart by 64-bit hashes; what a process remembers is bounded).  Added
tokens of the vocabulary that stand in a text are pieces of their own.

Defined results: a null or empty text has no ids but the end id; rows with one doc_id
follow in the order of a hash of their texts; a null doc_id comes first; extra columns
are not written; an empty table makes files without rows.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import bound_batches
from .memory import PieceMemory, process_store
from .token_arrays import expand, text_bytes, with_starts
from .words import Hasher, gather, lists, slices

END_ID = 2
SLICE = 1 << 20
PIECES = 5_000  # pieces encoded at a time; bounds what the library holds
UNSURE = (0xC2, 0xE1, 0xE2, 0xE3)  # first bytes of white space outside ASCII
WRITE = {
    "compression": "zstd",
    "parquet.enable.dictionary": "true",
    "parquet.dictionary.page.size": str(1 << 20),
    "parquet.writer.version": "v2",
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(1 << 20),
    "parquet.page.row.count.limit": "2000",
}


def kinds_of_bytes() -> np.ndarray:
    """Of each byte: 1 white space, 2 letter, 3 digit, 4 other visible ASCII, 0 unsure (outside ASCII, or a control)."""
    out = np.zeros(256, np.uint8)
    for k, chars in ((1, " \t\n\x0b\x0c\r"), (2, "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"), (3, "0123456789"), (4, "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~")):
        out[list(chars.encode())] = k
    return out


def safe_cuts(raw: np.ndarray) -> np.ndarray:
    """Places where the splitting pattern always cuts.

    Before a blank between visible characters, between an ASCII letter and another visible
    ASCII character (but for the apostrophe), and on both sides of a single line feed
    between visible characters.
    """
    n = len(raw)
    if n < 4:
        return np.zeros(0, np.int64)
    kind = kinds_of_bytes()[raw]
    ascii_ = kind > 1
    # A character outside ASCII is visible unless it is one of the few kinds of white space there.
    starts = (raw >= 128) & ~np.isin(raw, UNSURE)
    before, after = ascii_.copy(), ascii_ | (starts & (raw >= 0xC0))
    wide = np.flatnonzero(raw >= 128)
    wide = wide[wide > 2]
    before[wide] = ~((raw[wide - 1] == 0xC2) | np.isin(raw[wide - 2], UNSURE[1:]))
    middle = (raw[1:-1] == 32) | (raw[1:-1] == 10)
    alone = np.flatnonzero(middle & before[:-2] & after[2:]) + 1
    a, b = kind[:-1], kind[1:]
    cut = np.zeros(n, bool)
    cut[1:] = (((a == 2) & (b >= 3)) | ((a >= 3) & (b == 2))) & (raw[:-1] != 39)
    cut[alone] = True
    cut[alone[raw[alone] == 10] + 1] = True
    return np.flatnonzero(cut)


def added_tokens(tokenizer) -> re.Pattern | None:
    """The vocabulary's added tokens that the tokenizer takes out of a text before it splits it, the longest first."""
    taken = [t for t in tokenizer.get_added_tokens_decoder().values() if not (t.special and tokenizer.encode_special_tokens)]
    if any(t.lstrip or t.rstrip or t.single_word or t.normalized and tokenizer.normalizer is not None for t in taken):
        raise ValueError("Only added tokens that stand for their own text are cut out")
    contents = sorted((t.content.encode() for t in taken if t.content), key=lambda c: (-len(c), c))
    return re.compile(b"|".join(map(re.escape, contents))) if contents else None


def whole(cuts: np.ndarray, raw: np.ndarray, docs: np.ndarray, added: re.Pattern | None) -> np.ndarray:
    """The cuts, with every added token in a text a piece of its own."""
    if added is None:
        return cuts
    data, ends = raw.tobytes(), docs.tolist()
    found = [m.span() for a, b in zip(ends[:-1], ends[1:], strict=True) for m in added.finditer(data, a, b)]
    if not found:
        return cuts
    first, last = np.array(found, np.int64).T
    at = np.searchsorted(first, cuts) - 1  # the token that begins before a cut
    inside = (at >= 0) & (cuts < last[at])
    cuts = np.concatenate([cuts[~inside], first, last])
    return np.unique(cuts[cuts < len(raw)])


def encode(tokenizer, memory: PieceMemory, hasher: Hasher, texts: pa.Array, added: re.Pattern | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts, each closed by END_ID, and where each text begins."""
    raw, docs = text_bytes(texts)
    starts = with_starts(whole(safe_cuts(raw), raw, docs, added), docs, len(raw))
    ends = np.append(starts, len(raw))[1:]
    distinct, first, piece = np.unique(hasher.bytes.runs(hasher.codes[raw], starts, ends), return_index=True, return_inverse=True)

    def fresh(places):
        at = first[places]
        pieces = gather(raw, starts[at], ends[at])
        found, sizes = [np.zeros(0, np.int32)], []
        for a in range(0, len(pieces), PIECES):
            ids = [e.ids for e in tokenizer.encode_batch_fast(pieces[a : a + PIECES].to_pylist(), add_special_tokens=False)]
            sizes.extend(map(len, ids))
            found.append(np.fromiter(chain.from_iterable(ids), np.int32))
        return np.concatenate(found), np.array(sizes, np.int64), np.zeros(len(pieces))

    flat, begin, size, _ = memory.resolve(distinct, fresh)
    # The end id is one more piece after every text.
    flat, begin, size = np.append(flat, np.int32(END_ID)), np.append(begin, len(flat)), np.append(size, 1)
    bounds = np.searchsorted(starts, docs)
    order = np.insert(piece.astype(np.int64).ravel(), bounds[1:], len(distinct))
    own = size[order]
    closed = np.cumsum(own)
    last = bounds[1:] + np.arange(len(docs) - 1)  # place of each end piece
    return flat[expand(begin[order], own)], np.concatenate([[0], closed[last]])


def write_tokens(docs: DataFrame, path: str, vocabulary: str, doc_id: str = "doc_id", text: str = "text", special_as_text: bool = True, **options: str) -> None:
    """Write ``(doc_id, shard, row, before, n_tokens, ids)``; ``before`` counts the ids of the shard before the row.

    With ``special_as_text`` the name of a special token in a text is ordinary text; without, it has the token's id,
    as the library encodes by default.
    """
    bound_batches(docs.sparkSession)
    kind = dict(docs.dtypes)[doc_id]
    with open(vocabulary, encoding="utf-8") as file:
        model = file.read()  # a vocabulary, of fixed size

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from pyspark import TaskContext
        from tokenizers import Tokenizer

        own = f"{zlib.crc32(model.encode())} {special_as_text}"
        tokenizer = process_store(f"tokenizer {own}", lambda: Tokenizer.from_str(model))
        tokenizer.encode_special_tokens = special_as_text
        added = added_tokens(tokenizer)
        memory = process_store(f"pieces {own}", PieceMemory)
        hasher = Hasher(np.ones(256, bool), lower=False)
        shard, row, before = TaskContext.get().partitionId(), 0, 0
        for batch in slices(batches, "text", SLICE):
            ids, bounds = encode(tokenizer, memory, hasher, batch.column(1), added)
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array(np.full(n, shard, np.int32)), pa.array(np.arange(row, row + n, dtype=np.int64)),
                    pa.array(before + bounds[:-1]), pa.array(np.diff(bounds)), lists(ids, bounds, pa.int32()),
                ],
                names=["doc_id", "shard", "row", "before", "n_tokens", "ids"],
            )
            row, before = row + n, before + int(bounds[-1])

    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    rows = rows.withColumn("h", F.xxhash64("text")).repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h")
    shape = f"doc_id {kind}, shard int, row bigint, before bigint, n_tokens bigint, ids array<int>"
    rows.select("doc_id", "text").mapInArrow(write, shape).write.options(**{**WRITE, **options}).parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids)`` of the files of :func:`write_tokens`.

    The table of shards has one row per file written; it is summed from metadata columns only.
    """
    from pyspark.sql import Window

    files = spark.read.parquet(path)
    totals = files.groupBy("shard").agg(F.sum("n_tokens").alias("total"))
    base = totals.select("shard", (F.sum("total").over(Window.orderBy("shard")) - F.col("total")).alias("base"))
    return files.join(F.broadcast(base), "shard").select("doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids")


def with_crc(tokens: DataFrame, ids: str = "ids", to: str = "ids_crc32") -> DataFrame:
    """Replace the id lists by their crc32 as little-endian unsigned 32-bit integers."""
    keep = [f for f in tokens.schema.fields if f.name != ids]

    def crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(ids))
            values = column.flatten().to_numpy(zero_copy_only=False).astype("<u4")
            bounds = np.concatenate([[0], np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))])
            sums = [zlib.crc32(values[a:b].tobytes()) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in keep], pa.array(sums, pa.int64())], names=[*[f.name for f in keep], to])

    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keep)
    return tokens.mapInArrow(crc, f"{shape}, {to} bigint")
