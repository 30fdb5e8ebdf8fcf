"""Document fingerprints by consistent weighted sampling.

A document is a set of weighted terms: its words ``[^\\x20\\x09-\\x0D]+``, with A-Z lower-cased,
weighted by how often they stand in it.  For each of ``samples`` draws, every term has fixed
random numbers ``r, c ~ Gamma(2, 1)`` and ``b ~ U(0, 1)``, and with weight S

    t = floor(ln S / r + b),    ln a = ln c - r (t - b) - r.

The term with the smallest ``a`` is sampled together with its ``t``.  Two documents get the
same sample with a probability equal to their generalised Jaccard similarity, sum of smaller
weights over sum of larger ones (Ioffe, "Improved Consistent Sampling, Weighted Minhash and
L1 Sketching", 2010).  ``a`` depends on term and ``t`` alone, so its value stands for the
sample; a fingerprint keeps 16 bits of each, as four hex digits, and the likeness of two
fingerprints is the share of places where they agree.

All numbers come from hashes of the terms, alike on every executor; ``a`` is computed in
doubles and kept as a single, so the last digits of a processor's logarithm do not matter.
Within a slice of texts each pair of term and weight is drawn once.

:func:`against_next` sorts the documents by id over the cluster and streams each partition,
so a task holds a slice of texts and the row before it.  What stands at the edges of
partitions is stored and paired afterwards.

Defined results: a null text is empty; texts without words share one fingerprint of zeros;
rows with equal ids are ordered by the hash of their text, null ids come last; the next
document of the last row is the first, which may be the row itself; an empty table gives no
rows; columns of the input other than id and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path
from .words import Hasher, mix, slices, space_words

SAMPLES = 128
PAIR_ROWS, ENTRY_ROWS = 2048, 16384  # rows of work arrays


def uniforms(terms: np.ndarray, sample: np.ndarray, number: int) -> tuple[np.ndarray, np.ndarray]:
    """Two numbers in (0, 1) for each term and sample."""
    step = np.uint64((0x9E3779B97F4A7C15 * (2 * number + 1)) % 2**64)
    bits = mix(terms[:, None] + sample[None, :] * step)
    return ((bits >> np.uint64(32)) + 0.5) / 2**32, ((bits & np.uint64(0xFFFFFFFF)) + 0.5) / 2**32


def draws(terms: np.ndarray, weights: np.ndarray, samples: int) -> np.ndarray:
    """``ln a`` of every pair of term hash and weight, ``[pairs, samples]``."""
    sample = mix(np.arange(1, samples + 1, dtype=np.uint64))
    out = np.empty((len(terms), samples), np.float32)
    for i in range(0, len(terms), PAIR_ROWS):
        own = terms[i : i + PAIR_ROWS]
        u, v = uniforms(own, sample, 0)
        r = -np.log(u * v)
        u, v = uniforms(own, sample, 1)
        c = -np.log(u * v)
        b, _ = uniforms(own, sample, 2)
        t = np.floor(np.log(weights[i : i + PAIR_ROWS].astype(float))[:, None] / r + b)
        out[i : i + PAIR_ROWS] = np.log(c) - r * (t - b) - r
    return out


def codes(texts: pa.Array, hasher: Hasher, samples: int = SAMPLES) -> np.ndarray:
    """Sixteen bits of every sample, ``[texts, samples]``; zeros for a text without words."""
    words = hasher.read(texts)
    out = np.zeros((words.rows, samples), np.uint16)
    if not len(words.hash):
        return out
    terms, own = np.unique(words.hash, return_inverse=True)
    row = np.repeat(np.arange(words.rows), words.counts)
    entry, weight = np.unique(row * len(terms) + own, return_counts=True)
    row, own = entry // len(terms), entry % len(terms)
    pairs, own = np.unique(own * (int(weight.max()) + 1) + weight, return_inverse=True)
    drawn = draws(terms[pairs // (int(weight.max()) + 1)], pairs % (int(weight.max()) + 1), samples)
    first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
    least = np.full((len(first), samples), np.inf, np.float32)
    # Whole documents up to a bounded number of entries at a time; a longer one goes in pieces.
    cuts = np.unique(np.concatenate([first[np.searchsorted(first, np.arange(0, len(row), ENTRY_ROWS))[:-1]], np.arange(0, len(row), ENTRY_ROWS), [len(row)]]))
    place = np.cumsum(np.isin(np.arange(len(row)), first)) - 1
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        docs = place[a:b]
        starts = np.flatnonzero(np.concatenate([[True], docs[1:] != docs[:-1]]))
        at = docs[starts]
        least[at] = np.minimum(least[at], np.minimum.reduceat(drawn[own[a:b]], starts, axis=0))
    bits = mix(least.view(np.uint32).astype(np.uint64) + (np.arange(samples, dtype=np.uint64) << np.uint64(32)))
    out[row[first]] = (bits >> np.uint64(48)).astype(np.uint16)
    return out


def as_bytes(values: np.ndarray) -> pa.Array:
    """Codes in big-endian order, so that their hex digits read as four a sample."""
    bounds = np.arange(len(values) + 1, dtype=np.int32) * (2 * values.shape[1])
    return pa.BinaryArray.from_buffers(pa.binary(), len(values), [None, pa.py_buffer(bounds), pa.py_buffer(values.astype(">u2").tobytes())])


def hex_digits(c: str) -> Column:
    return F.lower(F.hex(c)).alias(c)


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", samples: int = SAMPLES) -> DataFrame:
    """``(doc, fingerprint)`` of every document."""
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc"), F.col(f"`{text}`").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(space_words(), lower=True)
        for batch in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column(0), as_bytes(codes(batch.column(1), hasher, samples))], ["doc", "fingerprint"])

    return rows.mapInArrow(run, f"doc {dict(rows.dtypes)['doc']}, fingerprint binary").select("doc", hex_digits("fingerprint"))


def likeness(a: Column | str, b: Column | str) -> Column:
    """Share of samples on which two fingerprints agree: estimates their generalised Jaccard similarity."""
    parts = lambda c: F.regexp_extract_all(c, F.lit("...."), F.lit(0))
    same = F.aggregate(F.zip_with(parts(a), parts(b), lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    return same / (F.length(a) / 4)


# Digests and codes are stored as bytes: half the size of their digits.
RESULT = "n_chars bigint, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"
NAMES = [c.split()[0] for c in RESULT.split(", ")]


def compared(texts: list[str], hasher: Hasher, samples: int) -> list[pa.Array]:
    """Result columns of all texts but the last, each beside the text after it."""
    edited = []
    for text, after in zip(texts[:-1], texts[1:], strict=True):
        gone = len(text) // 4
        edited.append(text[: len(text) - gone] + after[:gone])
    # Texts and edited texts share most terms, so they are drawn together.
    both = codes(pa.array(texts + edited, pa.large_string()), hasher, samples)
    own, other, after = both[: len(edited)], both[len(texts) :], both[1 : len(texts)]
    return [
        pa.array([len(t) for t in texts[:-1]], pa.int64()), pa.array([hashlib.sha256(t.encode()).digest() for t in edited], pa.binary()),
        as_bytes(own), as_bytes(other), pa.array((own == other).mean(axis=1)), pa.array((own == after).mean(axis=1)),
    ]


def against_next(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", samples: int = SAMPLES) -> DataFrame:
    """Every document's fingerprint beside that of its edited text (the last quarter replaced by the start of the next document) and the next document's."""
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    kind = dict(rows.dtypes)["doc"]
    ordered = rows.orderBy(F.asc_nulls_last("doc"), F.xxhash64("text"))
    shape = pa.schema([(n, pa.float64() if n.startswith("near") else pa.int64() if n == "n_chars" else pa.binary()) for n in NAMES])

    def result(ids: pa.Array, texts: list[str], hasher: Hasher) -> list[pa.Array]:
        return [ids, *compared(texts, hasher, samples)]

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, part = Hasher(space_words(), lower=True), TaskContext.get().partitionId()
        held = None

        def edge(ids: pa.Array, text: str, side: int) -> pa.RecordBatch:
            columns = [ids, *[pa.nulls(1, f.type) for f in shape], pa.array([side], pa.int32()), pa.array([part], pa.int32()), pa.array([text], pa.string())]
            return pa.RecordBatch.from_arrays(columns, ["doc", *NAMES, "side", "part", "text"])

        for batch in slices(batches, "text"):
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            if held is None:
                yield edge(ids.slice(0, 1), texts[0], 1)
            else:
                ids, texts = pa.concat_arrays([held[0], ids]), [held[1], *texts]
            n = len(texts) - 1
            held = ids.slice(n, 1), texts[n]
            if n:
                columns = [*result(ids.slice(0, n), texts, hasher), pa.array(np.zeros(n), pa.int32()), pa.array(np.full(n, part), pa.int32()), pa.nulls(n, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["doc", *NAMES, "side", "part", "text"])
        if held is not None:
            yield edge(*held, 2)

    path = scratch_path(spark, "fingerprints")
    ordered.mapInArrow(stream, f"doc {kind}, {RESULT}, side int, part int, text string").write.parquet(path)
    stored = spark.read.parquet(path)
    inner = stored.where("side = 0").select("doc", *NAMES)
    shown = ["doc", *[hex_digits(n) if n.endswith(("sha256", "fingerprint")) else n for n in NAMES]]
    parts = [r["part"] for r in stored.where("side = 1").select("part").orderBy("part").collect()]  # one number a partition
    if not parts:
        return inner.select(*shown)
    after = spark.createDataFrame(list(zip(parts, [*parts[1:], parts[0]], strict=True)), "part int, after int")
    last = stored.where("side = 2").select("doc", "text", "part").join(after, "part")
    first = stored.where("side = 1").select(F.col("part").alias("after"), F.col("text").alias("next"))

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(space_words(), lower=True)
        for batch in batches:
            for i in range(batch.num_rows):
                texts = [batch.column(1)[i].as_py(), batch.column(2)[i].as_py()]
                yield pa.RecordBatch.from_arrays(result(batch.column(0).slice(i, 1), texts, hasher), ["doc", *NAMES])

    return inner.unionByName(last.join(first, "after").select("doc", "text", "next").mapInArrow(pair, f"doc {kind}, {RESULT}")).select(*shown)
