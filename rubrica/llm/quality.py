"""Quality rules: shape of the text and fertility under a public vocabulary.

One pass over the documents, no shuffle.  Words, lines and 8-word windows come from
byte arrays; the vocabulary encodes each distinct word of a slice once.  Fertility is
characters per token, the share of byte-fallback tokens and the entropy of the tokens
in bits, as a share of the most that so many tokens of that vocabulary can have.  A document is kept if the base
rules pass and each measure lies in the band of its language and length, or of its
script where the language has none.

Defined results: null or wordless text has zero counts, fails the base rule and has
null measures; unknown or null languages use the script's band; a column of the
documents with the name of a result column gives way to it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import bound_batches
from .memory import PieceMemory, process_store
from .token_arrays import expand
from .words import Hasher, byte_table, gather, mix, slices, space_words

SLICE = 1 << 20
WINDOW = 8
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30

#: Token counts from which the next edges of a band hold: both measures fall with length.
STEPS = (0, 50, 100, 200, 400, 800, 1600, 3200, 6400)
#: Rejection bands: characters per token (low, high), highest byte-fallback share, lowest
#: entropy as a share of the most that so many tokens can have.  Languages first, then
#: scripts; an edge is one number or one for each of STEPS.  The low edges lie just below
#: the lowest document labelled good of that language and length (2 percent and 0.01; for
#: short documents, of which few are labelled, 5 percent and 0.05).  No labelled document
#: is too high or has byte-fallback tokens, so those edges only bound what is no prose.
BANDS = {
    "en": ((1.52, 1.63, 1.53, 1.82, 1.88, 1.93, 2.03, 2.11, 2.09), 8.0, 0.10, (0.75, 0.74, 0.75, 0.70, 0.66, 0.61, 0.57, 0.53, 0.46)),
    "fr": ((1.35, 1.35, 1.48, 1.62, 1.74, 1.82, 1.87, 1.90, 1.92), 8.0, 0.10, (0.75, 0.75, 0.74, 0.68, 0.64, 0.59, 0.55, 0.51, 0.45)),
    "de": ((1.52, 1.52, 1.72, 1.90, 1.92, 1.93, 2.09, 2.12, 2.12), 8.0, 0.10, (0.75, 0.75, 0.74, 0.70, 0.64, 0.60, 0.55, 0.51, 0.46)),
    "es": ((1.44, 1.44, 1.50, 1.66, 1.74, 1.77, 1.83, 1.86, 1.88), 8.0, 0.10, (0.75, 0.75, 0.73, 0.69, 0.64, 0.60, 0.56, 0.52, 0.44)),
    "latin": ((1.35, 1.35, 1.48, 1.62, 1.74, 1.77, 1.83, 1.86, 1.88), 8.0, 0.15, (0.74, 0.74, 0.73, 0.68, 0.64, 0.59, 0.55, 0.51, 0.44)),
    "other": (0.2, 6.0, 0.90, 0.30),
}
FOUND = (
    "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, n_tokens bigint, "
    "chars_per_token double, byte_share double, entropy_share double, latin_share double"
)
COLUMNS = [part.split()[0] for part in FOUND.split(", ")]


def repeats(row: np.ndarray, values: np.ndarray) -> np.ndarray:
    """For every entry, how many entries of its row have its value."""
    _, back, n = np.unique(values ^ mix(row.astype(np.uint64) + np.uint64(1)), return_inverse=True, return_counts=True)
    return n[back]


def per_row(marks: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(marks, dtype=np.int64)])
    return total[bounds[1:]] - total[bounds[:-1]]


def measure(w, processor, is_byte: np.ndarray, memory: PieceMemory) -> list[np.ndarray]:
    """The columns of FOUND for one slice."""
    raw, docs, rows = w.raw, w.docs, w.rows
    points = (raw & 0xC0) != 0x80
    inside = w.hasher.is_word[raw]
    chars = per_row(points & inside, docs)
    symbols = per_row(byte_table(SYMBOLS)[raw], docs)
    # Lines: cut at line feeds and at the ends of rows.
    feeds = np.flatnonzero(raw == 10)
    ends = np.sort(np.concatenate([feeds, docs[1:]]))
    starts = np.sort(np.concatenate([feeds + 1, docs[:-1]]))
    row = np.repeat(np.arange(rows), 1 + per_row(raw == 10, docs))
    worded = np.searchsorted(w.starts, starts) < np.searchsorted(w.starts, ends)
    line = w.hasher.bytes.runs(w.hasher.codes[raw], starts[worded], ends[worded])
    own = row[worded]
    first = np.zeros(len(line), bool)
    first[np.unique(line ^ mix(own.astype(np.uint64) + np.uint64(1)), return_index=True)[1]] = True
    dup_lines = np.bincount(own[~first], minlength=rows)
    gram, at, of = w.grams(WINDOW)
    twice = at[repeats(of, gram) > 1] if len(gram) else at
    change = np.zeros(len(w.starts) + 1, np.int64)
    np.add.at(change, twice, 1)
    np.add.at(change, twice + WINDOW, -1)
    repeated = per_row(np.cumsum(change)[:-1] > 0, w.bounds)
    # Tokens of the distinct words, dealt back to the rows.
    distinct, place, word = np.unique(w.hash, return_index=True, return_inverse=True)

    def fresh(new):
        ids = processor.encode(gather(raw, w.starts[place[new]], w.ends[place[new]]).to_pylist(), num_threads=1)
        return np.fromiter(chain.from_iterable(ids), np.int32), np.fromiter(map(len, ids), np.int64, len(ids)), np.zeros(len(ids))

    flat, begin, length, _ = memory.resolve(distinct, fresh)
    word = word.ravel()
    tokens = flat[expand(begin[word], length[word])].astype(np.int64)
    token_bounds = np.concatenate([[0], np.cumsum(length[word])])[w.bounds]
    n_tokens = np.diff(token_bounds)
    bytes_ = per_row(is_byte[tokens], token_bounds)
    key = np.repeat(np.arange(rows), n_tokens) * len(is_byte) + tokens
    key, n = np.unique(key, return_counts=True)
    entropy = np.bincount(key // len(is_byte), n * np.log2(n), minlength=rows)
    with np.errstate(divide="ignore", invalid="ignore"):
        total = np.log2(n_tokens)
        entropy = np.where(n_tokens > 1, (total - entropy / n_tokens) / np.log2(np.minimum(n_tokens, len(is_byte))), 1.0)
        per_token, share = chars / n_tokens, bytes_ / n_tokens
        # Latin: ASCII letters and the two-byte blocks up to U+024F (first bytes C3 to C9).
        letters = ((raw | 32) >= 97) & ((raw | 32) <= 122)
        latin = per_row(letters | ((raw >= 0xC3) & (raw <= 0xC9)), docs)
        foreign = per_row(raw >= 0xCA, docs)
        latin_share = latin / (latin + foreign)
    return [w.counts.astype(np.int64), chars, symbols, dup_lines.astype(np.int64), repeated, n_tokens, per_token, share, entropy, latin_share]


def text_measures(docs: DataFrame, vocabulary: str, text: str = "text") -> DataFrame:
    """The documents with the columns of FOUND."""
    bound_batches(docs.sparkSession)
    with open(vocabulary, "rb") as file:
        model = file.read()  # a vocabulary, of fixed size
    rows = docs.drop(*COLUMNS)
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        processor = process_store(f"pieces {zlib.crc32(model)}", lambda: sentencepiece.SentencePieceProcessor(model_proto=model))
        is_byte = np.array([processor.is_byte(i) for i in range(processor.vocab_size())])
        hasher = Hasher(space_words(), lower=False)
        memory = process_store(f"fertility {zlib.crc32(model)}", PieceMemory)
        for batch in slices(batches, text, SLICE):
            found = measure(hasher.read(batch.column(batch.schema.get_field_index(text))), processor, is_byte, memory)
            arrays = [pa.array(x) if x.dtype != float else pa.array(x, from_pandas=True) for x in found]
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], names=[*batch.schema.names, *COLUMNS])

    return rows.mapInArrow(read, f"{shape}, {FOUND}")


def edge(values: float | tuple[float, ...]) -> Column:
    """The edge that holds for a row's number of tokens."""
    if not isinstance(values, tuple):
        return F.lit(values)
    out = F.lit(values[0])
    for step, value in zip(STEPS[1:], values[1:], strict=True):
        out = F.when(F.col("n_tokens") >= step, F.lit(value)).otherwise(out)
    return out


def quality(docs: DataFrame, vocabulary: str, text: str = "text", lang: str = "lang", bands: dict | None = None) -> DataFrame:
    """The documents with their measures, ``base_failed`` and ``kept``."""
    bands = bands or BANDS
    found = text_measures(docs.drop("base_failed", "kept"), vocabulary, text)
    script = F.when(F.coalesce(F.col("latin_share"), F.lit(1.0)) >= 0.5, "latin").otherwise("other")
    named = F.when(F.col(f"`{lang}`").isin([k for k in bands if k not in ("latin", "other")]), F.col(f"`{lang}`")) if lang in docs.columns else F.lit(None)
    # A text in another script than its language's falls back to the script's band.
    band = F.when(script == "latin", F.coalesce(named, script)).otherwise(script)
    fits = F.lit(False)
    for name, (low, high, most_bytes, least_entropy) in bands.items():
        fits = fits | (
            (band == name)
            & F.col("chars_per_token").between(edge(low), edge(high))
            & (F.col("byte_share") <= edge(most_bytes))
            & (F.col("entropy_share") >= edge(least_entropy))
        )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return found.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & F.coalesce(fits, F.lit(False)))
