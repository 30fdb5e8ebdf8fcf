"""Words and word n-grams of whole texts as numpy arrays, for use inside tasks.

A slice of rows is handled as one byte buffer: byte tables find the words, a
polynomial over the bytes gives every word a 64-bit hash, and a polynomial over
the word hashes gives every n-gram one.  A null text is an empty text.  Slices
are bounded in bytes (one longer text makes a slice of its own), so memory
follows the longest text, not the batch.

Hashes are seeded constants, alike on every executor.  They stand for the words:
two different n-grams of the corpus share a hash with probability 2**-64 a pair.
Where a result hangs on single matches the callers compare the words themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
BASE = 0x9E3779B97F4A7C15 | 3  # odd, 3 modulo 4: powers differ from 1 by few factors of two
WORD_BASE = 0xD1342543DE82EF95 | 3


def byte_table(chars: str) -> np.ndarray:
    """True for the bytes of ``chars``."""
    out = np.zeros(256, bool)
    out[list(chars.encode("latin-1"))] = True
    return out


SPACES = "\t\n\x0b\x0c\r "


def space_words() -> np.ndarray:
    """Word bytes of ``[^\\x20\\x09-\\x0D]+``."""
    return ~byte_table(SPACES)


def letter_words() -> np.ndarray:
    """Word bytes of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``."""
    return byte_table("0123456789abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, range(128, 256))))


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values."""
    values = np.sort(values)
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    return values[new]


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def reach(self, n: int) -> None:
        if len(self.up) < n:
            size = max(1 << 16, n + n // 4)
            for name, base in (("up", self.base), ("down", self.inverse)):
                factors = np.full(size, base, np.uint64)
                factors[0] = 1
                setattr(self, name, np.cumprod(factors, dtype=np.uint64))

    def runs(self, values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Polynomial hash of ``values[start:end]`` for every pair of bounds."""
        self.reach(len(values) + 1)
        total = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * self.up[: len(values)], dtype=np.uint64, out=total[1:])
        return mix((total[ends] - total[starts]) * self.down[starts])


class Hasher:
    """Reads slices of texts as words; one per task."""

    def __init__(self, is_word: np.ndarray, lower: bool):
        self.is_word, self.lower = is_word, lower
        self.codes = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))
        self.bytes, self.grams = Powers(BASE), Powers(WORD_BASE)

    def read(self, texts: pa.Array, hashes: bool = True) -> "Words":
        return Words(self, texts, hashes)


class Words:
    """Words of a slice: ``starts``/``ends`` in bytes, ``bounds[d]:bounds[d + 1]`` the words of row d."""

    def __init__(self, hasher: Hasher, texts: pa.Array, hashes: bool):
        texts = texts.cast(pa.large_string()).fill_null("")
        offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
        buffer = texts.buffers()[2]
        raw = np.frombuffer(buffer, np.uint8)[offsets[0] : offsets[-1]] if buffer is not None and len(buffer) else np.zeros(0, np.uint8)
        self.hasher, self.raw, self.docs, self.rows = hasher, raw, offsets - offsets[0], len(texts)
        data = raw
        if hasher.lower:
            data = raw + ((raw >= 65) & (raw <= 90)).astype(np.uint8) * np.uint8(32)
        self.data = data
        n = len(data)
        word = hasher.is_word[data]
        before, after = np.zeros(n, bool), np.zeros(n, bool)
        before[1:], after[:-1] = word[:-1], word[1:]
        edges = self.docs[(self.docs > 0) & (self.docs < n)]
        before[edges], after[edges - 1] = False, False
        self.starts = np.flatnonzero(word & ~before)
        self.ends = np.flatnonzero(word & ~after) + 1
        self.bounds = np.searchsorted(self.starts, self.docs)
        self.counts = np.diff(self.bounds)
        self.hash = hasher.bytes.runs(hasher.codes[data], self.starts, self.ends) if hashes else None

    def grams(self, k: int, short: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(hash, first word, row)`` of all runs of k words inside a row, in order.

        With ``short``, a row of fewer words, but not none, gives one run of all its words.
        """
        per = np.maximum(self.counts - (k - 1), 0)
        if short:
            per = np.where((per == 0) & (self.counts > 0), 1, per)
        row = np.repeat(np.arange(self.rows), per)
        first = np.arange(len(row)) - np.repeat(np.cumsum(per) - per, per) + self.bounds[row]
        last = np.minimum(first + k, self.bounds[row + 1])
        return self.hasher.grams.runs(self.hash, first, last), first, row

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()

    def phrase(self, first: int, last: int) -> bytes:
        return b" ".join(self.word(i) for i in range(first, last))


def gather(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """``data[start:end]`` as an Arrow string array."""
    lengths = ends - starts
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(lengths, out=offsets[1:])
    source = np.repeat(starts - offsets[:-1], lengths) + np.arange(offsets[-1])
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[source])))


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches into runs of rows of about ``limit`` bytes of text."""
    import pyarrow.compute as pc

    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0).to_numpy(zero_copy_only=False)
        run = (np.cumsum(size.astype(np.int64)) - size) // limit
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(run)) + 1, [batch.num_rows]])
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield batch.slice(int(a), int(b - a))


def lists(values: np.ndarray, bounds: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Arrow list array with ``values[bounds[i]:bounds[i + 1]]``."""
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values, kind))
