"""Texts and runs of ids as flat numpy arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts in a row, and where each begins; null is empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    buffer = texts.buffers()[2]
    raw = np.frombuffer(buffer, np.uint8)[offsets[0] : offsets[-1]] if buffer is not None and len(buffer) else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def expand(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices ``start, start + 1, ...`` of every run, one run after the other."""
    total = np.cumsum(lengths)
    return np.repeat(starts - (total - lengths), lengths) + np.arange(total[-1] if len(total) else 0)


def with_starts(cuts: np.ndarray, docs: np.ndarray, n: int) -> np.ndarray:
    """The cuts and the starts of the texts that are not empty, in order."""
    cut = np.zeros(n, bool)
    cut[cuts] = True
    cut[docs[:-1][docs[1:] > docs[:-1]]] = True
    return np.flatnonzero(cut)
