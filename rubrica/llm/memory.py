"""What a worker process remembers from task to task: ids of text pieces met before.

Workers outlive tasks, and most pieces of a text are words met before.  A memory is a
cache of bounded size: losing it costs time and nothing else.  Pieces are told apart by
64-bit hashes.
"""

from __future__ import annotations

import sys
import types
from collections.abc import Callable

import numpy as np

from .token_arrays import expand

LIMIT = 600_000


def process_store(key: str, make: Callable):
    """``make()`` the first time in this process, the same object afterwards."""
    held = sys.modules.setdefault("__rubrica_llm_process__", types.ModuleType("__rubrica_llm_process__")).__dict__
    if key not in held:
        held[key] = make()
    return held[key]


class PieceMemory:
    """Sorted hashes beside lists of ids and a number for each piece."""

    def __init__(self, limit: int = LIMIT):
        self.limit = limit
        self.clear()

    def clear(self) -> None:
        self.hash, self.ids = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.begin, self.size, self.cost = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Place of each hash, -1 where it is new."""
        if not len(self.hash):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.hash, hashes), len(self.hash) - 1)
        return np.where(self.hash[at] == hashes, at, -1)

    def add(self, hashes: np.ndarray, sizes: np.ndarray, ids: np.ndarray, costs: np.ndarray) -> None:
        if len(self.hash) + len(hashes) > self.limit:
            self.clear()
        begin = len(self.ids) + np.cumsum(sizes) - sizes
        self.hash, first = np.unique(np.concatenate([self.hash, hashes]), return_index=True)
        self.begin, self.size = np.concatenate([self.begin, begin])[first], np.concatenate([self.size, sizes])[first]
        self.cost, self.ids = np.concatenate([self.cost, costs])[first], np.concatenate([self.ids, ids])

    def resolve(self, hashes: np.ndarray, encode: Callable) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """``(ids, begin, size, cost)`` of sorted distinct hashes.

        ``encode(places)`` gives ``(ids, sizes, costs)`` of the pieces at places of ``hashes`` that are new.
        """
        place = self.find(hashes)
        new = place < 0
        at = place[~new]
        old = self.ids[expand(self.begin[at], self.size[at])]
        size, cost, begin = np.zeros(len(hashes), np.int64), np.zeros(len(hashes)), np.zeros(len(hashes), np.int64)
        size[~new], cost[~new] = self.size[at], self.cost[at]
        begin[~new] = np.cumsum(size[~new]) - size[~new]
        ids, sizes, costs = encode(np.flatnonzero(new))
        size[new], cost[new] = sizes, costs
        begin[new] = len(old) + np.cumsum(sizes) - sizes
        # What is needed was taken out before the memory may start anew.
        self.add(hashes[new], sizes, ids, costs)
        return np.concatenate([old, ids]), begin, size, cost
