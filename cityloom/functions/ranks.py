"""Exact weighted medians of what lies around a point, from rows that stream by in order of value."""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

# executors need no copy of this module
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: pairs of points tested at a time
_PIECE = 1 << 20

ASK, COUNT, PICK = 0, 1, 2


class Block:
    """Points of one block with their counts and the two middle values of their neighbours."""

    def __init__(self, x: np.ndarray, y: np.ndarray, value: np.ndarray):
        self.x, self.y, self.value = x, y, value
        self.total, self.passed = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
        self.low, self.high = np.full(len(x), np.nan), np.full(len(x), np.nan)

    def add(self, x: np.ndarray, y: np.ndarray, value: np.ndarray) -> Block:
        return Block(np.append(self.x, x), np.append(self.y, y), np.append(self.value, value))

    def _weights(self, rows: np.ndarray, x, y, value, n, radius: float) -> np.ndarray:
        """How often each of the given values counts for each point of ``rows``: a point is not its own neighbour."""
        dx, dy = self.x[rows, None] - x, self.y[rows, None] - y
        own = (dx == 0) & (dy == 0) & (self.value[rows, None] == value)
        return np.where(np.hypot(dx, dy) <= radius, n - own, 0)

    def meet(self, x, y, value, n, radius: float, pick: bool) -> None:
        """Count the neighbours, or, with all counted and values ascending, step through the ranks to the middle ones."""
        step = max(1, _PIECE // max(len(self.x), 1))
        for a in range(0, len(x), step):
            part = [c[a : a + step] for c in (x, y, value, n)]
            if not pick:
                self.total += self._weights(slice(None), *part, radius).sum(axis=1)
                continue
            rows = np.flatnonzero(np.isnan(self.high) & (self.total > 0))
            if not len(rows):
                return
            upto = self.passed[rows, None] + self._weights(rows, *part, radius).cumsum(axis=1)
            for out, rank in ((self.low, (self.total[rows] - 1) // 2), (self.high, self.total[rows] // 2)):
                first = (upto > rank[:, None]).argmax(axis=1)
                found = (upto[:, -1] > rank) & np.isnan(out[rows])
                out[rows[found]] = part[2][first[found]]
            self.passed[rows] = upto[:, -1]

    def result(self) -> pa.RecordBatch:
        middle = 0.5 * self.low + 0.5 * self.high
        return pa.RecordBatch.from_arrays(
            [pa.array(c) for c in (self.x, self.y, self.value, self.total)] + [pa.array(middle, mask=np.isnan(middle))],
            names=["x", "y", "value", "n", "median"],
        )


def medians(radius: float):
    """Task over ``tx, ty, part, role, x, y, value, n`` sorted by block and role, values ascending: a row per asking point.

    A task holds one block of points; what surrounds them passes by, once to be counted and once to be picked from.
    """

    def run(batches):
        key, block = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            tx, ty, part, role, x, y, value, n = (c.to_numpy() for c in batch.columns)
            change = (tx[1:] != tx[:-1]) | (ty[1:] != ty[:-1]) | (part[1:] != part[:-1]) | (role[1:] != role[:-1])
            ends = np.append(np.flatnonzero(change) + 1, len(tx))
            for a, b in zip(np.append(0, ends[:-1]), ends, strict=True):
                own = (tx[a], ty[a], part[a])
                if own != key:
                    if block is not None:
                        yield block.result()
                    key, block = own, Block(x[:0], y[:0], value[:0])
                if role[a] == ASK:
                    block = block.add(x[a:b], y[a:b], value[a:b])
                else:
                    block.meet(x[a:b], y[a:b], value[a:b], n[a:b], radius, role[a] == PICK)
        if block is not None:
            yield block.result()

    return run
