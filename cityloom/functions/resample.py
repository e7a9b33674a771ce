"""Bootstrap multiplicities of many replicates at once, as numpy blocks inside Arrow tasks."""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

# tasks get these functions with the plan, so executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Cumulative Poisson(1) probabilities for 0..11 events; what is left lies below the resolution of the draws.
POISSON_CDF = [
    0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183,
    0.9999167588507119, 0.9999897508033253, 0.999998874797402, 0.9999998885745217, 0.9999999899522336, 0.9999999991683892,
]

_P = 2147483647
#: draws of one block: rows of a batch times replicates, small enough to stay in the cache
BLOCK = 1 << 15


def _first_at(c: float) -> int:
    """Smallest whole draw whose quotient by the modulus reaches ``c``."""
    h = int(c * _P)
    while h / float(_P) >= c:
        h -= 1
    while h / float(_P) < c:
        h += 1
    return h


_MARKS = [_first_at(c) for c in POISSON_CDF]


def uniform_block(seed: int, keys: np.ndarray, reps: np.ndarray) -> np.ndarray:
    """Draws of ``numeric.hash_uniform`` for every replicate (row) and key (column)."""
    a, b = np.fmod(keys, _P)[None, :], np.fmod(reps, _P)[:, None]
    h = np.fmod(a * 48271 + b * 69621 + seed, _P)
    h = np.fmod(h * h + b * 16807 + a * 11, _P)
    h = np.fmod(h * h + a * 40692 + 7, _P)
    return h / float(_P)


def poisson_times(u: np.ndarray) -> np.ndarray:
    """Poisson(1) multiplicity of uniform draws: how many of the cumulative probabilities each reaches."""
    return np.searchsorted(POISSON_CDF, u, "right")


class Draws:
    """Multiplicities of blocks of replicates (rows) and keys (columns): those of ``poisson_times(uniform_block(...))``.

    The modulus is 2^31 - 1, so remainders are two shifted additions; the first sum stays below 2^32 and its square with the
    next summands below 2^64. Only the last remainder is made unique. Keys below zero take the plain way.
    """

    def __init__(self, seed: int, keys: np.ndarray):
        self.seed, self.keys = seed, keys
        self.plain = seed < 0 or bool((keys < 0).any())
        a = (keys % _P).astype(np.uint64)
        self.first, self.second, self.third = (a * 48271) % _P, (a * 11) % _P, (a * 40692 + 7) % _P

    def __call__(self, reps: np.ndarray) -> np.ndarray:
        if self.plain:
            return poisson_times(uniform_block(self.seed, self.keys, reps)).astype(np.uint8)
        b, p, s = (reps % _P).astype(np.uint64)[:, None], np.uint64(_P), np.uint64(31)
        x = self.first + (b * 69621 + np.uint64(self.seed % _P)) % p
        high = self.second + (b * 16807) % p
        x *= x
        x += high
        for last in (False, True):
            if last:
                x *= x
                x += self.third
            for _ in range(2):
                np.right_shift(x, s, out=high)
                x &= p
                x += high
        h = x.astype(np.uint32)
        np.minimum(h, h - np.uint32(_P), out=h)
        times, over = np.zeros(h.shape, np.uint8), np.empty(h.shape, bool)
        for mark in _MARKS:
            np.greater_equal(h, np.uint32(mark), out=over)
            times += over.view(np.uint8)
        return times


def replicate_sums(n_boot: int, seed: int, n_sums: int):
    """Per task the sums of ``n_sums`` columns (after the key) over the rows each replicate draws, as often as it draws them."""

    def run(batches):
        sums, seen = np.zeros((n_boot, n_sums)), False
        reps = np.arange(1, n_boot + 1, dtype=np.int64)
        for batch in batches:
            keys = batch.column(0).to_numpy()
            values = np.stack([batch.column(c + 1).fill_null(0.0).to_numpy(zero_copy_only=False) for c in range(n_sums)], axis=1)
            seen |= len(keys) > 0
            for at in range(0, len(keys), BLOCK // 8):
                some = slice(at, at + BLOCK // 8)
                draws, step = Draws(seed, keys[some]), max(1, BLOCK // len(keys[some]))
                for lo in range(0, n_boot, step):
                    sums[lo : lo + step] += draws(reps[lo : lo + step]).astype(float) @ values[some]
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(reps), *map(pa.array, sums.T)], names=["_b", *(f"_s{c}" for c in range(n_sums))])

    return run
