"""Equal rows of a forest: merged before trees grow and before they are applied, with the same results."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from cityloom.functions import resample as R, trees as T
from cityloom.operators import model as M


def test_equal_rows_are_merged_without_another_tree(spark):
    """Copies of a row are grown as one with the sum of their draws, beyond the bits of a single draw."""
    rng = np.random.default_rng(11)
    x, y, t = rng.integers(0, 4, (6000, 3)).astype(np.uint8), rng.integers(0, 3, 6000), rng.integers(1, 9, 6000)
    order, starts = T.distinct(np.c_[x, y.astype(np.uint8)])
    sums, first = np.add.reduceat(t[order], starts), order[starts]
    assert len(starts) == len({(*a, b) for a, b in zip(map(tuple, x), y)}) and sums.max() > 15
    a, gain = T.grow(x, y, t, np.ones(3), 2, 9, np.random.default_rng(1))
    b, again = T.grow(x[first], y[first], sums, np.ones(3), 2, 9, np.random.default_rng(1))
    assert all((p == q).all() for p, q in zip(a, b)) and np.allclose(gain, again)
    rows = spark.range(5000).withColumnRenamed("id", "val_id").select(F.col("val_id").alias("_k"), (F.col("val_id") % 3).cast("int").alias("_y"), F.lit(9).alias("_fold"),
                     F.array((F.col("val_id") % 4).cast("double"), (F.col("val_id") % 2).cast("double")).alias("_x"))
    cuts = {-1: [np.array([0.5, 1.5, 2.5]), np.array([0.5])]}
    blocks = M._merged(rows, [-1], cuts, 5000).collect()
    assert sum(len(r.k) // 8 for r in blocks) == 5000 and sum(r.n for r in blocks) == 12
    drawn = sum(int(t.sum()) for _, _, _, _, t in M._dealt([_batch(blocks)], [(-1, 0, 1)], 7))
    assert drawn == int(R.Draws(7, np.arange(5000))(np.array([1])).sum())


def _batch(rows):
    names = ["forest", "n", "k", "starts", "x", "y"]
    return pa.RecordBatch.from_pydict({c: [bytes(r[c]) if isinstance(r[c], bytearray) else r[c] for r in rows] for c in names})
