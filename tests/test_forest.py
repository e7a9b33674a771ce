"""Forest: cuts against brute force, trees that never gather on the driver, branches of bounded size."""

import numpy as np
import pytest
from pyspark.sql import DataFrame, functions as F

from cityloom.functions import trees as T
from cityloom.operators import model as M


def _brute(x, y, t, cw):
    """Highest decrease of weighted Gini impurity over all features and cuts."""
    def q(rows):
        w = np.bincount(y[rows], weights=t[rows], minlength=len(cw)) * cw
        return (w**2).sum() / w.sum()

    every = np.ones(len(y), bool)
    best = (0.0, None)
    for f in range(x.shape[1]):
        for c in np.unique(x[:, f])[:-1]:
            low = x[:, f] <= c
            gain = q(low) + q(~low) - q(every)
            if gain > best[0] + 1e-9:
                best = (gain, (f, c))
    return best


@pytest.mark.parametrize("n", [12, 40, 4000])
def test_first_cut_is_the_best_one(n):
    rng = np.random.default_rng(n)
    x, y, t = rng.integers(0, 9, (n, 5)).astype(np.uint8), rng.integers(0, 3, n), rng.integers(1, 4, n)
    x[:, 3] = np.where(y == 1, 7, x[:, 3])
    cw = np.array([1.0, 2.5, 0.5])
    tree, gains = T.grow(x, y, t, cw, 5, 1, np.random.default_rng(1))
    gain, (f, c) = _brute(x, y, t, cw)
    assert gains.sum() == pytest.approx(gain) and (tree.feature[0], tree.cut[0]) == (f, c)
    h = T.histogram(x, y, t, np.arange(5), 3)
    (feature, cut, got, below, above), _ = T.best_of_histogram(h, np.arange(5), cw)
    assert (feature, cut) == (f, c) and got == pytest.approx(gain) and (below, above) == ((x[:, f] <= c).sum(), (x[:, f] > c).sum())


def test_full_tree_names_every_row_and_ignores_order():
    rng = np.random.default_rng(3)
    x, y, t = rng.integers(0, 30, (3000, 6)).astype(np.uint8), rng.integers(0, 4, 3000), rng.integers(1, 5, 3000)
    _, first, same = np.unique(x, axis=0, return_index=True, return_inverse=True)
    y = y[first][same.ravel()]
    tree, _ = T.grow(x, y, t, np.ones(4), 6, 60, np.random.default_rng(1))
    assert (T.votes(tree, x).argmax(axis=1) == y).all()
    p = rng.permutation(3000)
    again, _ = T.grow(x[p], y[p], t[p], np.ones(4), 6, 60, np.random.default_rng(1))
    assert all((a == b).all() for a, b in zip(tree, again))


def _rows(spark, n=600):
    label = F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit("c")), (F.col("id") % 3 + 1).cast("int"))
    x = F.array((F.col("id") % 3).cast("double"), (F.col("id") * 7919 % 101).cast("double"), F.lit(5.0), (F.col("id") % 2).cast("double"))
    return spark.range(n).select(F.col("id").alias("val_id"), F.col("id").alias("bid"), label.alias("truth_arch"), x.alias("features"), (F.col("id") % 5).cast("int").alias("fold"))


def test_trees_stay_in_tables_and_branches_stay_small(spark):
    """No tree reaches the driver and no task grows more than the rows of a branch; any layout gives the same result."""
    df = _rows(spark)
    labels = M.class_labels(df)
    small = M.fit_forests(df, labels, [M.WHOLE], 12, 1, 30, branch_rows=50)
    whole = M.fit_forests(df.repartition(7), labels, [M.WHOLE], 12, 1, 30)
    assert isinstance(small.trees, DataFrame) and not whole.tops and len(small.tops) == 12
    assert whole.trees.count() == 12 and small.trees.count() > 12 * 4
    got = {}
    for name, forest in (("small", small), ("whole", whole), ("again", M.fit_forests(df, labels, [M.WHOLE], 12, 1, 30))):
        pred = M.predict(forest, df, labels, ["bid", "truth_arch"])
        got[name] = sorted(tuple(r) for r in pred.collect())
        assert len(got[name]) == 600 and sum(r[1] == r[2] for r in got[name]) == 600
        imp = M.importances(forest)
        assert sum(imp) == pytest.approx(1) and imp[2] == 0 and max(imp) == imp[0]
    assert got["whole"] == got["again"]


def test_out_of_fold_never_sees_its_fold(spark):
    """A label that only one fold holds cannot be predicted there."""
    df = _rows(spark, 300).withColumn("truth_arch", F.when(F.col("fold") == 2, "only").otherwise(F.col("truth_arch")))
    out = M.out_of_fold(df, M.class_labels(df), 5, 10)
    assert out.count() == 300 and out.where("fold = 2 and pred_class = 'only'").count() == 0
