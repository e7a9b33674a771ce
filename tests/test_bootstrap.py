"""Draws of the bootstrap against the plain formula, and how they are spread over tasks."""

import numpy as np
from pyspark.sql import functions as F

from cityloom.functions import resample
from cityloom.operators import evaluation as E, sampling as R


def test_draws_equal_the_plain_formula():
    p = 2147483647
    rng = np.random.default_rng(1)
    for seed in (0, 1, 20260712, p - 1, p, 5 * p + 3):
        keys = np.r_[0, 1, 7, p - 1, p, p + 1, 2**40, 2**62, rng.integers(0, 2**33, 500)].astype(np.int64)
        reps = np.r_[1:60, 9999, 10000].astype(np.int64)
        want = resample.poisson_times(resample.uniform_block(seed, keys, reps))
        assert (resample.Draws(seed, keys)(reps) == want).all()
        assert (resample.Draws(seed, -keys)(reps) == resample.poisson_times(resample.uniform_block(seed, -keys, reps))).all()
    for mark, c in zip(resample._MARKS, resample.POISSON_CDF):
        assert mark / p >= c > (mark - 1) / p


def test_draws_are_made_by_many_tasks(spark, monkeypatch):
    """A table of one file is few bytes and many draws; tasks follow its rows."""
    monkeypatch.setattr(R, "DRAW_ROWS", 100)
    seen = []
    real = R.replicate_sums

    def spy(n_boot, seed, n_sums):
        run = real(n_boot, seed, n_sums)

        def counted(batches):
            batches = list(batches)
            assert sum(b.num_rows for b in batches) <= 200
            yield from run(iter(batches))

        seen.append(n_sums)
        return counted

    monkeypatch.setattr(R, "replicate_sums", spy)
    df = spark.range(0, 1000, 1, 1).select("id", (F.col("id") % 4 != 0).alias("h"))
    r = R.poisson_bootstrap(df, "id", F.col("h"), F.lit(1.0), 500, 1).first()
    assert r["value"] == 0.75 and r["ci95_lo"] < 0.75 < r["ci95_hi"] and r["n"] == 1000 and seen == [2]


def test_scopes_share_their_draws(spark):
    df = spark.range(300).select("id", F.lit("a").alias("truth_arch"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("pred_class"),
                                 F.when(F.col("id") % 50 != 0, 1.0 + F.col("id") % 5).alias("gfa_m2"), (F.col("id") % 2 == 0).alias("inside"))
    both = E.accuracy_with_intervals(df, "id", {"all": F.lit(True), "in": F.col("inside")}, 300, 5).collect()
    hit = F.col("truth_arch") == F.col("pred_class")
    assert [(r["denominator"], r["metric"], r["n"]) for r in both] == [
        ("all", "accuracy", 300), ("all", "gfa_weighted_accuracy", 300), ("in", "accuracy", 150), ("in", "gfa_weighted_accuracy", 150)]
    alone = R.poisson_bootstrap(df.where("inside"), "id", hit, F.col("gfa_m2"), 300, 5).first()
    assert all(abs(both[3][c] - 100 * alone[c]) < 0.0500001 for c in ("value", "ci95_lo", "ci95_hi"))
