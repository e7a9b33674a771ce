"""Neighbour counts and medians by rank selection against all pairs."""

import math
import random
from statistics import median

import pytest

from cityloom.operators import features


def _brute(rows, radius):
    out = {}
    for b, x, y, _ in rows:
        if x is None or y is None:
            out[b] = (0, 0.0)
            continue
        near = [a for o, ox, oy, a in rows if o != b and None not in (ox, oy, a) and math.hypot(x - ox, y - oy) <= radius]
        out[b] = (len(near), median(near) if near else 0.0)
    return out


@pytest.mark.parametrize("block", [7, 512])
def test_counts_and_medians(spark, block):
    rng = random.Random(11)
    rows = [(rng.uniform(-900, 900), rng.uniform(-900, 900), float(rng.randint(1, 40))) for _ in range(250)]
    rows += [(rng.uniform(0, 60), rng.uniform(0, 60), rng.uniform(1, 1e6)) for _ in range(150)]  # one crowded tile
    rows += [(10.0, 10.0, 5.0)] * 40 + [(10.0, 10.0, 7.0)] * 3  # stacked copies
    rows += [(0.0, 5000.0, 1.0), (100.0, 5000.0, 2.0), (200.0, 5000.0, 4.0), (300.5, 5000.0, 8.0)]  # on the radius, and alone
    rows += [(None, 1.0, 3.0), (9000.0, None, 3.0)]
    rows = [(k, *r) for k, r in enumerate(rows)]
    df = spark.createDataFrame(rows, "bid int, rep_x double, rep_y double, area_m2 double").repartition(3)
    got = {r.bid: (r.n_bld_100m, r.nbr_fp_med_m2) for r in features.neighbour_stats(df, block=block).collect()}
    want = _brute(rows, 100.0)
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert all(got[k][1] == pytest.approx(want[k][1], rel=1e-12) for k in want)
    assert max(n for n, _ in want.values()) > 180


def test_no_rows(spark):
    df = spark.createDataFrame([], "bid int, rep_x double, rep_y double, area_m2 double")
    assert features.neighbour_stats(df).collect() == []


def test_quadtree_of_a_strip_starts_near_its_leaves(spark):
    """Spots along a narrow strip: the first cells are not crowded, so no rounds of splits are needed."""
    from cityloom.operators import quadtree

    rows = [(float(k % 5), 40.0 * k) for k in range(3000)]
    tree = quadtree.build(spark.createDataFrame([(x, y, k) for k, (x, y) in enumerate(rows)], "_tx double, _ty double, _lo int"))
    assert tree.deepest == tree.start and tree.nodes.where("_leaf").agg({"_n": "max"}).first()[0] <= quadtree.CAPACITY
    got = quadtree.nearest(tree, spark.createDataFrame(rows, "_px double, _py double"), True, ["_lo"]).collect()
    at = {r["_py"]: r for r in got}
    assert len(got) == 3000
    for k, (x, y) in enumerate(rows):
        want = min((math.hypot(x - rows[j][0], y - rows[j][1]), j) for j in (k - 1, k + 1) if 0 <= j < 3000)
        assert at[y]["_lo"] == want[1] and at[y]["dist"] == pytest.approx(want[0])
