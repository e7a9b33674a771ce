"""Shape measures, predicates and overlap on hand-made polygons."""

import math
import random

import pytest
from pyspark.sql import functions as F

from cityloom.functions import geometry as G
from cityloom.operators import features as B, labelling as L, spatial as S


def ring(*pts):
    return [{"x": float(x), "y": float(y)} for x, y in pts]


def square(x, y, side=10.0):
    return [ring((x, y), (x + side, y), (x + side, y + side), (x, y + side))]


RECT = [ring((0, 0), (20, 0), (20, 5), (0, 5))]
LSHAPE = [ring((0, 0), (10, 0), (10, 4), (4, 4), (4, 10), (0, 10))]
HOLED = [ring((0, 0), (10, 0), (10, 10), (0, 10)), ring((2, 2), (2, 8), (8, 8), (8, 2))]


def frame(spark, geoms):
    rows = [(k, g) for k, g in enumerate(geoms)]
    return spark.createDataFrame(rows, f"bid bigint, geom {G.GEOM_TYPE}")


def test_measures(spark):
    d = {r["bid"]: r for r in G.with_shape(frame(spark, [square(0, 0), RECT, LSHAPE, HOLED])).collect()}
    assert d[0]["area_m2"] == 100 and d[0]["perimeter_m"] == 40
    assert d[1]["area_m2"] == 100 and d[2]["area_m2"] == 64
    assert d[3]["area_m2"] == 64
    assert (d[2]["rep_x"], d[2]["rep_y"]) == (2.0, 7.0)
    # the hole's middle is not an interior point
    assert not (2 < d[3]["rep_x"] < 8 and 2 < d[3]["rep_y"] < 8)


def test_shape_features(spark):
    f = {r["bid"]: r for r in B.shape_features(G.with_shape(frame(spark, [square(0, 0), RECT, LSHAPE]))).collect()}
    assert f[0]["compactness"] == pytest.approx(math.pi / 4, rel=1e-9)
    assert f[0]["aspect_ratio"] == pytest.approx(1.0) and f[0]["convexity"] == pytest.approx(1.0)
    assert f[1]["aspect_ratio"] == pytest.approx(4.0)
    assert f[2]["convexity"] < 1.0 and 0 < f[2]["compactness"] < 1.0


def test_rotated_rectangle_and_degenerate_fill(spark):
    c, s = math.cos(0.4), math.sin(0.4)
    tilted = [ring(*[(c * x - s * y, s * x + c * y) for x, y in [(0, 0), (30, 0), (30, 10), (0, 10)]])]
    sliver = [ring((0, 0), (50, 0), (50, 0.1), (0, 0.1))]
    f = {r["bid"]: r for r in B.shape_features(G.with_shape(frame(spark, [tilted, sliver]))).collect()}
    assert f[0]["aspect_ratio"] == pytest.approx(3.0, rel=1e-9)
    assert f[1]["aspect_ratio"] == pytest.approx(3.0, rel=1e-9)  # filled with the median


def test_contains_excludes_boundary_and_hole(spark):
    pts = [(5, 1, True), (5, 5, False), (0, 5, False), (2, 5, False), (11, 5, False), (10, 10, False)]
    df = spark.createDataFrame([(k, HOLED, float(x), float(y), e) for k, (x, y, e) in enumerate(pts)],
                               f"k int, geom {G.GEOM_TYPE}, x double, y double, e boolean")
    for r in df.withColumn("got", G.contains("geom", "x", "y")).collect():
        assert r["got"] == r["e"], r


def test_distance(spark):
    df = spark.createDataFrame([(square(0, 0), 13.0, 14.0), (square(0, 0), 5.0, 5.0)], f"geom {G.GEOM_TYPE}, x double, y double")
    assert [round(r[0], 9) for r in df.select(G.distance("geom", "x", "y").dist).collect()] == [5.0, 0.0]


def test_overlap_area(spark):
    tri = [ring((0, 0), (10, 0), (0, 10))]
    cases = [(square(0, 0), square(4, 4), 36.0), (square(2, 2), LSHAPE, 28.0), (HOLED, square(2, 2, 6), 0.0), (tri, square(0, 0), 50.0),
             (tri, square(5, 0, 5), 12.5), (square(0, 0), square(50, 50), 0.0)]
    df = spark.createDataFrame([(k, a, b, float(v)) for k, (a, b, v) in enumerate(cases)], f"k int, a {G.GEOM_TYPE}, b {G.GEOM_TYPE}, v double")
    for r in df.withColumn("got", G.overlap_area("a", "b")).collect():
        assert r["got"] == pytest.approx(r["v"], abs=1e-9), r["k"]


def test_neighbour_counts(spark):
    g = G.with_shape(frame(spark, [square(0, 0), square(30, 0), square(0, 30), square(500, 500)]))
    n = {r["bid"]: r for r in B.neighbourhood_features(g).collect()}
    assert [n[k]["n_bld_100m"] for k in range(4)] == [2, 2, 2, 0]
    assert n[0]["nbr_fp_med_m2"] == 100.0 and n[3]["nbr_fp_med_m2"] == 0.0
    assert n[0]["nn_dist_m"] == pytest.approx(30.0)
    assert n[3]["nn_dist_m"] == pytest.approx(math.hypot(500, 470))


def test_neighbours_with_stacked_copies(spark):
    g = G.with_shape(frame(spark, [square(0, 0)] * 3 + [square(20, 0, 8)]))
    n = {r["bid"]: r for r in B.neighbourhood_features(g).collect()}
    assert [n[k]["n_bld_100m"] for k in range(4)] == [3, 3, 3, 3]
    assert n[0]["nbr_fp_med_m2"] == 100.0 and n[3]["nbr_fp_med_m2"] == 100.0
    assert n[1]["nn_dist_m"] == 0.0


def test_spatial_joins_against_brute_force(spark):
    rng = random.Random(7)
    polys = [(k, square(rng.uniform(0, 900), rng.uniform(0, 900), rng.choice([8.0, 60.0, 700.0]))) for k in range(60)]
    hot = [(k, 100.0 + rng.random(), 100.0 + rng.random()) for k in range(80)]
    pts = hot + [(k, rng.uniform(-50, 1000), rng.uniform(-50, 1000)) for k in range(80, 200)]
    p = G.with_shape(spark.createDataFrame(polys, f"poly bigint, geom {G.GEOM_TYPE}"))
    q = spark.createDataFrame(pts, "pid bigint, px double, py double")
    got = {r["pid"]: r["poly"] for r in S.points_within(q, p, 25.0, "px", "py", "pid", "poly", []).collect()}
    over = {(r["poly"], r["o"]) for r in S.overlap_pairs(p, p.withColumnRenamed("poly", "o"), 25.0, "poly", "o", []).collect()}
    box = {k: (g[0][0]["x"], g[0][0]["y"], g[0][2]["x"], g[0][2]["y"]) for k, g in polys}
    want = {}
    for k, x, y in pts:
        inside = [b for b, (x0, y0, x1, y1) in box.items() if x0 < x < x1 and y0 < y < y1]
        if inside:
            want[k] = min(inside)
    assert got == want
    assert over == {(a, b) for a, A in box.items() for b, B_ in box.items()
                    if A[0] < B_[2] and B_[0] < A[2] and A[1] < B_[3] and B_[1] < A[3]}


def test_nearest_keeps_ties(spark):
    poi = spark.createDataFrame([(1, 0.0, 0.0), (2, 100.0, 0.0), (3, 900.0, 0.0)], "id bigint, px double, py double")
    b = spark.createDataFrame([(10, -5.0, 0.0), (11, 5.0, 0.0), (12, 130.0, 0.0)], "bid bigint, bx double, by double")
    got = S.nearest_with_ties(poi, b, 50.0, "id", "bid", ("px", "py"), ("bx", "by")).collect()
    assert {(r["id"], r["bid"]) for r in got} == {(1, 10), (1, 11), (2, 12)}


def test_match_falls_back_to_nearest(spark):
    b = G.with_shape(frame(spark, [square(0, 0), square(30, 0)]))
    t = spark.createDataFrame([(1, 5.0, 5.0), (2, 24.0, 5.0), (3, 15.0, 50.0), (4, 10.0, 5.0)], "val_id int, x double, y double")
    got = {r["val_id"]: (r["bid"], r["match_dist"], r["is_inside"]) for r in L.match_labels(t, b).collect()}
    assert got == {1: (0, 0.0, True), 2: (1, 6.0, False), 4: (0, 0.0, False)}


def test_largest_part_and_validity(spark):
    df = spark.createDataFrame([(1, [square(0, 0, 5), square(9, 9, 8), square(30, 30, 8)])], f"k int, parts array<{G.GEOM_TYPE}>")
    r = G.largest_part(df, "k", "parts").first()
    assert r["area_m2"] == 64 and r["geom"][0][0]["x"] == 9
    bad = frame(spark, [[ring((0, 0), (1, 1))], square(0, 0), []])
    assert [r[0] for r in bad.orderBy("bid").select(G.has_valid_rings(F.col("geom"))).collect()] == [False, True, False]


def _walked_hull(points):
    points = sorted(set(points))

    def half(seq):
        chain = []
        for p in seq:
            while len(chain) > 1:
                (ax, ay), (bx, by) = chain[-2:]
                if (bx - ax) * (p[1] - ay) - (by - ay) * (p[0] - ax) > 0:
                    break
                chain.pop()
            chain.append(p)
        return chain[:-1]

    ring = half(points) + half(points[::-1]) if len(points) > 2 else []
    return ring if len(ring) > 2 else []


def test_batched_hulls_equal_walked_ones():
    """Small grids (repeated, collinear and vertical points), random rings, empty and null rows, all in one batch."""
    import random

    import pyarrow as pa

    rng = random.Random(3)
    rows = [[], [[]], None, [[(1.0, float(k)) for k in range(9)]], [[(float(k), float(k * k % 7)) for k in range(50)]]]
    for _ in range(600):
        draw = rng.choice([lambda: float(rng.randint(0, 4)), lambda: rng.uniform(0, 100)])
        rows.append([[(draw(), draw()) for _ in range(rng.choice([1, 2, 3, 4, 6, 8, 30]))] for _ in range(rng.choice([1, 1, 2]))])
    kind = pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))
    batch = pa.array([r and [[{"x": x, "y": y} for x, y in ring] for ring in r] for r in rows], kind)
    row, x, y = G._hulls(G._Edges(batch))
    for k, r in enumerate(rows):
        got = list(zip(x[row == k].tolist(), y[row == k].tolist()))
        assert got == _walked_hull([p for ring in r or [] for p in ring])
