"""Cell covers of polygons against the test on the whole polygon."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cityloom.functions import geometry as G
from cityloom.operators import cover

GEOM = "array<array<struct<x:double,y:double>>>"


def _ring(points):
    return [{"x": float(x), "y": float(y)} for x, y in points]


def _star(cx, cy, r, n, rng):
    return _ring([(cx + r * rng.uniform(0.2, 1) * math.cos(2 * math.pi * k / n), cy + r * rng.uniform(0.2, 1) * math.sin(2 * math.pi * k / n)) for k in range(n)])


@pytest.fixture(scope="module")
def shapes(spark):
    rng = random.Random(5)
    rows = [
        (1, [_ring([(0, 0), (100, 0), (100, 60), (50, 60), (50, 100), (0, 100)])]),  # on the grid, as its points
        (2, [_ring([(200, 0), (400, 0), (400, 200), (200, 200)]), _ring([(250, 50), (250, 150), (350, 150), (350, 50)])]),  # a hole
        (3, [_star(150, 300, 140, 40, rng)]),
        (4, [_star(-80, -90, 77, 9, rng), _star(300, 500, 60, 7, rng)]),  # two shells
        (5, [_ring([(10, 10), (10, 10), (10, 10)])]),
        (6, [_ring([(30, 420), (31, 480), (32, 420)])]),
        (7, []),
        (8, None),
        (9, [_star(160, 290, 120, 25, rng)]),  # overlaps 3
    ]
    return spark.createDataFrame(rows, f"id int, geom {GEOM}")


@pytest.fixture(scope="module")
def points(spark):
    rng = random.Random(6)
    pts = [(float(x), float(y)) for x in range(-20, 420, 10) for y in range(-20, 220, 10)]
    pts += [(rng.uniform(-200, 450), rng.uniform(-200, 600)) for _ in range(1500)]
    return spark.createDataFrame([(k, x, y) for k, (x, y) in enumerate(pts)], "pid int, x double, y double")


@pytest.mark.parametrize("size", [7.0, 50.0, 1000.0])
def test_cover_equals_whole_polygons(shapes, points, size):
    pairs = points.crossJoin(shapes.where("size(geom) > 0")).where(G.contains("geom", "x", "y"))
    want = {(r.pid, r.id) for r in pairs.groupBy("pid").agg(F.min("id").alias("id")).collect()}
    boxed = G.with_shape(shapes.where("size(geom) > 0"))
    got = cover.points_within(points, boxed, "x", "y", "pid", "id", [], size)
    assert {(r.pid, r.id) for r in got.collect()} == want and len(want) > 400
    inside = cover.points_in_region(points, boxed, "x", "y", size)
    assert sorted(r.pid for r in inside.collect()) == sorted(p for p, _ in want)


def test_many_vertices(spark):
    """One region of 10,000 vertices: most cells need no test, crossed ones hold few of its edges."""
    n = 10_000
    ring = _ring([((1000 + 40 * math.sin(60 * 2 * math.pi * k / n)) * math.cos(2 * math.pi * k / n), (1000 + 40 * math.sin(60 * 2 * math.pi * k / n)) * math.sin(2 * math.pi * k / n)) for k in range(n)])
    region = G.with_shape(spark.createDataFrame([(1, [ring])], f"id int, geom {GEOM}"))
    rows = cover.cells(region, 50.0, ["id"]).select("_full", F.size("_edges").alias("n")).collect()
    assert sum(r._full for r in rows) > 800 and max(r.n for r in rows) < n / 10
    rng = random.Random(8)
    pts = spark.createDataFrame([(k, rng.uniform(-1100, 1100), rng.uniform(-1100, 1100)) for k in range(3000)], "pid int, x double, y double")
    got = {r.pid for r in cover.points_in_region(pts, region, "x", "y", 50.0).collect()}
    x1, y1 = (np.array([p[c] for p in ring]) for c in "xy")
    x2, y2 = np.roll(x1, -1), np.roll(y1, -1)
    want = {r.pid for r in pts.collect() if (((y1 > r.y) != (y2 > r.y)) & (r.x < (x2 - x1) * (r.y - y1) / (y2 - y1) + x1)).sum() % 2}
    assert got == want


def test_covered_cells_settle_without_python(shapes, points):
    full, crossed = cover.region_mask(shapes, 20.0)
    assert full.join(crossed, cover.CELL).count() == 0
    plan = points.withColumns({"_cx": F.floor(F.col("x") / 20), "_cy": F.floor(F.col("y") / 20)}).join(full, cover.CELL, "left_semi")
    assert "Python" not in plan._jdf.queryExecution().executedPlan().toString()
    boxed = G.with_shape(shapes.where("size(geom) > 0"))
    area = boxed.selectExpr("sum((xmax - xmin) * (ymax - ymin)) AS a").first().a
    size = cover.fitting_size(boxed, 1.0, most=1000)
    assert area / size**2 <= 1000 < area / (size / 2) ** 2 and cover.fitting_size(boxed, 50.0) == 50.0
    assert cover.points_in_region(points, G.with_shape(shapes.limit(0)), "x", "y").count() == 0


def test_crossed_cells_test_only_boxes_around_the_point(spark):
    """Nine small polygons to a cell: each point meets the one around it, not all of its cell."""
    blocks = spark.range(36).selectExpr("id", "CAST(id % 6 AS DOUBLE) * 80 AS x", "CAST(id div 6 AS DOUBLE) * 80 AS y")
    blocks = G.with_shape(blocks.select("id", G.box(F.col("x") + 5, F.col("y") + 5, F.col("x") + 75, F.col("y") + 75).alias("geom")))
    pts = spark.range(900).selectExpr("id AS pid", "CAST(id % 30 AS DOUBLE) * 16 + 8 AS x", "CAST(id div 30 AS DOUBLE) * 16 + 8 AS y")
    settled, met = cover.candidates(pts, blocks, "x", "y", "pid", "id", [], 240.0)
    assert settled.count() + met.count() <= 900
    assert cover.points_within(pts, blocks, "x", "y", "pid", "id", [], 240.0).count() == 900


def test_ranges_of_footprints_are_sampled_without_python(spark, small):
    from cityloom.plans import inputs
    from cityloom.sources.views import Inputs

    plan = inputs._spatial_order(Inputs(spark, small).buildings(), "bid")._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" in plan and "ArrowEvalPython" not in plan
