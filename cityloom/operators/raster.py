"""Height raster as a pixel table: clip, mosaic, statistics, focal maximum."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cityloom import rules
from cityloom.functions.numeric import closed_bin
from cityloom.operators import cover
from cityloom.operators.quantiles import quantile_columns
from cityloom.operators.skew import with_group_stats
from cityloom.sources.tables import lookup

PIXEL_M = 10.0


def with_centres(px: DataFrame) -> DataFrame:
    return px.withColumns({"px_x": (F.col("col") + 0.5) * PIXEL_M, "px_y": (F.col("prow") + 0.5) * PIXEL_M})


def clip_to_region(px: DataFrame, region: DataFrame, size: float = 250.0) -> DataFrame:
    """Pixels whose centre lies in any polygon of the region; members need no dissolving.

    Cells that the region covers keep their pixels without a test, and a pixel row moves once at most.
    """
    return cover.points_in_region(with_centres(px), region, "px_x", "px_y", size).drop("px_x", "px_y")


def mosaic(px: DataFrame, keys: list[str], order: str = "tile", value: str = "h") -> DataFrame:
    """First valid value per position by tile order; null where no tile has one."""
    ok = F.col(value).isNotNull() & ~F.isnan(value)
    return px.groupBy(*keys).agg(F.min_by(F.when(ok, F.col(value)), F.when(ok, F.col(order))).alias(value))


def pixel_stats(px: DataFrame, value: str = "h") -> DataFrame:
    """Totals and height statistics of positive pixels; NaN means no building, null means outside."""
    v = F.col(value)
    pos = px.where(v.isNotNull() & ~F.isnan(v) & (v > 0))
    head = px.agg(F.count(F.lit(1)).alias("n_total"), F.count(v).alias("n_inside"), F.count_if(F.isnan(v)).alias("n_nan"))
    body = pos.agg(F.count(F.lit(1)).alias("n_positive"), F.min(v).alias("min"), F.avg(v).alias("mean"), F.max(v).alias("max"))
    q = quantile_columns(pos, v, {"p50": 0.5, "p95": 0.95, "p99": 0.99})
    return head.crossJoin(body).crossJoin(q)


def tile_histogram(px: DataFrame, edges: list[float] | None = None) -> DataFrame:
    """Pixels per tile and height bin (half-open, last closed); empty bins of a tile count 0."""
    edges = [float(e) for e in (edges or rules.TILE_EDGES_M)]
    bins = lookup(px.sparkSession, ["bin", "lo", "hi"], [(k, edges[k], edges[k + 1]) for k in range(len(edges) - 1)])
    frame = px.select("tile").distinct().crossJoin(F.broadcast(bins))
    n = px.where("h > 0").groupBy("tile", closed_bin(F.col("h"), edges).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return frame.join(n, ["tile", "bin"], "left").select("tile", "lo", "hi", F.coalesce("n", F.lit(0)).alias("n"))


def tile_extremes(px: DataFrame) -> DataFrame:
    """Extreme percentiles and maximum per tile."""
    pos = px.where(F.col("h") > 0)
    q = quantile_columns(pos, F.col("h"), {"p999": 0.999, "p9999": 0.9999, "p99999": 0.99999}, ["tile"])
    return q.join(pos.groupBy("tile").agg(F.max("h").alias("max")), "tile")


def focal_max(landmarks: DataFrame, px: DataFrame) -> DataFrame:
    """Largest pixel in the 3x3 window at each landmark and how far it falls short of the true height.

    ``landmarks``: ``name, col, prow, true_h``. Nine equi-join keys per landmark; NaN is ignored. A landmark whose
    window has no valid pixel stays, with null results.
    """
    step = F.array(F.lit(-1), F.lit(0), F.lit(1))
    want = (
        landmarks.withColumn("_dc", F.explode(step))
        .withColumn("_dr", F.explode(step))
        .select("name", "true_h", (F.col("col") + F.col("_dc")).alias("col"), (F.col("prow") + F.col("_dr")).alias("prow"))
    )
    seen = px.where(F.col("h").isNotNull() & ~F.isnan("h")).select("col", "prow", "h")
    m = want.join(seen, ["col", "prow"], "left").groupBy("name", "true_h").agg(F.max("h").alias("window_max"))
    return m.withColumns(
        {"short_m": F.col("true_h") - F.col("window_max"), "short_pct": 100 * (1 - F.col("window_max") / F.col("true_h"))}
    )
