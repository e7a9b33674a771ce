"""Spatial joins: grid equi-join, cheap box filter, exact predicate, then a combined pick per key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from cityloom.functions import geometry as G
from cityloom.operators import grid, quadtree
from cityloom.operators.skew import balanced_join, first_per_key
from cityloom.session import cut_lineage

CELL = ["_k", "_cx", "_cy"]
BOX = ["xmin", "ymin", "xmax", "ymax"]


def point_polygon_pairs(
    points: DataFrame, polys: DataFrame, size: float, x: str, y: str, point_id: str, halo: float = 0.0
) -> DataFrame:
    """Candidate pairs whose point lies in the polygon's box grown by ``halo``.

    ``polys`` needs ``geom`` and its box. Column names of both sides must differ.
    """
    boxed = grid.with_box_level(polys, size, halo)
    levels = grid.occurring_levels(boxed)
    cells = grid.box_cells(boxed, size)
    probes = grid.point_cells(points, size, x, y, levels)
    joined = balanced_join(probes, cells, CELL)
    in_box = F.col(x).between(F.col("_bx0"), F.col("_bx1")) & F.col(y).between(F.col("_by0"), F.col("_by1"))
    return joined.where(in_box).drop(*CELL, "_lv", "_bx0", "_by0", "_bx1", "_by1")


def points_within(
    points: DataFrame, polys: DataFrame, size: float, x: str, y: str, point_id: str, poly_id: str, keep: list[str]
) -> DataFrame:
    """Polygon holding each point (lowest id when several do): ``point_id, poly_id, *keep``."""
    shapes = polys.select(poly_id, *keep, "geom", *BOX)
    pairs = point_polygon_pairs(points.select(point_id, x, y), shapes, size, x, y, point_id)
    hits = pairs.where(G.contains("geom", x, y)).select(point_id, poly_id, *keep)
    return first_per_key(hits, [point_id], [F.col(poly_id)])


def points_within_or_near(
    points: DataFrame,
    polys: DataFrame,
    size: float,
    x: str,
    y: str,
    point_id: str,
    poly_id: str,
    keep: list[str],
    tolerance: float,
) -> DataFrame:
    """Containing polygon, else the nearest one within ``tolerance``; adds ``match_dist``.

    One grown-box join serves both: distance is 0 inside, so the minimum prefers containment.
    """
    shapes = polys.select(poly_id, *keep, "geom", *BOX)
    pairs = point_polygon_pairs(points.select(point_id, x, y), shapes, size, x, y, point_id, tolerance)
    near = pairs.withColumn("_d", G.distance("geom", x, y)).where(F.col("_d.dist") <= tolerance)
    hits = near.select(point_id, poly_id, *keep, F.col("_d.dist").alias("match_dist"), F.col("_d.inside").alias("_in"))
    best = first_per_key(hits, [point_id], [~F.col("_in"), F.col("match_dist"), F.col(poly_id)])
    return best.withColumnRenamed("_in", "is_inside")


def overlap_pairs(a: DataFrame, b: DataFrame, size: float, a_id: str, b_id: str, b_keep: list[str]) -> DataFrame:
    """Polygon pairs with positive common area: ``a_id, b_id, *b_keep, a_area, b_area, inter``."""
    box = ["_bx0", "_by0", "_bx1", "_by1"]
    a_box = grid.with_box_level(a.select(a_id, "geom", "area_m2", "xmin", "ymin", "xmax", "ymax"), size)
    b_box = grid.with_box_level(b.select(b_id, *b_keep, "geom", "area_m2", "xmin", "ymin", "xmax", "ymax"), size)
    levels = grid.occurring_levels(a_box, b_box)

    def side(df: DataFrame, tag: str, cols: list[str]) -> DataFrame:
        c = grid.box_cells(df, size, levels)
        named = [F.col(n).alias(tag + n) for n in box] + [F.col("_lv").alias(f"{tag}_lv")]
        return c.select(*CELL, *cols, *named, F.col("geom").alias(f"{tag}_geom"), F.col("area_m2").alias(f"{tag}_area"))

    j = balanced_join(side(a_box, "a", [a_id]), side(b_box, "b", [b_id, *b_keep]), CELL)
    meets = (
        (F.col("a_bx0") < F.col("b_bx1"))
        & (F.col("b_bx0") < F.col("a_bx1"))
        & (F.col("a_by0") < F.col("b_by1"))
        & (F.col("b_by0") < F.col("a_by1"))
    )
    right_level = F.col("_k") == F.greatest("a_lv", "b_lv")
    j = j.where(right_level & meets & grid.shared_cell_owner(size))
    inter = G.overlap_area("a_geom", "b_geom")
    out = j.select(a_id, b_id, *b_keep, "a_area", "b_area", inter.alias("inter"))
    return out.where(F.col("inter") > 0)


def iou(inter: Column, a: Column, b: Column) -> Column:
    return inter / (a + b - inter)


def best_overlap(pairs: DataFrame, key: str, other: str) -> DataFrame:
    """Partner with the largest common area per ``key`` (lowest id on ties), with IoU and share of ``a``."""
    best = first_per_key(pairs, [key], [-F.col("inter"), F.col(other)])
    return best.withColumns(
        {"iou": iou(F.col("inter"), F.col("a_area"), F.col("b_area")), "overlap_share": F.col("inter") / F.col("a_area")}
    )


def _neighbour_cells(df: DataFrame, size: float, x: str, y: str, reach: int = 1) -> DataFrame:
    step = F.array(*[F.lit(i) for i in range(-reach, reach + 1)])
    return (
        df.withColumn("_dx", F.explode(step))
        .withColumn("_dy", F.explode(step))
        .withColumn("_cx", F.floor(F.col(x) / size) + F.col("_dx"))
        .withColumn("_cy", F.floor(F.col(y) / size) + F.col("_dy"))
        .drop("_dx", "_dy")
    )


def _own_cell(df: DataFrame, size: float, x: str, y: str) -> DataFrame:
    return df.withColumn("_cx", F.floor(F.col(x) / size)).withColumn("_cy", F.floor(F.col(y) / size))


def radius_pairs(
    probes: DataFrame, targets: DataFrame, radius: float, probe_xy: tuple[str, str], target_xy: tuple[str, str]
) -> DataFrame:
    """All (probe, target) pairs at most ``radius`` apart, with ``dist``.

    Column names of both sides must differ.
    """
    px, py = probe_xy
    tx, ty = target_xy
    left = _own_cell(probes, radius, px, py)
    right = _neighbour_cells(targets, radius, tx, ty)
    j = balanced_join(left, right, ["_cx", "_cy"])
    dist = F.hypot(F.col(px) - F.col(tx), F.col(py) - F.col(ty))
    return j.withColumn("dist", dist).where(F.col("dist") <= radius).drop("_cx", "_cy")


def nearest_with_ties(
    probes: DataFrame,
    targets: DataFrame,
    radius: float,
    probe_id: str,
    target_id: str,
    probe_xy: tuple[str, str],
    target_xy: tuple[str, str],
) -> DataFrame:
    """Nearest targets per probe within ``radius``, every equally near one kept.

    Works on distinct spots of both sides, so stacked rows never multiply candidates. A short search at a
    quarter of the radius settles crowded areas; only spots without a hit look farther. Ranking with ties
    runs before the shuffle as well (group limit), so each task ships one distance per spot.
    """
    px, py = probe_xy
    tx, ty = target_xy
    spots = cut_lineage(targets.select(F.col(tx).alias("_tx"), F.col(ty).alias("_ty")).distinct())
    asks = cut_lineage(probes.select(F.col(px).alias("_px"), F.col(py).alias("_py")).distinct())
    rank = F.rank().over(Window.partitionBy("_px", "_py").orderBy("dist"))

    def closest(ask: DataFrame, r: float) -> DataFrame:
        cand = radius_pairs(ask, spots, r, ("_px", "_py"), ("_tx", "_ty"))
        return cand.withColumn("_rk", rank).where(F.col("_rk") == 1).drop("_rk")

    short = cut_lineage(closest(asks, radius / 4.0))
    far = closest(cut_lineage(asks.join(short, ["_px", "_py"], "left_anti")), radius)
    hit = cut_lineage(short.unionByName(far))
    at_spot = targets.select(target_id, F.col(tx).alias("_tx"), F.col(ty).alias("_ty"))
    found = cut_lineage(balanced_join(at_spot, hit, ["_tx", "_ty"]))
    who = probes.select(probe_id, F.col(px).alias("_px"), F.col(py).alias("_py"))
    hits = balanced_join(who, found.select("_px", "_py", target_id, "dist"), ["_px", "_py"])
    return hits.select(probe_id, target_id, "dist")


def nearest_unbounded(
    probes: DataFrame, targets: DataFrame, probe_id: str, target_id: str, same_table: bool = False, out_id: str | None = None
) -> DataFrame:
    """Nearest target of every probe at any distance: ``probe_id, target_id (or out_id), dist``.

    Both sides carry ``x, y``. The search works on distinct spots, so stacked rows cost one lookup, and walks a quadtree of
    counted cells (:mod:`quadtree`). A probe stays without a row only when there is no (other) target at all. With
    ``same_table`` a row never finds itself; among rows on one spot the lowest id is reported, and the highest to the lowest one.
    """
    spots = targets.where(F.col("x").isNotNull() & F.col("y").isNotNull()).groupBy(F.col("x").alias("_tx"), F.col("y").alias("_ty"))
    spots = cut_lineage(spots.agg(F.min(target_id).alias("_lo"), F.max(target_id).alias("_hi"), F.count(F.lit(1)).alias("_rows")))
    if same_table:
        every = spots.select(F.col("_tx").alias("_px"), F.col("_ty").alias("_py"), "_lo", "_hi", "_rows")
        stacked = every.where(F.col("_rows") > 1).select("_px", "_py", "_lo", "_hi", F.lit(0.0).alias("dist"))
        asks = every.where(F.col("_rows") == 1).select("_px", "_py")
    else:
        asks = probes.where(F.col("x").isNotNull() & F.col("y").isNotNull()).select(F.col("x").alias("_px"), F.col("y").alias("_py")).distinct()
        stacked = None
    tree = quadtree.build(spots.select("_tx", "_ty", "_lo"))
    if tree is None:
        found = asks.select("_px", "_py", F.lit(None).cast(targets.schema[target_id].dataType).alias("_lo"), F.lit(0.0).alias("dist")).where(F.lit(False))
    else:
        found = quadtree.nearest(tree, asks, same_table, ["_lo"])
    found = found.select("_px", "_py", "_lo", F.col("_lo").alias("_hi"), "dist")
    found = found if stacked is None else stacked.unionByName(found)
    who = probes.select(F.col(probe_id).alias("_pid"), F.col("x").alias("_px"), F.col("y").alias("_py"))
    j = balanced_join(who, cut_lineage(found), ["_px", "_py"])
    tid = F.when(F.col("_pid") == F.col("_lo"), F.col("_hi")).otherwise(F.col("_lo")) if same_table else F.col("_lo")
    return j.select(F.col("_pid").alias(probe_id), tid.alias(out_id or target_id), "dist")
