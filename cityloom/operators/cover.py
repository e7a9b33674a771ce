"""Points against polygons through a cell cover: covered cells settle by the join alone, crossed cells test a few edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cityloom.functions import cover as C
from cityloom.operators.skew import balanced_join, first_per_key
from cityloom.session import cut_lineage

#: cells a cover has at most for the boxes of its polygons, beyond one or a few a polygon
MOST_CELLS = 4_000_000
CELL = ["_cx", "_cy"]


def fitting_size(polys: DataFrame, size: float, most: int = MOST_CELLS) -> float:
    """``size``, or the doubled size at which all boxes together have at most ``most`` cells."""
    area = polys.agg(F.sum((F.col("xmax") - F.col("xmin")) * (F.col("ymax") - F.col("ymin")))).first()[0] or 0.0
    while area / (size * size) > most:
        size *= 2
    return size


def cells(polys: DataFrame, size: float, keep: list[str]) -> DataFrame:
    """``*keep, _cx, _cy, _full, _odd, _edges``: a row per cell of ``geom`` that is covered or crossed. Polygons need not be
    disjoint; rows with a null or empty ``geom`` have no cells."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in polys.select(*keep).schema)
    shapes = polys.where(F.size("geom") > 0).select(*keep, "geom")
    return shapes.mapInArrow(C.covering(size, "geom"), f"{kinds}, {C.COVER}" if keep else C.COVER)


def region_mask(polys: DataFrame, size: float) -> tuple[DataFrame, DataFrame]:
    """Covered cells, and crossed ones with ``_parts``; each cell of a region once, in one of the two."""
    every = cells(polys, size, []).groupBy(*CELL).agg(
        F.max("_full").alias("_full"), F.collect_list(F.when(~F.col("_full"), F.struct(F.col("_odd").alias("odd"), F.col("_edges").alias("edges")))).alias("_parts")
    )
    every = cut_lineage(every.select(*CELL, "_full", F.when(~F.col("_full"), F.col("_parts")).alias("_parts")))
    return every.where("_full").select(*CELL), every.where(~F.col("_full")).select(*CELL, "_parts")


def points_in_region(points: DataFrame, polys: DataFrame, x: str, y: str, size: float = 250.0) -> DataFrame:
    """Rows of ``points`` strictly inside any polygon, each once: one join per kind of cell, no second one to make them distinct."""
    size = fitting_size(polys, size)
    full, crossed = region_mask(polys, size)
    at = points.withColumns({"_cx": C.cell(F.col(x), size), "_cy": C.cell(F.col(y), size)})
    settled = at.join(full, CELL, "left_semi")
    tested = balanced_join(at, crossed, CELL).where(C.in_any_part("_parts", x, y))
    return settled.select(*points.columns).unionByName(tested.select(*points.columns))


def candidates(points: DataFrame, polys: DataFrame, x: str, y: str, point_id: str, poly_id: str, keep: list[str], size: float) -> tuple[DataFrame, DataFrame]:
    """Points with the polygons that cover their cell, and those with the polygons that cross it and whose box holds the point.

    The box of a crossing polygon comes with its cell, so where many small polygons share a cell only those around the point are tested.
    """
    box = {"_x0": "xmin", "_y0": "ymin", "_x1": "xmax", "_y1": "ymax"}
    size = fitting_size(polys, size)
    every = cut_lineage(cells(polys.withColumns({a: F.col(c) for a, c in box.items()}), size, [poly_id, *keep, *box]))
    at = points.select(point_id, x, y, C.cell(F.col(x), size).alias("_cx"), C.cell(F.col(y), size).alias("_cy"))
    settled = balanced_join(at, every.where("_full").select(*CELL, poly_id, *keep), CELL)
    part = F.array(F.struct(F.col("_odd").alias("odd"), F.col("_edges").alias("edges")))
    met = balanced_join(at, every.where(~F.col("_full")).select(*CELL, poly_id, *keep, *box, part.alias("_parts")), CELL)
    return settled, met.where(F.col(x).between(F.col("_x0"), F.col("_x1")) & F.col(y).between(F.col("_y0"), F.col("_y1"))).drop(*box)


def points_within(points: DataFrame, polys: DataFrame, x: str, y: str, point_id: str, poly_id: str, keep: list[str], size: float) -> DataFrame:
    """Polygon strictly holding each point (lowest id when several do): ``point_id, poly_id, *keep``."""
    settled, met = candidates(points, polys, x, y, point_id, poly_id, keep, size)
    tested = met.where(C.in_any_part("_parts", x, y))
    hits = settled.select(point_id, poly_id, *keep).unionByName(tested.select(point_id, poly_id, *keep))
    return first_per_key(hits, [point_id], [F.col(poly_id)])
