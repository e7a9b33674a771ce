"""Grid keys that turn spatial predicates into equi-joins.

Level 0 cells have the given side; each further level is eight times wider. A box is stored on the
lowest level where it covers few cells, so a very large polygon never explodes into many rows, and only
levels that occur in the data are used. A pair of boxes meets on the coarser of their two levels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

LEVEL_FACTOR = 8.0
MAX_SPAN = 7.0


def _level(width: Column, height: Column, size: float) -> Column:
    ratio = F.greatest(width, height, F.lit(1e-9)) / F.lit(MAX_SPAN * size)
    return F.greatest(F.lit(0), F.ceil(F.log(LEVEL_FACTOR, ratio)).cast("int"))


def with_box_level(df: DataFrame, size: float, halo: float = 0.0) -> DataFrame:
    """Add ``_bx0.._by1`` (box grown by ``halo``) and its ``_lv``."""
    out = df.withColumns(
        {
            "_bx0": F.col("xmin") - halo,
            "_by0": F.col("ymin") - halo,
            "_bx1": F.col("xmax") + halo,
            "_by1": F.col("ymax") + halo,
        }
    )
    return out.withColumn("_lv", _level(F.col("_bx1") - F.col("_bx0"), F.col("_by1") - F.col("_by0"), size))


def occurring_levels(*frames: DataFrame) -> DataFrame:
    """One row with the sorted distinct levels; a double has no more than a few dozen."""
    lv = frames[0].select("_lv")
    for f in frames[1:]:
        lv = lv.unionByName(f.select("_lv"))
    return lv.agg(F.sort_array(F.collect_set("_lv")).alias("_levels"))


def _side(level: Column, size: float) -> Column:
    return F.lit(float(size)) * F.pow(F.lit(LEVEL_FACTOR), level.cast("double"))


def box_cells(df: DataFrame, size: float, levels: DataFrame | None = None) -> DataFrame:
    """One row per covered cell: ``_k`` level, ``_cx``, ``_cy``.

    Without ``levels`` a box sits on its own level only; with it, also on every coarser occurring level.
    """
    if levels is None:
        out = df.withColumn("_k", F.col("_lv"))
    else:
        out = (
            df.crossJoin(F.broadcast(levels))
            .withColumn("_k", F.explode(F.filter("_levels", lambda v: v >= F.col("_lv"))))
            .drop("_levels")
        )
    side = _side(F.col("_k"), size)

    def run(lo: str, hi: str) -> Column:
        return F.sequence(F.floor(F.col(lo) / side), F.floor(F.col(hi) / side))

    return out.withColumn("_cx", F.explode(run("_bx0", "_bx1"))).withColumn("_cy", F.explode(run("_by0", "_by1")))


def point_cells(df: DataFrame, size: float, x: str, y: str, levels: DataFrame) -> DataFrame:
    """One row per occurring level for each point."""
    out = df.crossJoin(F.broadcast(levels)).withColumn("_k", F.explode("_levels")).drop("_levels")
    side = _side(F.col("_k"), size)
    return out.withColumn("_cx", F.floor(F.col(x) / side)).withColumn("_cy", F.floor(F.col(y) / side))


def shared_cell_owner(size: float) -> Column:
    """True in exactly one of the cells two boxes share: the one with their common lower-left corner."""
    side = _side(F.col("_k"), size)
    own_x = F.floor(F.greatest(F.col("a_bx0"), F.col("b_bx0")) / side) == F.col("_cx")
    own_y = F.floor(F.greatest(F.col("a_by0"), F.col("b_by0")) / side) == F.col("_cy")
    return own_x & own_y
