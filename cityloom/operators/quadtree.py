"""Quadtree of counted cells over spots, stored with tight bounds, and the nearest spot by walking it.

A cell with more than ``CAPACITY`` spots is split, space without spots has no cells. A search first looks into the asker's own
leaf, which gives a bound; then it follows only cells whose spots can still be nearer. An asker whose own cell is empty takes
its bound from the smallest occupied cell around it. So crowded corners and wide empty areas cost the same few cells per
asker, and each round joins only what open askers can reach.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from cityloom.operators.skew import balanced_join
from cityloom.session import cut_lineage

CAPACITY = 32
#: levels a crowded cell is split by at once
STEP = 2
#: a cell of this level is not split any more (a square of a thousand km: about a millimetre)
DEEPEST = 30
#: levels below that of an evenly filled square at which a tree may start
LOOK_DOWN = 16
KEY = ["_lv", "_ix", "_iy"]
_BOX = ["_x0", "_y0", "_x1", "_y1"]


@dataclass
class Quadtree:
    """``nodes``: key, ``_n``, tight box and ``_leaf`` of every cell; ``spots``: the spots with the key of their leaf."""

    nodes: DataFrame
    spots: DataFrame
    x0: float
    y0: float
    side: float
    start: int
    deepest: int

    def cell(self, value: Column, origin: float, level: Column) -> Column:
        """Index of the cell of ``level``; coordinates beyond the tree belong to its border cells."""
        n = F.pow(F.lit(2.0), level.cast("double"))
        return F.greatest(F.lit(0.0), F.least(n - 1, F.floor((value - origin) / self.side * n))).cast("bigint")

    def keyed(self, rows: DataFrame, x: str, y: str, level: Column) -> DataFrame:
        out = rows.withColumn("_lv", level.cast("int"))
        return out.withColumns({"_ix": self.cell(F.col(x), self.x0, F.col("_lv")), "_iy": self.cell(F.col(y), self.y0, F.col("_lv"))})


def _counted(rows: DataFrame) -> DataFrame:
    box = (F.min("_tx").alias("_x0"), F.min("_ty").alias("_y0"), F.max("_tx").alias("_x1"), F.max("_ty").alias("_y1"))
    return rows.groupBy(*KEY).agg(F.count(F.lit(1)).alias("_n"), *box)


def _start(spots: DataFrame, n: int, capacity: int, square: Quadtree) -> int:
    """First level whose occupied cells hold half the capacity on average.

    A strip or a few towns fill a small part of their square, so cells are counted; one row with a number per level.
    """
    low = 0
    while low < DEEPEST and n * 2 > capacity * 4**low:
        low += 1
    levels = range(low, min(low + LOOK_DOWN, DEEPEST) + 1)
    cells = [F.xxhash64(square.cell(F.col("_tx"), square.x0, F.lit(k)), square.cell(F.col("_ty"), square.y0, F.lit(k))) for k in levels]
    occupied = spots.agg(*[F.approx_count_distinct(c) for c in cells]).first()
    return next((k for k, m in zip(levels, occupied, strict=True) if n * 2 <= capacity * m), levels[-1])


def build(spots: DataFrame, capacity: int = CAPACITY) -> Quadtree | None:
    """Tree over distinct spots ``_tx, _ty`` (other columns are kept); None without spots.

    Cells start at the level where they hold half their capacity on average; levels above are counted from them.
    """
    r = spots.agg(F.count(F.lit(1)), F.min("_tx"), F.min("_ty"), F.max("_tx"), F.max("_ty")).first()
    if not r[0]:
        return None
    side = max(r[3] - r[1], r[4] - r[2], 1e-6) * (1 + 1e-9)
    start = _start(spots, r[0], capacity, Quadtree(spots, spots, r[1], r[2], side, 0, 0))
    tree = Quadtree(spots, spots, r[1], r[2], side, start, start)
    open_, done, cells, level = tree.keyed(spots, "_tx", "_ty", F.lit(start)), [], [], start
    while True:
        leaf = F.col("_n") <= capacity if level + STEP <= DEEPEST else F.lit(True)
        cells.append(cut_lineage(_counted(open_).withColumn("_leaf", leaf)))
        crowded = cells[-1].where(~F.col("_leaf")).select(*KEY)
        if crowded.isEmpty():
            done.append(open_)
            break
        done.append(open_.join(cells[-1].where("_leaf").select(*KEY), KEY))
        level += STEP
        open_ = cut_lineage(tree.keyed(open_.join(crowded, KEY).drop(*KEY), "_tx", "_ty", F.lit(level)))
    nodes = cells[0]
    for more in cells[1:]:
        nodes = nodes.unionByName(more)
    if start:
        up = cells[0].withColumn("_up", F.explode(F.sequence(F.lit(1), F.lit(start))))
        up = up.select(
            (F.col("_lv") - F.col("_up")).alias("_lv"), *((F.floor(F.col(c) / F.pow(F.lit(2.0), F.col("_up")))).cast("bigint").alias(c) for c in ("_ix", "_iy")), "_n", *_BOX
        )
        total = [F.sum("_n").alias("_n"), *(F.min(c).alias(c) for c in _BOX[:2]), *(F.max(c).alias(c) for c in _BOX[2:])]
        nodes = nodes.unionByName(up.groupBy(*KEY).agg(*total).withColumn("_leaf", F.lit(False)))
    held = done[0]
    for more in done[1:]:
        held = held.unionByName(more.select(*held.columns))
    return Quadtree(cut_lineage(nodes), held if len(done) == 1 else cut_lineage(held), r[1], r[2], side, start, level)


def _gap(p: str, lo: str, hi: str) -> Column:
    return F.greatest(F.col(lo) - F.col(p), F.col(p) - F.col(hi), F.lit(0.0))


def _nearest_point() -> Column:
    """Distance from the asker to the box: no spot of it is nearer."""
    return F.hypot(_gap("_px", "_x0", "_x1"), _gap("_py", "_y0", "_y1"))


def _farthest_point() -> Column:
    """Every spot of the box is at most that far."""
    dx = F.greatest(F.abs(F.col("_px") - F.col("_x0")), F.abs(F.col("_px") - F.col("_x1")))
    dy = F.greatest(F.abs(F.col("_py") - F.col("_y0")), F.abs(F.col("_py") - F.col("_y1")))
    return F.hypot(dx, dy)


def _first_bounds(tree: Quadtree, asks: DataFrame, least: int) -> DataFrame:
    """``asks`` with ``_bound``: an upper limit of the distance to the nearest (other) spot."""
    dist = F.hypot(F.col("_px") - F.col("_tx"), F.col("_py") - F.col("_ty"))
    # the leaf that holds the asker's place, if there is one
    at = asks.withColumn("_l", F.explode(F.array(*[F.lit(k) for k in range(tree.start, tree.deepest + 1, STEP)])))
    met = tree.keyed(at, "_px", "_py", F.col("_l")).join(tree.nodes.where("_leaf").select(*KEY), KEY)
    near = met.join(tree.spots.select(*KEY, "_tx", "_ty"), KEY).withColumn("_d", dist)
    if least > 1:
        near = near.where((F.col("_px") != F.col("_tx")) | (F.col("_py") != F.col("_ty")))
    bounded = cut_lineage(near.groupBy("_px", "_py").agg(F.min("_d").alias("_bound")))
    # askers without another spot in their leaf: the smallest cell around them that has one
    alone = asks.join(bounded, ["_px", "_py"], "left_anti").withColumn("_l", F.explode(F.sequence(F.lit(0), F.lit(tree.start))))
    around = tree.nodes.where(F.col("_n") >= least)
    found = tree.keyed(alone, "_px", "_py", F.col("_l")).join(around, KEY).groupBy("_px", "_py").agg(F.max_by(_farthest_point(), F.col("_lv")).alias("_bound"))
    return bounded.unionByName(found)


def nearest(tree: Quadtree, asks: DataFrame, same_table: bool, rank: list[str]) -> DataFrame:
    """``_px, _py, dist, *rank`` of the nearest spot of each distinct asker ``_px, _py``, ties by ``rank`` columns of the spots.

    With ``same_table`` a spot at the asker's own place does not count. An asker has no row only if no other spot exists.
    """
    bounds = _first_bounds(tree, asks, 2 if same_table else 1)
    # the cells of about the bound's size that its circle meets: at most five by five
    fit = F.floor(F.log2(F.lit(tree.side) / F.greatest(F.col("_bound"), F.lit(1e-9)))) + 1
    at = bounds.withColumn("_lv", F.greatest(F.lit(0), F.least(F.lit(tree.start), fit)).cast("int"))
    runs = {c: F.sequence(*(tree.cell(F.col(p) + s * F.col("_bound"), o, F.col("_lv")) for s in (-1, 1))) for c, p, o in (("_ix", "_px", tree.x0), ("_iy", "_py", tree.y0))}
    at = at.withColumn("_ix", F.explode(runs["_ix"])).withColumn("_iy", F.explode(runs["_iy"]))
    leaves = None
    while True:
        reach = at.join(tree.nodes, KEY).where(_nearest_point() <= F.col("_bound") * (1 + 1e-12))
        reach = cut_lineage(reach.select("_px", "_py", "_bound", *KEY, "_leaf"))
        ends = reach.where("_leaf").drop("_leaf")
        leaves = ends if leaves is None else leaves.unionByName(ends)
        inner = reach.where(~F.col("_leaf"))
        if inner.isEmpty():
            break
        step = F.when(F.col("_lv") < tree.start, 1).otherwise(STEP)
        down = inner.withColumn("_k", step).withColumn("_w", F.pow(F.lit(2.0), F.col("_k")).cast("bigint"))
        child = lambda c: F.explode(F.sequence(F.col(c) * F.col("_w"), F.col(c) * F.col("_w") + F.col("_w") - 1))
        at = down.withColumn("_cx", child("_ix")).withColumn("_cy", child("_iy")).select("_px", "_py", "_bound", (F.col("_lv") + F.col("_k")).cast("int").alias("_lv"), F.col("_cx").alias("_ix"), F.col("_cy").alias("_iy"))
    dist = F.hypot(F.col("_px") - F.col("_tx"), F.col("_py") - F.col("_ty"))
    pairs = balanced_join(leaves, tree.spots.select(*KEY, "_tx", "_ty", *rank), KEY).withColumn("dist", dist)
    pairs = pairs.where(F.col("dist") <= F.col("_bound"))
    if same_table:
        pairs = pairs.where((F.col("_px") != F.col("_tx")) | (F.col("_py") != F.col("_ty")))
    best = pairs.groupBy("_px", "_py").agg(F.min(F.struct("dist", *rank)).alias("_b"))
    return best.select("_px", "_py", "_b.*")
