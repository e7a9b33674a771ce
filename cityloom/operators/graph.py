"""Connected components by alternating star contraction (Kiveris et al., 2014), as plain aggregates and joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cityloom.session import cut_lineage

MAX_ROUNDS = 60


def _with_min(edges: DataFrame) -> DataFrame:
    """Edges ``u, v`` with ``m``, the smallest of ``u`` and its neighbours.

    ``low`` has one row per ``u``, so a busy ``u`` is a plain skewed join, which adaptive execution splits at any size.
    """
    low = edges.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return edges.join(low, "u")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    j = _with_min(both)
    return j.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    j = _with_min(down)
    to_min = j.select(F.inline(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))))
    return to_min.where("u <> v").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node in an edge; ``root`` is the lowest id of its component.

    Stars shrink every round, so the number of rounds grows with the logarithm of the size, not with the
    length of the longest chain. Each round is stored, and the loop ends when the edge set stays the same.
    """
    cur = cut_lineage(edges.select(F.col("u").cast("bigint"), F.col("v").cast("bigint")).where("u <> v").distinct())
    mark = None
    for _ in range(MAX_ROUNDS):
        cur = cut_lineage(_small_star(_large_star(cur)), replaces=cur)
        new = cur.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if new == mark:
            break
        mark = new
    else:
        raise RuntimeError("components did not settle")
    members = cur.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return members.unionByName(cur.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
