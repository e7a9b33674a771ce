"""Merkle manifest of a dataset, kept as a log of nodes in postorder.

1. Every row is a leaf; leaves are numbered per group by distributed ranking (range partitions, then offsets).
2. A builder takes an aligned run of ``2**SEGMENT`` leaves, hashes it pairwise upwards and writes its nodes in the order in
   which they are completed, one log segment a run. The roots of the segments are the leaves of the next tier, until each
   group has one node left; the group roots, in order, are the leaves of one more such tree.
3. A node's place in the log follows from subtree sizes alone (:func:`postorder`), so a proof is read from the segment of
   its leaf by computed places, and goes on with the path of the segment in the tier above.

A run, and thus every task, holds at most ``2**SEGMENT`` leaves, whatever the size of a group.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from cityloom.llm.storage import ship, table

SEGMENT = 12
_PATH = ["left", "right", "tops"]


def subtree_size(level: int, index, n: int):
    """Nodes below and including node ``index`` of ``level`` in a tree over ``n`` leaves."""
    leaves = np.minimum(1 << level, n - (np.asarray(index, np.int64) << level))
    return sum(-(-leaves >> j) for j in range(level + 1))


def postorder(level: int, index, n: int):
    """Place (from 0) of node ``index`` of ``level`` in the log of a tree over ``n`` leaves.

    Before the first of ``x`` leaves to its left ends, ``floor(x / 2**j)`` nodes of each level ``j`` are complete, together
    ``2 x - popcount(x)``; then comes the node's own subtree, which it closes.
    """
    x = np.asarray(index, np.int64) << level
    return 2 * x - np.bitwise_count(x) + subtree_size(level, index, n) - 1


def height(n: int) -> int:
    """Levels above the leaves of a tree over ``n`` leaves."""
    return max(n - 1, 0).bit_length()


def _hash(*nodes: bytes) -> bytes:
    return hashlib.sha256("".join(x.hex() for x in nodes).encode()).digest()


def _levels(segment: int, n: int) -> int:
    return segment if n > 1 << segment else height(n)


def _build(segment: int):
    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("at")
        row, n = rows.column("node").to_pylist(), rows.column("n")[0].as_py()
        levels, count = _levels(segment, n), len(row)
        log: list = [b""] * int(subtree_size(levels, 0, count))
        for level in range(levels + 1):
            if level:
                row = [_hash(*row[i : i + 2]) for i in range(0, len(row), 2)]
            for place, node in zip(postorder(level, np.arange(len(row)), count).tolist(), row, strict=True):
                log[place] = node
        return pa.table(
            {
                "g": rows.column("g").slice(0, 1),
                "run": rows.column("run").slice(0, 1),
                "n": rows.column("n").slice(0, 1),
                "size": pa.array([count], pa.int64()),
                "log": pa.array([b"".join(log)], pa.binary()),
            }
        )

    return run


def _extract(segment: int, names: list[str]):
    def run(leaves: pa.Table, segments: pa.Table) -> pa.Table:
        if not len(leaves):
            return leaves.select(names).append_column("left", _texts([])).append_column("right", _texts([])).append_column("tops", _texts([]))
        (head,) = segments.select(["run", "n", "size", "log", *_PATH]).to_pylist()
        count, log = head["size"], head["log"]
        steps = []
        for level in range(_levels(segment, head["n"])):
            places = postorder(level, np.arange(-(-count >> level)), count)
            steps.append([log[32 * p : 32 * p + 32].hex() for p in places.tolist()])
        lefts, rights = [], []
        for i in (leaves.column("at").to_numpy() - (head["run"] << segment)).tolist():
            left, right = [], []
            for level, row in enumerate(steps):
                at = (i >> level) ^ 1
                sibling = row[at] if at < len(row) else ""
                left.append("" if at & 1 else sibling)
                right.append(sibling if at & 1 else "")
            lefts.append(left + head["left"])
            rights.append(right + head["right"])
        tops = [head["tops"]] * len(lefts)
        return leaves.select(names).append_column("left", _texts(lefts)).append_column("right", _texts(rights)).append_column("tops", _texts(tops))

    return run


def _texts(values: list) -> pa.Array:
    return pa.array(values, pa.list_(pa.string()))


def number(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``rows`` with ``at``, the place in its group by ``order`` (from 0, nulls first), and ``n``, the rows of the group.

    ``order`` has to begin with a column that sorts the groups apart, unless there is one group. Rows go to range partitions, so a group of any size is
    spread; only one row per partition and group is looked at together.
    """
    placed = table(
        rows.repartitionByRange(*order).sortWithinPartitions(*order).select(
            "*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("row")
        ),
        "placed",
    )
    heads = placed.groupBy("part", group).agg(F.min("row").alias("first"), F.count("*").alias("own"))
    ahead = F.sum("own").over(Window.partitionBy(group).orderBy("part")) - F.col("own")
    heads = heads.select("part", group, "first", ahead.alias("ahead"), F.sum("own").over(Window.partitionBy(group)).alias("n"))
    at = F.col("row") - F.col("first") + F.col("ahead")
    return placed.join(heads, ["part", group]).withColumn("at", at)


def grow(leaves: DataFrame, segment: int = SEGMENT) -> list[DataFrame]:
    """Log segments of the trees over ``leaves`` (``g, at, n, node``), a table per tier, the lowest first.

    A segment is ``g, run, n, size, log``: nodes of 32 bytes in postorder, the root of the segment last.
    """
    tiers = []
    while True:
        runs = leaves.select("g", F.shiftright("at", segment).alias("run"), "at", "n", "node")
        tiers.append(table(runs.groupBy("g", "run").applyInArrow(_build(segment), "g string, run long, n long, size long, log binary"), "segments"))
        above = -F.floor(-F.col("n") / F.lit(1 << segment))
        leaves = tiers[-1].select("g", F.col("run").alias("at"), above.cast("long").alias("n"), F.substring("log", -32, 32).alias("node"))
        if (leaves.agg(F.max("n")).first()[0] or 1) <= 1:
            return tiers


def _root() -> Column:
    return F.lower(F.hex(F.substring("log", -32, 32)))


def paths(leaves: DataFrame, tiers: list[DataFrame], above: DataFrame | None = None, segment: int = SEGMENT) -> DataFrame:
    """``leaves`` with ``left`` and ``right``, the siblings from leaf to root level by level (``''`` where a side has none),
    and ``tops``, the root of the leaf's group and those above it.

    ``above`` (``g, left, right, tops``) goes on beyond the root of each group.
    """
    none = F.array().cast("array<string>")
    last = tiers[-1]
    if above is None:
        known = last.select("*", none.alias("left"), none.alias("right"), F.array(_root()).alias("tops"))
    else:
        known = last.join(above.select("g", "left", "right", F.col("tops").alias("over")), "g")
        known = known.withColumn("tops", F.concat(F.array(_root()), "over")).drop("over")
    for tier in reversed(range(len(tiers))):
        below = leaves if tier == 0 else tiers[tier - 1].select("g", F.col("run").alias("at"))
        schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in below.schema), *(f"`{c}` array<string>" for c in _PATH)])
        runs = below.withColumn("run", F.shiftright("at", segment)).groupBy("g", "run")
        known = runs.cogroup(known.groupBy("g", "run")).applyInArrow(_extract(segment, below.columns), schema)
        if tier:
            known = tiers[tier - 1].join(known.withColumnRenamed("at", "run"), ["g", "run"])
            known = table(known, "paths")
    return known


def fold(leaf: Column, left: Column, right: Column) -> Column:
    """Root that follows from a leaf's digest and its siblings."""
    return F.aggregate(F.arrays_zip(left.alias("l"), right.alias("r")), leaf, lambda node, x: F.sha2(F.concat(x["l"], node, x["r"]), 256))


def proof_text(left: Column, right: Column) -> Column:
    """The siblings as one text, in the order in which they are used."""
    return F.array_join(F.zip_with(left, right, lambda a, b: F.concat(a, b)), "")


def field(value: Column) -> Column:
    """Unambiguous text of a value: ``-`` for null, else byte length, colon, value."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(*values: Column) -> Column:
    """Digest of a row's values, lowercase hex."""
    return F.sha2(F.concat(*map(field, values)), 256)


def prove(rows: DataFrame, group: str, key: str, leaf: str, segment: int = SEGMENT) -> DataFrame:
    """``rows`` with the proof of each row's digest ``leaf`` (lowercase hex): ``left``, ``right``, ``subroot`` and ``root``.

    Leaves of a group ascend by ``key`` (nulls first), equal keys by leaf; groups ascend bytewise, null first. A group of
    one row is its own subroot, one group's subroot is the root. An empty table gives no rows; repeated rows are a leaf
    each. Other columns are carried along; those named like one of the four new ones are replaced.
    """
    ship(rows.sparkSession)
    new = ["left", "right", "subroot", "root"]
    carried = F.struct(*(rows[c] for c in rows.columns if c.lower() not in new))
    leaves = rows.select(carried.alias("body"), field(F.col(group)).alias("g"), F.col(group).alias("o1"), F.col(key).alias("o2"), F.col(leaf).alias("o3"))
    leaves = number(leaves, "g", ["o1", "o2", "o3"])
    leaves = table(leaves.select("g", "o1", "at", "n", F.unhex("o3").alias("node"), "body"), "leaves")
    tiers = grow(leaves.select("g", "at", "n", "node"), segment)
    names = leaves.groupBy("g").agg(F.first("o1").alias("o1"))
    groups = tiers[-1].join(names, "g").select(F.lit("").alias("all"), F.col("g").alias("group"), "o1", F.unhex(_root()).alias("node"))
    groups = number(groups, "all", ["o1"]).select(F.col("all").alias("g"), "group", "at", "n", "node")
    groups = table(groups, "groups")
    over = table(paths(groups, grow(groups, segment), segment=segment).select(F.col("group").alias("g"), *_PATH), "over")
    proven = paths(leaves.select("g", "at", "body"), tiers, over, segment)
    return proven.select("body.*", "left", "right", F.col("tops")[0].alias("subroot"), F.col("tops")[1].alias("root"))


def manifest(docs: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """``doc_id, lang, leaf, tampered, left, right, subroot, root`` for every row of ``documents``.

    ``tampered`` is the leaf after 1 is added to ``n_chars``. Leaves hash doc_id, source, lang, n_chars and text; groups
    are the languages. Only these five columns are read, so others may have any name; nulls anywhere are hashed as such.
    """
    five = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    changed = [*five[:3], F.col("n_chars") + 1, five[4]]
    return prove(docs.select("doc_id", "lang", leaf(*five).alias("leaf"), leaf(*changed).alias("tampered")), "lang", "doc_id", "leaf", segment)
