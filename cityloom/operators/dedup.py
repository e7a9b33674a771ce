"""Same-model clusters: near-identical buildings close to each other, and the first few kept of each."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from cityloom import rules
from cityloom.operators.graph import connected_components
from cityloom.operators.skew import balanced_join
from cityloom.session import cut_lineage
from cityloom.sources.tables import lookup

# Rows of one micro-bucket always satisfy all three limits pairwise.
_MICRO_M = rules.DISTANCE_TOL_M / math.sqrt(2.0) * 0.999
_MICRO_LOG = -math.log(1.0 - rules.AREA_REL_TOL) * 0.999
# Join bins are wider than the limits, so a row reaches few bins.
_BIN_H = 10 * rules.HEIGHT_ABS_TOL_M
_BIN_LOG = 10 * _MICRO_LOG


def _same_model() -> Column:
    dist = F.hypot(F.col("x") - F.col("o_x"), F.col("y") - F.col("o_y"))
    rel = F.abs(F.col("area") - F.col("o_area")) / F.greatest("area", "o_area")
    return (
        (F.abs(F.col("height") - F.col("o_height")) <= rules.HEIGHT_ABS_TOL_M)
        & (rel <= rules.AREA_REL_TOL)
        & (dist <= rules.DISTANCE_TOL_M)
    )


def _bins(value: Column, tol: float, width: float) -> Column:
    return F.sequence(F.floor((value - tol) / width), F.floor((value + tol) / width))


def _forward_cells(df: DataFrame) -> DataFrame:
    """Own cell of side ``DISTANCE_TOL_M`` and the four behind it: of two cells side by side exactly one sees the other."""
    steps = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((0, 0), (-1, -1), (-1, 0), (-1, 1), (0, -1))])
    out = df.withColumn("_s", F.explode(steps))
    return out.withColumns({f"_c{c}": F.floor(F.col(c) / rules.DISTANCE_TOL_M) + F.col(f"_s.{c}") for c in "xy"}).drop("_s")


def model_pairs(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Same-model pairs of rows, each pair once: ``id, o_id`` with the columns of both sides.

    ``df`` has ``id, x, y, area, height``. Equi-join on cell, height bin and log-area bin.
    """
    by = by or []
    pos = df.where(F.col("area") > 0)
    log_a = F.log("area")
    own = {f"_c{c}": F.floor(F.col(c) / rules.DISTANCE_TOL_M) for c in "xy"}
    left = pos.withColumns({**own, "_ch": F.floor(F.col("height") / _BIN_H), "_ca": F.floor(log_a / _BIN_LOG)})
    right = _forward_cells(pos.withColumns({"_ox": own["_cx"], "_oy": own["_cy"]}))
    right = right.withColumn("_ch", F.explode(_bins(F.col("height"), rules.HEIGHT_ABS_TOL_M, _BIN_H)))
    right = right.withColumn("_ca", F.explode(_bins(log_a, 2 * _MICRO_LOG, _BIN_LOG)))
    right = right.withColumnsRenamed({c: f"o_{c}" for c in pos.columns if c not in by})
    keys = [*by, "_cx", "_cy", "_ch", "_ca"]
    # rows of one cell meet in both roles
    once = (F.col("_cx") != F.col("_ox")) | (F.col("_cy") != F.col("_oy")) | (F.col("id") < F.col("o_id"))
    return balanced_join(left, right, keys).where(once & _same_model())


def partners(pairs: DataFrame) -> DataFrame:
    """``id, o_id`` in both directions."""
    return pairs.select(F.inline(F.array(F.struct("id", "o_id"), F.struct(F.col("o_id").alias("id"), F.col("id").alias("o_id")))))


_SPAN = ["x", "y", "height", "area"]
_CUT = {"x": _MICRO_M, "y": _MICRO_M, "height": rules.HEIGHT_ABS_TOL_M, "area": _MICRO_LOG}


#: buckets with at most so many pairs of kinds between them are compared kind by kind
DIRECT = 1024


def _placed(kinds: DataFrame, level: int) -> DataFrame:
    """Place of each row among the buckets of ``level``: each is cut in half along every side from one level to the next."""
    return kinds.withColumns({f"_q{c}": F.floor((F.log(c) if c == "area" else F.col(c)) / (_CUT[c] / 2**level)) for c in _SPAN})


def _boxed(kinds: DataFrame, by: list[str], level: int) -> DataFrame:
    """Boxes of the buckets of ``level``."""
    place = [f"_q{c}" for c in _SPAN]
    ends = [f(c).alias(f"{t}_{c}") for c in _SPAN for f, t in ((F.min, "lo"), (F.max, "hi"))]
    return _placed(kinds, level).groupBy(*by, "node", *place).agg(F.count(F.lit(1)).alias("kinds"), *ends)


def _side(boxes: DataFrame, by: list[str], tag: str) -> DataFrame:
    return boxes.withColumnsRenamed({c: f"{tag}{c}" for c in boxes.columns if c not in by})


def _least_and_most() -> tuple[Column, Column]:
    """Whether some pair of two boxes could be of the same model, and whether every pair is."""
    gap = {c: F.greatest(F.col(f"a_lo_{c}") - F.col(f"b_hi_{c}"), F.col(f"b_lo_{c}") - F.col(f"a_hi_{c}"), F.lit(0.0)) for c in _SPAN}
    reach = {c: F.greatest(F.abs(F.col(f"a_hi_{c}") - F.col(f"b_lo_{c}")), F.abs(F.col(f"b_hi_{c}") - F.col(f"a_lo_{c}"))) for c in _SPAN}
    some = (gap["height"] <= rules.HEIGHT_ABS_TOL_M) & (F.hypot(gap["x"], gap["y"]) <= rules.DISTANCE_TOL_M)
    some &= gap["area"] / F.greatest(F.least("a_hi_area", "b_hi_area"), F.greatest("a_lo_area", "b_lo_area")) <= rules.AREA_REL_TOL
    every = (reach["height"] <= rules.HEIGHT_ABS_TOL_M) & (F.hypot(reach["x"], reach["y"]) <= rules.DISTANCE_TOL_M)
    every &= F.greatest((F.col("a_hi_area") - F.col("b_lo_area")) / F.col("a_hi_area"), (F.col("b_hi_area") - F.col("a_lo_area")) / F.col("b_hi_area")) <= rules.AREA_REL_TOL
    return some, every


#: side of the cells in which boxes of buckets meet; wide, so that few boxes reach into a second one
_MEET_M = 4 * rules.DISTANCE_TOL_M


_MEET = ["_cx", "_cy", "_ch", "_ca"]


def _offered(boxes: DataFrame) -> DataFrame:
    """Boxes in the cells where the lower corner of a touching one can lie; ``_row`` is the row of cells of their own."""

    def reach(low: Column, high: Column, tol: float, side: float, width: float) -> Column:
        room = tol * (1 + 1e-9)  # rounding
        return F.explode(F.sequence(F.floor((low - room - side) / width), F.floor((high + room) / width)))

    out = boxes.withColumn("_row", F.floor(F.col("lo_y") / _MEET_M))
    out = out.withColumn("_cx", reach(F.col("lo_x"), F.col("hi_x"), rules.DISTANCE_TOL_M, _MICRO_M, _MEET_M))
    out = out.withColumn("_cy", F.explode(F.sequence("_row", F.floor((F.col("hi_y") + rules.DISTANCE_TOL_M * (1 + 1e-9)) / _MEET_M))))
    out = out.withColumn("_ch", reach(F.col("lo_height"), F.col("hi_height"), rules.HEIGHT_ABS_TOL_M, rules.HEIGHT_ABS_TOL_M, _BIN_H))
    # the limit of areas is a little more than a bucket's side in logarithms
    return out.withColumn("_ca", reach(F.log("lo_area"), F.log("hi_area"), 1.01 * _MICRO_LOG, _MICRO_LOG, _BIN_LOG))


def near_buckets(kinds: DataFrame, by: list[str]) -> DataFrame:
    """Pairs of buckets whose boxes may touch, each pair once, with box, place and ``kinds`` of both sides (``a_``, ``b_``).

    A bucket is asked for in the cell of its lower corner and offered where that of a touching one can lie; of two cells
    above each other, only the upper one is offered the rows of the lower one.
    """
    boxes = cut_lineage(_boxed(kinds, by, 0).drop(*(f"_q{c}" for c in _SPAN)))
    asked = boxes.withColumns({f"_c{c}": F.floor(F.col(f"lo_{c}") / _MEET_M) for c in "xy"})
    asked = asked.withColumns({"_ch": F.floor(F.col("lo_height") / _BIN_H), "_ca": F.floor(F.log("lo_area") / _BIN_LOG)})
    j = balanced_join(_side(asked, [*by, *_MEET], "a_"), _side(_offered(boxes), [*by, *_MEET], "b_"), [*by, *_MEET])
    j = j.where((F.col("b__row") < F.col("_cy")) | (F.col("a_node") < F.col("b_node"))).drop(*_MEET, "b__row")
    place = lambda t, c: F.floor((F.log(f"{t}lo_{c}") if c == "area" else F.col(f"{t}lo_{c}")) / _CUT[c])
    return j.withColumns({f"{t}_q{c}": place(t, c) for t in ("a_", "b_") for c in _SPAN})


def touching_buckets(kinds: DataFrame, by: list[str]) -> DataFrame:
    """``*by, u, v``: pairs of buckets that hold at least one same-model pair of rows between them.

    ``kinds``: distinct ``x, y, area, height`` with their bucket ``node``. Bounding boxes settle most pairs of buckets; those
    left open are compared kind by kind where that is at most ``DIRECT`` pairs; the others are cut in half along every side and
    their parts compared again, until one pair of parts links them.
    """
    some, every = _least_and_most()
    met = cut_lineage(near_buckets(kinds, by).where(some).withColumn("_linked", every))
    pair = [*by, "a_node", "b_node"]
    linked, level = met.where("_linked").select(*pair), 0
    few = F.col("a_kinds") * F.col("b_kinds") <= DIRECT

    def compared(some: DataFrame, level: int) -> DataFrame:
        """Pairs of buckets with few kinds that hold a same-model pair."""
        own = _placed(kinds, level)
        for t in ("a_", "b_"):
            place = {f"_q{c}": f"{t}_q{c}" for c in _SPAN}
            values = {c: c if t == "a_" else f"o_{c}" for c in _SPAN}
            side = own.select(*by, "node", *place, *_SPAN).withColumnsRenamed({"node": f"{t}node", **place, **values})
            some = some.join(side, [*by, f"{t}node", *place.values()])
        return some.where(_same_model()).select(*pair)

    keyed = [*pair, *(f"{t}_q{c}" for t in ("a_", "b_") for c in _SPAN)]
    new = compared(met.where(~F.col("_linked") & few).select(*keyed), 0)
    linked = linked.unionByName(new)
    open_ = met.where(~F.col("_linked") & ~few)
    while not open_.isEmpty():
        level += 1
        finer = cut_lineage(_boxed(kinds.join(_open_nodes(open_, by), [*by, "node"], "left_semi"), by, level))
        place = {f"_q{c}": F.floor(F.col(f"_q{c}") / 2) for c in _SPAN}
        finer = finer.withColumns({f"_p{c}": v for c, v in zip(_SPAN, place.values())})
        parts = open_.select(*pair, *(F.col(f"{t}_q{c}").alias(f"{t}_p{c}") for t in ("a_", "b_") for c in _SPAN))
        for t in ("a_", "b_"):
            side = finer.select(*by, F.col("node").alias(f"{t}node"), *(F.col(f"_p{c}").alias(f"{t}_p{c}") for c in _SPAN), *(F.col(c).alias(f"{t}{c}") for c in finer.columns if c.startswith(("lo_", "hi_", "_q", "kinds"))))
            parts = parts.join(side, [*by, f"{t}node", *(f"{t}_p{c}" for c in _SPAN)])
        met = cut_lineage(parts.where(some).withColumn("_linked", every))
        new = met.where("_linked").select(*pair).unionByName(compared(met.where(~F.col("_linked") & few).select(*keyed), level))
        new = cut_lineage(new.distinct())
        linked = linked.unionByName(new)
        open_ = cut_lineage(met.where(~F.col("_linked") & ~few).join(new, pair, "left_anti"))
    return linked.select(*by, F.least("a_node", "b_node").alias("u"), F.greatest("a_node", "b_node").alias("v")).distinct()


def _open_nodes(open_: DataFrame, by: list[str]) -> DataFrame:
    return open_.select(*by, F.col("a_node").alias("node")).unionByName(open_.select(*by, F.col("b_node").alias("node"))).distinct()


def same_model_clusters(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Add ``cluster_root`` (lowest id of the cluster) to ``id, x, y, area, height`` rows; separate per ``by``.

    Transitive closure without listing pairs: rows fall into micro-buckets whose members are linked by construction, equal
    rows are joined once, and bounding boxes decide which buckets touch. Components are then found on the buckets.
    """
    by = by or []
    micro = {
        "_ux": F.floor(F.col("x") / _MICRO_M),
        "_uy": F.floor(F.col("y") / _MICRO_M),
        "_uh": F.floor(F.col("height") / rules.HEIGHT_ABS_TOL_M),
        "_ua": F.floor(F.log("area") / _MICRO_LOG),
    }
    pos = df.where(F.col("area") > 0).withColumns(micro)
    keys = [*by, *micro]
    buckets = cut_lineage(pos.groupBy(*keys).agg(F.min("id").alias("node")))
    tagged = cut_lineage(balanced_join(pos, buckets, keys))
    kinds = cut_lineage(tagged.groupBy(*by, "x", "y", "area", "height", "node").agg(F.min("id").alias("id")))
    edges = touching_buckets(kinds, by)
    if by:
        # ids repeat across groups, so nodes are numbered; the number is stored, and so the same wherever it is read
        nodes = cut_lineage(buckets.select(*by, "node").withColumn("_nid", F.monotonically_increasing_id()))
        e = edges
        for end in ("u", "v"):
            e = e.join(nodes.withColumnsRenamed({"node": end, "_nid": f"_{end}"}), [*by, end])
        comp = connected_components(e.select(F.col("_u").alias("u"), F.col("_v").alias("v")))
        named = nodes.join(comp.withColumnRenamed("node", "_nid"), "_nid", "left")
        named = named.withColumn("_comp", F.coalesce("root", "_nid"))
        low = named.groupBy(*by, "_comp").agg(F.min("node").alias("cluster_root"))
        roots = named.join(low, [*by, "_comp"]).select(*by, "node", "cluster_root")
    else:
        comp = connected_components(edges)
        roots = buckets.select("node").join(comp, "node", "left")
        roots = roots.select("node", F.coalesce("root", "node").alias("cluster_root"))
    out = balanced_join(tagged.drop(*micro), roots, [*by, "node"]).drop("node")
    rest = df.where(F.coalesce(F.col("area") <= 0, F.lit(True))).withColumn("cluster_root", F.col("id"))
    return out.unionByName(rest.select(*out.columns))


def cluster_sizes(clustered: DataFrame, by: list[str] | None = None) -> DataFrame:
    return clustered.groupBy(*(by or []), "cluster_root").agg(F.count(F.lit(1)).alias("cluster_size"))


def keep_first(clustered: DataFrame, keep: int = rules.KEEP_PER_CLUSTER, by: list[str] | None = None) -> DataFrame:
    """First ``keep`` rows per cluster by id. The rank limit runs before the shuffle too, so a huge cluster
    ships only a few rows per task."""
    w = Window.partitionBy(*(by or []), "cluster_root").orderBy("id")
    return clustered.withColumn("rank_in_cluster", F.row_number().over(w)).where(F.col("rank_in_cluster") <= keep)


def size_histogram(sizes: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Clusters per size bucket 1, 2, 3, 4-6, 7+; empty buckets count 0."""
    by = by or []
    n = F.col("cluster_size")
    bucket = (
        F.when(n == 1, "1").when(n == 2, "2").when(n == 3, "3").when(n <= 6, "4-6").otherwise("7+")
    )
    counted = sizes.groupBy(*by, bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    names = lookup(sizes.sparkSession, ["bucket"], [(b,) for b in ("1", "2", "3", "4-6", "7+")])
    frame = sizes.select(*by).distinct().join(F.broadcast(names)) if by else names
    return frame.join(counted, [*by, "bucket"], "left").select(*by, "bucket", F.coalesce("n", F.lit(0)).alias("n"))
