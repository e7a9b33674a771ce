"""Reports over building pairs of the two footprint sets and over labelled points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cityloom import rules
from cityloom.functions.numeric import closed_bin, half_even
from cityloom.operators import labelling as L, spatial
from cityloom.operators.skew import union_all
from cityloom.sources.tables import lookup


def overlap_matches(b23: DataFrame, b26: DataFrame) -> DataFrame:
    """Best 2026 overlap of every 2023 building: ``bid23, bid, inter, area23, area26, iou, overlap23, ...``."""
    pairs = spatial.overlap_pairs(b23, b26, L.FOOTPRINT_CELL_M, "bid23", "bid", ["height"])
    best = spatial.best_overlap(pairs, "bid23", "bid")
    best = best.withColumnsRenamed({"a_area": "area23", "b_area": "area26", "overlap_share": "overlap23"})
    return best.join(b23.select("bid23", "floors_2023"), "bid23")


def centroid_matches(b23: DataFrame, b26: DataFrame) -> DataFrame:
    """2026 footprint holding the interior point of each 2023 building."""
    pts = b23.select("bid23", F.col("rep_x").alias("p_x"), F.col("rep_y").alias("p_y"))
    polys = b26.select("bid", "height", F.col("area_m2").alias("area26"), "geom", *spatial.BOX)
    hit = spatial.points_within(pts, polys, L.FOOTPRINT_CELL_M, "p_x", "p_y", "bid23", "bid", ["height", "area26"])
    return hit.join(b23.select("bid23", "floors_2023", F.col("area_m2").alias("area23")), "bid23")


def _ratio() -> Column:
    return F.col("height") / F.col("floors_2023").cast("double")


def band_table(clean: DataFrame) -> DataFrame:
    """Storey height by floor band. Heights and floors are small integers, so exact quantiles stay small."""
    bands = lookup(clean.sparkSession, ["floors_min", "floors_max", "band"], rules.FLOOR_BANDS)
    inside = F.col("floors_2023").between(F.col("floors_min"), F.col("floors_max"))
    j = clean.join(F.broadcast(bands), inside)
    q = F.percentile(_ratio(), [0.25, 0.5, 0.75])
    same = (F.col("height") == 4 * F.col("floors_2023")).cast("double")
    out = j.groupBy("band", "floors_min", "floors_max").agg(
        F.count(F.lit(1)).alias("n_clean_pairs"), q.alias("_q"), F.avg(same).alias("_same")
    )
    names = ["storey_height_p25_m", "storey_height_median_m", "storey_height_p75_m"]
    return out.select(
        "band",
        "floors_min",
        "floors_max",
        "n_clean_pairs",
        *[half_even(F.col("_q")[k], 3).alias(n) for k, n in enumerate(names)],
        half_even(F.col("_same"), 4).alias("frac_height_eq_2x_floor"),
    )


def synthetic_report(overlap: DataFrame, centroid: DataFrame) -> DataFrame:
    """Is the height a multiple of the floor count? By pairing method and for strict overlaps."""
    base = overlap.select("floors_2023", "height", "iou")
    sources = [
        base.where(F.col("iou") >= rules.IOU_MIN).withColumn("pairing", F.lit("iou_0.3")),
        centroid.select("floors_2023", "height").withColumn("pairing", F.lit("centroid")),
        base.where(F.col("iou") >= rules.IOU_STRICT).withColumn("pairing", F.lit("iou_0.7")),
    ]
    d = union_all(sources).where(F.col("floors_2023").between(1, rules.SUPERTALL_FLOORS - 1))
    off = F.abs(F.col("height") - 4 * F.col("floors_2023"))
    return (
        d.groupBy("pairing")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.percentile(_ratio(), [0.25, 0.5, 0.75]).alias("_q"),
            F.avg((off == 0).cast("double")).alias("_eq"),
            F.avg((off <= 2).cast("double")).alias("_near"),
        )
        .select(
            "pairing",
            "n",
            F.round(F.col("_q")[0], 6).alias("p25"),
            F.round(F.col("_q")[1], 6).alias("median"),
            F.round(F.col("_q")[2], 6).alias("p75"),
            F.round(F.col("_eq"), 6).alias("share_equal"),
            F.round(F.col("_near"), 6).alias("share_within_2m"),
        )
    )


def anomaly_pairs(overlap: DataFrame, centroid: DataFrame) -> DataFrame:
    """Storey heights near 4 m and near 8 m for buildings of 7 to 12 floors, by pairing method."""
    d = union_all(
        [
            overlap.where(F.col("iou") >= rules.IOU_MIN).select("floors_2023", "height").withColumn("pairing", F.lit("iou_0.3")),
            centroid.select("floors_2023", "height").withColumn("pairing", F.lit("centroid")),
        ]
    ).where(F.col("floors_2023").between(*rules.ANOMALY_FLOORS))
    r = _ratio()
    return d.groupBy("pairing").agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.median(r), 6).alias("median"),
        F.round(F.avg(r.between(3.5, 4.5).cast("double")), 6).alias("share_near_4"),
        F.round(F.avg(r.between(7.0, 9.0).cast("double")), 6).alias("share_near_8"),
    )


def labelled_heights(truth: DataFrame, b23: DataFrame, b26: DataFrame) -> DataFrame:
    """Labelled points with 2023 floors and 2026 height of the matched buildings (null when unmatched)."""
    m26 = L.match_labels(truth, b26).select("val_id", "bid").join(b26.select("bid", "height"), "bid")
    polys = b23.select(F.col("bid23").alias("bid"), "geom", *spatial.BOX)
    m23 = L.match_labels(truth, polys).select("val_id", F.col("bid").alias("bid23"))
    m23 = m23.join(b23.select("bid23", "floor23", "floors_2023"), "bid23")
    out = truth.join(m26.select("val_id", F.col("height").alias("height26")), "val_id", "left")
    return out.join(m23.select("val_id", "floor23", "floors_2023"), "val_id", "left")


def anomaly_labels(labelled: DataFrame, area: str) -> DataFrame:
    """Labelled points of 7 to 12 floors per area: FLOOR over observed floors, plausible 2026 storey heights."""
    w = labelled.where(F.col("floors_observed").between(*rules.ANOMALY_FLOORS) & F.col("floor23").isNotNull())
    storey = F.col("height26") / F.col("floors_observed").cast("double")
    return w.groupBy(area).agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.median(F.col("floor23") / F.col("floors_observed").cast("double")), 6).alias("median_floor_ratio"),
        F.count_if(F.coalesce(storey.between(2.5, 4.5), F.lit(False))).alias("n_plausible"),
    )


def floor_error_report(labelled: DataFrame, storey_heights: list[float]) -> DataFrame:
    """Error of floors derived from the 2026 height at several storey heights, and of the 2023 floors."""
    ok = labelled.where((F.col("status") == "annotated") & (F.col("floors_observed") > 0))
    ok = ok.where(F.col("height26").isNotNull() & (F.col("floors_observed") < rules.SUPERTALL_FLOORS))
    obs = F.col("floors_observed").cast("double")
    guesses = [
        F.struct(F.lit(f"height_over_{h:g}").alias("source"), half_even(F.col("height26") / F.lit(h)).alias("pred"))
        for h in storey_heights
    ]
    guesses.append(F.struct(F.lit("floors_2023").alias("source"), F.col("floors_2023").cast("double").alias("pred")))
    d = ok.select(obs.alias("obs"), F.inline(F.array(*guesses))).where(F.col("pred").isNotNull())
    err = F.col("pred") - F.col("obs")
    return d.groupBy("source").agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg(F.abs(err)), 6).alias("mae"),
        F.round(F.avg(err), 6).alias("bias"),
        F.round(F.avg((F.abs(err) <= 1).cast("double")), 6).alias("within_1"),
        F.round(F.avg((F.abs(err) <= 2).cast("double")), 6).alias("within_2"),
        F.round(F.median(F.abs(err) / F.col("obs")), 6).alias("median_ape"),
    )


def floor_ratio_by_bin(labelled: DataFrame) -> DataFrame:
    """FLOOR over observed floors by right-closed bins of the observed floors."""
    ok = labelled.where((F.col("status") == "annotated") & (F.col("floors_observed") > 0) & F.col("floor23").isNotNull())
    bins = closed_bin(F.col("floors_observed"), rules.OBSERVED_FLOOR_EDGES, right_closed=True)
    names = F.array(*[F.lit(n) for n in rules.OBSERVED_FLOOR_LABELS])
    obs = F.col("floors_observed").cast("double")
    close = F.abs(F.col("floor23") / 2.0 - obs) <= 1
    return (
        ok.withColumn("bin", F.element_at(names, bins + 1))
        .groupBy("bin")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.round(F.median(F.col("floor23") / obs), 6).alias("median_ratio"),
            F.round(F.avg(close.cast("double")) * 100, 6).alias("within_1_pct"),
        )
    )


def tallest_with_floors(b26: DataFrame, b23: DataFrame, n: int = 20) -> DataFrame:
    """Tallest buildings with the 2023 floors at their interior point, else of the largest overlap."""
    top = b26.orderBy(F.col("height").desc(), "bid").limit(n)
    pts = top.select("bid", F.col("rep_x").alias("p_x"), F.col("rep_y").alias("p_y"))
    inside = spatial.points_within(pts, b23, L.FOOTPRINT_CELL_M, "p_x", "p_y", "bid", "bid23", ["floor23"])
    rest = top.join(inside, "bid", "left_anti")
    pairs = spatial.overlap_pairs(b23, rest, L.FOOTPRINT_CELL_M, "bid23", "bid", [])
    best = spatial.best_overlap(pairs, "bid", "bid23").select("bid", "bid23").join(b23.select("bid23", "floor23"), "bid23")
    found = inside.withColumn("match_via", F.lit("inside")).unionByName(best.withColumn("match_via", F.lit("overlap")))
    out = top.select("bid", "height", "district").join(found, "bid", "left")
    return out.withColumn("implied_floors", F.floor(F.col("floor23") / 2).cast("int"))


def ratio_quantiles(pairs: DataFrame, ratio: Column, low: float, high: float) -> DataFrame:
    """P5 to P95 of an integer ratio and the share inside [low, high]."""
    r = pairs.select(ratio.alias("r")).where(F.col("r").isNotNull())
    out = r.agg(
        F.count(F.lit(1)).alias("n"),
        F.percentile("r", [0.05, 0.25, 0.5, 0.75, 0.95]).alias("_q"),
        F.round(F.avg(F.col("r").between(low, high).cast("double")) * 100, 6).alias("share_pct"),
    )
    return out.select(
        "n", *[F.round(F.col("_q")[k], 6).alias(f"p{p}") for k, p in enumerate((5, 25, 50, 75, 95))], "share_pct"
    )
