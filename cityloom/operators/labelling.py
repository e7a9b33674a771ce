"""Floors, parcel class, POI signals, and the rule table that turns them into a label per building."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cityloom import rules
from cityloom.functions import geometry as G
from cityloom.functions.numeric import half_even
from cityloom.operators import cover, spatial
from cityloom.sources.tables import lookup

PARCEL_CELL_M = 250.0
FOOTPRINT_CELL_M = 64.0


def with_floors(df: DataFrame) -> DataFrame:
    """``is_supertall``, ``floors`` (height over 4 m, half to even; null for supertall) and its source."""
    tall = F.col("height") >= rules.SUPERTALL_HEIGHT_M
    floors = half_even(F.col("height") / F.lit(rules.METERS_PER_FLOOR)).cast("int")
    return df.withColumns(
        {
            "is_supertall": tall,
            "floors": F.when(~tall, floors),
            "floors_source": F.when(tall, F.lit("supertall_pending")).otherwise(
                F.lit(f"round_h{rules.METERS_PER_FLOOR:g}")
            ),
        }
    )


def supertall_floors(buildings: DataFrame, buildings_2023: DataFrame) -> DataFrame:
    """``bid, floors`` for supertall buildings whose best 2023 overlap reaches the IoU limit."""
    tall = buildings.where(F.col("height") >= rules.SUPERTALL_HEIGHT_M)
    pairs = spatial.overlap_pairs(buildings_2023, tall, FOOTPRINT_CELL_M, "bid23", "bid", [])
    floors = buildings_2023.select("bid23", "floors_2023")
    best = spatial.best_overlap(pairs, "bid", "bid23").where(F.col("iou") >= rules.IOU_MIN)
    return best.join(floors, "bid23").select("bid", F.col("floors_2023").alias("floors"))


def resolve_supertall(df: DataFrame, buildings: DataFrame, buildings_2023: DataFrame) -> DataFrame:
    """Fill supertall floors from 2023; the others keep null floors and a flag."""
    found = supertall_floors(buildings, buildings_2023).withColumnRenamed("floors", "_f23")
    j = df.join(found, "bid", "left")
    source = (
        F.when(F.col("is_supertall") & F.col("_f23").isNotNull(), F.lit("crosswalk_iou2023"))
        .when(F.col("is_supertall"), F.lit("supertall_unmatched_crosswalk_or_cnbh"))
        .otherwise(F.col("floors_source"))
    )
    return j.withColumns({"floors": F.coalesce("floors", "_f23"), "floors_source": source}).drop("_f23")


def parcel_of(buildings: DataFrame, parcels: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """``bid, parcel_id, class``: parcel holding the interior point of each building."""
    shapes = G.with_shape(parcels) if "xmin" not in parcels.columns else parcels
    pts = buildings.select("bid", "rep_x", "rep_y")
    return cover.points_within(pts, shapes, "rep_x", "rep_y", "bid", "parcel_id", keep or ["class"], PARCEL_CELL_M)


def with_parcel_class(df: DataFrame, parcel_rows: DataFrame) -> DataFrame:
    j = df.join(parcel_rows.select("bid", "parcel_id", F.col("class").alias("euluc_class")), "bid", "left")
    return j.withColumn("euluc_out", F.col("euluc_class").isNull())


def codes(typecode: Column) -> Column:
    """Bar-separated codes as an array without empties."""
    return F.filter(F.split(F.coalesce(typecode, F.lit("")), r"\|"), lambda c: c != "")


def any_prefix(typecode: Column, prefix: str) -> Column:
    return F.exists(codes(typecode), lambda c: c.startswith(prefix))


def nearest_buildings(poi: DataFrame, buildings: DataFrame, radius: float) -> DataFrame:
    """POI to its nearest building interior point within ``radius``; ties are all kept."""
    pts = poi.select("id", F.col("x").alias("poi_x"), F.col("y").alias("poi_y"))
    spots = buildings.select("bid", "rep_x", "rep_y")
    return spatial.nearest_with_ties(pts, spots, radius, "id", "bid", ("poi_x", "poi_y"), ("rep_x", "rep_y"))


def poi_signals(poi: DataFrame, buildings: DataFrame, parcel_rows: DataFrame) -> DataFrame:
    """``bid, mall_signal, hotel_signal`` for buildings hit by at least one rule.

    The nearest building is chosen first; the class condition of a rule is tested on that building. All rules
    share one nearest search at the largest radius, since the nearest building does not depend on the rule.
    """
    every = rules.MALL_RULES + rules.HOTEL_RULES
    radius = max(r["max_dist"] for r in every)
    wanted = poi.where(any_of([any_prefix(F.col("typecode"), r["prefix"]) for r in every]))
    hits = nearest_buildings(wanted, buildings, radius)
    hits = hits.join(wanted.select("id", "typecode"), "id").join(parcel_rows.select("bid", "class"), "bid", "left")

    def rule_hit(r: dict) -> Column:
        c = any_prefix(F.col("typecode"), r["prefix"]) & (F.col("dist") <= r["max_dist"])
        return c if r["classes"] is None else c & F.coalesce(F.col("class").isin(r["classes"]), F.lit(False))

    return hits.groupBy("bid").agg(
        F.bool_or(any_of([rule_hit(r) for r in rules.MALL_RULES])).alias("mall_signal"),
        F.bool_or(any_of([rule_hit(r) for r in rules.HOTEL_RULES])).alias("hotel_signal"),
    )


def any_of(conds: list[Column]) -> Column:
    out = conds[0]
    for c in conds[1:]:
        out = out | c
    return out


def class_label(cls: Column) -> Column:
    """Land-use label of a parcel class; null where the class gives none."""
    out = F.lit(None).cast("string")
    for k, v in rules.CLASS_LABELS.items():
        if v is not None:
            out = F.when(cls == k, F.lit(v)).otherwise(out)
    return out


def label_rules(df: DataFrame) -> DataFrame:
    """``mixed_use_candidate``, ``archetype``, ``label_rule``, ``bundled_label`` by fixed priority."""
    mall, hotel = F.coalesce("mall_signal", F.lit(False)), F.coalesce("hotel_signal", F.lit(False))
    mixed = F.coalesce(F.col("euluc_class") == rules.MIXED_USE_CLASS, F.lit(False)) & mall
    land = class_label(F.col("euluc_class"))
    high = F.coalesce(F.col("floors") >= rules.RESIDENTIAL_FLOOR_CUTOFF, F.lit(False))
    by_floors = F.when(high, F.lit("residential_high_rise")).otherwise(F.lit("residential_mid_rise"))
    label = (
        F.when(F.col("mixed_use_candidate"), F.lit("mixed_use"))
        .when(F.col("mall_signal"), F.lit("shopping_mall"))
        .when(F.col("hotel_signal"), F.lit("hotel"))
        .when(land == "residential", by_floors)
        .otherwise(F.coalesce(land, F.lit("unknown")))
    )
    rule = (
        F.when(F.col("mixed_use_candidate"), F.lit("mixed_use_candidate"))
        .when(F.col("mall_signal"), F.lit("mall"))
        .when(F.col("hotel_signal"), F.lit("hotel"))
        .when(land.isNotNull(), F.lit("euluc_direct"))
        .otherwise(F.lit("unknown"))
    )
    out = df.withColumns({"mall_signal": mall, "hotel_signal": hotel, "mixed_use_candidate": mixed})
    out = out.withColumns({"archetype": label, "label_rule": rule})
    return out.withColumn("bundled_label", F.col("archetype").isin(list(rules.BUNDLES)))


def coarse(label: Column) -> Column:
    """Residential sub-labels folded into one."""
    return F.when(label.startswith("residential"), F.lit("residential")).otherwise(label)


def is_hit(pred: Column, truth: Column) -> Column:
    """Prediction equals the truth, or is a bundle that contains it."""
    out = pred == truth
    for bundle, members in rules.BUNDLES.items():
        out = out | ((pred == bundle) & truth.isin(members))
    return F.coalesce(out, F.lit(False))


MASTER_COLUMNS = [
    "bid",
    "height",
    "ep",
    "district",
    "area_m2",
    "rep_x",
    "rep_y",
    "is_supertall",
    "floors",
    "floors_source",
    "parcel_id",
    "euluc_class",
    "euluc_out",
    "mall_signal",
    "hotel_signal",
    "mixed_use_candidate",
    "archetype",
    "label_rule",
    "bundled_label",
]


def build_master(buildings: DataFrame, buildings_2023: DataFrame, parcels: DataFrame, poi: DataFrame) -> DataFrame:
    """Whole rule-labelling plan: floors, supertall crosswalk, parcel class, POI signals, label."""
    shaped = buildings if "rep_x" in buildings.columns else G.with_shape(buildings)
    slim = shaped.drop("geom", "xmin", "ymin", "xmax", "ymax")
    floors = resolve_supertall(with_floors(slim), shaped, buildings_2023)
    parcel_rows = parcel_of(slim, parcels)
    classed = with_parcel_class(floors, parcel_rows)
    signals = poi_signals(poi, slim, parcel_rows)
    return label_rules(classed.join(signals, "bid", "left")).select(*MASTER_COLUMNS)


# --- POI votes ------------------------------------------------------------------------------------------


def map_codes(df: DataFrame, code: str = "code") -> DataFrame:
    """Add ``vote``: exact code, else four-digit group, else two-digit group.

    A level that lists the code ends the descent even when it says skip (null vote). The three code tables
    are fixed lists of a few dozen entries, hence broadcast.
    """
    spark = df.sparkSession
    tables = [("_sub", rules.POI_SUB_CODES), ("_mid", rules.POI_MID_CODES), ("_big", rules.POI_BIG_CODES)]
    keys = [
        F.col(code),
        F.concat(F.substring(code, 1, 4), F.lit("00")),
        F.concat(F.substring(code, 1, 2), F.lit("0000")),
    ]
    out = df
    for (name, table), key in zip(tables, keys):
        t = lookup(spark, [f"{name}_k", name], list(table.items()))
        out = out.withColumn("_key", key).join(F.broadcast(t), F.col("_key") == F.col(f"{name}_k"), "left")
        out = out.drop("_key", f"{name}_k")
    hit = F.coalesce("_sub", "_mid", "_big")
    return out.withColumn("vote", F.when(hit != "skip", hit)).drop("_sub", "_mid", "_big")


def poi_votes(hits: DataFrame) -> DataFrame:
    """Winning label per building under two schemes: one vote per code (A) and 1/N per code (C).

    ``hits`` has ``id, bid, typecode``. Ties go to the label seen first in (POI id, code position) order.
    """
    split = hits.select("id", "bid", codes(F.col("typecode")).alias("_c")).where(F.size("_c") > 0)
    each = split.select("id", "bid", F.size("_c").alias("_n"), F.posexplode("_c").alias("pos", "code"))
    votes = map_codes(each).where(F.col("vote").isNotNull())
    tally = votes.groupBy("bid", "vote").agg(
        F.count(F.lit(1)).cast("double").alias("votes_a"),
        F.sum(F.lit(1.0) / F.col("_n")).alias("votes_c"),
        F.min(F.struct("id", "pos")).alias("first_seen"),
    )

    def winner(score: str) -> Column:
        return F.min_by("vote", F.struct((-F.round(score, 9)).alias("s"), F.col("first_seen").alias("o")))

    return tally.groupBy("bid").agg(winner("votes_a").alias("poi_arch_a"), winner("votes_c").alias("poi_arch_c"))


def match_labels(truth: DataFrame, buildings: DataFrame, tolerance: float = rules.MATCH_TOLERANCE_M) -> DataFrame:
    """``val_id, bid, match_dist, is_inside``: footprint holding each labelled point, else the nearest one."""
    pts = truth.select("val_id", F.col("x").alias("t_x"), F.col("y").alias("t_y"))
    polys = buildings.select("bid", "geom", "xmin", "ymin", "xmax", "ymax")
    return spatial.points_within_or_near(pts, polys, FOOTPRINT_CELL_M, "t_x", "t_y", "val_id", "bid", [], tolerance)


def annotated(truth: DataFrame) -> DataFrame:
    return truth.where(F.col("status") == "annotated").withColumnRenamed("archetype", "truth_arch")


def evaluated(truth: DataFrame, buildings: DataFrame, master: DataFrame) -> DataFrame:
    """Annotated points with the predicted label, floors and class of their building; unmatched rows dropped."""
    t = annotated(truth)
    m = match_labels(t, buildings).select("val_id", "bid")
    cols = ["bid", "archetype", "label_rule", "floors", "euluc_class", "area_m2"]
    j = t.join(m, "val_id").join(master.select(*cols), "bid")
    j = j.withColumnsRenamed({"archetype": "pred_arch", "label_rule": "pred_rule", "floors": "pred_floors"})
    j = j.withColumn("pred_coarse", coarse(F.col("pred_arch")))
    return j.withColumn("hit", is_hit(F.col("pred_coarse"), F.col("truth_arch")))
