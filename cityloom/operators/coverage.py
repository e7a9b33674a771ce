"""Coverage shares, class profiles and accuracy tables of the rule labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cityloom import rules
from cityloom.functions.numeric import half_even
from cityloom.operators.labelling import any_of, class_label, coarse, codes, is_hit
from cityloom.operators.quantiles import quantile_columns
from cityloom.operators.skew import union_all
from cityloom.sources.tables import lookup


def coverage(master: DataFrame) -> DataFrame:
    """Labelled, unknown and height-complete shares by scope (city, in parcel) and weight (count, floor area).

    One pass: every row feeds its scopes, all sums are computed at once and only the eight totals are
    unpivoted. Missing floors weigh nothing in floor area; height completeness is then area-weighted.
    """
    labelled, has_floors = F.col("archetype") != "unknown", F.col("floors").isNotNull()
    gfa = F.coalesce(F.col("area_m2") * F.col("floors"), F.lit(0.0))
    one = F.lit(1.0)
    scoped = master.withColumn(
        "scope",
        F.explode(
            F.when(F.col("euluc_out"), F.array(F.lit("citywide"))).otherwise(
                F.array(F.lit("citywide"), F.lit("euluc_scoped"))
            )
        ),
    )
    sums = scoped.groupBy("scope").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(~has_floors).alias("n_floors_na"),
        *[
            F.sum(F.when(c, w).otherwise(0.0)).alias(f"{name}_{wn}")
            for wn, w in (("count", one), ("gfa", gfa), ("area", F.col("area_m2")))
            for name, c in (("all", F.lit(True)), ("lab", labelled), ("unk", ~labelled), ("has", has_floors))
        ],
    )

    def row(weight: str, height_weight: str):
        total = F.col(f"all_{weight}")
        return F.struct(
            F.lit(weight).alias("weight"),
            half_even(total).alias("weight_total"),
            half_even(F.col(f"lab_{weight}") / total * 100, 2).alias("pct_rule_labeled"),
            F.lit(0.0).alias("pct_ml_predicted"),
            half_even(F.col(f"unk_{weight}") / total * 100, 2).alias("pct_unknown"),
            half_even(F.col(f"has_{height_weight}") / F.col(f"all_{height_weight}") * 100, 4).alias("pct_height_complete"),
        )

    rows = F.explode(F.array(row("count", "count"), row("gfa", "area")))
    return sums.select("scope", "n", "n_floors_na", rows.alias("r")).select("scope", "n", "n_floors_na", "r.*")


def class_profile(master: DataFrame) -> DataFrame:
    """Floors and footprint quantiles of the two classes left without a label."""
    names = lookup(master.sparkSession, ["euluc_class", "name"], list(rules.PROFILE_CLASSES.items()))
    part = master.join(F.broadcast(names), "euluc_class").select("euluc_class", "name", "floors", "area_m2")
    low = F.avg(F.when(F.col("floors").isNotNull(), (F.col("floors") <= 3).cast("double")))
    head = part.groupBy("euluc_class", "name").agg(
        F.count(F.lit(1)).alias("n"), half_even(low * 100, 1).alias("pct_floors_le3")
    )
    qs = {"p10": 0.10, "p25": 0.25, "p50": 0.50, "p75": 0.75, "p90": 0.90}
    # floors have few distinct values, so the exact aggregate stays small; areas need the bracketed one
    fl = part.groupBy("euluc_class").agg(F.percentile("floors", list(qs.values())).alias("_f"))
    fl = fl.select("euluc_class", *[half_even(F.col("_f")[k], 1).alias(f"floors_{n}") for k, n in enumerate(qs)])
    ar = quantile_columns(part, F.col("area_m2"), {f"area_{n}_m2": q for n, q in qs.items()}, ["euluc_class"])
    ar = ar.select("euluc_class", *[F.round(f"area_{n}_m2", 4).alias(f"area_{n}_m2") for n in qs])
    return head.join(fl, "euluc_class").join(ar, "euluc_class")


def _accuracy(df: DataFrame, metric: str, hit: str, by: str | None = None) -> DataFrame:
    aggs = [
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col(hit).cast("int")).alias("rule_hit"),
        half_even(F.sum(F.col(hit).cast("int")) * 100.0 / F.count(F.lit(1)), 1).alias("accuracy_pct"),
    ]
    out = df.groupBy(F.col(by).alias("archetype_truth")).agg(*aggs) if by else df.agg(*aggs)
    return out.withColumn("metric", F.lit(metric))


def rule_accuracy(evaluated: DataFrame) -> DataFrame:
    """Accuracy per true label, overall, by land use alone, and of the full rules inside parcels."""
    land = coarse(class_label(F.col("euluc_class")))
    ev = evaluated.withColumn("land_hit", is_hit(land, F.col("truth_arch")))
    inside = ev.where(F.col("euluc_class").isNotNull())
    return union_all(
        [
            _accuracy(ev, "rule_accuracy_by_archetype", "hit", "truth_arch"),
            _accuracy(ev, "overall_rule_accuracy", "hit"),
            _accuracy(inside, "euluc_direct_only_accuracy", "land_hit"),
            _accuracy(inside, "full_rule_accuracy_in_parcel", "hit"),
        ]
    )


def floor_flip_rate(evaluated: DataFrame) -> DataFrame:
    """Share of residential predictions that change side of the floor cutoff within two floors."""
    f, cut = F.col("pred_floors"), rules.RESIDENTIAL_FLOOR_CUTOFF
    flip = ((f - 2 >= cut) != (f >= cut)) | ((f + 2 >= cut) != (f >= cut))
    resi = evaluated.where(F.col("pred_arch").startswith("residential") & f.isNotNull())
    return resi.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(flip).alias("n_flip"),
        half_even(F.avg(flip.cast("int")) * 100, 1).alias("flip_pct"),
    )


def code_count_histogram(poi: DataFrame) -> DataFrame:
    sized = poi.select(F.size(codes(F.col("typecode"))).cast("bigint").alias("n_codes"))
    counts = sized.groupBy("n_codes").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("_t"))
    return counts.crossJoin(F.broadcast(total)).select(
        "n_codes", "n", F.round(F.col("n") * 100.0 / F.col("_t"), 6).alias("share_pct")
    )


def vote_scheme_report(votes: DataFrame, matched: DataFrame) -> DataFrame:
    """How often the two vote schemes disagree, and the accuracy of each on labelled buildings."""
    city = votes.agg(F.count(F.lit(1)).alias("n_voted"), F.count_if(F.col("poi_arch_a") != F.col("poi_arch_c")).alias("n_flip"))
    j = matched.join(votes, "bid")

    def acc(col: str):
        return half_even(F.avg((coarse(F.col(col)) == F.col("truth_arch")).cast("int")) * 100, 1)

    ours = j.agg(F.count(F.lit(1)).alias("n_labelled"), acc("poi_arch_a").alias("acc_a_pct"), acc("poi_arch_c").alias("acc_c_pct"))
    return city.crossJoin(ours)


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """Counts of several columns in one pass: ``field, value, n``."""
    pairs = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns])
    return df.select(F.inline(pairs)).groupBy("field", "value").agg(F.count(F.lit(1)).alias("n"))


def physical_height(master: DataFrame) -> DataFrame:
    """Floors times the storey height of the label; null for labels outside the table."""
    table = lookup(master.sparkSession, ["archetype", "storey_m"], list(rules.STOREY_HEIGHTS.items()))
    j = master.join(F.broadcast(table), "archetype", "left")
    return j.withColumn("physical_height_m", F.round(F.col("floors") * F.col("storey_m"), 6))
