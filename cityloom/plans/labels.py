"""Rule labelling, coverage and its diagnostics, label and vote tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from cityloom.functions import geometry as G
from cityloom.functions.numeric import half_even
from cityloom.operators import coverage as C, labelling as L
from cityloom.plans.inputs import annotated_master, build_master, buildings, master, parcels, slim
from cityloom.plans.registry import register
from cityloom.sources.views import Inputs


@register(
    "l1_poi_signals",
    "SELECT bid, mall AS mall_signal, hotel AS hotel_signal FROM sig WHERE mall OR hotel",
)
def l1_poi_signals(i: Inputs):
    b = slim(i)
    out = L.poi_signals(i.view("poi"), b, L.parcel_of(b, parcels(i)))
    return out.where(F.col("mall_signal") | F.col("hotel_signal"))


@register(
    "l2_mixed_use_candidates",
    "SELECT bid FROM master WHERE mixed_use_candidate",
)
def l2_mixed_use_candidates(i: Inputs):
    return master(i).where("mixed_use_candidate").select("bid")


@register("l3_rule_labels", "SELECT bid, floors, euluc_class, archetype, label_rule FROM master")
def l3_rule_labels(i: Inputs):
    return master(i).select("bid", "floors", "euluc_class", "archetype", "label_rule")


@register("l4_bundled_labels", "SELECT bid, archetype FROM master WHERE archetype = 'sport_culture'")
def l4_bundled_labels(i: Inputs):
    return master(i).where("bundled_label").select("bid", "archetype")


@register(
    "l5_master",
    """SELECT bid, height, ep, district, area_m2, rx AS rep_x, ry AS rep_y, is_supertall, floors, floors_source,
       parcel_id, euluc_class, euluc_out, mall_signal, hotel_signal, mixed_use_candidate, archetype, label_rule,
       archetype = 'sport_culture' AS bundled_label FROM master""",
)
def l5_master(i: Inputs):
    return build_master(i)


@register(
    "a5_coverage",
    """
SELECT s.scope, w.weight, count(*) AS n,
  round_even(sum(CASE WHEN w.weight = 'count' THEN 1 ELSE coalesce(area_m2*floors, 0) END), 0) AS weight_total,
  round_even(sum(CASE WHEN archetype <> 'unknown' THEN CASE WHEN w.weight = 'count' THEN CAST(1 AS DOUBLE) ELSE coalesce(area_m2*floors, 0) END ELSE 0 END)
    / sum(CASE WHEN w.weight = 'count' THEN CAST(1 AS DOUBLE) ELSE coalesce(area_m2*floors, 0) END) * 100, 2) AS pct_rule_labeled,
  CAST(0 AS DOUBLE) AS pct_ml_predicted,
  round_even(sum(CASE WHEN archetype = 'unknown' THEN CASE WHEN w.weight = 'count' THEN CAST(1 AS DOUBLE) ELSE coalesce(area_m2*floors, 0) END ELSE 0 END)
    / sum(CASE WHEN w.weight = 'count' THEN CAST(1 AS DOUBLE) ELSE coalesce(area_m2*floors, 0) END) * 100, 2) AS pct_unknown,
  round_even(sum(CASE WHEN floors IS NOT NULL THEN CASE WHEN w.weight = 'count' THEN CAST(1 AS DOUBLE) ELSE area_m2 END ELSE 0 END)
    / sum(CASE WHEN w.weight = 'count' THEN CAST(1 AS DOUBLE) ELSE area_m2 END) * 100, 4) AS pct_height_complete,
  sum(CASE WHEN floors IS NULL THEN 1 ELSE 0 END) AS n_floors_na
FROM master m JOIN (VALUES ('citywide'), ('euluc_scoped')) s(scope) ON s.scope = 'citywide' OR NOT m.euluc_out
CROSS JOIN (VALUES ('count'), ('gfa')) w(weight)
GROUP BY 1, 2""",
)
def a5_coverage(i: Inputs):
    return C.coverage(master(i))


@register(
    "a6_class_profile",
    """
SELECT p.class AS euluc_class, p.name, count(*) AS n,
  round_even(avg(CASE WHEN floors IS NULL THEN NULL WHEN floors <= 3 THEN CAST(1 AS DOUBLE) ELSE 0 END)*100, 1) AS pct_floors_le3,
  round_even(quantile_cont(CAST(floors AS DOUBLE), 0.1), 1) AS floors_p10, round_even(quantile_cont(CAST(floors AS DOUBLE), 0.25), 1) AS floors_p25,
  round_even(quantile_cont(CAST(floors AS DOUBLE), 0.5), 1) AS floors_p50, round_even(quantile_cont(CAST(floors AS DOUBLE), 0.75), 1) AS floors_p75,
  round_even(quantile_cont(CAST(floors AS DOUBLE), 0.9), 1) AS floors_p90,
  round(quantile_cont(area_m2, 0.1), 4) AS area_p10_m2, round(quantile_cont(area_m2, 0.25), 4) AS area_p25_m2,
  round(quantile_cont(area_m2, 0.5), 4) AS area_p50_m2, round(quantile_cont(area_m2, 0.75), 4) AS area_p75_m2,
  round(quantile_cont(area_m2, 0.9), 4) AS area_p90_m2
FROM master m JOIN (VALUES (3, 'industrial'), (10, 'park_greenspace')) p(class, name) ON m.euluc_class = p.class
GROUP BY 1, 2""",
)
def a6_class_profile(i: Inputs):
    return C.class_profile(master(i))


EVAL = {
    "ev": """
SELECT t.val_id, t.archetype AS truth_arch, t.floors_observed, m.bid, m.archetype AS pred_arch, m.floors AS pred_floors,
       m.euluc_class, m.area_m2,
       CASE WHEN m.archetype LIKE 'residential%' THEN 'residential' ELSE m.archetype END AS pred_coarse,
       CASE WHEN m.archetype LIKE 'residential%' THEN t.archetype = 'residential'
            WHEN m.archetype = 'sport_culture' THEN t.archetype IN ('sport_culture', 'sports', 'culture')
            ELSE m.archetype = t.archetype END AS hit,
       CASE WHEN m.euluc_class = 0 THEN t.archetype = 'residential' WHEN m.euluc_class = 1 THEN t.archetype = 'office'
            WHEN m.euluc_class IN (4,5) THEN t.archetype = 'transportation' WHEN m.euluc_class = 6 THEN t.archetype = 'government_office'
            WHEN m.euluc_class = 7 THEN t.archetype = 'education' WHEN m.euluc_class = 8 THEN t.archetype = 'healthcare'
            WHEN m.euluc_class = 9 THEN t.archetype IN ('sport_culture', 'sports', 'culture') ELSE false END AS land_hit
FROM truth t JOIN tmatch x USING (val_id) JOIN master m ON m.bid = x.bid WHERE t.status = 'annotated'""",
    "votes": """
SELECT bid, vote, count(*) AS a, sum(CAST(1 AS DOUBLE)/n) AS c, min(id*100 + pos) AS first_seen FROM (
  SELECT n.bid, n.id, k.pos, k.n, CASE k.code WHEN '060101' THEN 'shopping_mall' WHEN '060400' THEN 'shopping_mall'
     WHEN '100100' THEN 'hotel' WHEN '100200' THEN 'hotel' WHEN '120203' THEN 'mixed_use' WHEN '141201' THEN 'education'
     WHEN '060100' THEN 'shopping_mall' END AS vote
  FROM pn n JOIN (SELECT id, len(l) AS n, unnest(l) AS code, generate_subscripts(l, 1) AS pos
                  FROM (SELECT id, string_split(typecode, '|') AS l FROM poi)) k ON k.id = n.id)
WHERE vote IS NOT NULL GROUP BY 1, 2""",
    "winners": """
SELECT bid, arg_min(vote, (-round(a, 9), first_seen)) AS poi_arch_a, arg_min(vote, (-round(c, 9), first_seen)) AS poi_arch_c
FROM votes GROUP BY 1""",
}


@register(
    "a7_rule_accuracy",
    """
SELECT 'rule_accuracy_by_archetype' AS metric, truth_arch AS archetype_truth, count(*) AS n, sum(hit::INT) AS rule_hit,
       round_even(sum(hit::INT)*CAST(100 AS DOUBLE)/count(*), 1) AS accuracy_pct FROM ev GROUP BY truth_arch
UNION ALL SELECT 'overall_rule_accuracy', NULL, count(*), sum(hit::INT), round_even(sum(hit::INT)*CAST(100 AS DOUBLE)/count(*), 1) FROM ev
UNION ALL SELECT 'euluc_direct_only_accuracy', NULL, count(*), sum(land_hit::INT), round_even(sum(land_hit::INT)*CAST(100 AS DOUBLE)/count(*), 1) FROM ev WHERE euluc_class IS NOT NULL
UNION ALL SELECT 'full_rule_accuracy_in_parcel', NULL, count(*), sum(hit::INT), round_even(sum(hit::INT)*CAST(100 AS DOUBLE)/count(*), 1) FROM ev WHERE euluc_class IS NOT NULL""",
    EVAL,
)
def a7_rule_accuracy(i: Inputs):
    return C.rule_accuracy(annotated_master(i))


@register(
    "a8_floor_flip_rate",
    """
SELECT count(*) AS n, sum(flip::INT) AS n_flip, round_even(avg(flip::INT)*100, 1) AS flip_pct FROM (
 SELECT ((pred_floors - 2 >= 10) <> (pred_floors >= 10)) OR ((pred_floors + 2 >= 10) <> (pred_floors >= 10)) AS flip
 FROM ev WHERE pred_arch LIKE 'residential%' AND pred_floors IS NOT NULL)""",
    EVAL,
)
def a8_floor_flip_rate(i: Inputs):
    return C.floor_flip_rate(annotated_master(i))


@register(
    "a9_multi_code_share",
    """
SELECT n_codes, count(*) AS n, round(count(*)*CAST(100 AS DOUBLE)/(SELECT count(*) FROM poi), 6) AS share_pct
FROM (SELECT id, count(*) AS n_codes FROM codes GROUP BY id) GROUP BY 1""",
)
def a9_multi_code_share(i: Inputs):
    return C.code_count_histogram(i.view("poi"))


@register("a10_poi_votes", "SELECT * FROM winners", EVAL)
def a10_poi_votes(i: Inputs):
    poi = i.view("poi")
    hits = L.nearest_buildings(poi, slim(i), 150.0).join(poi.select("id", "typecode"), "id")
    return L.poi_votes(hits)


@register(
    "a11_vote_schemes",
    """
SELECT (SELECT count(*) FROM winners) AS n_voted, (SELECT count(*) FROM winners WHERE poi_arch_a <> poi_arch_c) AS n_flip,
  count(*) AS n_labelled, round_even(avg((poi_arch_a = truth_arch)::INT)*100, 1) AS acc_a_pct,
  round_even(avg((poi_arch_c = truth_arch)::INT)*100, 1) AS acc_c_pct
FROM ev JOIN winners USING (bid)""",
    EVAL,
)
def a11_vote_schemes(i: Inputs):
    poi = i.view("poi")
    hits = L.nearest_buildings(poi, slim(i), 150.0).join(poi.select("id", "typecode"), "id")
    labelled = L.annotated(i.view("truth"))
    matched = L.match_labels(labelled, buildings(i)).join(labelled.select("val_id", "truth_arch"), "val_id")
    return C.vote_scheme_report(L.poi_votes(hits), matched)


@register(
    "j20_code_lookup",
    """
SELECT id, code, CASE code WHEN '060101' THEN 'shopping_mall' WHEN '060400' THEN 'shopping_mall' WHEN '100100' THEN 'hotel'
  WHEN '100200' THEN 'hotel' WHEN '120203' THEN 'mixed_use' WHEN '141201' THEN 'education' WHEN '060100' THEN 'shopping_mall' END AS vote
FROM codes""",
)
def j20_code_lookup(i: Inputs):
    each = i.view("poi").select("id", F.explode(L.codes(F.col("typecode"))).alias("code"))
    return L.map_codes(each)


@register(
    "f13_coarse_label",
    """SELECT bid, CASE WHEN archetype LIKE 'residential%' THEN 'residential' ELSE archetype END AS coarse FROM master""",
)
def f13_coarse_label(i: Inputs):
    return master(i).select("bid", L.coarse(F.col("archetype")).alias("coarse"))


@register(
    "a13_value_counts",
    """
SELECT 'archetype' AS field, archetype AS value, count(*) AS n FROM master GROUP BY archetype
UNION ALL SELECT 'label_rule', label_rule, count(*) FROM master GROUP BY label_rule
UNION ALL SELECT 'floors_source', floors_source, count(*) FROM master GROUP BY floors_source""",
)
def a13_value_counts(i: Inputs):
    return C.value_counts(master(i), ["archetype", "label_rule", "floors_source"])


@register(
    "f1_floors",
    """SELECT bid, height >= 160 AS is_supertall, CASE WHEN height < 160 THEN CAST(round_even(CAST(height AS DOUBLE)/4, 0) AS INT) END AS floors,
 CASE WHEN height >= 160 THEN 'supertall_pending' ELSE 'round_h4' END AS floors_source FROM b26""",
)
def f1_floors(i: Inputs):
    return L.with_floors(i.buildings()).select("bid", "is_supertall", "floors", "floors_source")


@register("f3_supertall_flag", "SELECT bid, height FROM b26 WHERE height >= 160")
def f3_supertall_flag(i: Inputs):
    return L.with_floors(i.buildings()).where("is_supertall").select("bid", "height")


@register(
    "f17_physical_height",
    """
SELECT m.bid, round(m.floors*s.storey, 6) AS physical_height_m FROM master m JOIN (VALUES ('government_office', 3.9), ('office', 3.9), ('hotel', 3.6),
 ('shopping_mall', 5.4), ('healthcare', 4.2), ('education', 3.9), ('sport_culture', 6.0), ('transportation', 6.0),
 ('residential_mid_rise', 3.0), ('residential_high_rise', 3.0)) s(archetype, storey) ON s.archetype = m.archetype WHERE m.floors IS NOT NULL""",
)
def f17_physical_height(i: Inputs):
    return C.physical_height(master(i)).where(F.col("physical_height_m").isNotNull()).select("bid", "physical_height_m")
