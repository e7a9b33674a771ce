"""Features, model, evaluation tables and the labelling list."""

from __future__ import annotations

from pyspark.sql import functions as F

from cityloom import rules
from cityloom.functions.resample import POISSON_CDF
from cityloom.operators import evaluation as E, features as B, labelling as L, model as M, sampling as R, spatial
from cityloom.operators.quantiles import exact_quantiles
from cityloom.plans.inputs import buildings, master, parcels, slim
from cityloom.plans.joins import NEIGHBOURS
from cityloom.plans.registry import register
from cityloom.plans.shapes import GCJ, HULL
from cityloom.sources.views import Inputs, stored, stored_tables

SCALE = {
    "sc": """
SELECT bid, area_m2, parcel_id, euluc_class, euluc_out, CAST(coalesce(floors, med) AS DOUBLE) AS floors_feat, area_m2*coalesce(floors, med) AS gfa_m2,
  CAST(is_supertall AS INT) AS is_supertall_int FROM master, (SELECT quantile_cont(CAST(floors AS DOUBLE), 0.5) AS med FROM master WHERE is_supertall AND floors IS NOT NULL)""",
    "pf": """
SELECT s.bid, CASE WHEN s.parcel_id IS NULL THEN 0 ELSE 14400 END::DOUBLE AS parcel_area_m2, coalesce(n, 0) AS n_bld_in_parcel,
  coalesce(s.gfa_m2/nullif(t.g, 0), 0) AS gfa_share_parcel, CAST(s.parcel_id IS NOT NULL AS INT) AS in_parcel
FROM sc s LEFT JOIN (SELECT parcel_id, count(*) AS n, sum(gfa_m2) AS g FROM sc WHERE parcel_id IS NOT NULL GROUP BY 1) t ON t.parcel_id = s.parcel_id""",
    "ns": "SELECT bid, count(*) AS n_bld_100m, quantile_cont(other_area, 0.5) AS nbr_fp_med_m2, min(dist) AS nn FROM nb GROUP BY bid",
}
ALL = {**NEIGHBOURS, **HULL, **SCALE}


@register("b1_scale_features", "SELECT bid, floors_feat, round(gfa_m2, 6) AS gfa_m2, is_supertall_int FROM sc", ALL)
def b1_scale_features(i: Inputs):
    return B.scale_features(master(i)).withColumn("gfa_m2", F.round("gfa_m2", 6))


@register("w8_global_median_fill", "SELECT bid, floors_feat FROM sc WHERE is_supertall_int = 1", ALL)
def w8_global_median_fill(i: Inputs):
    return B.scale_features(master(i)).where("is_supertall_int = 1").select("bid", "floors_feat")


@register(
    "b2_shape_features",
    """SELECT g.bid, g.perimeter_m, round(4*pi()*area_m2/(perimeter_m*perimeter_m), 9) AS compactness, round(g.area_m2/h.hull_area, 9) AS convexity,
 round(r.aspect, 6) AS aspect_ratio FROM g26 g JOIN hull h USING (bid) JOIN rect r USING (bid)""",
    ALL,
)
def b2_shape_features(i: Inputs):
    s = B.shape_features(buildings(i))
    return s.select("bid", "perimeter_m", F.round("compactness", 9).alias("compactness"), F.round("convexity", 9).alias("convexity"),
                    F.round("aspect_ratio", 6).alias("aspect_ratio"))


@register("a19_neighbour_stats", "SELECT g.bid, coalesce(n_bld_100m, 0) AS n_bld_100m, coalesce(nbr_fp_med_m2, 0) AS nbr_fp_med_m2 FROM g26 g LEFT JOIN ns USING (bid)", ALL)
def a19_neighbour_stats(i: Inputs):
    return B.neighbour_stats(slim(i))


@register(
    "b3_neighbourhood_features",
    "SELECT bid, n_bld_100m, nbr_fp_med_m2, round(nn, 6) AS nn_dist_m FROM ns",
    ALL,
)
def b3_neighbourhood_features(i: Inputs):
    n = B.neighbourhood_features(slim(i))
    return n.withColumn("nn_dist_m", F.round("nn_dist_m", 6))


def _parcel_rows(i: Inputs):
    m = master(i)
    return m.select("bid", "parcel_id").join(B.scale_features(m).select("bid", "gfa_m2"), "bid")


@register("b4_parcel_features", "SELECT bid, parcel_area_m2, n_bld_in_parcel, round(gfa_share_parcel, 9) AS gfa_share_parcel, in_parcel FROM pf", ALL)
def b4_parcel_features(i: Inputs):
    f = B.parcel_features(_parcel_rows(i), parcels(i))
    return f.withColumn("gfa_share_parcel", F.round("gfa_share_parcel", 9))


@register("a20_parcel_stats", "SELECT bid, n_bld_in_parcel, round(gfa_share_parcel, 9) AS gfa_share_parcel FROM pf", ALL)
def a20_parcel_stats(i: Inputs):
    f = B.parcel_features(_parcel_rows(i), parcels(i))
    return f.select("bid", "n_bld_in_parcel", F.round("gfa_share_parcel", 9).alias("gfa_share_parcel"))


@register("w4_group_total", "SELECT s.bid, round(t.g, 6) AS parcel_gfa FROM sc s JOIN (SELECT parcel_id, sum(gfa_m2) AS g FROM sc GROUP BY 1) t ON t.parcel_id = s.parcel_id", ALL)
def w4_group_total(i: Inputs):
    from cityloom.operators.skew import with_group_stats

    rows = _parcel_rows(i).where(F.col("parcel_id").isNotNull())
    return with_group_stats(rows, "parcel_id", {"g": F.sum("gfa_m2")}).select("bid", F.round("g", 6).alias("parcel_gfa"))


@register(
    "a21_class_agreement",
    """
SELECT count(*) AS n, avg((a.class = o.class)::INT::DOUBLE) AS agreement FROM bp a JOIN (
 SELECT bid, arg_max(class, (inter, -parcel_id)) AS class FROM (
  SELECT r.bid, p.parcel_id, p.class, sum((least(r.xb, p.x0+p.side)-greatest(r.xa, p.x0))*(least(r.yb, p.y0+p.side)-greatest(r.ya, p.y0))) AS inter
  FROM r26 r JOIN parcels p ON r.xa < p.x0+p.side AND p.x0 < r.xb AND r.ya < p.y0+p.side AND p.y0 < r.yb GROUP BY 1, 2, 3) GROUP BY bid) o USING (bid)""",
)
def a21_class_agreement(i: Inputs):
    """The parcel that holds the interior point against the parcel that covers most of the footprint."""
    p = parcels(i).select("parcel_id", "class", "geom", "area_m2", "xmin", "ymin", "xmax", "ymax")
    pairs = spatial.overlap_pairs(buildings(i), p, L.PARCEL_CELL_M, "bid", "parcel_id", ["class"])
    again = spatial.best_overlap(pairs, "bid", "parcel_id").select("bid", F.col("class").alias("euluc_class"))
    return B.class_agreement(master(i), again, "bid", "euluc_class")


def feature_rows(i: Inputs):
    """Stored feature table and its column order."""
    df = stored(i, "features", lambda: B.feature_table(master(i), buildings(i), parcels(i))[0])
    return df, [c for c in df.columns if c not in ("bid", "rep_x", "rep_y")]


#: codes of the two category columns in the given tables, for the reference SQL; the operator finds them in the data
EULUC_CODES, EP_CODES = range(11), range(14)

#: feature, SQL, digits both sides round to
MATRIX = [
    ("area_m2", "g.area_m2", None),
    ("perimeter_m", "g.perimeter_m", None),
    ("compactness", "4*pi()*g.area_m2/(g.perimeter_m*g.perimeter_m)", 9),
    ("aspect_ratio", "r.aspect", 6),
    ("convexity", "g.area_m2/h.hull_area", 9),
    ("floors_feat", "s.floors_feat", None),
    ("gfa_m2", "s.gfa_m2", 6),
    ("is_supertall_int", "s.is_supertall_int", None),
    ("n_bld_100m", "n.n_bld_100m", None),
    ("nbr_fp_med_m2", "n.nbr_fp_med_m2", None),
    ("nn_dist_m", "n.nn", 6),
    ("parcel_area_m2", "p.parcel_area_m2", None),
    ("n_bld_in_parcel", "p.n_bld_in_parcel", None),
    ("gfa_share_parcel", "p.gfa_share_parcel", 9),
    ("in_parcel", "p.in_parcel", None),
    *((f"euluc_{c}", f"s.euluc_class IS NOT DISTINCT FROM {c}", None) for c in EULUC_CODES),
    ("euluc_nan", "s.euluc_out", None),
    *((f"ep_{c}", f"g.ep IS NOT DISTINCT FROM {c}", None) for c in EP_CODES),
    ("ep_nan", "g.ep IS NULL", None),
]


def _matrix_sql() -> str:
    cells = [f"CAST({sql} AS DOUBLE)" if digits is None else f"round(CAST({sql} AS DOUBLE), {digits})" for _, sql, digits in MATRIX]
    cols = ", ".join(f"{cell} AS {name}" for cell, (name, _, _) in zip(cells, MATRIX, strict=True))
    joins = "JOIN hull h USING (bid) JOIN rect r USING (bid) JOIN sc s USING (bid) JOIN ns n USING (bid) JOIN pf p USING (bid)"
    return f"SELECT g.bid, {cols}, {len(MATRIX)} AS n_features FROM g26 g {joins}"


@register("b5_feature_matrix", _matrix_sql(), ALL)
def b5_feature_matrix(i: Inputs):
    f, names = feature_rows(i)
    digits = {name: d for name, _, d in MATRIX}
    cols = [F.round(c, digits[c]).alias(c) if digits.get(c) is not None else F.col(c) for c in names]
    return B.require_finite(f, names).select("bid", *cols, F.lit(len(names)).alias("n_features"))


EXCLUDED = [9, 96, 141]


@register(
    "b6_truth_set",
    """SELECT val_id, t.bid, archetype AS truth_arch, m.class IS NOT NULL AS in_parcel, val_id NOT IN (9, 96, 141) AS is_train
FROM tmatch t JOIN truth USING (val_id) LEFT JOIN bp m ON m.bid = t.bid WHERE status = 'annotated'""",
)
def b6_truth_set(i: Inputs):
    return M.truth_set(i.view("truth"), buildings(i), master(i), EXCLUDED)


PLANE_CELL_M = 500.0


def _train(i: Inputs):
    f, names = feature_rows(i)
    t = M.truth_set(i.view("truth"), buildings(i), master(i), EXCLUDED).where("is_train")
    j = t.join(M.assemble(f, names, ["bid", "rep_x", "rep_y"]), "bid")
    return M.with_cell(j, "rep_x", "rep_y", PLANE_CELL_M), names


# cells by size, then one after the other to the fold with the fewest rows so far (the first of equal ones)
FOLDS = {
    "trained": f"""SELECT val_id, t.bid, CAST(floor(g.rx/{PLANE_CELL_M:.0f}) AS BIGINT)*100000 + CAST(floor(g.ry/{PLANE_CELL_M:.0f}) AS BIGINT) AS cell
FROM tmatch t JOIN truth USING (val_id) JOIN g26 g ON g.bid = t.bid WHERE status = 'annotated' AND val_id NOT IN (9, 96, 141)""",
    "ordered": "SELECT cell, n, row_number() OVER (ORDER BY n DESC, cell) AS r FROM (SELECT cell, count(*) AS n FROM trained GROUP BY cell)",
    "dealt": f"""
WITH RECURSIVE d AS (
  SELECT CAST(0 AS BIGINT) AS r, CAST({[0] * rules.CV_FOLDS} AS BIGINT[]) AS held, CAST(NULL AS BIGINT) AS cell, CAST(NULL AS INT) AS fold
  UNION ALL
  SELECT o.r, list_transform(held, lambda h, k: h + CASE WHEN k = list_position(held, list_min(held)) THEN o.n ELSE 0 END), o.cell, CAST(list_position(held, list_min(held)) - 1 AS INT)
  FROM d JOIN ordered o ON o.r = d.r + 1)
SELECT cell, fold FROM d WHERE r > 0""",
}


@register("b7_spatial_folds", "SELECT val_id, bid, cell, fold FROM trained JOIN dealt USING (cell)", FOLDS)
def b7_spatial_folds(i: Inputs):
    """Folds need the place of a building only: no labels, no features."""
    t = M.matched_truth(i.view("truth"), buildings(i), EXCLUDED).where("is_train")
    rows = M.with_cell(t.join(slim(i).select("bid", "rep_x", "rep_y"), "bid"), "rep_x", "rep_y", PLANE_CELL_M)
    return M.spatial_folds(rows).select("val_id", "bid", "cell", "fold")


def _modelled(i: Inputs):
    """Final model: city predictions and importances, stored together."""

    def build():
        train, names = _train(i)
        labels = M.class_labels(train)
        model = M.fit_forest(train, labels)
        f, _ = feature_rows(i)
        return {
            "city": M.predict(model, M.assemble(f, names, ["bid"]), labels, ["bid"]),
            "importance": E.importance_table(i.spark, names, M.importances(model)),
        }

    return stored_tables(i, "model", build, ("orders", "customer", "part"))


def _oof(i: Inputs):
    def build():
        train, _ = _train(i)
        train = M.spatial_folds(train)
        return {"oof": M.out_of_fold(train, M.class_labels(train))}

    return stored_tables(i, "oof", build, ("orders", "customer", "part"))["oof"]


@register("b8_city_predictions")
def b8_city_predictions(i: Inputs):
    return _modelled(i)["city"]


@register("b8_out_of_fold")
def b8_out_of_fold(i: Inputs):
    return _oof(i)


@register("b9_combined_predictions")
def b9_combined_predictions(i: Inputs):
    matched = M.truth_set(i.view("truth"), buildings(i), master(i), EXCLUDED)
    return E.combine_predictions(matched, _oof(i), _modelled(i)["city"]).select("val_id", "bid", "truth_arch", "in_parcel", "pred_class")


@register("b10_importances")
def b10_importances(i: Inputs):
    return _modelled(i)["importance"]


# Reports are checked on a reproducible prediction: the rule label and a confidence from the key.
PRED = {
    **SCALE,
    "pred": """
SELECT m.bid, CASE WHEN archetype LIKE 'residential%' THEN 'residential' ELSE archetype END AS pred_class,
  CAST((m.bid*7919) % 1000 AS DOUBLE)/1000 AS pred_confidence, euluc_out, district, archetype, floors, m.area_m2, rx, ry FROM master m""",
    "pt": """
SELECT t.val_id, p.*, x.archetype AS truth_arch, s.gfa_m2, s.euluc_class IS NOT NULL AS in_parcel FROM tmatch t JOIN truth x USING (val_id)
JOIN pred p ON p.bid = t.bid JOIN sc s ON s.bid = t.bid WHERE x.status = 'annotated'""",
}
LABELS = ["culture", "education", "office", "residential", "shopping_mall", "unknown"]
SHARES = ["residential", "office", "shopping_mall", "unknown"]


def predictions(i: Inputs):
    conf = ((F.col("bid") * 7919) % 1000).cast("double") / 1000.0
    return master(i).withColumns({"pred_class": L.coarse(F.col("archetype")), "pred_confidence": conf})


def labelled_predictions(i: Inputs):
    t = M.truth_set(i.view("truth"), buildings(i), master(i), [])
    p = predictions(i).select("bid", "pred_class", "pred_confidence")
    return t.join(p, "bid").join(B.scale_features(master(i)).select("bid", "gfa_m2"), "bid")


@register(
    "a25_confidence_histogram",
    """
SELECT CAST(b AS INT) AS bin, CAST(b AS DOUBLE)/10 AS lo, CAST(b + 1 AS DOUBLE)/10 AS hi, count(p.bid) AS n,
  round_even(CAST(100 AS DOUBLE)*count(p.bid)/(SELECT count(*) FROM pred), 2) AS share_pct
FROM (SELECT unnest(range(10)) AS b) LEFT JOIN pred p ON p.pred_confidence >= CAST(b AS DOUBLE)/10 AND (p.pred_confidence < CAST(b + 1 AS DOUBLE)/10 OR b = 9) GROUP BY b""",
    PRED,
)
def a25_confidence_histogram(i: Inputs):
    return E.confidence_histogram(predictions(i))


@register(
    "a26_confidence_by_class",
    """SELECT pred_class, count(*) AS n, round_even(avg(CAST(pred_confidence AS DECIMAL(20,10))), 3) AS mean_confidence, round_even(quantile_cont(pred_confidence, 0.5), 3) AS median_confidence
FROM pred GROUP BY 1""",
    PRED,
)
def a26_confidence_by_class(i: Inputs):
    return E.confidence_by_class(predictions(i))


@register(
    "a27_scope_diagnostics",
    """
SELECT s.scope, count(*) AS n, round_even(avg(CAST(pred_confidence AS DECIMAL(20,10))), 3) AS conf_mean, round_even(quantile_cont(pred_confidence, 0.5), 3) AS conf_median,
 round_even(100*avg(euluc_out::INT), 1) AS euluc_out_share_pct, """
    + ", ".join(f"round_even(100*avg((pred_class = '{x}')::INT), 1) AS share_{x}_pct" for x in SHARES)
    + """ FROM pred JOIN (VALUES ('citywide'), ('west'), ('south')) s(scope) ON s.scope = 'citywide' OR (s.scope = 'west' AND rx <= 600) OR (s.scope = 'south' AND ry <= 200)
GROUP BY 1""",
    PRED,
)
def a27_scope_diagnostics(i: Inputs):
    scopes = {"citywide": F.lit(True), "west": F.col("rep_x") <= 600, "south": F.col("rep_y") <= 200}
    return E.scope_diagnostics(predictions(i), scopes, SHARES)


@register(
    "a28_confusion",
    "SELECT l.truth, " + ", ".join(f"count(*) FILTER (p.pred_class = '{x}') AS {x}" for x in LABELS)
    + " FROM (VALUES " + ", ".join(f"('{x}')" for x in LABELS) + ") l(truth) LEFT JOIN pt p ON p.truth_arch = l.truth GROUP BY 1",
    PRED,
)
def a28_confusion(i: Inputs):
    return E.confusion(labelled_predictions(i), LABELS)


@register(
    "a29_class_metrics",
    """
SELECT class, n_truth, round_even(pr, 3) AS precision, round_even(re, 3) AS recall, round_even(coalesce(2*pr*re/nullif(pr+re, 0), 0), 3) AS f1, n_truth >= 5 AS learnable
FROM (SELECT l.class, count(*) FILTER (truth_arch = l.class) AS n_truth,
  coalesce(count(*) FILTER (truth_arch = l.class AND pred_class = l.class)/CAST(nullif(count(*) FILTER (pred_class = l.class), 0) AS DOUBLE), 0) AS pr,
  coalesce(count(*) FILTER (truth_arch = l.class AND pred_class = l.class)/CAST(nullif(count(*) FILTER (truth_arch = l.class), 0) AS DOUBLE), 0) AS re
 FROM (VALUES """ + ", ".join(f"('{x}')" for x in LABELS) + """) l(class) CROSS JOIN pt GROUP BY 1)""",
    PRED,
)
def a29_class_metrics(i: Inputs):
    return E.class_metrics(labelled_predictions(i), LABELS)


POISSON = "CASE " + " ".join(f"WHEN u < CAST({c!r} AS DOUBLE) THEN {k}" for k, c in enumerate(POISSON_CDF)) + f" ELSE {len(POISSON_CDF)} END"


BOOT = {
    "bt": f"""SELECT b, h, gfa_m2, in_parcel, CAST({POISSON} AS DOUBLE) AS t FROM (
   SELECT *, CAST((h2*h2 + k*40692 + 7) % 2147483647 AS DOUBLE)/2147483647 AS u FROM (
    SELECT *, (h1*h1 + b*16807 + k*11) % 2147483647 AS h2 FROM (
     SELECT val_id::BIGINT AS k, b, (truth_arch = pred_class)::INT::DOUBLE AS h, gfa_m2, in_parcel, (val_id::BIGINT*48271 + b*69621 + 20260712) % 2147483647 AS h1
     FROM pt CROSS JOIN (SELECT unnest(range(1, 10001)) AS b))))""",
    "reps": """SELECT s.denominator, b, sum(t*h)/sum(t) AS plain, sum(t*gfa_m2*h)/sum(t*gfa_m2) AS weighted FROM bt
 JOIN (VALUES ('full_matched'), ('in_parcel')) s(denominator) ON s.denominator = 'full_matched' OR in_parcel WHERE t > 0 GROUP BY 1, 2""",
    "point": """SELECT s.denominator, count(*) AS n, avg((truth_arch = pred_class)::INT) AS plain, sum((truth_arch = pred_class)::INT*gfa_m2)/sum(gfa_m2) AS weighted
FROM pt JOIN (VALUES ('full_matched'), ('in_parcel')) s(denominator) ON s.denominator = 'full_matched' OR in_parcel GROUP BY 1""",
}


@register(
    "a30_accuracy_by_scope",
    """
SELECT p.denominator, p.n, m.metric, round_even(any_value(CASE m.metric WHEN 'accuracy' THEN p.plain ELSE p.weighted END)*100, 1) AS value,
 round_even(quantile_cont(CASE m.metric WHEN 'accuracy' THEN r.plain ELSE r.weighted END, 0.025)*100, 1) AS ci95_lo,
 round_even(quantile_cont(CASE m.metric WHEN 'accuracy' THEN r.plain ELSE r.weighted END, 0.975)*100, 1) AS ci95_hi
FROM point p JOIN reps r USING (denominator) CROSS JOIN (VALUES ('accuracy'), ('gfa_weighted_accuracy')) m(metric) GROUP BY 1, 2, 3""",
    {**PRED, **BOOT},
)
def a30_accuracy_by_scope(i: Inputs):
    """Both accuracies of both denominators with their bootstrap intervals."""
    scopes = {"full_matched": F.lit(True), "in_parcel": F.col("in_parcel")}
    return E.accuracy_with_intervals(labelled_predictions(i), "val_id", scopes)


@register(
    "r4_bootstrap_interval",
    f"""
SELECT v.value, quantile_cont(s, 0.025) AS ci95_lo, quantile_cont(s, 0.975) AS ci95_hi, v.n FROM (
 SELECT b, sum(t*h)/sum(t) AS s FROM (SELECT b, h, CAST({POISSON} AS DOUBLE) AS t FROM (
   SELECT b, h, CAST((h2*h2 + k*40692 + 7) % 2147483647 AS DOUBLE)/2147483647 AS u FROM (
    SELECT k, b, h, (h1*h1 + b*16807 + k*11) % 2147483647 AS h2 FROM (
     SELECT val_id::BIGINT AS k, b, (truth_arch = pred_class)::INT::DOUBLE AS h, (val_id::BIGINT*48271 + b*69621 + 20260712) % 2147483647 AS h1
     FROM pt CROSS JOIN (SELECT unnest(range(1, 10001)) AS b))))) GROUP BY b),
 (SELECT avg((truth_arch = pred_class)::INT) AS value, count(*) AS n FROM pt) v GROUP BY v.value, v.n""",
    PRED,
)
def r4_bootstrap_interval(i: Inputs):
    hit = F.col("truth_arch") == F.col("pred_class")
    return R.poisson_bootstrap(labelled_predictions(i), "val_id", hit, F.lit(1.0), rules.BOOTSTRAP_N, rules.MODEL_SEED)


@register(
    "w5_importance_rank",
    """SELECT p_type AS feature, round(avg(p_retailprice), 6) AS importance, row_number() OVER (ORDER BY round(avg(p_retailprice), 6) DESC, p_type) AS rank,
 row_number() OVER (ORDER BY round(avg(p_retailprice), 6) DESC, p_type) <= 10 AS top10 FROM part GROUP BY 1""",
)
def w5_importance_rank(i: Inputs):
    scores = i.table("part").groupBy(F.col("p_type").alias("feature")).agg(F.round(F.avg("p_retailprice"), 6).alias("importance"))
    return E.with_importance_rank(scores)


@register(
    "w7_round_robin",
    """SELECT bid, pred_class FROM (SELECT bid, pred_class, row_number() OVER (PARTITION BY pred_class ORDER BY md5('20260712:' || bid)) AS r FROM pred WHERE pred_confidence <= (SELECT quantile_cont(pred_confidence, 0.1) FROM pred))
ORDER BY r, pred_class LIMIT 20""",
    PRED,
)
def w7_round_robin(i: Inputs):
    """From the tenth of the buildings with the lowest confidence."""
    pred = predictions(i)
    low = exact_quantiles(pred, F.col("pred_confidence"), [0.1]).select(F.col("value").alias("_q"))
    pool = pred.crossJoin(F.broadcast(low)).where(F.col("pred_confidence") <= F.col("_q")).select("bid", "pred_class")
    return R.round_robin(pool, "pred_class", 20, rules.MODEL_SEED, "bid")


LIST_WINDOWS = {"lingang": (400.0, 150.0, 150.0), "zhangjiang": (2200.0, 150.0, 150.0)}


def _listing() -> dict[str, str]:
    """Strata of the labelling list in SQL: each draw excludes labelled rows and those drawn before."""
    q, edges = rules.LIST_QUOTAS, rules.LIST_FLOOR_EDGES
    cut = lambda value, share, where: f"(SELECT quantile_cont({value}, {share}::DOUBLE) FROM pred WHERE {where})"
    hotel, bundle = "archetype = 'hotel'", "archetype = 'sport_culture'"
    quart = [cut("area_m2", x, bundle) for x in (0.25, 0.5, 0.75)]
    parts = [f"area_m2 <= {quart[0]}", f"area_m2 > {quart[0]} AND area_m2 <= {quart[1]}", f"area_m2 > {quart[1]} AND area_m2 <= {quart[2]}", f"area_m2 > {quart[2]}"]
    box = {k: f"rx BETWEEN {x - h} AND {x + h} AND ry BETWEEN {y - h} AND {y + h}" for k, (x, y, h) in LIST_WINDOWS.items()}
    strata = [
        [("hotel_high_conf", f"{hotel} AND pred_confidence >= {cut('pred_confidence', 0.667, hotel)}", q["hotel"] // 2)],
        [("hotel_low_conf", f"{hotel} AND pred_confidence <= {cut('pred_confidence', 0.333, hotel)}", q["hotel"] - q["hotel"] // 2)],
        [(f"sport_culture_fp_q{k + 1}", f"{bundle} AND {c}", q["bundle"] // 4 + (k < q["bundle"] % 4)) for k, c in enumerate(parts)],
        [*((f"floors_{a}_{b - 1}", f"floors BETWEEN {a} AND {b - 1}", q["floors"]) for a, b in zip(edges, edges[1:])), (f"floors_{edges[-1]}plus", f"floors >= {edges[-1]}", q["floors"])],
        *([(f"low_conf_{k}", f"{b} AND pred_confidence <= {cut('pred_confidence', 0.333, b)}", q["window"])] for k, b in box.items()),
    ]
    out = {
        "labelled": "SELECT val_id, t.bid FROM tmatch t JOIN truth USING (val_id) WHERE status = 'annotated'",
        "listed0": f"SELECT bid, 'reassess_' || val_id AS stratum FROM labelled WHERE val_id IN ({', '.join(map(str, EXCLUDED))})",
    }
    for n, some in enumerate(strata):
        case = " ".join(f"WHEN {c} THEN '{k}'" for k, c, _ in some)
        quota = " ".join(f"WHEN '{k}' THEN {m}" for k, _, m in some)
        out[f"listed{n + 1}"] = f"""SELECT * FROM listed{n} UNION ALL SELECT bid, stratum FROM (SELECT bid, CASE {case} END AS stratum FROM pred) WHERE stratum IS NOT NULL
 AND bid NOT IN (SELECT bid FROM labelled) AND bid NOT IN (SELECT bid FROM listed{n})
 QUALIFY row_number() OVER (PARTITION BY stratum ORDER BY md5('{rules.MODEL_SEED}:' || stratum || ':' || bid)) <= CASE stratum {quota} END"""
    last = f"listed{len(strata)}"
    away = " AND ".join(f"NOT ({b})" for b in box.values())
    out["listing"] = f"""SELECT * FROM {last} UNION ALL SELECT bid, 'low_conf_citywide' FROM (SELECT bid, pred_class,
 row_number() OVER (PARTITION BY pred_class ORDER BY md5('{rules.MODEL_SEED}:' || bid)) AS turn FROM pred
 WHERE pred_confidence <= {cut('pred_confidence', 0.1, 'true')} AND {away} AND bid NOT IN (SELECT bid FROM labelled) AND bid NOT IN (SELECT bid FROM {last})
 ORDER BY turn, pred_class LIMIT {q["low_conf"]})"""
    return out


def _listed(i: Inputs):
    matched = M.truth_set(i.view("truth"), buildings(i), master(i), []).select("val_id", "bid")
    boxes = {k: R.in_window(F.col("rep_x"), F.col("rep_y"), F.lit(x), F.lit(y), F.lit(h)) for k, (x, y, h) in LIST_WINDOWS.items()}
    rows = predictions(i)
    listed = R.labelling_list(rows, matched, EXCLUDED, boxes, rules.MODEL_SEED)
    return R.labelling_sheet(listed, rows, F.lit(121.0) + F.col("rep_x") / 100000.0, F.lit(30.9) + F.col("rep_y") / 100000.0)


@register(
    "r3_labelling_list",
    """SELECT l.bid, m.district, round_even(30.9::DOUBLE + m.ry/100000, 7) AS lat_wgs84, round_even(121 + m.rx/100000, 7) AS lon_wgs84, m.label_rule, m.euluc_class, m.floors,
 round_even(m.area_m2, 1) AS footprint_m2, p.pred_class, round_even(p.pred_confidence, 3) AS pred_confidence, l.stratum, '' AS actual_class, '' AS actual_floors, '' AS notes
FROM listing l JOIN pred p USING (bid) JOIN master m ON m.bid = l.bid""",
    {**PRED, **_listing()},
)
def r3_labelling_list(i: Inputs):
    """The sheet but for the shifted position, which ``r3_labelling_positions`` returns."""
    return _listed(i).drop("lat_bd09", "lon_bd09")


@register(
    "r3_labelling_positions",
    """
SELECT id AS bid, round_even(z*sin(t) + 0.006, 7) AS lat_bd09, round_even(z*cos(t) + 0.0065, 7) AS lon_bd09 FROM (
 SELECT id, sqrt(glon*glon + glat*glat) + 0.00002*sin(glat*pi()*3000/180) AS z, atan2(glat, glon) + 0.000003*cos(glon*pi()*3000/180) AS t FROM gcj)""",
    {**PRED, **_listing(), "ll": "SELECT l.bid AS id, CAST(121 AS DOUBLE) + m.rx/100000 AS lon, CAST(30.9 AS DOUBLE) + m.ry/100000 AS lat FROM listing l JOIN master m USING (bid)", "gcj": GCJ["gcj"]},
)
def r3_labelling_positions(i: Inputs):
    return _listed(i).select("bid", "lat_bd09", "lon_bd09")
