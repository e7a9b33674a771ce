"""Spatial and relational joins, two-set pairing reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from cityloom.functions import geometry as G
from cityloom.operators import labelling as L, pairing as P, spatial
from cityloom.plans.inputs import buildings, buildings_2023, master, parcels, slim
from cityloom.plans.registry import register
from cityloom.sources.views import Inputs


@register("j1_parcel_join", "SELECT g.bid, p.parcel_id, p.class AS euluc_class, p.class IS NULL AS euluc_out FROM b26 g LEFT JOIN bp p ON p.bid = g.bid")
def j1_parcel_join(i: Inputs):
    b = slim(i)
    return L.with_parcel_class(b, L.parcel_of(b, parcels(i))).select("bid", "parcel_id", "euluc_class", "euluc_out")


@register(
    "j2_supertall_overlap",
    "SELECT bid, floors, floors_source FROM chassis WHERE is_supertall",
)
def j2_supertall_overlap(i: Inputs):
    b = buildings(i)
    out = L.resolve_supertall(L.with_floors(b.select("bid", "height")), b, buildings_2023(i))
    return out.where("is_supertall").select("bid", "floors", "floors_source")


@register(
    "j3_best_overlap",
    "SELECT bid23, bid, height, floors_2023, inter, area23, area26, round(iou, 9) AS iou, round(overlap23, 9) AS overlap23 FROM best23",
)
def j3_best_overlap(i: Inputs):
    m = P.overlap_matches(buildings_2023(i), buildings(i))
    return m.withColumns({"iou": F.round("iou", 9), "overlap23": F.round("overlap23", 9)})


@register("j4_centroid_pairs", "SELECT bid23, bid, height, area26, floors_2023, area23 FROM cenp")
def j4_centroid_pairs(i: Inputs):
    return P.centroid_matches(buildings_2023(i), buildings(i))


@register("j5_label_match", "SELECT val_id, bid, round(match_dist, 6) AS match_dist FROM tmatch")
def j5_label_match(i: Inputs):
    m = L.match_labels(i.view("truth"), buildings(i))
    return m.select("val_id", "bid", F.round("match_dist", 6).alias("match_dist"))


@register("j6_nearest_building", "SELECT id, bid, round(dist, 6) AS dist FROM pn")
def j6_nearest_building(i: Inputs):
    n = L.nearest_buildings(i.view("poi"), slim(i), 150.0)
    return n.select("id", "bid", F.round("dist", 6).alias("dist"))


@register(
    "j7_gated_hits",
    "SELECT DISTINCT n.bid FROM pn n JOIN codes c ON c.id = n.id JOIN bp b ON b.bid = n.bid WHERE c.code LIKE '1002%' AND b.class IN (1, 2)",
)
def j7_gated_hits(i: Inputs):
    b = slim(i)
    poi = i.view("poi").where(L.any_prefix(F.col("typecode"), "1002"))
    allowed = L.parcel_of(b, parcels(i)).where(F.col("class").isin(1, 2)).select("bid")
    return L.nearest_buildings(poi, b, 150.0).join(allowed, "bid", "left_semi").select("bid").distinct()


NEIGHBOURS = {
    "nb": """
SELECT a.bid, b.bid AS other, b.area_m2 AS other_area, sqrt((a.rx-b.rx)*(a.rx-b.rx) + (a.ry-b.ry)*(a.ry-b.ry)) AS dist
FROM (SELECT *, CAST(floor(rx/100) AS INT) AS cx, CAST(floor(ry/100) AS INT) AS cy FROM g26) a
JOIN (SELECT g.*, CAST(floor(rx/100) AS INT) + dx AS cx, CAST(floor(ry/100) AS INT) + dy AS cy
      FROM g26 g, (VALUES (-1), (0), (1)) u(dx), (VALUES (-1), (0), (1)) v(dy)) b
  ON a.cx = b.cx AND a.cy = b.cy AND a.bid <> b.bid
WHERE sqrt((a.rx-b.rx)*(a.rx-b.rx) + (a.ry-b.ry)*(a.ry-b.ry)) <= 100"""
}


@register(
    "j8_neighbour_pairs",
    """SELECT bid, count(*) AS n_higher, round(max(dist), 6) AS farthest, round(min(dist), 6) AS closest
FROM nb WHERE bid < other GROUP BY bid""",
    NEIGHBOURS,
)
def j8_neighbour_pairs(i: Inputs):
    """Unordered pairs within 100 m, counted at the lower id of each pair (pairs themselves never leave the join)."""
    b = slim(i)
    left = b.select("bid", "rep_x", "rep_y")
    right = b.select(F.col("bid").alias("other"), F.col("rep_x").alias("o_x"), F.col("rep_y").alias("o_y"))
    pairs = spatial.radius_pairs(left, right, 100.0, ("rep_x", "rep_y"), ("o_x", "o_y"))
    return pairs.where(F.col("bid") < F.col("other")).groupBy("bid").agg(
        F.count(F.lit(1)).alias("n_higher"), F.round(F.max("dist"), 6).alias("farthest"), F.round(F.min("dist"), 6).alias("closest")
    )


@register(
    "j9_nearest_neighbour",
    "SELECT bid, round(min(dist), 6) AS nn_dist_m FROM nb GROUP BY bid",
    NEIGHBOURS,
)
def j9_nearest_neighbour(i: Inputs):
    pts = slim(i).select("bid", F.col("rep_x").alias("x"), F.col("rep_y").alias("y"))
    nn = spatial.nearest_unbounded(pts, pts, "bid", "bid", same_table=True, out_id="other")
    return nn.select("bid", F.round("dist", 6).alias("nn_dist_m"))


@register(
    "j17_equi_merge",
    "SELECT m.bid, m.archetype, v.ep, v.district FROM master m LEFT JOIN b26 v USING (bid)",
)
def j17_equi_merge(i: Inputs):
    return master(i).select("bid", "archetype").join(i.buildings().select("bid", "ep", "district"), "bid", "left")


@register(
    "j18_semi_anti",
    """SELECT bid, 'mall_hit' AS kind FROM master WHERE bid IN (SELECT bid FROM sig WHERE mall)
UNION ALL SELECT bid, 'not_labelled' FROM master WHERE bid NOT IN (SELECT bid FROM tmatch)""",
)
def j18_semi_anti(i: Inputs):
    m = master(i).select("bid", "mall_signal")
    hit = m.join(m.where("mall_signal").select("bid"), "bid", "left_semi").select("bid", F.lit("mall_hit").alias("kind"))
    matched = L.match_labels(i.view("truth"), buildings(i)).select("bid")
    free = m.join(matched, "bid", "left_anti").select("bid", F.lit("not_labelled").alias("kind"))
    return hit.unionByName(free)


@register(
    "j22_tallest_floors",
    """
SELECT t.bid, t.height, t.district, f.bid23, g.floor23, f.match_via, CAST(g.floor23//2 AS INT) AS implied_floors
FROM top t LEFT JOIN fl f ON f.bid = t.bid LEFT JOIN g23 g ON g.bid23 = f.bid23""",
    {
        "top": "SELECT * FROM g26 ORDER BY height DESC, bid LIMIT 20",
        "ins": """SELECT t.bid, min(g.bid23) AS bid23 FROM top t JOIN g23 g ON t.rx > g.x0 AND t.rx < g.x0+g.w AND t.ry > g.y0 AND t.ry < g.y0+g.d
   AND NOT (g.lshape AND t.rx >= g.x0+g.w/2 AND t.ry >= g.y0+g.d/2) GROUP BY 1""",
        "ovl": """SELECT o.bid, o.bid23 FROM ov o JOIN top t ON t.bid = o.bid WHERE o.bid NOT IN (SELECT bid FROM ins)
   QUALIFY row_number() OVER (PARTITION BY o.bid ORDER BY o.inter DESC, o.bid23) = 1""",
        "fl": "SELECT *, 'inside' AS match_via FROM ins UNION ALL SELECT *, 'overlap' FROM ovl",
    },
)
def j22_tallest_floors(i: Inputs):
    return P.tallest_with_floors(buildings(i), buildings_2023(i))


@register(
    "a1_band_table",
    """
SELECT b.band, b.lo AS floors_min, b.hi AS floors_max, count(*) AS n_clean_pairs,
 round_even(quantile_cont(height/CAST(floors_2023 AS DOUBLE), 0.25), 3) AS storey_height_p25_m,
 round_even(quantile_cont(height/CAST(floors_2023 AS DOUBLE), 0.5), 3) AS storey_height_median_m,
 round_even(quantile_cont(height/CAST(floors_2023 AS DOUBLE), 0.75), 3) AS storey_height_p75_m,
 round_even(avg(CAST(height = 4*floors_2023 AS INT)), 4) AS frac_height_eq_2x_floor
FROM best23 JOIN (VALUES (1,3,'1-3'), (4,6,'4-6'), (7,9,'7-9'), (10,18,'10-18'), (19,30,'19-30'), (31,39,'31-39')) b(lo, hi, band)
  ON floors_2023 BETWEEN b.lo AND b.hi WHERE iou >= CAST(0.3 AS DOUBLE) GROUP BY 1, 2, 3""",
)
def a1_band_table(i: Inputs):
    return P.band_table(P.overlap_matches(buildings_2023(i), buildings(i)).where(F.col("iou") >= 0.3))


@register(
    "a2_synthetic_height",
    """
SELECT pairing, count(*) AS n, round(quantile_cont(height/CAST(floors_2023 AS DOUBLE), 0.25), 6) AS p25,
 round(quantile_cont(height/CAST(floors_2023 AS DOUBLE), 0.5), 6) AS median, round(quantile_cont(height/CAST(floors_2023 AS DOUBLE), 0.75), 6) AS p75,
 round(avg(CAST(height = 4*floors_2023 AS INT)), 6) AS share_equal, round(avg(CAST(abs(height - 4*floors_2023) <= 2 AS INT)), 6) AS share_within_2m
FROM (SELECT 'iou_0.3' AS pairing, height, floors_2023 FROM best23 WHERE iou >= CAST(0.3 AS DOUBLE)
 UNION ALL SELECT 'iou_0.7', height, floors_2023 FROM best23 WHERE iou >= CAST(0.7 AS DOUBLE)
 UNION ALL SELECT 'centroid', height, floors_2023 FROM cenp)
WHERE floors_2023 BETWEEN 1 AND 39 GROUP BY 1""",
)
def a2_synthetic_height(i: Inputs):
    a, b = buildings_2023(i), buildings(i)
    return P.synthetic_report(P.overlap_matches(a, b), P.centroid_matches(a, b))


@register(
    "a3_anomaly_pairs",
    """
SELECT pairing, count(*) AS n, round(quantile_cont(r, 0.5), 6) AS median, round(avg(CAST(r BETWEEN 3.5 AND 4.5 AS INT)), 6) AS share_near_4,
 round(avg(CAST(r BETWEEN 7 AND 9 AS INT)), 6) AS share_near_8
FROM (SELECT 'iou_0.3' AS pairing, height/CAST(floors_2023 AS DOUBLE) AS r FROM best23 WHERE iou >= CAST(0.3 AS DOUBLE) AND floors_2023 BETWEEN 7 AND 12
 UNION ALL SELECT 'centroid', height/CAST(floors_2023 AS DOUBLE) FROM cenp WHERE floors_2023 BETWEEN 7 AND 12) GROUP BY 1""",
)
def a3_anomaly_pairs(i: Inputs):
    a, b = buildings_2023(i), buildings(i)
    return P.anomaly_pairs(P.overlap_matches(a, b), P.centroid_matches(a, b))


TRUTH23 = {
    "t23in": """
SELECT t.val_id, min(b.bid23) AS bid23 FROM truth t JOIN g23 b
  ON t.x > b.x0 AND t.x < b.x0+b.w AND t.y > b.y0 AND t.y < b.y0+b.d
 AND NOT (b.lshape AND t.x >= b.x0+b.w/2 AND t.y >= b.y0+b.d/2) GROUP BY 1""",
    "t23near": """
SELECT t.val_id, r.bid23, min(sqrt(power(greatest(r.xa - t.x, 0, t.x - r.xb), 2) + power(greatest(r.ya - t.y, 0, t.y - r.yb), 2))) AS dist
FROM truth t JOIN r23 r ON t.x BETWEEN r.xa - 10 AND r.xb + 10 AND t.y BETWEEN r.ya - 10 AND r.yb + 10
WHERE t.val_id NOT IN (SELECT val_id FROM t23in) GROUP BY 1, 2
HAVING min(sqrt(power(greatest(r.xa - t.x, 0, t.x - r.xb), 2) + power(greatest(r.ya - t.y, 0, t.y - r.yb), 2))) <= 10
QUALIFY row_number() OVER (PARTITION BY t.val_id ORDER BY dist, r.bid23) = 1""",
    "lab": """
SELECT t.*, h.height AS height26, g.floor23, g.floors_2023 FROM truth t LEFT JOIN tmatch m USING (val_id)
LEFT JOIN b26 h ON h.bid = m.bid
LEFT JOIN (SELECT val_id, bid23 FROM t23in UNION ALL SELECT val_id, bid23 FROM t23near) x ON x.val_id = t.val_id
LEFT JOIN g23 g ON g.bid23 = x.bid23""",
}


@register(
    "a3_anomaly_labels",
    """
SELECT archetype, count(*) AS n, round(quantile_cont(floor23/CAST(floors_observed AS DOUBLE), 0.5), 6) AS median_floor_ratio,
  count(*) FILTER (height26/CAST(floors_observed AS DOUBLE) BETWEEN 2.5 AND 4.5) AS n_plausible
FROM lab WHERE floors_observed BETWEEN 7 AND 12 AND floor23 IS NOT NULL GROUP BY 1""",
    TRUTH23,
)
def a3_anomaly_labels(i: Inputs):
    return P.anomaly_labels(P.labelled_heights(i.view("truth"), buildings_2023(i), buildings(i)), "archetype")


@register(
    "a4_floor_errors",
    """
SELECT source, count(*) AS n, round(avg(abs(pred-obs)), 6) AS mae, round(avg(pred-obs), 6) AS bias,
 round(avg(CAST(abs(pred-obs) <= 1 AS INT)), 6) AS within_1, round(avg(CAST(abs(pred-obs) <= 2 AS INT)), 6) AS within_2,
 round(quantile_cont(abs(pred-obs)/obs, 0.5), 6) AS median_ape
FROM (SELECT s.source, CAST(floors_observed AS DOUBLE) AS obs,
   CASE s.source WHEN 'height_over_4' THEN round_even(CAST(height26 AS DOUBLE)/4, 0) WHEN 'height_over_3' THEN round_even(CAST(height26 AS DOUBLE)/3, 0)
        ELSE CAST(floors_2023 AS DOUBLE) END AS pred
  FROM lab CROSS JOIN (VALUES ('height_over_4'), ('height_over_3'), ('floors_2023')) s(source)
  WHERE status = 'annotated' AND floors_observed > 0 AND floors_observed < 40 AND height26 IS NOT NULL)
WHERE pred IS NOT NULL GROUP BY 1""",
    TRUTH23,
)
def a4_floor_errors(i: Inputs):
    return P.floor_error_report(P.labelled_heights(i.view("truth"), buildings_2023(i), buildings(i)), [4.0, 3.0])


@register(
    "a18_floor_ratio_bins",
    """
SELECT CASE WHEN floors_observed <= 3 THEN '1-3' WHEN floors_observed <= 6 THEN '4-6' WHEN floors_observed <= 12 THEN '7-12'
  WHEN floors_observed <= 30 THEN '13-30' ELSE '>30' END AS bin, count(*) AS n,
 round(quantile_cont(floor23/CAST(floors_observed AS DOUBLE), 0.5), 6) AS median_ratio,
 round(avg(CAST(abs(floor23/CAST(2 AS DOUBLE) - floors_observed) <= 1 AS INT))*100, 6) AS within_1_pct
FROM lab WHERE status = 'annotated' AND floors_observed > 0 AND floor23 IS NOT NULL GROUP BY 1""",
    TRUTH23,
)
def a18_floor_ratio_bins(i: Inputs):
    return P.floor_ratio_by_bin(P.labelled_heights(i.view("truth"), buildings_2023(i), buildings(i)))


@register(
    "a16_ratio_quantiles",
    """
SELECT count(*) AS n, round(quantile_cont(r, 0.05), 6) AS p5, round(quantile_cont(r, 0.25), 6) AS p25, round(quantile_cont(r, 0.5), 6) AS p50,
 round(quantile_cont(r, 0.75), 6) AS p75, round(quantile_cont(r, 0.95), 6) AS p95, round(avg(CAST(r BETWEEN 2.5 AND 5 AS INT))*100, 6) AS share_pct
FROM (SELECT height/CAST(ep AS DOUBLE) AS r FROM b26 WHERE ep > 0)""",
)
def a16_ratio_quantiles(i: Inputs):
    pos = i.buildings().where(F.col("ep") > 0)
    return P.ratio_quantiles(pos, F.col("height") / F.col("ep").cast("double"), 2.5, 5.0)


@register(
    "w2_best_row_per_key",
    """SELECT bid, max(inter) AS inter, arg_min(bid23, (-inter, bid23)) AS bid23 FROM ov GROUP BY bid""",
)
def w2_best_row_per_key(i: Inputs):
    pairs = spatial.overlap_pairs(buildings_2023(i), buildings(i), L.FOOTPRINT_CELL_M, "bid23", "bid", [])
    return spatial.best_overlap(pairs, "bid", "bid23").select("bid", "inter", "bid23")


@register("w3_first_match", "SELECT bid23, bid FROM cen")
def w3_first_match(i: Inputs):
    return P.centroid_matches(buildings_2023(i), buildings(i)).select("bid23", "bid")
