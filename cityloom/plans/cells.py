"""Scan cells, POI proximity, raster pixels and streaming ingest."""

from __future__ import annotations


from pyspark.sql import functions as F

from cityloom import rules
from cityloom.functions import geometry as G
from cityloom.operators import cover, labelling as L, poi as P, raster as R
from cityloom.plans.inputs import buildings, parcels, slim
from cityloom.plans.registry import register
from cityloom.session import scratch_path
from cityloom.sources.views import Inputs
from cityloom.streaming import poi_stream as ST

CELLS = {
    "cells": """
SELECT DISTINCT CAST(100*floor(y0/500) + floor(x0/500) AS BIGINT) AS cell_id, 500*floor(x0/500) + 30 AS cx, 500*floor(y0/500) + 30 AS cy FROM parcels""",
    "pieces": """
SELECT c.cell_id, p.parcel_id, p.class, (least(c.cx+500, p.x0+p.side) - greatest(c.cx, p.x0))*(least(c.cy+500, p.y0+p.side) - greatest(c.cy, p.y0)) AS inter
FROM cells c JOIN parcels p ON c.cx < p.x0+p.side AND p.x0 < c.cx+500 AND c.cy < p.y0+p.side AND p.y0 < c.cy+500""",
    "meta": "SELECT cell_id, sum(inter)/10000 AS area_ha, bool_or(class IN (1, 2)) AS dense FROM pieces WHERE class IN (0, 1, 2) GROUP BY 1",
    "tc": "SELECT t.val_id, min(c.cell_id) AS cell_id FROM truth t JOIN cells c ON t.x > c.cx AND t.x < c.cx+500 AND t.y > c.cy AND t.y < c.cy+500 GROUP BY 1",
    "pcell": "SELECT p.id, p.typecode, min(c.cell_id) AS cell_id FROM poi p JOIN cells c ON p.x > c.cx AND p.x < c.cx+500 AND p.y > c.cy AND p.y < c.cy+500 GROUP BY 1, 2",
    "cdist": """SELECT t.val_id, c.cell_id, sqrt(power(greatest(c.cx - t.x, 0, t.x - c.cx - 500), 2) + power(greatest(c.cy - t.y, 0, t.y - c.cy - 500), 2)) AS dist
FROM truth t JOIN cells c ON t.x BETWEEN c.cx - 1200 AND c.cx + 1700 AND t.y BETWEEN c.cy - 1200 AND c.cy + 1700""",
}


def cells(i: Inputs):
    p = i.view("parcels")
    ix, iy = F.floor(F.col("x0") / 500), F.floor(F.col("y0") / 500)
    c = p.select((100 * iy + ix).alias("cell_id"), (500 * ix + 30).cast("double").alias("cx"), (500 * iy + 30).cast("double").alias("cy")).distinct()
    return G.with_shape(c.select("cell_id", G.box(F.col("cx"), F.col("cy"), F.col("cx") + 500.0, F.col("cy") + 500.0).alias("geom")))


def done_cells(i: Inputs):
    return cells(i).where(F.col("cell_id") % 3 == 0).select("cell_id")


@register("g13_cell_overlay", "SELECT cell_id, parcel_id, class, inter FROM pieces", CELLS)
def g13_cell_overlay(i: Inputs):
    return P.cell_overlaps(cells(i), parcels(i))


@register("a22_cell_metadata", "SELECT cell_id, round(area_ha, 6) AS area_ha, dense FROM meta", CELLS)
def a22_cell_metadata(i: Inputs):
    return P.cell_metadata(cells(i), parcels(i)).withColumn("area_ha", F.round("area_ha", 6))


@register(
    "a23_request_budget",
    """
SELECT threshold_ha, n_cells, n_dense, estimate, feasible, coalesce(threshold_ha = min(CASE WHEN feasible THEN threshold_ha END) OVER (), false) AS chosen FROM (
 SELECT *, estimate <= 40 - 150 + 145 AS feasible FROM (SELECT th AS threshold_ha, count(*) FILTER (area_ha >= th) AS n_cells, count(*) FILTER (area_ha >= th AND dense) AS n_dense,
  CAST(floor((count(*) FILTER (area_ha >= th) + count(*) FILTER (area_ha >= th AND dense)*4*0.5::DOUBLE)*1.12::DOUBLE) AS BIGINT) AS estimate
 FROM meta CROSS JOIN (VALUES (5), (8), (10)) v(th) GROUP BY 1))""",
    CELLS,
)
def a23_request_budget(i: Inputs):
    return P.request_budget(P.cell_metadata(cells(i), parcels(i)), 4.0, 185)


@register("t2_work_list", "SELECT cell_id, round(area_ha, 6) AS area_ha, dense FROM meta WHERE area_ha >= 2 AND cell_id % 3 <> 0", CELLS)
def t2_work_list(i: Inputs):
    w = P.work_list(P.cell_metadata(cells(i), parcels(i)), done_cells(i), 2.0)
    return w.select("cell_id", F.round("area_ha", 6).alias("area_ha"), "dense")


@register(
    "j15_scan_status",
    """SELECT t.val_id, t.status, t.archetype, c.cell_id, CASE WHEN c.cell_id IS NULL THEN 'outside' WHEN c.cell_id % 3 = 0 THEN 'scanned' ELSE 'dropped' END AS scan_status
FROM truth t LEFT JOIN tc c USING (val_id)""",
    CELLS,
)
def j15_scan_status(i: Inputs):
    return P.point_status(i.view("truth"), cells(i), done_cells(i))


@register("j21_cells_of_points", "SELECT DISTINCT cell_id FROM tc JOIN truth USING (val_id) WHERE status = 'annotated'", CELLS)
def j21_cells_of_points(i: Inputs):
    return P.point_cells(L.annotated(i.view("truth")), cells(i)).select("cell_id").distinct()


@register("g11_polygons_near_point", "SELECT val_id, cell_id, round(dist, 6) AS dist FROM cdist WHERE dist <= 1200", CELLS)
def g11_polygons_near_point(i: Inputs):
    counts = i.spark.createDataFrame([], "cell_id bigint, n_poi bigint, n_mall bigint, n_hotel bigint")
    near = P.cells_around(i.view("truth"), cells(i), counts, 1200.0)
    return near.select("val_id", "cell_id", F.round("dist", 6).alias("dist"))


@register(
    "j16_cells_with_counts",
    """SELECT d.val_id, d.cell_id, coalesce(n.n_poi, 0) AS n_poi, coalesce(n.n_mall, 0) AS n_mall, coalesce(n.n_hotel, 0) AS n_hotel FROM cdist d JOIN truth t USING (val_id)
LEFT JOIN (SELECT cell_id, count(*) AS n_poi, count(*) FILTER (typecode LIKE '0601%') AS n_mall, count(*) FILTER (typecode LIKE '1001%' OR typecode LIKE '1002%') AS n_hotel FROM pcell GROUP BY 1) n
 ON n.cell_id = d.cell_id WHERE d.dist <= 1200 AND t.archetype = 'shopping_mall'""",
    CELLS,
)
def j16_cells_with_counts(i: Inputs):
    c = cells(i)
    poi = i.view("poi").select(F.col("id").alias("val_id"), "x", "y", "typecode")
    counts = P.counts_by_cell(P.point_cells(poi, c).join(poi.select("val_id", "typecode"), "val_id"))
    malls = i.view("truth").where(F.col("archetype") == "shopping_mall")
    return P.cells_around(malls, c, counts, 1200.0).select("val_id", "cell_id", "n_poi", "n_mall", "n_hotel")


KIND = {
    "tm": "SELECT val_id, x, y FROM truth WHERE archetype = 'shopping_mall'",
    "md": "SELECT t.val_id, min(sqrt((t.x-p.x)*(t.x-p.x) + (t.y-p.y)*(t.y-p.y))) AS dist FROM tm t CROSS JOIN poi p WHERE p.typecode LIKE '0601%' GROUP BY 1",
    "sd": "SELECT t.val_id, min(sqrt((t.x-p.x)*(t.x-p.x) + (t.y-p.y)*(t.y-p.y))) AS dist FROM tm t CROSS JOIN poi p WHERE p.typecode LIKE '06%' GROUP BY 1",
}


@register(
    "j12_nearest_mall",
    """SELECT t.val_id, round(md.dist, 6) AS dist, p.id, p.name, p.typecode, p.x, p.y FROM tm t JOIN md USING (val_id)
JOIN poi p ON p.typecode LIKE '0601%' AND sqrt((t.x-p.x)*(t.x-p.x) + (t.y-p.y)*(t.y-p.y)) = md.dist
QUALIFY row_number() OVER (PARTITION BY t.val_id ORDER BY p.id) = 1""",
    KIND,
)
def j12_nearest_mall(i: Inputs):
    malls = i.view("truth").where(F.col("archetype") == "shopping_mall")
    near = P.nearest_of_kind(malls, i.view("poi"), "mall")
    return near.select("val_id", F.round("dist", 6).alias("dist"), "id", "name", "typecode", "x", "y")


@register(
    "j14_two_source_check",
    "SELECT val_id, round(m.dist, 6) AS mall_dist, round(s.dist, 6) AS shop_dist, coalesce(m.dist, 9e9) <= 150 OR coalesce(s.dist, 9e9) <= 100 AS hit FROM tm LEFT JOIN md m USING (val_id) LEFT JOIN sd s USING (val_id)",
    KIND,
)
def j14_two_source_check(i: Inputs):
    malls = i.view("truth").where(F.col("archetype") == "shopping_mall")
    poi = i.view("poi")
    m = P.nearest_of_kind(malls, poi, "mall").select("val_id", F.col("dist").alias("m"))
    s = P.nearest_of_code(malls, poi, "06").select("val_id", F.col("dist").alias("s"))
    near = lambda c, most: F.coalesce(F.col(c) <= most, F.lit(False))  # noqa: E731  no POI of a source: not near
    hit = near("m", 150) | near("s", 100)
    return malls.select("val_id").join(m, "val_id", "left").join(s, "val_id", "left").select("val_id", F.round("m", 6).alias("mall_dist"), F.round("s", 6).alias("shop_dist"), hit.alias("hit"))


TOKENS = {
    "tk": """SELECT val_id, x, y, CASE archetype WHEN 'office' THEN 'BUILDING' WHEN 'education' THEN 'MACHINERY' WHEN 'culture' THEN 'HOUSEHOLD' ELSE CASE WHEN val_id % 5 = 0 THEN NULL ELSE 'AUTO' END END AS tok FROM truth""",
    "nr": """SELECT t.val_id, p.id, coalesce(contains(p.name, t.tok), false) AS m FROM (SELECT *, CAST(floor(x/500) AS INT) AS cx FROM tk) t JOIN (SELECT *, CAST(floor(x/500) AS INT) + d AS cx FROM poi, (VALUES (-1), (0), (1)) u(d)) p
 ON t.cx = p.cx AND sqrt((t.x-p.x)*(t.x-p.x) + (t.y-p.y)*(t.y-p.y)) <= 500""",
}


def _tokens(i: Inputs):
    a = F.col("archetype")
    tok = F.when(a == "office", "BUILDING").when(a == "education", "MACHINERY").when(a == "culture", "HOUSEHOLD").when(F.col("val_id") % 5 == 0, "广场").otherwise("AUTO")
    return i.view("truth").withColumn("tok", P.name_tokens(tok, "[A-Z]{2,}"))


@register(
    "j13_token_matches",
    """SELECT tk.val_id, count(nr.id) AS n_near, count(nr.id) FILTER (nr.m) AS n_match FROM tk LEFT JOIN nr USING (val_id) GROUP BY 1""",
    TOKENS,
)
def j13_token_matches(i: Inputs):
    return P.token_matches(_tokens(i), i.view("poi"), "tok", 500.0).select("val_id", "n_near", "n_match")


@register(
    "t3_first_matches",
    """SELECT tk.val_id, f.first_ids FROM tk LEFT JOIN (SELECT val_id, string_agg(id::VARCHAR, ',' ORDER BY id) AS first_ids FROM
 (SELECT val_id, id FROM nr WHERE m QUALIFY row_number() OVER (PARTITION BY val_id ORDER BY id) <= 3) GROUP BY 1) f USING (val_id)""",
    TOKENS,
)
def t3_first_matches(i: Inputs):
    return P.token_matches(_tokens(i), i.view("poi"), "tok", 500.0).select("val_id", "first_ids")


@register("d5_category_entropy", """SELECT bid, round(-sum(n/t*ln(n/t)), 6) + 0 AS entropy FROM (SELECT bid, code, count(*)::DOUBLE AS n, sum(count(*)) OVER (PARTITION BY bid)::DOUBLE AS t
 FROM pn JOIN codes USING (id) GROUP BY 1, 2) GROUP BY 1""")
def d5_category_entropy(i: Inputs):
    poi = i.view("poi")
    hits = L.nearest_buildings(poi, slim(i), 150.0)
    codes = poi.select("id", F.explode(L.codes(F.col("typecode"))).alias("code"))
    return P.category_entropy(hits, codes).select("bid", (F.round("entropy", 6) + 0).alias("entropy"))


@register("d6_category_counts", "SELECT code, count(DISTINCT id) AS n_poi, count(DISTINCT bid) AS n_buildings FROM pn JOIN codes USING (id) GROUP BY 1")
def d6_category_counts(i: Inputs):
    poi = i.view("poi")
    hits = L.nearest_buildings(poi, slim(i), 150.0)
    return P.category_counts(hits, poi.select("id", F.explode(L.codes(F.col("typecode"))).alias("code")))


@register(
    "d10_vote_fallback",
    """SELECT b.bid, CASE WHEN v.skip IS NULL THEN 'no_poi_hit' ELSE 'all_skip_hits' END AS reason FROM b26 b
LEFT JOIN (SELECT bid, bool_and(code LIKE '05%') AS skip FROM pn JOIN codes USING (id) GROUP BY 1) v USING (bid) WHERE v.skip IS NULL OR v.skip""",
)
def d10_vote_fallback(i: Inputs):
    poi = i.view("poi")
    b = slim(i)
    hits = L.nearest_buildings(poi, b, 150.0)
    coded = L.map_codes(poi.select("id", F.explode(L.codes(F.col("typecode"))).alias("code")))
    return P.votes_fallback(b, hits, coded)


@register(
    "d11_parcel_subset",
    """SELECT class, count(*) AS n, sum(side*side) AS area_m2 FROM parcels WHERE EXISTS (SELECT 1 FROM cells c WHERE c.cell_id % 3 = 0 AND x0+side/2 > c.cx AND x0+side/2 < c.cx+500 AND y0+side/2 > c.cy AND y0+side/2 < c.cy+500) GROUP BY 1""",
    CELLS,
)
def d11_parcel_subset(i: Inputs):
    """Parcels whose interior point lies in the boundary polygons, counted and measured per class."""
    p = parcels(i)
    region = cells(i).where(F.col("cell_id") % 3 == 0)
    pts = p.select("parcel_id", F.col("rep_x").alias("p_x"), F.col("rep_y").alias("p_y"))
    inside = cover.points_in_region(pts, region, "p_x", "p_y", 250.0)
    return p.join(inside, "parcel_id", "left_semi").groupBy("class").agg(F.count(F.lit(1)).alias("n"), F.sum("area_m2").alias("area_m2"))


# --- raster -------------------------------------------------------------------------------------------------

REGION = {
    "inpx": """SELECT px.* FROM px WHERE EXISTS (SELECT 1 FROM parcels p WHERE p.class IN (0, 1) AND 10*col+5 > p.x0 AND 10*col+5 < p.x0+p.side AND 10*prow+5 > p.y0 AND 10*prow+5 < p.y0+p.side)"""
}


@register("p1_clip_pixels", "SELECT tile, col, prow, h FROM inpx", REGION)
def p1_clip_pixels(i: Inputs):
    return R.clip_to_region(i.view("px"), parcels(i).where(F.col("class").isin(0, 1)))


@register("g14_region_mask", "SELECT count(*) AS n_inside, (SELECT count(*) FROM px) AS n_total FROM inpx", REGION)
def g14_region_mask(i: Inputs):
    px = i.view("px")
    inside = R.clip_to_region(px, parcels(i).where(F.col("class").isin(0, 1)))
    return inside.agg(F.count(F.lit(1)).alias("n_inside")).crossJoin(px.agg(F.count(F.lit(1)).alias("n_total")))


@register("p2_mosaic", "SELECT (col - col % 2) AS col, prow, arg_min(h, tile) FILTER (h IS NOT NULL) AS h FROM px GROUP BY 1, 2")
def p2_mosaic(i: Inputs):
    px = i.view("px").withColumn("col", F.col("col") - F.col("col") % 2)
    return R.mosaic(px, ["col", "prow"])


@register(
    "p3_pixel_stats",
    """SELECT count(*) AS n_total, count(h) AS n_inside, count(*) FILTER (isnan(h)) AS n_nan, count(*) FILTER (h > 0) AS n_positive, min(h) FILTER (h > 0) AS min,
 round(avg(h) FILTER (h > 0), 6) AS mean, max(h) FILTER (h > 0) AS max, round(quantile_cont(h, 0.5) FILTER (h > 0), 6) AS p50, round(quantile_cont(h, 0.95) FILTER (h > 0), 6) AS p95,
 round(quantile_cont(h, 0.99) FILTER (h > 0), 6) AS p99 FROM px""",
)
def p3_pixel_stats(i: Inputs):
    s = R.pixel_stats(i.view("px"))
    return s.withColumns({c: F.round(c, 6) for c in ("mean", "p50", "p95", "p99")})


@register(
    "p4_tile_histogram",
    """SELECT t.tile, e.lo, e.hi, count(px.h) AS n FROM (SELECT DISTINCT tile FROM px) t CROSS JOIN (VALUES """
    + ", ".join(f"({a}::DOUBLE, {b}::DOUBLE)" for a, b in zip(rules.TILE_EDGES_M, rules.TILE_EDGES_M[1:]))
    + """) e(lo, hi) LEFT JOIN px ON px.tile = t.tile AND px.h >= e.lo AND (px.h < e.hi OR (e.hi = 700 AND px.h = 700)) GROUP BY 1, 2, 3""",
)
def p4_tile_histogram(i: Inputs):
    return R.tile_histogram(i.view("px"))


@register(
    "p4_tile_extremes",
    """SELECT tile, round(quantile_cont(h, 0.999), 6) AS p999, round(quantile_cont(h, 0.9999), 6) AS p9999, round(quantile_cont(h, 0.99999), 6) AS p99999, max(h) AS max
FROM px WHERE h > 0 GROUP BY 1""",
)
def p4_tile_extremes(i: Inputs):
    e = R.tile_extremes(i.view("px"))
    return e.withColumns({c: F.round(c, 6) for c in ("p999", "p9999", "p99999")})


@register(
    "p5_focal_max",
    """SELECT c.c_custkey AS name, (400 + c.c_custkey % 50)::DOUBLE AS true_h, max(px.h) AS window_max, round(400 + c.c_custkey % 50 - max(px.h), 6) AS short_m,
 round(100*(1 - max(px.h)/(400 + c.c_custkey % 50)), 6) AS short_pct
FROM customer c LEFT JOIN px ON abs(px.col - c.c_custkey % 100) <= 1 AND abs(px.prow - c.c_custkey//100) <= 1 AND px.h IS NOT NULL GROUP BY c.c_custkey""",
)
def p5_focal_max(i: Inputs):
    k = F.col("c_custkey")
    marks = i.table("customer").select(k.alias("name"), (k % 100).cast("int").alias("col"), F.floor(k / 100).cast("int").alias("prow"), (400 + k % 50).cast("double").alias("true_h"))
    out = R.focal_max(marks, i.view("px"))
    return out.withColumns({"short_m": F.round("short_m", 6), "short_pct": F.round("short_pct", 6)})


# --- streaming ------------------------------------------------------------------------------------------------


def _event_files(i: Inputs) -> str:
    """Event records as JSON files by day; every twentieth record is written twice."""
    path = scratch_path(i.spark, "events-json")
    ev = i.table("events").select("event_id", "ts", "event_type", "value", (F.col("event_id") % 50).cast("int").alias("cell_id"), (F.col("event_id") % 11 == 0).alias("capped"))
    ev = ev.unionByName(ev.where("event_id % 20 = 0"))
    ev.withColumn("day", F.to_date("ts")).repartition("day").write.partitionBy("day").json(path)
    return path


@register("p6_incremental_ingest", "SELECT event_id, event_type, CAST(event_id % 50 AS INT) AS cell_id, event_id % 11 = 0 AS capped FROM events")
def p6_incremental_ingest(i: Inputs):
    src = _event_files(i)
    out = scratch_path(i.spark, "ingested")
    ST.ingest(ST.read_records(i.spark, src), "event_id", out, scratch_path(i.spark, "ingest-log"))
    return i.spark.read.parquet(out).select("event_id", "event_type", "cell_id", "capped")


@register("p7_running_counts", "SELECT date_trunc('day', ts) AS window_start, event_type AS kind, count(*) AS n FROM events GROUP BY 1, 2")
def p7_running_counts(i: Inputs):
    src = _event_files(i)
    out, counts = scratch_path(i.spark, "ingested"), scratch_path(i.spark, "kind-counts")
    ST.ingest(ST.read_records(i.spark, src), "event_id", out, scratch_path(i.spark, "counts-log"), counts, F.col("event_type"))
    return ST.totals(i.spark, counts)
