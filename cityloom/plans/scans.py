"""Scans, contracts, sinks, quality reports, set operations and small ordering queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from cityloom import rules
from cityloom.functions import geodesy
from cityloom.operators import labelling as L, pairing as P, quality as Q, spatial
from cityloom.operators.skew import first_per_key, union_all
from cityloom.plans.inputs import buildings, buildings_2023, master, slim
from cityloom.plans.registry import register
from cityloom.plans.shapes import GCJ, lonlat
from cityloom.session import scratch_path
from cityloom.sources import sinks, tables as S
from cityloom.sources.views import Inputs


@register("s1_building_scan", "SELECT bid, height, area_m2 FROM g26")
def s1_building_scan(i: Inputs):
    raw = buildings(i).select("bid", F.concat(F.col("height").cast("string"), F.when(F.col("bid") % 2 == 0, ".0").otherwise("")).alias("height"), F.col("area_m2").alias("Area"), F.lit(4326).alias("srid"))
    return S.scan_buildings(S.require_srid(raw), ["bid", "height", "area_m2"])


@register("s2_floor_scan", "SELECT bid AS bid23, CAST(FLOOR AS INT) AS floor23, CAST(CAST(FLOOR AS INT)//2 AS INT) AS floors_2023 FROM b23")
def s2_floor_scan(i: Inputs):
    """Every third floor code is written with a decimal point."""
    raw = i.view("b23").withColumn("FLOOR", F.concat("FLOOR", F.when(F.col("bid") % 3 == 0, ".0").otherwise("")))
    return S.scan_buildings_2023(raw.withColumnRenamed("bid", "bid23")).select("bid23", "floor23", "floors_2023")


@register("s3_height_scan", "SELECT bid, height FROM b26")
def s3_height_scan(i: Inputs):
    return S.scan_buildings(i.view("b26"), ["bid", "height"])


@register("s4_footprint_contract", "SELECT count(*) AS n_rows, count(*) BETWEEN 838000 AND 850000 AS in_band FROM b26")
def s4_footprint_contract(i: Inputs):
    df = S.require_columns(i.view("b26"), ["bid", "height", "district"])
    return S.row_count_check(df, rules.ROW_BAND)


@register("s5_master_scan", "SELECT bid, archetype FROM master")
def s5_master_scan(i: Inputs):
    return master(i).select("bid", "archetype")


@register("s6_vendor_fields", "SELECT m.bid, v.ep, v.district FROM master m JOIN b26 v USING (bid)")
def s6_vendor_fields(i: Inputs):
    vendor = i.view("b26").select("bid", F.expr("try_cast(ep AS INT)").alias("ep"), "district")
    return S.attach_by_key(master(i).select("bid"), vendor, "bid", ["ep", "district"])


@register("s7_report_csv", "SELECT epd_id, category, gwp FROM epd")
def s7_report_csv(i: Inputs):
    """Report CSV with provenance lines and header, written and read back as one report."""
    path = scratch_path(i.spark, "report-csv")
    sinks.write_commented_csv(i.view("epd").select("epd_id", "category", "gwp"), path, ["made from the product table", "gwp, in kg"])
    return S.read_report_csv(i.spark, path, "epd_id bigint, category string, gwp double")


def _cell_records(i: Inputs):
    """Scan-cell records: POIs grouped into fifty cells, as JSON lines in the shared folder.

    The record format nests the POIs of a cell; a record holds at most the POIs of one page range, here by
    id range, so no record grows with the data.
    """
    poi = lonlat(i.view("poi"))
    wgs = F.format_string("%.6f,%.6f", "lon", "lat")
    p = F.struct(
        F.col("id").cast("string").alias("id"), "name", "typecode", F.lit("addr").alias("addr"), F.lit("0,0").alias("gcj"), wgs.alias("wgs")
    )
    cell = (F.col("id") % 50).cast("int")
    page = F.floor(F.col("id") / 10_000)
    return poi.groupBy(cell.alias("cell_id"), page.alias("_page")).agg(
        (F.count(F.lit(1)) > 25).alias("capped"), F.sort_array(F.collect_list(p)).alias("pois")
    ).drop("_page")


@register(
    "s8_cell_records",
    """SELECT CAST(id % 50 AS INT) AS cell_id, CAST(id AS VARCHAR) AS id, name, typecode, CAST(printf('%.6f', lon) AS DOUBLE) AS wgs_lng,
 CAST(printf('%.6f', lat) AS DOUBLE) AS wgs_lat FROM poi JOIN ll USING (id)""",
    GCJ,
)
def s8_cell_records(i: Inputs):
    path = scratch_path(i.spark, "cells-json")
    _cell_records(i).write.json(path)
    return S.read_cell_records(i.spark, path).select("cell_id", "id", "name", "typecode", "wgs_lng", "wgs_lat")


@register(
    "s9_poi_union",
    "SELECT CAST(id AS VARCHAR) AS id, name, typecode, lon AS wgs_lng, lat AS wgs_lat FROM poi JOIN ll USING (id)",
    GCJ,
)
def s9_poi_union(i: Inputs):
    """CSV-style main source and JSON-style extra source; the extra one repeats every third id."""
    poi = lonlat(i.view("poi")).select(
        F.col("id").cast("string").alias("id"), "name", "typecode", F.col("lon").alias("wgs_lng"), F.col("lat").alias("wgs_lat"),
        (F.col("id") % 3).alias("k"), F.lit(0).alias("ord"),
    )
    poi = poi.unionByName(poi.where("id % 7 = 0").withColumns({"name": F.lit("again"), "ord": F.lit(1)}))
    path = scratch_path(i.spark, "poi-extra")
    extra = poi.where("k <> 1").withColumn("name", F.when(F.col("k") == 0, F.lit("other name")).otherwise(F.col("name")))
    extra.drop("k").write.json(path)
    schema = "id string, name string, typecode string, wgs_lng double, wgs_lat double, ord int"
    return S.union_poi(poi.where("k <> 2").drop("k"), i.spark.read.schema(schema).json(path))


@register(
    "s10_slim_records",
    "SELECT CAST(id AS VARCHAR) AS id, name, typecode, printf('%.6f', 2*lon - glon) || ',' || printf('%.6f', 2*lat - glat) AS wgs FROM poi JOIN gcj USING (id)",
    GCJ,
)
def s10_slim_records(i: Inputs):
    poi = lonlat(i.view("poi"))
    raw = poi.select(
        F.col("id").cast("string").alias("id"), "name", "typecode", F.lit("addr").alias("address"),
        F.concat_ws(",", F.col("lon").cast("string"), F.col("lat").cast("string")).alias("location"),
    )
    return S.slim_poi(raw).select("id", "name", "typecode", "wgs")


@register("s11_done_set", "SELECT CAST(c_custkey AS INT) AS cell_id FROM customer WHERE c_custkey % 7 = 0")
def s11_done_set(i: Inputs):
    path = scratch_path(i.spark, "done")
    ids = i.table("customer").where("c_custkey % 7 = 0").select(F.col("c_custkey").cast("string"))
    ids.write.text(path)
    return S.read_done_set(i.spark, path)


@register("s12_result_sink", "SELECT bid23, bid, height, floors_2023 FROM best23 WHERE iou >= CAST(0.3 AS DOUBLE)")
def s12_result_sink(i: Inputs):
    path = scratch_path(i.spark, "pairs")
    clean = P.overlap_matches(buildings_2023(i), buildings(i)).where(F.col("iou") >= rules.IOU_MIN)
    sinks.write_table(clean.select("bid23", "bid", "height", "floors_2023"), path)
    return i.spark.read.parquet(path)


@register("s13_master_sink", "SELECT district, count(*) AS n, sum(height) AS height_sum FROM master GROUP BY 1")
def s13_master_sink(i: Inputs):
    path = scratch_path(i.spark, "master-by-district")
    sinks.write_table(master(i), path, ["district"])
    back = i.spark.read.parquet(path)
    return back.groupBy("district").agg(F.count(F.lit(1)).alias("n"), F.sum("height").alias("height_sum"))


@register("s14_report_sink", "SELECT archetype, count(*) AS n FROM master GROUP BY 1")
def s14_report_sink(i: Inputs):
    path = scratch_path(i.spark, "report")
    counts = master(i).groupBy("archetype").agg(F.count(F.lit(1)).alias("n"))
    sinks.write_report(counts, path, ["label counts", "weights: rows"])
    return i.spark.read.csv(path, schema="archetype string, n bigint", header=True)


@register("s16_blind_export", "SELECT bid, district, rx AS rep_x, ry AS rep_y FROM g26")
def s16_blind_export(i: Inputs):
    return sinks.blind_export(slim(i).drop("height"), ["bid", "district", "rep_x", "rep_y"])


@register(
    "s17_folder_export",
    """SELECT district, folder_no, bid AS item_no, bid AS name FROM b26 JOIN
 (SELECT district, row_number() OVER (ORDER BY min(bid)) AS folder_no FROM b26 GROUP BY 1) USING (district)""",
)
def s17_folder_export(i: Inputs):
    rows = i.buildings().withColumn("text", sinks.placemark_text(F.col("bid").cast("string"), F.lit("https://x"), F.col("geom")[0]))
    out = sinks.folder_export(rows, "district", "bid", ["bid", "text"])
    return out.select("district", "folder_no", "item_no", F.col("placemark.bid").alias("name"))


@register("f2_floor_halving", "SELECT bid, CAST(CAST(FLOOR AS INT)//2 AS INT) AS floors_2023 FROM b23")
def f2_floor_halving(i: Inputs):
    return S.scan_buildings_2023(i.view("b23")).select("bid", "floors_2023")


@register(
    "f5_extent_filter",
    """SELECT g.bid FROM g26 g, (SELECT min(x0) AS xa, min(y0) AS ya, max(x0+w) AS xb, max(y0+d) AS yb FROM b23) e
WHERE g.rx BETWEEN e.xa AND e.xb AND g.ry BETWEEN e.ya AND e.yb""",
)
def f5_extent_filter(i: Inputs):
    box = buildings_2023(i).agg(F.min("xmin").alias("xa"), F.min("ymin").alias("ya"), F.max("xmax").alias("xb"), F.max("ymax").alias("yb"))
    inside = F.col("rep_x").between(F.col("xa"), F.col("xb")) & F.col("rep_y").between(F.col("ya"), F.col("yb"))
    return slim(i).join(F.broadcast(box), inside).select("bid")


@register("f7_annotated", "SELECT val_id, archetype AS truth_arch FROM truth WHERE status = 'annotated'")
def f7_annotated(i: Inputs):
    return L.annotated(i.view("truth")).select("val_id", "truth_arch")


@register(
    "f14_poi_kind",
    """SELECT id, CASE WHEN typecode LIKE '0601%' THEN 'mall' WHEN typecode LIKE '1001%' OR typecode LIKE '1002%' THEN 'hotel' ELSE 'other' END AS kind FROM poi""",
)
def f14_poi_kind(i: Inputs):
    from cityloom.operators.poi import poi_kind

    return i.view("poi").select("id", poi_kind(F.col("typecode")).alias("kind"))


@register(
    "f18_floor_checks",
    """SELECT count(*) FILTER (CAST(FLOOR AS INT) % 2 <> 0) AS n_odd, count(*) FILTER (CAST(FLOOR AS INT) <= 0) AS n_not_positive,
 count(*) FILTER (CAST(FLOOR AS DOUBLE) <> round(CAST(FLOOR AS DOUBLE))) AS n_not_integer FROM b23""",
)
def f18_floor_checks(i: Inputs):
    v = F.expr("try_cast(FLOOR AS DOUBLE)")
    return i.view("b23").agg(
        F.count_if(v % 2 != 0).alias("n_odd"), F.count_if(v <= 0).alias("n_not_positive"), F.count_if(v != F.rint(v)).alias("n_not_integer")
    )


@register("f20_sentinel_rows", "SELECT bid, height, ep, district FROM b26 WHERE height = 236")
def f20_sentinel_rows(i: Inputs):
    return i.buildings().where(F.col("height") == 236).select("bid", "height", "ep", "district")


@register(
    "f21_first_by_keyword",
    """SELECT k.keyword, min(p.id) AS id, arg_min(p.x, p.id) AS x, arg_min(p.y, p.id) AS y
FROM (VALUES ('BUILDING'), ('AUTOMOBILE'), ('MACHINERY'), ('HOUSEHOLD'), ('not there')) k(keyword)
LEFT JOIN poi p ON contains(p.name, k.keyword) GROUP BY 1""",
)
def f21_first_by_keyword(i: Inputs):
    from cityloom.operators.poi import first_by_keyword

    return first_by_keyword(i.view("poi"), ["BUILDING", "AUTOMOBILE", "MACHINERY", "HOUSEHOLD", "not there"]).select("keyword", "id", "x", "y")


@register(
    "a12_dedup_by_id",
    "SELECT user_id, min(event_id) AS event_id, arg_min(event_type, event_id) AS event_type, count(*) - 1 AS n_duplicates FROM events GROUP BY 1",
)
def a12_dedup_by_id(i: Inputs):
    ev = i.table("events").select("user_id", "event_id", "event_type")
    first = first_per_key(ev, ["user_id"], [F.col("event_id")])
    dup = ev.groupBy("user_id").agg((F.count(F.lit(1)) - 1).alias("n_duplicates"))
    return first.join(dup, "user_id")


@register(
    "a14_qc_report",
    """
SELECT u.check, u.actual, CASE u.check WHEN 'rows' THEN CAST(412099 AS DOUBLE) WHEN 'odd' THEN CAST(0 AS DOUBLE) END AS expected,
 CASE u.check WHEN 'rows' THEN u.actual = 412099 WHEN 'odd' THEN u.actual = 0 ELSE true END AS ok
FROM (SELECT unnest(['rows', 'min', 'max', 'median', 'nulls', 'not_positive', 'not_integer', 'odd', 'tail_rows']) AS check,
  unnest([CAST(count(*) AS DOUBLE), min(v), max(v), quantile_cont(v, 0.5), CAST(count(*) FILTER (v IS NULL) AS DOUBLE), CAST(count(*) FILTER (v <= 0) AS DOUBLE),
   CAST(count(*) FILTER (v <> round(v)) AS DOUBLE), CAST(count(*) FILTER (v % 2 = 1) AS DOUBLE), CAST(count(*) FILTER (v > 130) AS DOUBLE)]) AS actual
  FROM (SELECT CAST(FLOOR AS DOUBLE) AS v FROM b23)) u""",
)
def a14_qc_report(i: Inputs):
    return Q.qc_report(i.view("b23"), "FLOOR", 130, {"rows": rules.EXPECTED_ROWS_2023, "odd": 0})


@register(
    "a14_qc_report_2026",
    """
SELECT u.check, u.actual, CASE u.check WHEN 'epsg' THEN CAST(4326 AS DOUBLE) WHEN 'rows' THEN CAST(843062 AS DOUBLE) END AS expected,
 CASE u.check WHEN 'epsg' THEN true WHEN 'rows' THEN u.actual = 843062 ELSE true END AS ok
FROM (SELECT unnest(['epsg', 'rows', 'min', 'max', 'median', 'nulls', 'tail_rows']) AS check,
  unnest([CAST(4326 AS DOUBLE), CAST(count(*) AS DOUBLE), min(v), max(v), quantile_cont(v, 0.5), CAST(count(*) FILTER (v IS NULL) AS DOUBLE), CAST(count(*) FILTER (v >= 160) AS DOUBLE)]) AS actual
  FROM (SELECT CAST(height AS DOUBLE) AS v FROM b26)) u""",
)
def a14_qc_report_2026(i: Inputs):
    """Coordinate system and height report of the newer footprints."""
    b = i.view("b26").withColumn("srid", F.lit(4326))
    return Q.coordinate_check(b).unionByName(Q.height_report(b, "height", rules.SUPERTALL_HEIGHT_M, 843062))


@register("a14_field_types", "SELECT * FROM (SELECT unnest(['bid23', 'FLOOR']) AS field, unnest(['bigint', 'string']) AS kind, unnest([false, true]) AS expected, unnest([count(bid), count(FLOOR)]) AS filled FROM b23)")
def a14_field_types(i: Inputs):
    """Fields and types of the older footprints, of which only the floor code is expected."""
    b = i.view("b23").select(F.col("bid").cast("bigint").alias("bid23"), F.col("FLOOR").cast("string").alias("FLOOR"))
    return Q.field_types(b, ["FLOOR"])


@register("a14_tail_distribution", "SELECT CAST(FLOOR AS INT) AS value, count(*) AS n, CAST(CAST(FLOOR AS INT)//2 AS INT) AS implied_floors FROM b23 WHERE CAST(FLOOR AS INT) > 80 GROUP BY 1, 3")
def a14_tail_distribution(i: Inputs):
    return Q.tail_distribution(i.view("b23"), "FLOOR", 80)


@register(
    "u3_field_comparison",
    """SELECT * FROM (VALUES ('c_custkey', 'both'), ('c_name', 'both'), ('c_nationkey', 'left'), ('c_acctbal', 'both'), ('c_mktsegment', 'left'), ('extra', 'right')) f(field, side),
 LATERAL (SELECT CASE WHEN side <> 'right' THEN count(*) END AS n_left,
   CASE field WHEN 'c_acctbal' THEN count(*) FILTER (c_acctbal > 0) WHEN 'extra' THEN count(*) FILTER (c_custkey % 3 = 0) ELSE CASE WHEN side <> 'left' THEN count(*) END END AS n_right FROM customer)""",
)
def u3_field_comparison(i: Inputs):
    """The customer table against a vendor's cut of it, with gaps in one field and a field of its own."""
    c = i.table("customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")
    vendor = c.select("c_custkey", "c_name", F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("c_acctbal"), F.when(F.col("c_custkey") % 3 == 0, 1).alias("extra"))
    return Q.field_comparison(c, vendor)


@register(
    "a15_code_profile",
    """
SELECT ep, count(*) AS n, quantile_cont(CAST(height AS DOUBLE), 0.5) AS h_med, min(height) AS h_min, max(height) AS h_max, quantile_cont(area_m2, 0.5) AS area_med,
 any_value(t.district) AS top_district, round_even(any_value(t.c)/CAST(count(*) AS DOUBLE), 2) AS top_share
FROM g26 JOIN (SELECT ep, district, count(*) AS c FROM b26 GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY ep ORDER BY c DESC, district) = 1) t USING (ep) GROUP BY 1""",
)
def a15_code_profile(i: Inputs):
    return Q.code_profile(slim(i))


@register(
    "a17_missing_codes",
    """SELECT CAST(u.code AS INT) AS code FROM (SELECT unnest(range((SELECT min(code) FROM spread), (SELECT max(code) + 1 FROM spread))) AS code) u
WHERE u.code NOT IN (SELECT code FROM spread)""",
    {"spread": "SELECT ep*3 + CAST(bid % 2 AS INT) AS code FROM b26"},
)
def a17_missing_codes(i: Inputs):
    """The code column spread out, so that every third code never occurs."""
    return Q.missing_codes(i.buildings().select((F.col("ep") * 3 + F.col("bid") % 2).cast("int").alias("ep")), "ep").select("code")


@register(
    "a33_code_counts",
    """SELECT ep AS code, count(*) AS n, (SELECT count(DISTINCT ep) FROM b26) AS n_distinct, (SELECT count(*) FROM b26 WHERE ep IS NULL) AS n_null,
 (SELECT count(*) FROM b26 WHERE ep = 0) AS n_zero, (SELECT count(*) FROM b26 WHERE ep < 0) AS n_negative FROM b26 GROUP BY 1 ORDER BY n DESC, code LIMIT 30""",
)
def a33_code_counts(i: Inputs):
    return Q.code_counts(i.buildings(), "ep")


@register("u1_union_sources", "SELECT bid, 'y2026' AS source FROM b26 UNION ALL SELECT bid, 'y2023' FROM b23")
def u1_union_sources(i: Inputs):
    a = i.view("b26").select("bid", F.lit("y2026").alias("source"))
    return a.unionByName(i.view("b23").select("bid", F.lit("y2023").alias("source")))


@register(
    "u2_rule_hit_sets",
    """SELECT bid FROM (SELECT n.bid FROM pn n JOIN codes c ON c.id = n.id WHERE c.code LIKE '1001%' UNION
 SELECT n.bid FROM pn n JOIN codes c ON c.id = n.id WHERE c.code LIKE '1002%') INTERSECT SELECT bid FROM bp WHERE class IN (1, 2)""",
)
def u2_rule_hit_sets(i: Inputs):
    from cityloom.plans.inputs import parcels

    b, poi = slim(i), i.view("poi")
    hits = L.nearest_buildings(poi, b, 150.0).join(poi.select("id", "typecode"), "id")
    one = hits.where(L.any_prefix(F.col("typecode"), "1001")).select("bid")
    two = hits.where(L.any_prefix(F.col("typecode"), "1002")).select("bid")
    allowed = L.parcel_of(b, parcels(i)).where(F.col("class").isin(1, 2)).select("bid")
    return one.union(two).distinct().join(allowed, "bid", "left_semi")


@register(
    "u4_metric_rows",
    """SELECT 'floors_missing' AS metric, count(*) AS n, NULL::DOUBLE AS accuracy_pct FROM master WHERE floors IS NULL
UNION ALL SELECT 'labelled_share', NULL, round_even(avg((archetype <> 'unknown')::INT)*100, 1) FROM master""",
)
def u4_metric_rows(i: Inputs):
    from cityloom.functions.numeric import half_even

    m = master(i)
    a = m.where(F.col("floors").isNull()).agg(F.count(F.lit(1)).alias("n")).select(F.lit("floors_missing").alias("metric"), "n")
    share = half_even(F.avg((F.col("archetype") != "unknown").cast("int")) * 100, 1)
    b = m.agg(share.alias("accuracy_pct")).select(F.lit("labelled_share").alias("metric"), "accuracy_pct")
    return union_all([a, b])


@register("t5_sorted_report", "SELECT district, count(*) AS n FROM b26 GROUP BY 1 ORDER BY n DESC, district")
def t5_sorted_report(i: Inputs):
    return i.buildings().groupBy("district").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "district")
