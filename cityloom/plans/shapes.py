"""Geometry measures, projections and datum shifts."""

from __future__ import annotations

from pyspark.sql import functions as F

from cityloom.functions import geodesy as D, geometry as G
from cityloom.operators import labelling as L, spatial
from cityloom.plans.inputs import buildings, buildings_2023, parcels
from cityloom.plans.registry import register
from cityloom.sources.views import Inputs


@register(
    "g1_area_perimeter_box",
    "SELECT bid, area_m2, perimeter_m, x0 AS xmin, y0 AS ymin, x0+w AS xmax, y0+d AS ymax FROM g26",
)
def g1_area_perimeter_box(i: Inputs):
    return buildings(i).select("bid", "area_m2", "perimeter_m", "xmin", "ymin", "xmax", "ymax")


@register("g2_compactness", "SELECT bid, round(4*pi()*area_m2/(perimeter_m*perimeter_m), 9) AS compactness FROM g26")
def g2_compactness(i: Inputs):
    b = buildings(i)
    return b.select("bid", F.round(G.compactness(F.col("area_m2"), F.col("perimeter_m")), 9).alias("compactness"))


HULL = {
    "vd": "SELECT DISTINCT bid, x, y FROM v26",
    # hull edges: directed vertex pairs with every vertex on or left of the line, and no collinear vertex beyond
    "he": """
SELECT p.bid, p.x AS x1, p.y AS y1, q.x AS x2, q.y AS y2 FROM vd p JOIN vd q ON p.bid = q.bid AND (p.x <> q.x OR p.y <> q.y)
JOIN vd k ON k.bid = p.bid
GROUP BY ALL HAVING min((q.x-p.x)*(k.y-p.y) - (q.y-p.y)*(k.x-p.x)) >= 0
 AND max(CASE WHEN (q.x-p.x)*(k.y-p.y) - (q.y-p.y)*(k.x-p.x) = 0
   THEN greatest(-((q.x-p.x)*(k.x-p.x) + (q.y-p.y)*(k.y-p.y)), (q.x-p.x)*(k.x-q.x) + (q.y-p.y)*(k.y-q.y)) ELSE 0 END) <= 0""",
    "hull": "SELECT bid, sum(x1*y2 - x2*y1)/2 AS hull_area FROM he GROUP BY bid",
    "rects": """
SELECT e.bid, (max(u) - min(u)) AS a, (max(v) - min(v)) AS b FROM (
  SELECT e.bid, e.x1, e.y1, e.x2, e.y2, (k.x*(e.x2-e.x1) + k.y*(e.y2-e.y1))/sqrt((e.x2-e.x1)*(e.x2-e.x1) + (e.y2-e.y1)*(e.y2-e.y1)) AS u,
    (k.y*(e.x2-e.x1) - k.x*(e.y2-e.y1))/sqrt((e.x2-e.x1)*(e.x2-e.x1) + (e.y2-e.y1)*(e.y2-e.y1)) AS v
  FROM he e JOIN vd k ON k.bid = e.bid) e GROUP BY e.bid, x1, y1, x2, y2""",
    "rect": """
SELECT bid, arg_min(greatest(a,b)/least(a,b), (round(a*b, 4), greatest(a,b))) AS aspect FROM rects GROUP BY bid""",
}


@register("g3_convexity", "SELECT g.bid, round(g.area_m2/h.hull_area, 9) AS convexity FROM g26 g JOIN hull h USING (bid)", HULL)
def g3_convexity(i: Inputs):
    from cityloom.operators.features import convexity

    return convexity(buildings(i)).select("bid", F.round("convexity", 9).alias("convexity"))


@register("g4_aspect_ratio", "SELECT bid, round(aspect, 6) AS aspect_ratio FROM rect", HULL)
def g4_aspect_ratio(i: Inputs):
    from cityloom.operators.features import aspect_ratio

    return aspect_ratio(buildings(i)).select("bid", F.round("aspect_ratio", 6).alias("aspect_ratio"))


@register("g5_interior_point", "SELECT bid, rx AS rep_x, ry AS rep_y FROM g26")
def g5_interior_point(i: Inputs):
    return buildings(i).select("bid", "rep_x", "rep_y")


@register(
    "g6_point_in_polygon",
    """SELECT t.val_id, t.x > b.x0 AND t.x < b.x0+b.w AND t.y > b.y0 AND t.y < b.y0+b.d
 AND NOT (b.lshape AND t.x >= b.x0+b.w/2 AND t.y >= b.y0+b.d/2) AS inside FROM truth t JOIN b26 b ON b.bid = t.target_bid""",
)
def g6_point_in_polygon(i: Inputs):
    j = i.view("truth").join(i.buildings().withColumnRenamed("bid", "target_bid"), "target_bid")
    return j.select("val_id", G.contains("geom", "x", "y").alias("inside"))


@register("g7_overlap_area", "SELECT bid23, bid, inter FROM ov")
def g7_overlap_area(i: Inputs):
    p = spatial.overlap_pairs(buildings_2023(i), buildings(i), L.FOOTPRINT_CELL_M, "bid23", "bid", [])
    return p.select("bid23", "bid", "inter")


@register(
    "g8_iou",
    """SELECT o.bid23, o.bid, round(o.inter/(g.area23 + h.area_m2 - o.inter), 9) AS iou, round(o.inter/g.area23, 9) AS overlap_share
FROM ov o JOIN g23 g USING (bid23) JOIN g26 h ON h.bid = o.bid""",
)
def g8_iou(i: Inputs):
    p = spatial.overlap_pairs(buildings_2023(i), buildings(i), L.FOOTPRINT_CELL_M, "bid23", "bid", [])
    iou = spatial.iou(F.col("inter"), F.col("a_area"), F.col("b_area"))
    return p.select("bid23", "bid", F.round(iou, 9).alias("iou"), F.round(F.col("inter") / F.col("a_area"), 9).alias("overlap_share"))


@register(
    "g9_point_polygon_distance",
    """SELECT t.val_id, round(min(sqrt(power(greatest(r.xa - t.x, 0, t.x - r.xb), 2) + power(greatest(r.ya - t.y, 0, t.y - r.yb), 2))), 6) AS dist
FROM truth t JOIN r26 r ON r.bid = t.target_bid GROUP BY 1""",
)
def g9_point_polygon_distance(i: Inputs):
    j = i.view("truth").join(i.buildings().withColumnRenamed("bid", "target_bid"), "target_bid")
    return j.select("val_id", F.round(G.distance("geom", "x", "y").dist, 6).alias("dist"))


@register(
    "g10_point_distance",
    """SELECT t.val_id, round(sqrt((t.x-g.rx)*(t.x-g.rx) + (t.y-g.ry)*(t.y-g.ry)), 6) AS dist FROM truth t JOIN g26 g ON g.bid = t.target_bid""",
)
def g10_point_distance(i: Inputs):
    b = buildings(i).select(F.col("bid").alias("target_bid"), "rep_x", "rep_y")
    j = i.view("truth").join(b, "target_bid")
    return j.select("val_id", F.round(F.hypot(F.col("x") - F.col("rep_x"), F.col("y") - F.col("rep_y")), 6).alias("dist"))


@register(
    "g12_largest_part",
    """SELECT parcel_id, arg_min(bid, (-area_m2, bid)) AS bid, max(area_m2) AS area_m2 FROM bp JOIN g26 USING (bid) GROUP BY 1""",
)
def g12_largest_part(i: Inputs):
    """Largest footprint of each parcel: parts stay rows, so a parcel with very many parts is no problem."""
    b = buildings(i)
    j = L.parcel_of(b, parcels(i)).join(b.select("bid", "area_m2"), "bid")
    best = F.min_by("bid", F.struct(-F.col("area_m2"), F.col("bid")))
    return j.groupBy("parcel_id").agg(best.alias("bid"), F.max("area_m2").alias("area_m2"))


@register(
    "g12_multipolygon_part",
    """SELECT bid, greatest(CASE WHEN lshape THEN w*d*3/4 ELSE w*d END, (bid % 3 + 1)*w/2*d/2) AS area_m2 FROM b26""",
)
def g12_multipolygon_part(i: Inputs):
    """Footprint and an annex as one multipolygon each: its largest polygon."""
    b = i.view("b26").select("bid", "x0", "y0", "w", "d").join(i.buildings().select("bid", "geom"), "bid")
    annex = G.box(F.col("x0") + 100, F.col("y0"), F.col("x0") + 100 + (F.col("bid") % 3 + 1) * F.col("w") / 2, F.col("y0") + F.col("d") / 2)
    parts = b.select("bid", F.array(F.col("geom"), annex).alias("parts"))
    return G.largest_part(parts, "bid", "parts").select("bid", "area_m2")


# lon/lat of a fixture point: the metric plane laid over the city
LONLAT = "121.0 + x/100000 AS lon, 30.9 + y/100000 AS lat"


def lonlat(df, x="x", y="y"):
    return df.withColumns({"lon": F.lit(121.0) + F.col(x) / 100000.0, "lat": F.lit(30.9) + F.col(y) / 100000.0})


PI = "pi()"
GCJ = {
    "ll": "SELECT id, CAST(121 AS DOUBLE) + x/100000 AS lon, CAST(30.9 AS DOUBLE) + y/100000 AS lat FROM poi",
    "gcj": """
SELECT id, lon, lat, lon + dlon*180/(6378245.0/sqrt(m)*cos(radians(lat))*pi()) AS glon,
  lat + dlat*180/((6378245.0*(1-0.00669342162296594323))/(m*sqrt(m))*pi()) AS glat
FROM (SELECT id, lon, lat, 1 - 0.00669342162296594323*sin(radians(lat))*sin(radians(lat)) AS m,
  -100 + 2*x + 3*y + 0.2*y*y + 0.1*x*y + 0.2*sqrt(abs(x)) + (20*sin(6*x*pi()) + 20*sin(2*x*pi()))*2/3
   + (20*sin(y*pi()) + 40*sin(y/3*pi()))*2/3 + (160*sin(y/12*pi()) + 320*sin(y*pi()/30))*2/3 AS dlat,
  300 + x + 2*y + 0.1*x*x + 0.1*x*y + 0.1*sqrt(abs(x)) + (20*sin(6*x*pi()) + 20*sin(2*x*pi()))*2/3
   + (20*sin(x*pi()) + 40*sin(x/3*pi()))*2/3 + (150*sin(x/12*pi()) + 300*sin(x/30*pi()))*2/3 AS dlon
 FROM (SELECT *, lon - 105 AS x, lat - 35 AS y FROM ll))""",
}


@register("f8_gcj02", "SELECT id, round(glon, 8) AS lon, round(glat, 8) AS lat FROM gcj", GCJ)
def f8_gcj02(i: Inputs):
    lon, lat = D.wgs84_to_gcj02(F.col("lon"), F.col("lat"))
    return lonlat(i.view("poi")).select("id", F.round(lon, 8).alias("lon"), F.round(lat, 8).alias("lat"))


@register(
    "f9_bd09",
    """
SELECT id, round(z*cos(t) + 0.0065, 8) AS lon, round(z*sin(t) + 0.006, 8) AS lat FROM (
 SELECT id, sqrt(glon*glon + glat*glat) + 0.00002*sin(glat*pi()*3000/180) AS z, atan2(glat, glon) + 0.000003*cos(glon*pi()*3000/180) AS t FROM gcj)""",
    GCJ,
)
def f9_bd09(i: Inputs):
    lon, lat = D.wgs84_to_bd09(F.col("lon"), F.col("lat"))
    return lonlat(i.view("poi")).select("id", F.round(lon, 8).alias("lon"), F.round(lat, 8).alias("lat"))


@register("f10_gcj02_inverse", "SELECT id, round(2*lon - glon, 8) AS lon, round(2*lat - glat, 8) AS lat FROM gcj", GCJ)
def f10_gcj02_inverse(i: Inputs):
    lon, lat = D.gcj02_to_wgs84(F.col("lon"), F.col("lat"))
    return lonlat(i.view("poi")).select("id", F.round(lon, 8).alias("lon"), F.round(lat, 8).alias("lat"))


@register(
    "f11_map_link",
    """SELECT id, 'https://api.map.baidu.com/marker?location=' || printf('%.7f', lat) || '%2C' || printf('%.7f', lon) || '&title=P' || id
 || '&content=UBEM&coord_type=wgs84&output=html&src=ubem.validation' AS url FROM ll""",
    GCJ,
)
def f11_map_link(i: Inputs):
    title = F.concat(F.lit("P"), F.col("id").cast("string"))
    return lonlat(i.view("poi")).select("id", D.marker_link(F.col("lon"), F.col("lat"), title).alias("url"))


# Krueger series with the third flattening n of the WGS84 ellipsoid
TM = {
    "tm": """
SELECT id, 500000 + 0.9996*a*(eta + a1*cos(2*xi)*sinh(2*eta) + a2*cos(4*xi)*sinh(4*eta) + a3*cos(6*xi)*sinh(6*eta)) AS x,
  0.9996*a*(xi + a1*sin(2*xi)*cosh(2*eta) + a2*sin(4*xi)*cosh(4*eta) + a3*sin(6*xi)*cosh(6*eta)) AS y
FROM (SELECT *, atan2(t, cos(p)) AS xi, atanh(sin(p)/sqrt(1 + t*t)) AS eta,
   n/2 - 2*n*n/3 + 5*n*n*n/16 AS a1, 13*n*n/48 - 3*n*n*n/5 AS a2, 61*n*n*n/240 AS a3, 6378137/(1+n)*(1 + n*n/4 + n*n*n*n/64) AS a
 FROM (SELECT *, sinh(atanh(s) - k*atanh(k*s)) AS t FROM (SELECT *, 2*sqrt(n)/(1+n) AS k
   FROM (SELECT id, sin(radians(lat)) AS s, radians(lon - 123) AS p,
     CAST(1 AS DOUBLE)/(2*CAST(298.257223563 AS DOUBLE) - 1) AS n FROM ll))))""",
}


@register("f12_to_metric", "SELECT id, round(x, 4) AS x, round(y, 4) AS y FROM tm", {**GCJ, **TM})
def f12_to_metric(i: Inputs):
    x, y = D.to_metric(F.col("lon"), F.col("lat"))
    return lonlat(i.view("poi")).select("id", F.round(x, 4).alias("x"), F.round(y, 4).alias("y"))


@register("f12_back_to_lonlat", "SELECT id, round(lon, 8) AS lon, round(lat, 8) AS lat FROM ll", GCJ)
def f12_back_to_lonlat(i: Inputs):
    df = lonlat(i.view("poi"))
    x, y = D.to_metric(F.col("lon"), F.col("lat"))
    lon, lat = D.to_geographic(F.col("mx"), F.col("my"))
    return df.select("id", x.alias("mx"), y.alias("my")).select("id", F.round(lon, 8).alias("lon"), F.round(lat, 8).alias("lat"))


@register(
    "f19_cell_polygon_text",
    """
SELECT parcel_id, string_agg(printf('%.6f', glon) || ',' || printf('%.6f', glat), '|' ORDER BY k) AS poly FROM (
 SELECT parcel_id, k, lon + dlon*180/(6378245.0/sqrt(m)*cos(radians(lat))*pi()) AS glon,
  lat + dlat*180/((6378245.0*(1-0.00669342162296594323))/(m*sqrt(m))*pi()) AS glat
 FROM (SELECT parcel_id, k, lon, lat, 1 - 0.00669342162296594323*sin(radians(lat))*sin(radians(lat)) AS m,
  -100 + 2*x + 3*y + 0.2*y*y + 0.1*x*y + 0.2*sqrt(abs(x)) + (20*sin(6*x*pi()) + 20*sin(2*x*pi()))*2/3
   + (20*sin(y*pi()) + 40*sin(y/3*pi()))*2/3 + (160*sin(y/12*pi()) + 320*sin(y*pi()/30))*2/3 AS dlat,
  300 + x + 2*y + 0.1*x*x + 0.1*x*y + 0.1*sqrt(abs(x)) + (20*sin(6*x*pi()) + 20*sin(2*x*pi()))*2/3
   + (20*sin(x*pi()) + 40*sin(x/3*pi()))*2/3 + (150*sin(x/12*pi()) + 300*sin(x/30*pi()))*2/3 AS dlon
  FROM (SELECT parcel_id, k, CAST(121 AS DOUBLE) + (x0 + CASE WHEN k IN (1,2) THEN side ELSE 0 END)/100000 AS lon,
         CAST(30.9 AS DOUBLE) + (y0 + CASE WHEN k IN (2,3) THEN side ELSE 0 END)/100000 AS lat, lon - 105 AS x, lat - 35 AS y
        FROM parcels, (VALUES (0), (1), (2), (3), (4)) c(k)))) GROUP BY 1""",
)
def f19_cell_polygon_text(i: Inputs):
    p = parcels(i)
    lon = lambda c: F.lit(121.0) + F.col(c) / 100000.0
    lat = lambda c: F.lit(30.9) + F.col(c) / 100000.0
    return p.select("parcel_id", D.cell_polygon_text(lon("xmin"), lat("ymin"), lon("xmax"), lat("ymax")).alias("poly"))


@register(
    "d8_valid_footprints",
    "SELECT bid, area_m2 > 0 AS valid FROM g26",
)
def d8_valid_footprints(i: Inputs):
    return buildings(i).select("bid", (G.has_valid_rings(F.col("geom")) & (F.col("area_m2") > 0)).alias("valid"))
