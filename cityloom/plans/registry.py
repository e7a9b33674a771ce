"""Registry of queries and helpers to compose the reference SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cityloom.sources.views import VIEW_SQL, Inputs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

# Derived relations of the reference SQL. Footprints are rectangles or L-shapes on the axes, so area,
# interior point, containment and overlap have closed forms that do not share code with the operators.
CTE = {name: body.format(**{t: t for t in _TABLES}, b26="b26") for name, body in VIEW_SQL.items()}
CTE.update(
    {
        "g26": """
SELECT *, CASE WHEN lshape THEN w*d*3/4 ELSE w*d END AS area_m2, 2*(w+d) AS perimeter_m,
       CASE WHEN lshape THEN x0 + w/4 ELSE x0 + w/2 END AS rx,
       CASE WHEN lshape THEN y0 + 3*d/4 ELSE y0 + d/2 END AS ry
FROM b26""",
        "g23": """
SELECT bid AS bid23, CAST(FLOOR AS INT) AS floor23, CAST(FLOOR AS INT)//2 AS floors_2023, x0, y0, w, d, lshape,
       CASE WHEN lshape THEN w*d*3/4 ELSE w*d END AS area23,
       CASE WHEN lshape THEN x0 + w/4 ELSE x0 + w/2 END AS rx,
       CASE WHEN lshape THEN y0 + 3*d/4 ELSE y0 + d/2 END AS ry
FROM b23""",
        "r26": """
SELECT bid, x0 AS xa, y0 AS ya, x0+w AS xb, CASE WHEN lshape THEN y0+d/2 ELSE y0+d END AS yb FROM b26
UNION ALL SELECT bid, x0, y0+d/2, x0+w/2, y0+d FROM b26 WHERE lshape""",
        "r23": """
SELECT bid AS bid23, x0 AS xa, y0 AS ya, x0+w AS xb, CASE WHEN lshape THEN y0+d/2 ELSE y0+d END AS yb FROM b23
UNION ALL SELECT bid, x0, y0+d/2, x0+w/2, y0+d FROM b23 WHERE lshape""",
        "v26": """
SELECT bid, i,
       CASE WHEN i IN (0,5) THEN x0 WHEN i IN (1,2) THEN x0+w
            ELSE CASE WHEN lshape THEN x0+w/2 ELSE x0+w END END AS x,
       CASE WHEN i IN (0,1) THEN y0 WHEN i IN (4,5) THEN y0+d
            ELSE CASE WHEN lshape THEN y0+d/2 ELSE y0+d END END AS y
FROM b26 CROSS JOIN (SELECT unnest([0,1,2,3,4,5]) AS i) v""",
        "e26": """
SELECT a.bid, a.i, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2
FROM v26 a JOIN v26 b ON a.bid = b.bid AND b.i = (a.i + 1) % 6""",
        # overlap pairs 2023 x 2026; neighbours share a 25 m grid so a box range join finds them
        "ov": """
SELECT a.bid23, b.bid,
       sum((least(a.xb,b.xb)-greatest(a.xa,b.xa))*(least(a.yb,b.yb)-greatest(a.ya,b.ya))) AS inter
FROM r23 a JOIN r26 b ON CAST(floor(a.xa/64) AS BIGINT) - CAST(floor(b.xa/64) AS BIGINT) BETWEEN -1 AND 1
 AND a.xa < b.xb AND b.xa < a.xb AND a.ya < b.yb AND b.ya < a.yb
GROUP BY 1, 2""",
        "best23": """
SELECT o.bid23, o.bid, o.inter, g.area23, h.area_m2 AS area26, g.floors_2023, h.height,
       o.inter/(g.area23 + h.area_m2 - o.inter) AS iou, o.inter/g.area23 AS overlap23
FROM ov o JOIN g23 g USING (bid23) JOIN g26 h ON h.bid = o.bid
QUALIFY row_number() OVER (PARTITION BY o.bid23 ORDER BY o.inter DESC, o.bid) = 1""",
        "cen": """
SELECT g.bid23, min(b.bid) AS bid FROM g23 g JOIN g26 b
  ON g.rx > b.x0 AND g.rx < b.x0+b.w AND g.ry > b.y0 AND g.ry < b.y0+b.d
 AND NOT (b.lshape AND g.rx >= b.x0+b.w/2 AND g.ry >= b.y0+b.d/2)
GROUP BY 1""",
        "cenp": """
SELECT c.bid23, c.bid, g.floors_2023, b.height, g.area23, b.area_m2 AS area26
FROM cen c JOIN g23 g USING (bid23) JOIN g26 b ON b.bid = c.bid""",
        "bp": """
SELECT g.bid, min(p.parcel_id) AS parcel_id, arg_min(p.class, p.parcel_id) AS class
FROM g26 g JOIN parcels p ON g.rx > p.x0 AND g.rx < p.x0+p.side AND g.ry > p.y0 AND g.ry < p.y0+p.side
GROUP BY 1""",
        # floors with supertall buildings paired to 2023
        "sup": """
SELECT o.bid, arg_max(g.floors_2023, o.inter*1000000 - o.bid23) AS f23,
       max(o.inter) AS inter, arg_max(g.area23, o.inter*1000000 - o.bid23) AS area23
FROM ov o JOIN g23 g USING (bid23) JOIN b26 b ON b.bid = o.bid WHERE b.height >= 160 GROUP BY 1""",
        "chassis": """
SELECT g.bid, g.height, g.ep, g.district, g.area_m2, g.rx, g.ry, g.height >= 160 AS is_supertall,
       CASE WHEN g.height < 160 THEN CAST(round_even(CAST(g.height AS DOUBLE)/4, 0) AS INT)
            WHEN s.inter/(g.area_m2 + s.area23 - s.inter) >= CAST(0.3 AS DOUBLE) THEN CAST(s.f23 AS INT) END AS floors,
       CASE WHEN g.height < 160 THEN 'round_h4'
            WHEN s.inter/(g.area_m2 + s.area23 - s.inter) >= CAST(0.3 AS DOUBLE) THEN 'crosswalk_iou2023'
            ELSE 'supertall_unmatched_crosswalk_or_cnbh' END AS floors_source
FROM g26 g LEFT JOIN sup s ON s.bid = g.bid""",
        # POI -> nearest building interior point within 150 m, ties kept
        "pn": """
SELECT p.id, p.typecode, b.bid, sqrt((p.x-b.rx)*(p.x-b.rx) + (p.y-b.ry)*(p.y-b.ry)) AS dist
FROM poi p JOIN g26 b ON b.rx BETWEEN p.x-150 AND p.x+150 AND b.ry BETWEEN p.y-150 AND p.y+150
WHERE sqrt((p.x-b.rx)*(p.x-b.rx) + (p.y-b.ry)*(p.y-b.ry)) <= 150
QUALIFY rank() OVER (PARTITION BY p.id ORDER BY (p.x-b.rx)*(p.x-b.rx) + (p.y-b.ry)*(p.y-b.ry)) = 1""",
        "codes": "SELECT * FROM (SELECT id, unnest(string_split(typecode, '|')) AS code FROM poi) WHERE code <> ''",
        "sig": """
SELECT n.bid,
       bool_or(c.code LIKE '0601%') AS mall,
       bool_or(c.code LIKE '1001%' OR (c.code LIKE '1002%' AND b.class IN (1,2))) AS hotel
FROM pn n JOIN codes c ON c.id = n.id LEFT JOIN bp b ON b.bid = n.bid GROUP BY 1""",
        "master": """
SELECT c.*, p.parcel_id, p.class AS euluc_class, p.class IS NULL AS euluc_out,
       coalesce(s.mall, false) AS mall_signal, coalesce(s.hotel, false) AS hotel_signal,
       coalesce(p.class = 1 AND s.mall, false) AS mixed_use_candidate,
       CASE WHEN coalesce(p.class = 1 AND s.mall, false) THEN 'mixed_use'
            WHEN coalesce(s.mall, false) THEN 'shopping_mall'
            WHEN coalesce(s.hotel, false) THEN 'hotel'
            WHEN p.class = 0 THEN CASE WHEN c.floors >= 10 THEN 'residential_high_rise' ELSE 'residential_mid_rise' END
            WHEN p.class = 1 THEN 'office' WHEN p.class IN (4,5) THEN 'transportation'
            WHEN p.class = 6 THEN 'government_office' WHEN p.class = 7 THEN 'education'
            WHEN p.class = 8 THEN 'healthcare' WHEN p.class = 9 THEN 'sport_culture' ELSE 'unknown' END AS archetype,
       CASE WHEN coalesce(p.class = 1 AND s.mall, false) THEN 'mixed_use_candidate'
            WHEN coalesce(s.mall, false) THEN 'mall' WHEN coalesce(s.hotel, false) THEN 'hotel'
            WHEN p.class IN (0,1,4,5,6,7,8,9) THEN 'euluc_direct' ELSE 'unknown' END AS label_rule
FROM chassis c LEFT JOIN bp p ON p.bid = c.bid LEFT JOIN sig s ON s.bid = c.bid""",
        # labelled point -> building: inside, else nearest within 10 m
        "tin": """
SELECT t.val_id, min(b.bid) AS bid FROM truth t JOIN b26 b
  ON t.x > b.x0 AND t.x < b.x0+b.w AND t.y > b.y0 AND t.y < b.y0+b.d
 AND NOT (b.lshape AND t.x >= b.x0+b.w/2 AND t.y >= b.y0+b.d/2)
GROUP BY 1""",
        "tnear": """
SELECT val_id, bid, dist FROM (
  SELECT t.val_id, e.bid, min(sqrt(
      power(t.x - (e.x1 + u.t*(e.x2-e.x1)), 2) + power(t.y - (e.y1 + u.t*(e.y2-e.y1)), 2))) AS dist
  FROM truth t
  JOIN b26 b ON t.x BETWEEN b.x0-10 AND b.x0+b.w+10 AND t.y BETWEEN b.y0-10 AND b.y0+b.d+10
  JOIN e26 e ON e.bid = b.bid,
  LATERAL (SELECT CASE WHEN (e.x2-e.x1)*(e.x2-e.x1)+(e.y2-e.y1)*(e.y2-e.y1) > 0 THEN
      greatest(0, least(1, ((t.x-e.x1)*(e.x2-e.x1)+(t.y-e.y1)*(e.y2-e.y1))
        /((e.x2-e.x1)*(e.x2-e.x1)+(e.y2-e.y1)*(e.y2-e.y1)))) ELSE 0 END AS t) u
  WHERE t.val_id NOT IN (SELECT val_id FROM tin)
  GROUP BY 1, 2)
WHERE dist <= 10 QUALIFY row_number() OVER (PARTITION BY val_id ORDER BY dist, bid) = 1""",
        "tmatch": """
SELECT val_id, bid, CAST(0 AS DOUBLE) AS match_dist FROM tin
UNION ALL SELECT val_id, bid, dist FROM tnear""",
    }
)

_NEEDS_ORDER = list(CTE)


def with_ctes(body: str, extra: dict[str, str] | None = None) -> str:
    """Prefix ``body`` with the relations it uses, directly or through others."""
    import re

    pool = {**CTE, **(extra or {})}
    order = _NEEDS_ORDER + [k for k in (extra or {}) if k not in CTE]
    used: set[str] = set()

    def visit(sql: str) -> None:
        for name in pool:
            if name not in used and re.search(rf"\b(FROM|JOIN|from|join|,)\s+{name}\b", sql):
                used.add(name)
                visit(pool[name])

    visit(body)
    names = [n for n in order if n in used]
    if not names:
        return body.strip()
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({pool[n].strip()})" for n in names) + "\n" + body.strip()


def register(name: str, oracle: str | None = None, extra: dict[str, str] | None = None):
    """Register ``fn(Inputs) -> DataFrame`` under ``name``, with reference SQL where SQL can say it."""

    def wrap(fn: Callable[[Inputs], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")
        QUERIES[name] = lambda spark, folder: fn(Inputs(spark, folder))
        if oracle is not None:
            ORACLES[name] = with_ctes(oracle, extra)
        return fn

    return wrap
