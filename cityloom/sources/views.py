"""Input views over the Parquet tables: the shapes the operators expect, derived row by row.

Each body is one SELECT that both Spark and the reference engine can run; ``{name}`` marks a source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cityloom.functions import geometry as G
from cityloom.session import merged, scratch_path

VIEW_SQL = {
    "b26": """
SELECT o_orderkey AS bid,
       CAST(25*(o_orderkey % 120) + (o_orderkey*37) % 7 AS DOUBLE) AS x0,
       CAST(25*((o_orderkey - o_orderkey % 120)/120) + (o_orderkey*53) % 5 AS DOUBLE) AS y0,
       CAST(8 + (o_orderkey*17) % 9 AS DOUBLE) AS w,
       CAST(8 + (o_orderkey*29) % 9 AS DOUBLE) AS d,
       (o_orderkey % 5 = 0) AS lshape,
       CAST(CASE WHEN o_orderkey % 97 = 0 THEN 160 + 4*(o_orderkey % 20)
            ELSE 4*(1 + (o_orderkey*7919) % 12)
                 + CASE WHEN o_orderkey % 6 = 0 THEN 2 ELSE 0 END END AS INT) AS height,
       CAST(o_orderkey % 14 AS INT) AS ep,
       o_orderpriority AS district
FROM {orders}""",
    "b23": """
SELECT bid, x0 + CAST(bid % 5 AS DOUBLE) AS x0, y0 + CAST(bid % 3 AS DOUBLE) AS y0, w, d, lshape,
       CAST(2*(CASE WHEN bid % 97 = 0 THEN 40 + bid % 20
               ELSE 1 + (bid*7919) % 12 + CASE WHEN bid % 11 = 0 THEN 1 ELSE 0 END END) AS STRING) AS FLOOR
FROM {b26} WHERE bid % 2 = 0""",
    "parcels": """
SELECT CAST(24*yb + xb AS BIGINT) AS parcel_id, CAST(125*xb AS DOUBLE) AS x0, CAST(125*yb AS DOUBLE) AS y0,
       CAST(120 AS DOUBLE) AS side, CAST((7*xb + 11*yb) % 12 AS INT) AS class
FROM (SELECT DISTINCT CAST(((o_orderkey % 120) - (o_orderkey % 120) % 5)/5 AS BIGINT) AS xb,
             CAST(((o_orderkey - o_orderkey % 600))/600 AS BIGINT) AS yb FROM {orders}) t
WHERE (7*xb + 11*yb) % 12 <> 11""",
    "poi": """
SELECT c_custkey AS id, concat('poi ', c_mktsegment) AS name,
       CASE c_custkey % 8 WHEN 0 THEN '060101' WHEN 1 THEN '060400' WHEN 2 THEN '100100'
            WHEN 3 THEN '100200' WHEN 4 THEN '120203' WHEN 5 THEN '141201'
            WHEN 6 THEN '060101|100100' ELSE '050000|060100' END AS typecode,
       CAST(25*((c_custkey*31) % 120) + c_custkey % 25 AS DOUBLE) AS x,
       CAST(25*((10*c_custkey - (10*c_custkey) % 120)/120) + c_custkey % 23 AS DOUBLE) AS y
FROM {customer}""",
    "truth": """
SELECT p_partkey AS val_id, b.bid AS target_bid,
       b.x0 + b.w/2 + CAST(6*(p_partkey % 4) AS DOUBLE) AS x, b.y0 + b.d/4 AS y,
       CASE WHEN p_partkey % 5 = 0 THEN 'not_found' ELSE 'annotated' END AS status,
       CASE p_partkey % 6 WHEN 0 THEN 'residential' WHEN 1 THEN 'office' WHEN 2 THEN 'education'
            WHEN 3 THEN 'shopping_mall' WHEN 4 THEN 'culture' ELSE 'residential' END AS archetype,
       CAST(1 + p_size % 30 AS INT) AS floors_observed
FROM {part} p JOIN {b26} b ON b.bid = p.p_partkey*7""",
    "sim": """
SELECT concat(l_returnflag, l_linestatus) AS archetype, CAST(month(l_shipdate) AS INT) AS month,
       sum(l_quantity)*3600000 AS lights_j, sum(l_linenumber)*3600000 AS equip_j,
       sum(l_quantity)*12600000 AS cool_j, sum(l_quantity)*9000000 AS heat_j
FROM {lineitem} GROUP BY concat(l_returnflag, l_linestatus), CAST(month(l_shipdate) AS INT)""",
    "obs": """
SELECT concat(l_returnflag, l_linestatus) AS archetype, CAST(month(l_shipdate) AS INT) AS month,
       CAST(sum(CASE WHEN l_linenumber % 2 = 0 THEN 7 ELSE 9 END) AS DOUBLE) AS eui
FROM {lineitem} GROUP BY concat(l_returnflag, l_linestatus), CAST(month(l_shipdate) AS INT)""",
    "px": """
SELECT CAST(event_id % 2 AS INT) AS tile, CAST(event_id % 100 AS INT) AS col,
       CAST((event_id - event_id % 100)/100 AS INT) AS prow,
       CASE WHEN event_type = 'error' THEN NULL ELSE value END AS h
FROM {events}""",
    "epd": """
SELECT p_partkey AS epd_id, p_type AS category,
       CASE p_partkey % 3 WHEN 0 THEN 'm3' WHEN 1 THEN 'm2' ELSE 'kg' END AS unit,
       p_retailprice AS gwp, CAST(100 + p_size AS DOUBLE) AS density, CAST(10 + p_size AS DOUBLE) AS mass_m2
FROM {part}""",
}


class Inputs:
    """The Parquet tables of one folder and the views over them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def table(self, name: str) -> DataFrame:
        return merged(self.spark.read.parquet(f"{self.folder}/{name}.parquet"))

    def view(self, name: str) -> DataFrame:
        body = VIEW_SQL[name]
        needed = {n for n in ("b26", *_TABLES) if "{" + n + "}" in body}
        frames = {n: self.view(n) if n in VIEW_SQL else self.table(n) for n in needed}
        return self.spark.sql(body, **frames)

    def buildings(self) -> DataFrame:
        """2026 footprints: ``bid, height, ep, district, geom``."""
        return self.view("b26").select("bid", "height", "ep", "district", _footprint().alias("geom"))

    def buildings_2023(self) -> DataFrame:
        """2023 footprints: ``bid23, FLOOR, geom``."""
        return self.view("b23").select(F.col("bid").alias("bid23"), "FLOOR", _footprint().alias("geom"))

    def parcels(self) -> DataFrame:
        """Land-use parcels: ``parcel_id, class, geom``."""
        s = F.col("side")
        return self.view("parcels").select(
            "parcel_id", "class", G.box(F.col("x0"), F.col("y0"), F.col("x0") + s, F.col("y0") + s).alias("geom")
        )


_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def _footprint():
    x0, y0, w, d = (F.col(c) for c in ("x0", "y0", "w", "d"))
    notch_x = F.when(F.col("lshape"), x0 + w / 2).otherwise(x0 + w)
    notch_y = F.when(F.col("lshape"), y0 + d / 2).otherwise(y0 + d)
    return G.polygon((x0, y0), (x0 + w, y0), (x0 + w, notch_y), (notch_x, notch_y), (notch_x, y0 + d), (x0, y0 + d))


_STORED: dict[tuple, tuple[str, list[str]]] = {}


def stored_tables(i: Inputs, name: str, build, sources: tuple[str, ...]) -> dict[str, DataFrame]:
    """Intermediate tables written once to the shared folder and read back by later jobs of the session.

    ``build`` returns the frames by name. The key holds path, size and modification time of every source
    file, so changed inputs are rebuilt.
    """
    marks = []
    for t in sources:
        files = i.table(t).select(*(F.col(f"_metadata.{c}").alias(c) for c in ("file_path", "file_modification_time", "file_size"))).distinct()
        mark = F.xxhash64("file_path", "file_modification_time", "file_size").cast("decimal(38,0)")
        marks.append(tuple(files.agg(F.count("*"), F.sum(mark)).first()))
    key = (i.spark.sparkContext.applicationId, i.folder, name, tuple(marks))
    if key not in _STORED:
        path = scratch_path(i.spark, name)
        names = []
        for part, df in build().items():
            df.write.parquet(f"{path}/{part}")
            names.append(part)
        _STORED[key] = (path, names)
    path, names = _STORED[key]
    return {n: merged(i.spark.read.parquet(f"{path}/{n}")) for n in names}


def stored(i: Inputs, name: str, build, sources: tuple[str, ...] = ("orders", "customer")) -> DataFrame:
    """:func:`stored_tables` for a single frame."""
    return stored_tables(i, name, lambda: {"data": build()}, sources)["data"]
