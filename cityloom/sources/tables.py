"""Readers with their contracts: column checks, coercion, explicit keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cityloom.functions import geodesy

POI_FIELDS = ["id", "name", "typecode", "wgs_lng", "wgs_lat"]
CELL_RECORD = (
    "cell_id int, capped boolean, pois array<struct<id:string,name:string,typecode:string,addr:string,gcj:string,wgs:string>>"
)


def lookup(spark: SparkSession, columns: list[str], rows: list[tuple]) -> DataFrame:
    """Small fixed table as an inline relation, so its size is known to the optimizer."""

    def lit(v) -> str:
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return str(v).lower()
        if isinstance(v, float):
            return f"CAST({v!r} AS DOUBLE)"
        if isinstance(v, int):
            return str(v)
        return "'" + str(v).replace("\\", "\\\\").replace("'", "\\'") + "'"

    body = ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)
    return spark.sql(f"SELECT * FROM VALUES {body} AS t({', '.join(columns)})")


def require_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def require_srid(df: DataFrame, srid: int = 4326, column: str = "srid") -> DataFrame:
    """Fail the job on any row in another coordinate system; the column is dropped."""
    bad = ~F.col(column).eqNullSafe(F.lit(srid))
    return df.withColumn(
        column, F.when(bad, F.raise_error(F.concat(F.lit("unexpected srid: "), F.col(column).cast("string"))))
    ).where(F.col(column).isNull()).drop(column)


def number(column: str) -> Column:
    """Number or numeric text as a double; anything else is null."""
    v = F.expr(f"try_cast(trim(CAST({column} AS STRING)) AS DOUBLE)")
    return F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v)


def truncated(value: Column) -> Column:
    """The whole part of a double, towards zero: 12.5 counts as 12."""
    return value.cast("bigint").cast("int")


def scan_buildings(df: DataFrame, keep: list[str]) -> DataFrame:
    """2026 footprints: numeric height, ``Area`` renamed to ``area_m2``, only the wanted columns."""
    require_columns(df, ["height"])
    if "Area" in df.columns:
        df = df.withColumnRenamed("Area", "area_m2")
    return df.select(*keep).withColumn("height", truncated(number("height")))


def scan_buildings_2023(df: DataFrame) -> DataFrame:
    """2023 footprints: ``FLOOR`` text holds twice the floors; an odd value stops the job, a fraction is cut off."""
    require_columns(df, ["FLOOR"])
    code = number("FLOOR")
    checked = F.when(code % 2 == 1, F.raise_error(F.concat(F.lit("odd FLOOR: "), F.col("FLOOR").cast("string"))).cast("double"))
    return df.withColumn("floor23", truncated(F.coalesce(checked, code))).withColumn("floors_2023", F.floor(F.col("floor23") / 2).cast("int"))


def row_count_check(df: DataFrame, band: tuple[int, int]) -> DataFrame:
    """One row: count and whether it lies in the expected band."""
    n = F.count(F.lit(1))
    return df.agg(n.alias("n_rows"), n.between(*band).alias("in_band"))


def attach_by_key(master: DataFrame, vendor: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Vendor fields by explicit key; a master row without a vendor row stops the job."""
    v = vendor.select(key, *columns, F.lit(True).alias("_has"))
    j = master.join(v, key, "left")
    guard = F.when(F.col("_has").isNull(), F.raise_error(F.concat(F.lit("no vendor row for "), F.col(key).cast("string"))))
    return j.withColumn("_has", F.coalesce(guard.cast("boolean"), F.col("_has"))).where("_has").drop("_has")


def read_report_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Report CSV with ``#`` provenance lines above the header, UTF-8 with or without a byte-order mark."""
    return spark.read.csv(path, schema=schema, header=True, comment="#", encoding="UTF-8")


def read_cell_records(spark: SparkSession, path: str) -> DataFrame:
    """One row per POI from nested scan-cell JSON lines."""
    rec = spark.read.schema(CELL_RECORD).json(path)
    return explode_cells(rec)


def explode_cells(records: DataFrame) -> DataFrame:
    poi = records.select("cell_id", "capped", F.posexplode("pois").alias("pos", "p"))
    wgs = F.split("p.wgs", ",")
    return poi.select(
        "cell_id",
        "capped",
        "pos",
        "p.id",
        "p.name",
        "p.typecode",
        "p.addr",
        wgs[0].cast("double").alias("wgs_lng"),
        wgs[1].cast("double").alias("wgs_lat"),
    )


def slim_poi(df: DataFrame) -> DataFrame:
    """Raw service record to six fields; ``location`` is ``lng,lat`` in GCJ-02 and is shifted to WGS84."""
    loc = F.split(F.coalesce(F.col("location"), F.lit("0,0")), ",")
    lng, lat = loc[0].cast("double"), loc[1].cast("double")
    wlng, wlat = geodesy.gcj02_to_wgs84(lng, lat)
    return df.select(
        "id",
        "name",
        "typecode",
        F.col("address").alias("addr"),
        F.concat_ws(",", lng.cast("string"), lat.cast("string")).alias("gcj"),
        F.format_string("%.6f,%.6f", wlng, wlat).alias("wgs"),
    )


def union_poi(primary: DataFrame, extra: DataFrame) -> DataFrame:
    """Shared POI fields of both sources, one row per id; the primary source wins, and inside a source the lowest ``ord``.

    Rows of one source that share id and ``ord`` are ordered by their other fields, so the result never depends on arrival.
    """
    from cityloom.operators.skew import first_per_key

    cols = [*POI_FIELDS, "ord"]
    require_columns(primary, cols)
    require_columns(extra, cols)
    both = primary.select(*cols, F.lit(0).alias("_src")).unionByName(extra.select(*cols, F.lit(1).alias("_src")))
    order: list[Column] = [F.col("_src"), F.col("ord"), *(F.col(c) for c in POI_FIELDS[1:])]
    return first_per_key(both, ["id"], order).select(*POI_FIELDS)


def read_done_set(spark: SparkSession, path: str) -> DataFrame:
    """Finished cell ids, one per line or separated by blanks."""
    words = spark.read.text(path).select(F.explode(F.split(F.trim("value"), r"\s+")).alias("w"))
    return words.where(F.col("w") != "").select(F.col("w").cast("int").alias("cell_id")).distinct()
