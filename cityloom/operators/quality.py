"""Dataset checks and profiles: one aggregate pass, reported as rows of (check, actual, expected, ok)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cityloom.functions.numeric import half_even
from cityloom.operators.quantiles import exact_quantiles
from cityloom.sources.tables import lookup


def qc_report(df: DataFrame, value: str, tail_above: int, expected: dict[str, float]) -> DataFrame:
    """Checks of one numeric text or number column against expected values (null: reported only)."""
    v = F.expr(f"try_cast({value} AS DOUBLE)")
    d = df.select(v.alias("v"))
    sums = d.agg(
        F.count(F.lit(1)).cast("double").alias("rows"),
        F.min("v").alias("min"),
        F.max("v").alias("max"),
        F.percentile("v", 0.5).alias("median"),
        F.count_if(F.col("v").isNull()).cast("double").alias("nulls"),
        F.count_if(F.col("v") <= 0).cast("double").alias("not_positive"),
        F.count_if(F.col("v") != F.rint("v")).cast("double").alias("not_integer"),
        F.count_if(F.col("v") % 2 == 1).cast("double").alias("odd"),
        F.count_if(F.col("v") > tail_above).cast("double").alias("tail_rows"),
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(c).alias("check"),
                F.col(c).alias("actual"),
                F.lit(expected.get(c)).cast("double").alias("expected"),
            )
            for c in sums.columns
        ]
    )
    out = sums.select(F.inline(rows))
    return out.withColumn("ok", F.col("expected").isNull() | (F.col("actual") == F.col("expected")))


def coordinate_check(df: DataFrame, expected: int = 4326, column: str = "srid") -> DataFrame:
    """Coordinate system of a table: ``check, actual, expected, ok``; ``actual`` is null where rows disagree."""
    one = F.when(F.min(column).eqNullSafe(F.max(column)) & (F.count(column) == F.count(F.lit(1))), F.max(column)).cast("double")
    out = df.agg(one.alias("actual")).select(F.lit("epsg").alias("check"), "actual", F.lit(float(expected)).alias("expected"))
    return out.withColumn("ok", F.coalesce(F.col("actual") == F.col("expected"), F.lit(False)))


def field_types(df: DataFrame, expected: list[str] | None = None) -> DataFrame:
    """``field, kind, expected, filled``: every column with its type, whether it was expected, and the rows that fill it."""
    counts = df.agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in df.columns])
    rows = [
        F.struct(F.lit(f.name).alias("field"), F.lit(f.dataType.simpleString()).alias("kind"), F.lit(expected is None or f.name in expected).alias("expected"), F.col(f"`{f.name}`").alias("filled"))
        for f in df.schema
    ]
    return counts.select(F.inline(F.array(*rows)))


def height_report(df: DataFrame, value: str, cutoff: float, expected_rows: int | None = None) -> DataFrame:
    """Report of the newer data: rows, range, median and gaps of the heights, and how many reach the cutoff."""
    d = df.select(F.expr(f"try_cast({value} AS DOUBLE)").alias("v"))
    sums = d.agg(
        F.count(F.lit(1)).cast("double").alias("rows"), F.min("v").alias("min"), F.max("v").alias("max"), F.percentile("v", 0.5).alias("median"),
        F.count_if(F.col("v").isNull()).cast("double").alias("nulls"), F.count_if(F.col("v") >= cutoff).cast("double").alias("tail_rows"),
    )
    want = {"rows": expected_rows}
    rows = [F.struct(F.lit(c).alias("check"), F.col(c).alias("actual"), F.lit(want.get(c)).cast("double").alias("expected")) for c in sums.columns]
    out = sums.select(F.inline(F.array(*rows)))
    return out.withColumn("ok", F.col("expected").isNull() | (F.col("actual") == F.col("expected")))


def tail_distribution(df: DataFrame, value: str, cutoff: int) -> DataFrame:
    """Counts per value above the cutoff with the floors a doubled code stands for."""
    v = F.expr(f"try_cast({value} AS INT)")
    t = df.select(v.alias("value")).where(F.col("value") > cutoff)
    out = t.groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    return out.withColumn("implied_floors", F.floor(F.col("value") / 2).cast("int"))


def field_comparison(left: DataFrame, right: DataFrame) -> DataFrame:
    """Every field of either frame: which side has it and how many rows of each side fill it (null where it is missing)."""

    def filled(df: DataFrame, name: str) -> DataFrame:
        counts = df.agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in df.columns])
        return counts.select(F.inline(F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"`{c}`").alias(name)) for c in df.columns])))

    both = filled(left, "n_left").join(filled(right, "n_right"), "field", "full")
    side = F.when(F.col("n_right").isNull(), "left").when(F.col("n_left").isNull(), "right").otherwise("both")
    return both.select("field", side.alias("side"), "n_left", "n_right")


def code_profile(df: DataFrame) -> DataFrame:
    """Per code: size, median/min/max height, median area, most frequent district and its share.

    The district mode is a two-level count, so no group is gathered; ties go to the lowest name.
    """
    head = df.groupBy("ep").agg(
        F.count(F.lit(1)).alias("n"),
        F.percentile("height", 0.5).alias("h_med"),
        F.min("height").alias("h_min"),
        F.max("height").alias("h_max"),
    )
    area = exact_quantiles(df.where(F.col("ep").isNotNull()), F.col("area_m2"), [0.5], ["ep"])
    area = area.select("ep", F.col("value").alias("area_med"))
    per = df.groupBy("ep", "district").agg(F.count(F.lit(1)).alias("_c"))
    top = per.groupBy("ep").agg(F.min_by(F.struct("district", "_c"), F.struct(-F.col("_c"), F.col("district"))).alias("_t"))
    j = head.join(area, "ep").join(top, "ep")
    share = half_even(F.col("_t._c").cast("double") / F.col("n"), 2)
    return j.select("ep", "n", "h_med", "h_min", "h_max", "area_med", F.col("_t.district").alias("top_district"), share.alias("top_share"))


def missing_codes(df: DataFrame, column: str) -> DataFrame:
    """Integers between the lowest and highest observed code that never occur."""
    seen = df.select(F.col(column).alias("code")).distinct()
    span = seen.agg(F.explode(F.sequence(F.min("code"), F.max("code"))).alias("code"))
    return span.join(seen, "code", "left_anti")


def code_counts(df: DataFrame, column: str, top: int = 30) -> DataFrame:
    """Distinct, null, zero and negative counts on every row of the ``top`` most frequent codes."""
    c = F.col(column)
    counts = df.groupBy(c.alias("code")).agg(F.count(F.lit(1)).alias("n"))
    facts = counts.agg(
        F.count("code").alias("n_distinct"),
        F.sum(F.when(F.col("code").isNull(), F.col("n")).otherwise(0)).alias("n_null"),
        F.sum(F.when(F.col("code") == 0, F.col("n")).otherwise(0)).alias("n_zero"),
        F.sum(F.when(F.col("code") < 0, F.col("n")).otherwise(0)).alias("n_negative"),
    )
    best = counts.orderBy(F.col("n").desc(), "code").limit(top)
    return best.crossJoin(F.broadcast(facts))
