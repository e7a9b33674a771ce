"""Exact quantiles over unbounded groups, without sorting or holding a group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from cityloom.session import cut_lineage

ACCURACY = 10_000
#: rows that a bracket may hold; more are narrowed down first
FIT = 1_000_000
_PARTS = 256


def _narrowed(data: DataFrame, brackets: DataFrame, by: list[str], fit: int) -> DataFrame:
    """Brackets ``*by, q, n, lo, hi`` narrowed until each holds at most ``fit`` rows, or a single value.

    A round counts what lies below and inside each wide bracket and takes the two marks around the wanted ranks of a sketch
    of its inside, so it keeps about a hundredth of the rows.
    """
    held, room = brackets, brackets.agg(F.max(6 * F.col("n") / ACCURACY)).first()[0] or 0
    marks = [float(k) / _PARTS for k in range(_PARTS + 1)]
    done = None
    while room > fit:
        met = data.join(F.broadcast(held), by) if by else data.crossJoin(F.broadcast(held))
        inner = F.when((F.col("_v") >= F.col("lo")) & (F.col("_v") <= F.col("hi")), F.col("_v"))
        found = met.groupBy(*by, "q", "n", "lo", "hi").agg(
            F.count_if(F.col("_v") < F.col("lo")).alias("_below"), F.count(inner).alias("_in"), F.percentile_approx(inner, marks, ACCURACY).alias("_m")
        )
        rank = F.col("q") * (F.col("n") - 1) - F.col("_below")
        part = lambda r: r / F.greatest(F.col("_in"), F.lit(1)) * _PARTS
        # a mark and two ranks to spare on either side
        left, right = (F.floor(part(rank - 2)) - 1).cast("int"), (F.ceil(part(rank + 2)) + 1).cast("int")
        lo = F.when(left <= 0, F.col("lo")).otherwise(F.get("_m", F.greatest(left, F.lit(0))))
        hi = F.when(right >= _PARTS, F.col("hi")).otherwise(F.get("_m", F.least(right, F.lit(_PARTS))))
        stays = (F.col("_in") <= fit) | (F.col("lo") == F.col("hi")) | ((lo == F.col("lo")) & (hi == F.col("hi")))
        found = cut_lineage(found.select(*by, "q", "n", F.when(stays, F.col("lo")).otherwise(lo).alias("lo"), F.when(stays, F.col("hi")).otherwise(hi).alias("hi"), stays.alias("_stays"), "_in"))
        ready = found.where("_stays").select(*by, "q", "n", "lo", "hi")
        done = ready if done is None else done.unionByName(ready)
        held = found.where(~F.col("_stays")).select(*by, "q", "n", "lo", "hi")
        room = 0 if held.isEmpty() else fit + 1
    return held if done is None else done.unionByName(held)


def exact_quantiles(df: DataFrame, value: Column, qs: list[float], by: list[str] | None = None, fit: int = FIT) -> DataFrame:
    """Linear-interpolation quantiles per group: ``*by, q, value``. Null and NaN are left out.

    A first pass brackets each quantile with a rank-bounded sketch (a few in ten thousand of the rows); brackets of more
    than ``fit`` rows are narrowed by further passes. The last pass counts what lies below and keeps value counts only inside
    the brackets, where the ranks are exact. ``by`` must be a report dimension with few, non-null groups, since brackets are
    broadcast.
    """
    by = by or []
    slack = 2.0 / ACCURACY
    data = df.select(*by, value.cast("double").alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    marks = [min(max(q + s, 0.0), 1.0) for q in qs for s in (-slack, slack)]
    sketch = data.groupBy(*by).agg(
        F.count(F.lit(1)).alias("_n"),
        F.percentile_approx("_v", [float(m) for m in marks], ACCURACY).alias("_m"),
        F.min("_v").alias("_min"),
        F.max("_v").alias("_max"),
    )

    def bracket(i: int, q: float) -> Column:
        # a bracket one rank too narrow would lose the quantile, so small groups keep all their values
        small = F.col("_n") <= 2 * ACCURACY
        lo = F.col("_min") if q - slack <= 0 else F.when(small, F.col("_min")).otherwise(F.col("_m")[2 * i])
        hi = F.col("_max") if q + slack >= 1 else F.when(small, F.col("_max")).otherwise(F.col("_m")[2 * i + 1])
        return F.struct(F.lit(float(q)).alias("q"), F.col("_n").alias("n"), lo.alias("lo"), hi.alias("hi"))

    each = cut_lineage(sketch.select(*by, F.inline(F.array(*[bracket(i, q) for i, q in enumerate(qs)]))))
    each = _narrowed(data, each, by, fit)
    brackets = each.groupBy(*by).agg(F.collect_list(F.struct("q", "n", "lo", "hi")).alias("_br"))
    joined = data.join(F.broadcast(brackets), by) if by else data.crossJoin(F.broadcast(brackets))
    marked = joined.withColumn("_b", F.explode(F.filter("_br", lambda b: F.col("_v") <= b.hi)))
    inside = F.when(F.col("_v") >= F.col("_b.lo"), F.col("_v"))
    counts = marked.groupBy(*by, F.col("_b.q").alias("q"), F.col("_b.n").alias("_n"), inside.alias("_in")).agg(
        F.count(F.lit(1)).alias("_c")
    )
    w = Window.partitionBy(*by, "q").orderBy(F.col("_in").asc_nulls_first())
    ranked = counts.withColumn("_cum", F.sum("_c").over(w))
    pos = F.col("q") * (F.col("_n") - 1)
    picks = {}
    for name, r in (("_v0", F.floor(pos)), ("_v1", F.ceil(pos))):
        picks[name] = F.max(F.when((F.col("_cum") > r) & (F.col("_cum") - F.col("_c") <= r), F.col("_in")))
    out = ranked.groupBy(*by, "q", "_n").agg(*[c.alias(n) for n, c in picks.items()])
    frac = pos - F.floor(pos)
    value = F.col("_v0") + (F.col("_v1") - F.col("_v0")) * frac
    missed = F.raise_error(F.concat(F.lit("bracket misses the rank of quantile "), F.col("q").cast("string"))).cast("double")
    return out.select(*by, "q", F.when((F.col("_n") > 0) & value.isNull(), missed).otherwise(value).alias("value"))


def quantile_columns(df: DataFrame, value: Column, named: dict[str, float], by: list[str] | None = None) -> DataFrame:
    """:func:`exact_quantiles` with one column per quantile."""
    by = by or []
    long = exact_quantiles(df, value, list(named.values()), by)
    return long.groupBy(*by).agg(*[F.max(F.when(F.col("q") == q, F.col("value"))).alias(n) for n, q in named.items()])
