"""Joins and group totals that stay balanced when one key holds a large share of all rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import MapType

from cityloom.session import cut_lineage


#: keys above one in so many rows of a side are split; at most that many keys of a side can be
SHARES = 256
#: a split of fewer rows is not worth a task of its own
MIN_ROWS = 50_000


def hot_keys(big: DataFrame, small: DataFrame | None, keys: list[str], min_rows: int = MIN_ROWS) -> DataFrame:
    """Keys that hold more than their share of a side's rows, with the splits each side needs: ``*keys, _fb, _fs``.

    Both sides are counted in one aggregate over their keys; ``small`` may be left out.
    """
    rows = big.select(*keys, F.lit(1).alias("_b"), F.lit(0).alias("_s"))
    if small is not None:
        rows = rows.unionByName(small.select(*keys, F.lit(0).alias("_b"), F.lit(1).alias("_s")))
    counts = rows.groupBy(*keys).agg(F.sum("_b").alias("_b"), F.sum("_s").alias("_s"))
    totals = counts.agg(*[F.greatest(F.sum(c) / F.lit(float(SHARES)), F.lit(float(min_rows))).alias(f"{c}_most") for c in ("_b", "_s")])
    over = counts.crossJoin(F.broadcast(totals)).where((F.col("_b") > F.col("_b_most")) | (F.col("_s") > F.col("_s_most")))
    parts = [F.greatest(F.ceil(F.col(c) / F.col(f"{c}_most")), F.lit(1)).cast("int").alias(n) for c, n in (("_b", "_fb"), ("_s", "_fs"))]
    return over.select(*keys, *parts)


def balanced_join(big: DataFrame, small: DataFrame, keys: list[str], how: str = "inner", min_rows: int = MIN_ROWS) -> DataFrame:
    """Equi-join whose hot keys are spread over several tasks, whichever side they are on.

    Keys are counted, so inputs of any size behave alike, on any session. A key that is hot in ``big`` splits its rows of
    ``big`` by their other columns and repeats the matching rows of ``small`` once per split. In an inner join a key that is
    hot in ``small`` splits ``small`` and repeats ``big``; in a left, left_semi or left_anti join only ``big`` can be split.
    Rows alike in all columns stay together.
    """
    # counted ahead, so that plans of nested joins do not double; 2 * SHARES rows at most
    rows = hot_keys(big, small if how == "inner" else None, keys, min_rows).collect()
    if not rows:
        return big.join(small, keys, how)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in big.select(*keys).schema) + ", _fb int, _fs int"
    hot = F.broadcast(big.sparkSession.createDataFrame([tuple(r) for r in rows], schema))

    def salted(side: DataFrame, own: str, other: str) -> DataFrame:
        rest = [c for c in side.columns if c not in keys and not isinstance(side.schema[c].dataType, MapType)]
        out = side.join(hot, keys, "left").withColumns({c: F.coalesce(F.col(c), F.lit(1)) for c in ("_fb", "_fs")})
        place = F.when(F.col(own) > 1, F.pmod(F.xxhash64(*[F.col(c) for c in rest]), F.col(own))).otherwise(0).cast("int") if rest else F.lit(0)
        out = out.withColumn(f"_n{own}", place)
        return out.withColumn(f"_n{other}", F.explode(F.sequence(F.lit(0), F.col(other) - 1))).drop("_fb", "_fs")

    left, right = salted(big, "_fb", "_fs"), salted(small, "_fs", "_fb")
    return left.join(right, [*keys, "_n_fb", "_n_fs"], how).drop("_n_fb", "_n_fs")


def with_group_stats(df: DataFrame, key: str, stats: dict[str, Column]) -> DataFrame:
    """Attach per-group aggregates to every row without holding a group in one task.

    Rows with a null key get null statistics.
    """
    df = cut_lineage(df)  # read three times: totals, keys, join
    totals = df.where(F.col(key).isNotNull()).groupBy(key).agg(*[c.alias(n) for n, c in stats.items()])
    known = balanced_join(df.where(F.col(key).isNotNull()), totals, [key])
    missing = df.where(F.col(key).isNull())
    for name in stats:
        missing = missing.withColumn(name, F.lit(None).cast(known.schema[name].dataType))
    return known.select(*df.columns, *stats).unionByName(missing)


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Lowest row per key by ``order``; a map-side combined ``min``, so a hot key costs one row per task."""
    rest = [c for c in df.columns if c not in keys]
    ranked = F.struct(*[o.alias(f"_o{i}") for i, o in enumerate(order)])
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), ranked).alias("_r"))
    return picked.select(*keys, "_r.*").select(*df.columns)


def union_all(frames: list[DataFrame]) -> DataFrame:
    """Union by name; a column missing on one side becomes null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
