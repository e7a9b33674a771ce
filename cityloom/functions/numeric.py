"""Rounding, bucketing and hash-draw helpers that stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def half_even(x: Column, digits: int = 0) -> Column:
    """Round half to even on the scaled double (not Spark's half-up ``round``)."""
    if digits == 0:
        return F.rint(x)
    scale = float(10**digits)
    return F.rint(x * F.lit(scale)) / F.lit(scale)


def safe_ratio(num: Column, den: Column, default: float | None = None) -> Column:
    """``num / den`` as double; ``default`` (or null) where the denominator is zero or null."""
    r = F.try_divide(num.cast("double"), den.cast("double"))
    return r if default is None else F.coalesce(r, F.lit(float(default)))


def draw_order(seed: int, *keys: Column) -> Column:
    """Seeded random order: the same rows come first on any partitioning."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in keys]))


_P = 2147483647


def hash_uniform(seed: int, a: Column, b: Column) -> Column:
    """Uniform draw in [0, 1) from two integer keys, integer arithmetic modulo a Mersenne prime."""
    p = F.lit(_P).cast("bigint")
    a = a.cast("bigint") % p
    b = b.cast("bigint") % p
    h = (a * F.lit(48271) + b * F.lit(69621) + F.lit(seed).cast("bigint")) % p
    h = (h * h + b * F.lit(16807) + a * F.lit(11)) % p
    h = (h * h + a * F.lit(40692) + F.lit(7)) % p
    return h.cast("double") / F.lit(float(_P))


def closed_bin(x: Column, edges: list[float], right_closed: bool = False, last_closed: bool = True) -> Column:
    """0-based bin of ``x`` against an explicit edge list, null outside."""
    out = F.lit(None).cast("int")
    n = len(edges) - 1
    for i in reversed(range(n)):
        lo, hi = F.lit(float(edges[i])), F.lit(float(edges[i + 1]))
        if right_closed:
            inside = (x > lo) & (x <= hi)
        elif i == n - 1 and last_closed:
            inside = (x >= lo) & (x <= hi)
        else:
            inside = (x >= lo) & (x < hi)
        out = F.when(inside, F.lit(i)).otherwise(out)
    return out
