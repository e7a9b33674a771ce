"""Monthly energy use: meter parsing, run matrix, simulated against measured, city totals, embodied carbon."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window, functions as F

from cityloom import rules
from cityloom.functions.numeric import half_even, hash_uniform
from cityloom.operators.quantiles import quantile_columns
from cityloom.sources.tables import lookup


def meter_kinds(columns: list[str]) -> dict[str, tuple[str, bool]]:
    """End use of each meter column and whether it is a zone variable; other columns are left out."""
    found = {}
    for name in columns:
        for use, words, zone in [(u, w, False) for u, w in rules.METERS.items()] + [(u, [w], True) for u, w in rules.ZONE_VARIABLES.items()]:
            if name not in found and re.search("|".join(map(re.escape, words)), name, re.IGNORECASE):
                found[name] = use, zone
    return found


def parse_monthly(wide: DataFrame, runs: DataFrame) -> DataFrame:
    """Monthly kWh/m2 per end use from wide meter columns in joules.

    ``wide``: ``run, month`` and meter columns; ``runs``: ``run, area_m2, cop_cooling, cop_heating``. The columns are turned
    into rows of (run, month, use, joules) and summed. A run whose heating or cooling meter is all zero uses the zone
    variable instead; a run without exactly twelve months stops the job.
    """
    kinds = meter_kinds([c for c in wide.columns if c not in ("run", "month")])
    names = [F.struct(F.lit(use).alias("use"), F.lit(zone).alias("zone"), F.col(f"`{c}`").cast("double").alias("joules")) for c, (use, zone) in kinds.items()]
    none = F.lit(None).cast("array<struct<use: string, zone: boolean, joules: double>>")
    long = wide.select("run", "month", F.inline_outer(F.array(*names) if names else none))
    sums = {(u, z): F.coalesce(F.sum(F.when((F.col("use") == u) & (F.col("zone") == z), F.col("joules"))), F.lit(0.0)) for u in rules.METERS for z in (False, True)}
    d = long.groupBy("run", "month").agg(*[c.alias(f"{u}_{z}") for (u, z), c in sums.items()])
    year = Window.partitionBy("run")
    gate = F.when(F.count(F.lit(1)).over(year) != 12, F.raise_error(F.concat(F.lit("not 12 months: "), F.col("run").cast("string"))).cast("double"))
    joules = {u: F.coalesce(gate, F.when(F.sum(f"{u}_False").over(year) == 0, F.col(f"{u}_True")).otherwise(F.col(f"{u}_False"))) for u in rules.METERS}
    d = d.select("run", "month", *[c.alias(u) for u, c in joules.items()]).join(runs.select("run", "area_m2", "cop_cooling", "cop_heating"), "run")
    per = {"cooling": F.col("cop_cooling"), "heating": F.col("cop_heating")}
    eui = {u: F.col(u) / rules.J_PER_KWH / per.get(u, F.lit(1.0)) / F.col("area_m2") for u in ("cooling", "heating", "lighting", "equipment")}
    total = eui["cooling"] + eui["heating"] + eui["lighting"] + eui["equipment"]
    cols = [half_even(c, 3).alias(f"{u}_kwh_m2") for u, c in {**eui, "total": total}.items()]
    return d.select("run", "month", *cols)


def run_matrix(labels: DataFrame, column: str) -> DataFrame:
    """Label x height-bin cells without the excluded ones, with floors and conditioned area."""
    spark = labels.sparkSession
    bins = lookup(spark, ["height_bin", "n_floors"], list(rules.HEIGHT_BINS.items()))
    out = lookup(spark, [column, "height_bin"], rules.MATRIX_EXCLUDED)
    cells = labels.select(column).distinct().crossJoin(F.broadcast(bins)).join(F.broadcast(out), [column, "height_bin"], "left_anti")
    x, y = rules.SHOEBOX_SIDE_M
    return cells.withColumns(
        {
            "area_m2": F.lit(x * y) * F.col("n_floors"),
            "cop_cooling": F.lit(rules.COP_COOLING),
            "cop_heating": F.lit(rules.COP_HEATING),
        }
    )


def nmbe(sim: Column, obs: Column) -> Column:
    """Normalised mean bias error in percent as an aggregate; a zero observed total stops the job."""
    total = F.sum(obs)
    bad = F.when((total == 0) | total.isNull(), F.raise_error(F.lit("observed mean is zero or empty")).cast("double"))
    return F.coalesce(bad, F.lit(100.0) * (F.sum(sim) - total) / total)


def monthly_comparison(sim: DataFrame, obs: DataFrame) -> DataFrame:
    """Month rows with difference and ratio plus an annual row (month 0) with the NMBE, per label.

    ``sim``: ``archetype, month, sim``; ``obs``: ``archetype, month, obs``. Pairs by key; a label without
    twelve observed months stops the job.
    """
    j = obs.join(sim, ["archetype", "month"], "left")
    m = j.select(
        "archetype",
        "month",
        F.col("sim").alias("sim_kwh_m2"),
        F.col("obs").alias("obs_kwh_m2"),
        half_even(F.col("sim") - F.col("obs"), 3).alias("diff_kwh_m2"),
        half_even(F.col("sim") / F.col("obs"), 3).alias("ratio"),
        F.lit(None).cast("double").alias("nmbe_pct"),
    )
    n = F.count("sim")
    gate = F.when(n != 12, F.raise_error(F.concat(F.lit("not 12 months: "), F.first("archetype"))).cast("double"))
    # decimal sums do not depend on the order rows arrive in
    s, o = (F.sum(F.col(c).cast("decimal(24,6)")).cast("double") for c in ("sim", "obs"))
    year = j.groupBy("archetype").agg(
        F.lit(0).alias("month"),
        F.coalesce(gate, half_even(s, 2)).alias("sim_kwh_m2"),
        half_even(o, 2).alias("obs_kwh_m2"),
        half_even(s - o, 2).alias("diff_kwh_m2"),
        half_even(s / o, 3).alias("ratio"),
        half_even(nmbe(F.col("sim"), F.col("obs")), 1).alias("nmbe_pct"),
    )
    return m.unionByName(year)


def calibration_trace(iterations: DataFrame, obs: DataFrame) -> DataFrame:
    """NMBE per label and parameter iteration. ``iterations``: ``archetype, iteration, params, month, sim``."""
    j = iterations.join(obs, ["archetype", "month"])
    return j.groupBy("archetype", "iteration", "params").agg(half_even(nmbe(F.col("sim"), F.col("obs")), 2).alias("nmbe_pct"))


def shape_agreement(sim: DataFrame, obs: DataFrame) -> DataFrame:
    """Correlation of the monthly profiles and the peak month of each side (first month on ties)."""
    j = obs.join(sim, ["archetype", "month"])
    return j.groupBy("archetype").agg(
        F.corr("sim", "obs").alias("shape_r"),
        F.min_by("month", F.struct(-F.col("sim"), F.col("month"))).alias("sim_peak_month"),
        F.min_by("month", F.struct(-F.col("obs"), F.col("month"))).alias("obs_peak_month"),
    )


def calibration_verdict(comparison: DataFrame, residential: list[str]) -> DataFrame:
    """Pass or fail per label: 10 percent for public, 20 percent for residential labels."""
    year = comparison.where(F.col("month") == 0)
    limit = F.when(F.col("archetype").isin(residential), F.lit(rules.RESIDENTIAL_NMBE_LIMIT)).otherwise(F.lit(rules.PUBLIC_NMBE_LIMIT))
    return year.select("archetype", "nmbe_pct", limit.alias("limit_pct"), (F.abs("nmbe_pct") <= limit).alias("passed"))


def residential_check(annual: DataFrame, bounds: tuple[float, float] = rules.RESIDENTIAL_EUI_BOUNDS) -> DataFrame:
    """Annual use against the lower and upper benchmark. ``annual``: ``archetype, annual_kwh_m2``."""
    v = F.col("annual_kwh_m2")
    state = F.when(v < bounds[0], "below").when(v > bounds[1], "above").otherwise("within")
    return annual.select("archetype", "annual_kwh_m2", state.alias("position"))


def annual_pivot(monthly: DataFrame) -> DataFrame:
    """Annual sum per label, one column per height bin. ``monthly``: ``archetype, height_bin, total``."""
    bins = list(rules.HEIGHT_BINS)
    p = monthly.groupBy("archetype").pivot("height_bin", bins).agg(F.sum("total"))
    return p.select("archetype", *[half_even(F.col(b), 1).alias(b) for b in bins])


def run_summary(runs: DataFrame) -> DataFrame:
    """Finished, failed and cached runs; mean and longest seconds of fresh ones. ``ok, cached, seconds``."""
    fresh = F.col("ok") & ~F.col("cached")
    return runs.agg(
        F.count_if("ok").alias("n_ok"),
        F.count_if(~F.col("ok")).alias("n_failed"),
        F.count_if(F.col("ok") & F.col("cached")).alias("n_cached"),
        F.avg(F.when(fresh, F.col("seconds"))).alias("mean_seconds"),
        F.max(F.when(fresh, F.col("seconds"))).alias("max_seconds"),
    )


def height_bin(floors: Column, height: Column) -> Column:
    """low up to 3 floors, multi up to 24 m, high up to 100 m, supertall above."""
    return (
        F.when(floors <= 3, F.lit("low"))
        .when(height <= 24, F.lit("multi"))
        .when(height <= 100, F.lit("high"))
        .when(height > 100, F.lit("supertall"))
        .otherwise(F.lit("unknown"))
    )


def city_energy(buildings: DataFrame, eui: DataFrame) -> DataFrame:
    """City kWh per label, bin and month. Floor area is summed per (label, bin) first, so the energy table is
    joined to a few dozen totals instead of every building. Labels without energy figures stay as one row per bin with null
    month and kWh; buildings without floors or area are counted in ``n`` and add no floor area."""
    b = buildings.withColumn("height_bin", height_bin(F.col("floors"), F.col("height")))
    gfa = b.groupBy("archetype", "height_bin").agg(F.coalesce(F.sum(F.col("area_m2") * F.col("floors")), F.lit(0.0)).alias("gfa_m2"), F.count(F.lit(1)).alias("n"))
    j = gfa.join(eui, ["archetype", "height_bin"], "left")
    return j.select("archetype", "height_bin", "month", "n", "gfa_m2", (F.col("gfa_m2") * F.col("eui_kwh_m2")).alias("kwh"))


# --- embodied carbon --------------------------------------------------------------------------------------


def normalised_factors(epd: DataFrame, excluded: list[str]) -> DataFrame:
    """Emission factor per kg: per m3 over density, per m2 over mass per m2, per kg as is; excluded products dropped."""
    per_kg = (
        F.when(F.col("unit") == "m3", F.col("gwp") / F.col("density"))
        .when(F.col("unit") == "m2", F.col("gwp") / F.col("mass_m2"))
        .when(F.col("unit") == "kg", F.col("gwp"))
    )
    drop = lookup(epd.sparkSession, ["category"], [(c,) for c in excluded])
    return epd.join(F.broadcast(drop), "category", "left_anti").withColumn("gwp_per_kg", per_kg)


def end_of_life_stage(product: Column, category: Column) -> Column:
    """Stage whose end-of-life factor a product carries, by the first material word in its name, else in its category."""

    def of(text: Column) -> Column:
        low = F.lower(text)
        return F.coalesce(*[F.when(low.contains(word), F.lit(stage)) for word, stage in rules.EOL_STAGE])

    return F.coalesce(of(product), of(category))


def factor_stats(factors: DataFrame) -> DataFrame:
    s = factors.groupBy("category").agg(
        F.count(F.lit(1)).alias("n"), F.avg("gwp_per_kg").alias("mean"), F.min("gwp_per_kg").alias("low"), F.max("gwp_per_kg").alias("high")
    )
    med = quantile_columns(factors, F.col("gwp_per_kg"), {"median": 0.5}, ["category"])
    return s.join(med, "category")


def embodied_samples(stats: DataFrame, intensity: DataFrame, stages: dict[str, float], n_draws: int, seed: int) -> DataFrame:
    """``archetype, category, stage, draw, v``: embodied carbon per m2 of every draw, material and life-cycle stage.

    ``stats``: ``category, low, median, high`` (triangular factor per kg); ``intensity``: ``archetype, category, category_no,
    kg_m2``; ``stages`` scales the factor per stage. A draw is an integer hash of (draw, material and stage), so all labels
    share it and no random state is kept.
    """
    frame = lookup(stats.sparkSession, ["stage", "stage_no", "share"], [(s, k, float(v)) for k, (s, v) in enumerate(stages.items())])
    parts = intensity.join(stats.select("category", "low", "median", "high"), "category").crossJoin(F.broadcast(frame))
    d = parts.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(n_draws))))
    u = hash_uniform(seed, F.col("draw"), F.col("category_no") * 16 + F.col("stage_no"))
    lo, mid, hi = F.col("low"), F.col("median"), F.col("high")
    split = F.when(hi > lo, (mid - lo) / (hi - lo)).otherwise(F.lit(0.0))
    value = F.when(u < split, lo + F.sqrt(u * (hi - lo) * (mid - lo))).otherwise(hi - F.sqrt((1 - u) * (hi - lo) * (hi - mid)))
    return d.select("archetype", "category", "stage", "draw", (value * F.col("kg_m2") * F.col("share")).alias("v"))


def embodied_spread(samples: DataFrame, by: list[str]) -> DataFrame:
    """Mean, median, P5 and P95 per ``by`` of the draws, whose other parts are added up first."""
    per = samples.groupBy(*by, "draw").agg(F.sum("v").alias("v"))
    return per.groupBy(*by).agg(F.avg("v").alias("mean"), F.percentile("v", [0.05, 0.5, 0.95]).alias("_q")).select(
        *by, "mean", F.col("_q")[1].alias("median"), F.col("_q")[0].alias("p05"), F.col("_q")[2].alias("p95")
    )
