"""Energy, calibration, embodied carbon and run reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from cityloom import rules
from cityloom.operators import energy as E
from cityloom.plans.inputs import master
from cityloom.plans.registry import register
from cityloom.sources.tables import lookup
from cityloom.sources.views import Inputs

# Run area 1,000 m2; runs with return flag R report cooling only through the zone variable.
MONTHLY = {
    "mon": """
SELECT archetype, month, round_even(cool_j/3600000/3.5::DOUBLE/1000, 3) AS cooling_kwh_m2, round_even(heat_j/3600000/2.5::DOUBLE/1000, 3) AS heating_kwh_m2,
 round_even(lights_j/3600000/1000, 3) AS lighting_kwh_m2, round_even(equip_j/3600000/1000, 3) AS equipment_kwh_m2,
 round_even(cool_j/3600000/3.5::DOUBLE/1000 + heat_j/3600000/2.5::DOUBLE/1000 + lights_j/3600000/1000 + equip_j/3600000/1000, 3) AS total_kwh_m2 FROM sim""",
    "cmp": """
SELECT o.archetype, o.month, m.total_kwh_m2 AS sim, o.eui/100 AS obs FROM obs o JOIN mon m USING (archetype, month)""",
    "yr": """
SELECT archetype, sum(CAST(sim AS DECIMAL(24,6)))::DOUBLE AS s, sum(CAST(obs AS DECIMAL(24,6)))::DOUBLE AS o, 100*(sum(sim)-sum(obs))/sum(obs) AS nmbe FROM cmp GROUP BY 1""",
}


def monthly(i: Inputs):
    s = i.view("sim")
    zone = F.col("archetype").startswith("R")
    wide = s.select(
        F.col("archetype").alias("run"),
        "month",
        F.col("lights_j").alias("InteriorLights:Electricity [J](Monthly)"),
        F.col("equip_j").alias("InteriorEquipment:Electricity [J](Monthly)"),
        F.when(zone, 0.0).otherwise(F.col("cool_j")).alias("DistrictCooling:Facility [J](Monthly)"),
        F.col("cool_j").alias("Z1:Zone Ideal Loads Supply Air Total Cooling Energy [J](Monthly)"),
        F.col("heat_j").alias("DistrictHeatingWater:Facility [J](Monthly)"),
    )
    runs = s.select(F.col("archetype").alias("run")).distinct().select(
        "run", F.lit(1000.0).alias("area_m2"), F.lit(rules.COP_COOLING).alias("cop_cooling"), F.lit(rules.COP_HEATING).alias("cop_heating")
    )
    return E.parse_monthly(wide, runs).withColumnRenamed("run", "archetype")


def sim(i: Inputs):
    return monthly(i).select("archetype", "month", F.col("total_kwh_m2").alias("sim"))


def obs(i: Inputs):
    return i.view("obs").select("archetype", "month", (F.col("eui") / 100).alias("obs"))


@register("c1_monthly_parse", "SELECT * FROM mon", MONTHLY)
def c1_monthly_parse(i: Inputs):
    return monthly(i)


CMP_SQL = """
SELECT archetype, month, sim AS sim_kwh_m2, obs AS obs_kwh_m2, round_even(sim - obs, 3) AS diff_kwh_m2, round_even(sim/obs, 3) AS ratio, NULL::DOUBLE AS nmbe_pct FROM cmp
UNION ALL SELECT archetype, 0, round_even(s, 2), round_even(o, 2), round_even(s - o, 2), round_even(s/o, 3), round_even(nmbe, 1) FROM yr"""


@register("c3_monthly_comparison", CMP_SQL, MONTHLY)
def c3_monthly_comparison(i: Inputs):
    return E.monthly_comparison(sim(i), obs(i))


@register("u5_annual_row", "SELECT archetype, 0 AS month, round_even(s, 2) AS sim_kwh_m2, round_even(nmbe, 1) AS nmbe_pct FROM yr UNION ALL SELECT archetype, month, sim, NULL FROM cmp", MONTHLY)
def u5_annual_row(i: Inputs):
    return E.monthly_comparison(sim(i), obs(i)).select("archetype", "month", "sim_kwh_m2", "nmbe_pct")


@register("r6_nmbe", "SELECT archetype, round(nmbe, 6) AS nmbe_pct FROM yr", MONTHLY)
def r6_nmbe(i: Inputs):
    j = sim(i).join(obs(i), ["archetype", "month"])
    return j.groupBy("archetype").agg(F.round(E.nmbe(F.col("sim"), F.col("obs")), 6).alias("nmbe_pct"))


@register(
    "r7_shape_agreement",
    """SELECT archetype, round(corr(sim, obs), 6) AS shape_r, arg_min(month, (-sim, month)) AS sim_peak_month, arg_min(month, (-obs, month)) AS obs_peak_month FROM cmp GROUP BY 1""",
    MONTHLY,
)
def r7_shape_agreement(i: Inputs):
    return E.shape_agreement(sim(i), obs(i)).withColumn("shape_r", F.round("shape_r", 6))


@register(
    "c4_calibration_trace",
    """SELECT archetype, k AS iteration, 'scale=' || k AS params, round_even(100*(sum(sim*(10+k)/10) - sum(obs))/sum(obs), 2) AS nmbe_pct
FROM cmp CROSS JOIN (SELECT unnest([0,1,2,3]) AS k) GROUP BY 1, 2, 3""",
    MONTHLY,
)
def c4_calibration_trace(i: Inputs):
    it = sim(i).withColumn("iteration", F.explode(F.array(*[F.lit(k) for k in range(4)])))
    it = it.withColumn("params", F.concat(F.lit("scale="), F.col("iteration").cast("string"))).withColumn("sim", F.col("sim") * (10 + F.col("iteration")) / 10)
    return E.calibration_trace(it, obs(i))


@register(
    "d1_calibration_verdict",
    """SELECT archetype, round_even(nmbe, 1) AS nmbe_pct, CASE WHEN archetype LIKE 'R%' THEN 20 ELSE 10 END::DOUBLE AS limit_pct,
 abs(round_even(nmbe, 1)) <= CASE WHEN archetype LIKE 'R%' THEN 20 ELSE 10 END AS passed FROM yr""",
    MONTHLY,
)
def d1_calibration_verdict(i: Inputs):
    return E.calibration_verdict(E.monthly_comparison(sim(i), obs(i)), ["RF", "RO"])


@register(
    "d2_residential_check",
    """SELECT archetype, round(s, 6) AS annual_kwh_m2, CASE WHEN s < 31.5 THEN 'below' WHEN s > 48.8 THEN 'above' ELSE 'within' END AS position FROM yr""",
    MONTHLY,
)
def d2_residential_check(i: Inputs):
    annual = sim(i).groupBy("archetype").agg(F.round(F.sum("sim"), 6).alias("annual_kwh_m2"))
    return E.residential_check(annual)


@register(
    "j19_run_cells",
    """SELECT a.archetype, b.bin AS height_bin FROM (SELECT DISTINCT archetype FROM master) a CROSS JOIN (VALUES ('low'), ('multi'), ('high'), ('supertall')) b(bin)
WHERE NOT (a.archetype = 'residential_mid_rise' AND b.bin IN ('high', 'supertall')) AND NOT (a.archetype = 'residential_high_rise' AND b.bin IN ('low', 'multi'))""",
)
def j19_run_cells(i: Inputs):
    return E.run_matrix(master(i), "archetype").select("archetype", "height_bin")


@register(
    "c2_run_roster",
    """SELECT a.archetype, b.bin AS height_bin, b.n AS n_floors, 100*b.n::DOUBLE AS area_m2, 3.5::DOUBLE AS cop_cooling, 2.5::DOUBLE AS cop_heating
FROM (SELECT DISTINCT archetype FROM master) a CROSS JOIN (VALUES ('low', 2), ('multi', 5), ('high', 15), ('supertall', 35)) b(bin, n)
WHERE NOT (a.archetype = 'residential_mid_rise' AND b.bin IN ('high', 'supertall')) AND NOT (a.archetype = 'residential_high_rise' AND b.bin IN ('low', 'multi'))""",
)
def c2_run_roster(i: Inputs):
    return E.run_matrix(master(i), "archetype")


@register(
    "c5_run_summary",
    """SELECT count(*) FILTER (l_returnflag <> 'R') AS n_ok, count(*) FILTER (l_returnflag = 'R') AS n_failed, count(*) FILTER (l_returnflag = 'A') AS n_cached,
 avg(l_quantity) FILTER (l_returnflag = 'N') AS mean_seconds, max(l_quantity) FILTER (l_returnflag = 'N') AS max_seconds FROM lineitem""",
)
def c5_run_summary(i: Inputs):
    runs = i.table("lineitem").select((F.col("l_returnflag") != "R").alias("ok"), (F.col("l_returnflag") == "A").alias("cached"), F.col("l_quantity").alias("seconds"))
    return E.run_summary(runs)


@register(
    "a31_annual_pivot",
    """SELECT l_returnflag || l_linestatus AS archetype, """
    + ", ".join(f"round_even(sum(l_quantity) FILTER (l_linenumber % 4 = {k}), 1) AS {b}" for k, b in enumerate(rules.HEIGHT_BINS))
    + " FROM lineitem GROUP BY 1",
)
def a31_annual_pivot(i: Inputs):
    names = F.array(*[F.lit(b) for b in rules.HEIGHT_BINS])
    m = i.table("lineitem").select(
        F.concat("l_returnflag", "l_linestatus").alias("archetype"), F.element_at(names, F.col("l_linenumber") % 4 + 1).alias("height_bin"), F.col("l_quantity").alias("total")
    )
    return E.annual_pivot(m)


@register(
    "d7_city_energy",
    """
SELECT g.archetype, g.bin AS height_bin, e.month, g.n, g.gfa_m2, g.gfa_m2*(e.lights_j/3600000/1000000) AS kwh FROM (
  SELECT archetype, CASE WHEN floors <= 3 THEN 'low' WHEN height <= 24 THEN 'multi' WHEN height <= 100 THEN 'high' WHEN height > 100 THEN 'supertall' ELSE 'unknown' END AS bin,
    coalesce(sum(area_m2*floors), 0) AS gfa_m2, count(*) AS n FROM master GROUP BY 1, 2) g
LEFT JOIN (VALUES ('office', 'NO'), ('hotel', 'AF'), ('education', 'RF')) k(archetype, sim_label) ON k.archetype = g.archetype
LEFT JOIN sim e ON e.archetype = k.sim_label""",
)
def d7_city_energy(i: Inputs):
    spark = i.spark
    names = F.broadcast(lookup(spark, ["label", "sim_label"], [("office", "NO"), ("hotel", "AF"), ("education", "RF")]))
    bins = F.explode(F.array(*[F.lit(b) for b in rules.HEIGHT_BINS]))
    s = i.view("sim").select(F.col("archetype").alias("sim_label"), "month", (F.col("lights_j") / 3600000 / 1000000).alias("eui_kwh_m2"))
    eui = s.join(names, "sim_label").select(F.col("label").alias("archetype"), bins.alias("height_bin"), "month", "eui_kwh_m2")
    return E.city_energy(master(i), eui)


EPD = {
    "ef": """SELECT epd_id, category, CASE unit WHEN 'm3' THEN gwp/density WHEN 'm2' THEN gwp/mass_m2 ELSE gwp END AS gwp_per_kg FROM epd
WHERE category <> (SELECT min(category) FROM epd)""",
    "efs": """SELECT category, count(*) AS n, avg(gwp_per_kg) AS mean, min(gwp_per_kg) AS low, max(gwp_per_kg) AS high, quantile_cont(gwp_per_kg, 0.5) AS median FROM ef GROUP BY 1""",
}


def _excluded(i: Inputs):
    return [i.view("epd").agg(F.min("category")).first()[0]]


@register("d4_factor_stats", "SELECT category, n, round(mean, 6) AS mean, round(low, 6) AS low, round(high, 6) AS high, round(median, 6) AS median FROM efs", EPD)
def d4_factor_stats(i: Inputs):
    s = E.factor_stats(E.normalised_factors(i.view("epd"), _excluded(i)))
    return s.select("category", "n", *[F.round(c, 6).alias(c) for c in ("mean", "low", "high", "median")])


@register(
    "d4_normalised_factors",
    """SELECT epd_id, round(gwp_per_kg, 6) AS gwp_per_kg, CASE epd_id % 9 WHEN 0 THEN 'C3-balancing' WHEN 1 THEN 'C3-balancing' WHEN 2 THEN 'C4' WHEN 3 THEN 'C4' WHEN 4 THEN 'C4' WHEN 5 THEN 'C4'
 WHEN 6 THEN 'C3' WHEN 7 THEN 'C3' ELSE CASE WHEN lower(category) LIKE '%steel%' THEN 'C3' END END AS eol_stage FROM ef""",
    EPD,
)
def d4_normalised_factors(i: Inputs):
    """Product names stand in turn for the groups of the end-of-life table; every ninth has none and falls back on its category."""
    names = ["CMU 200 mm", "Medium density concrete block", "AAC panel", "Clay brick", "Reclaimed brick", "Glass pane", "Steel rebar", "Aluminum profile"]
    product = F.get(F.array(*[F.lit(x) for x in names]), (F.col("epd_id") % 9).cast("int"))
    n = E.normalised_factors(i.view("epd"), _excluded(i))
    return n.select("epd_id", F.round("gwp_per_kg", 6).alias("gwp_per_kg"), E.end_of_life_stage(product, F.col("category")).alias("eol_stage"))


# draws per label, material and life-cycle stage
SAMPLES = {
    **EPD,
    "smp": """
SELECT archetype, category, stage, draw, kg*share*CASE WHEN u < sp THEN low + sqrt(u*(high-low)*(median-low)) ELSE high - sqrt((1-u)*(high-low)*(high-median)) END AS v FROM (
  SELECT *, coalesce((median-low)/nullif(high-low, 0), 0) AS sp, CAST((h2*h2 + draw*40692 + 7) % 2147483647 AS DOUBLE)/2147483647 AS u FROM (
   SELECT *, (h1*h1 + no*16807 + draw*11) % 2147483647 AS h2 FROM (
    SELECT *, (draw*48271 + no*69621 + 20260712) % 2147483647 AS h1 FROM (
     SELECT a.archetype, e.*, n.no*16 + s.k AS no, s.stage, s.share, d.draw, (10 + length(e.category) + a.k)::DOUBLE AS kg
     FROM efs e JOIN (SELECT category, row_number() OVER (ORDER BY category) AS no FROM efs) n USING (category)
     CROSS JOIN (VALUES ('office', 1), ('hotel', 2), ('residential', 3)) a(archetype, k)
     CROSS JOIN (VALUES ('A1-A3', 0, 1::DOUBLE), ('A4', 1, 0.1::DOUBLE), ('A5', 2, 0.05::DOUBLE)) s(stage, k, share) CROSS JOIN (SELECT unnest(range(1, 2001)) AS draw) d))))""",
}
_SPREAD = "round(avg(v), 4) AS mean, round(quantile_cont(v, 0.5), 4) AS median, round(quantile_cont(v, 0.05), 4) AS p05, round(quantile_cont(v, 0.95), 4) AS p95"


def _samples(i: Inputs):
    """Material intensities are a parameter of the operator; here a label-dependent figure per category."""
    from pyspark.sql import Window

    stats = E.factor_stats(E.normalised_factors(i.view("epd"), _excluded(i)))
    no = F.row_number().over(Window.orderBy("category"))
    labels = F.broadcast(lookup(i.spark, ["archetype", "k"], [("office", 1), ("hotel", 2), ("residential", 3)]))
    inten = stats.select("category", no.alias("category_no")).crossJoin(labels).select(
        "archetype", "category", "category_no", (F.lit(10.0) + F.length("category") + F.col("k")).alias("kg_m2")
    )
    return E.embodied_samples(stats, inten, {"A1-A3": 1.0, "A4": 0.1, "A5": 0.05}, 2000, rules.MODEL_SEED)


def _rounded(df, by: list[str]):
    return df.select(*by, *[F.round(c, 4).alias(c) for c in ("mean", "median", "p05", "p95")])


@register("d3_embodied_carbon", f"SELECT archetype, {_SPREAD} FROM (SELECT archetype, draw, sum(v) AS v FROM smp GROUP BY 1, 2) GROUP BY 1", SAMPLES)
def d3_embodied_carbon(i: Inputs):
    return _rounded(E.embodied_spread(_samples(i), ["archetype"]), ["archetype"])


@register("d3_embodied_by_stage", f"SELECT archetype, category, stage, {_SPREAD} FROM smp GROUP BY 1, 2, 3", SAMPLES)
def d3_embodied_by_stage(i: Inputs):
    by = ["archetype", "category", "stage"]
    return _rounded(E.embodied_spread(_samples(i), by), by)
