"""Window sampling with growing half-width, seeded draws, stratified labelling lists, bootstrap intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from cityloom import rules
from cityloom.functions.geodesy import wgs84_to_bd09
from cityloom.functions.numeric import draw_order, half_even
from cityloom.functions.resample import replicate_sums
from cityloom.operators.dedup import cluster_sizes, keep_first, same_model_clusters, size_histogram
from cityloom.operators.quantiles import exact_quantiles
from cityloom.operators.skew import union_all
from cityloom.session import cut_lineage
from cityloom.sources.tables import lookup


class NotEnoughCandidates(RuntimeError):
    """A window stays short of its quota at the largest half-width."""


def in_window(x: Column, y: Column, cx: Column, cy: Column, half: Column) -> Column:
    """Axis-aligned box, both ends included."""
    return x.between(cx - half, cx + half) & y.between(cy - half, cy + half)


def in_areas(df: DataFrame, areas: dict[str, tuple[float, float, float, float]] = rules.STUDY_AREAS) -> DataFrame:
    """Rows with ``lon, lat`` inside named areas (west, south, east, north, ends included), a row per ``area`` that holds it."""
    frame = lookup(df.sparkSession, ["area", "_w", "_s", "_e", "_n"], [(k, *map(float, b)) for k, b in areas.items()])
    inside = F.col("lon").between(F.col("_w"), F.col("_e")) & F.col("lat").between(F.col("_s"), F.col("_n"))
    return df.join(F.broadcast(frame), inside).drop("_w", "_s", "_e", "_n")


def draw(df: DataFrame, n: int, seed: int, *keys: str) -> DataFrame:
    """Seeded simple random sample of ``n`` rows (top-n by hash, so no global sort)."""
    return df.orderBy(draw_order(seed, *[F.col(k) for k in keys])).limit(n)


def draw_per_group(df: DataFrame, by: list[str], quota: Column, seed: int, *keys: str) -> DataFrame:
    """Seeded draw of up to ``quota`` rows per group; the rank limit is applied before the shuffle too."""
    w = Window.partitionBy(*by).orderBy(draw_order(seed, *[F.col(k) for k in keys]))
    return df.withColumn("draw_no", F.row_number().over(w)).where(F.col("draw_no") <= quota)


#: steps of a window that are clustered in one go
LOOK_AHEAD = 3


def growing_windows(spark, windows: list[tuple[str, float, float, int, int]], max_half: int) -> DataFrame:
    """``window, cx, cy, quota, step, half``: every half-width each window may get, the last one the first beyond ``max_half``."""
    steps = F.greatest(F.ceil((F.lit(max_half) - F.col("_h")) / rules.HALFWIDTH_STEP_M), F.lit(0))
    frame = lookup(spark, ["window", "cx", "cy", "_h", "quota"], [(k, float(x), float(y), float(h), q) for k, x, y, h, q in windows])
    frame = frame.withColumn("step", F.explode(F.sequence(F.lit(0), steps.cast("int"))))
    return frame.withColumn("half", F.col("_h") + F.col("step") * F.lit(float(rules.HALFWIDTH_STEP_M)))


def sample_windows(
    footprints: DataFrame,
    windows: list[tuple[str, float, float, int, int]],
    seed: int = rules.SAMPLE_SEED,
    max_half: int = rules.MAX_HALFWIDTH_M,
) -> dict[str, DataFrame]:
    """Sample each window: area floor, box, same-model dedup, seeded draw; short windows grow by 300 m.

    ``footprints`` has ``id, x, y, area, height``; a window is (key, centre x, centre y, half-width, quota). The limit is
    tested before growing, so a window may be tried once beyond ``max_half``. Each row is given the smallest step that holds
    it; running counts of these name the first step that can fill the quota. That step and the next ones are clustered
    together, each by itself, and the first with enough rows is taken. Returns ``picked``, ``kept``, ``sizes`` and
    ``tally`` (one row per window).
    """
    spark = footprints.sparkSession
    base = footprints.where(F.col("area") >= rules.MIN_FOOTPRINT_M2)
    steps = growing_windows(spark, windows, max_half)
    last = steps.groupBy("window", "cx", "cy", "_h", "quota").agg(F.max("step").alias("last"), F.max("half").alias("_most"))
    box = in_window(F.col("x"), F.col("y"), F.col("cx"), F.col("cy"), F.col("_most"))
    away = F.greatest(F.abs(F.col("x") - F.col("cx")), F.abs(F.col("y") - F.col("cy"))) - F.col("_h")
    first = F.greatest(F.ceil(away / rules.HALFWIDTH_STEP_M), F.lit(0)).cast("int")
    near = cut_lineage(base.join(F.broadcast(last), box).withColumn("first_step", first))
    new = near.groupBy("window", "quota", "last", F.col("first_step").alias("step")).agg(F.count(F.lit(1)).alias("_n"))
    enough = F.sum("_n").over(Window.partitionBy("window").orderBy("step")) >= F.col("quota")
    able = new.withColumn("_ok", enough).where("_ok").groupBy("window", "last").agg(F.min("step").alias("from"))
    taken, tried = None, {w[0]: 0 for w in windows}
    from_ = {r["window"]: (r["from"], r["last"]) for r in able.collect()}  # a row per window
    while True:
        todo = {k: (lo, hi) for k, (lo, hi) in from_.items() if k in tried and lo <= hi}
        missing = [k for k in tried if k not in todo]
        if missing:
            raise NotEnoughCandidates(f"windows {missing}: too few candidates up to a half-width of {max_half} m")
        frame = F.broadcast(lookup(spark, ["window", "_lo"], [(k, lo) for k, (lo, _) in todo.items()]))
        runs = near.join(frame, "window").withColumn("step", F.explode(F.sequence(F.col("_lo"), F.least(F.col("_lo") + LOOK_AHEAD - 1, F.col("last"))).cast("array<int>")))
        runs = runs.where(F.col("first_step") <= F.col("step")).withColumn("half", F.col("_h") + F.col("step") * F.lit(float(rules.HALFWIDTH_STEP_M)))
        clusters = cut_lineage(same_model_clusters(runs.drop("_lo", "_most", "first_step", "last"), ["window", "step"]))
        kept = keep_first(clusters, by=["window", "step"])
        full = kept.groupBy("window", "step", "quota").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= F.col("quota"))
        full = cut_lineage(full.groupBy("window").agg(F.min("step").alias("step")))
        found = clusters.join(F.broadcast(full), ["window", "step"])
        taken = found if taken is None else taken.unionByName(found)
        for r in full.collect():  # a row per window
            del tried[r["window"]]
        if not tried:
            break
        from_ = {k: (lo + LOOK_AHEAD, hi) for k, (lo, hi) in from_.items()}
    everything = cut_lineage(taken)
    kept = keep_first(everything, by=["window"])
    picked = draw_per_group(kept, ["window"], F.col("quota"), seed, "window", "id")
    sizes = cluster_sizes(everything, ["window"])
    counts = everything.groupBy("window").agg(
        F.count("*").alias("n_clipped"), F.first("half").alias("final_half"), F.first("cx").alias("cx"), F.first("cy").alias("cy"), F.first("_h").alias("initial_half")
    )
    tally = counts.join(kept.groupBy("window").agg(F.count("*").alias("candidates_kept")), "window").select(
        "window",
        "cx",
        "cy",
        "initial_half",
        "final_half",
        "candidates_kept",
        (F.col("n_clipped") - F.col("candidates_kept")).alias("dropped_duplicates"),
        *[(F.col(c) + s * F.col("final_half")).alias(n) for n, c, s in
          (("box_xmin", "cx", -1), ("box_ymin", "cy", -1), ("box_xmax", "cx", 1), ("box_ymax", "cy", 1))],
    )
    return {"picked": picked, "kept": kept, "tally": tally, "sizes": sizes}


def window_ids(picked: DataFrame, order: list[str], quota: int = 40) -> DataFrame:
    """``V001``-style ids: window ordinal times quota plus the row's rank by id; out of range stops the job."""
    spark = picked.sparkSession
    ordinals = lookup(spark, ["window", "window_no"], [(k, n) for n, k in enumerate(order)])
    ranked = picked.withColumn("_r", F.row_number().over(Window.partitionBy("window").orderBy("id")))
    n = F.col("window_no") * quota + F.col("_r")
    bad = (n < 1) | (n > quota * len(order))
    text = F.when(bad, F.raise_error(F.concat(F.lit("id out of range: "), n.cast("string"))).cast("string"))
    j = ranked.join(F.broadcast(ordinals), "window")
    return j.withColumn("val_id", F.coalesce(text, F.format_string("V%03d", n.cast("int")))).drop("_r", "window_no")


def cluster_note(size: Column) -> Column:
    return F.when(size >= 2, F.format_string("同款约 %d 栋(自动识别)", size.cast("int"))).otherwise(F.lit(""))


def sampling_summary(result: dict[str, DataFrame], ids: DataFrame, seed: int, centre: Column | None = None) -> DataFrame:
    """One JSON document per window: centre, half-widths, counts, box, range of ids and cluster-size histogram.

    ``ids``: the picked rows with ``val_id``; ``centre``: longitude and latitude of the centre as a struct of ``cx`` and
    ``cy``.
    """
    hist = size_histogram(result["sizes"], ["window"])
    packed = hist.groupBy("window").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("bucket", "n")))).alias("histogram"))
    spans = ids.groupBy("window").agg(F.array(F.min("val_id"), F.max("val_id")).alias("id_range"))
    tally = result["tally"].withColumn("initial_halfwidth_m", F.col("initial_half"))
    tally = tally.withColumn("centre_wgs84", centre) if centre is not None else tally
    j = tally.drop("initial_half", "cx", "cy").join(spans, "window").join(packed, "window").withColumn("seed", F.lit(seed))
    return j.select("window", F.to_json(F.struct(*[c for c in j.columns])).alias("summary"))


#: rows whose draws one task makes; more rows are more tasks, whatever their bytes
DRAW_ROWS = 8192


def poisson_bootstraps(df: DataFrame, key: str, wanted: dict[str, tuple[Column, Column, Column]], n_boot: int, seed: int) -> DataFrame:
    """Percentile bootstrap intervals of weighted shares: ``name, value, ci95_lo, ci95_hi, n``, one row for each of ``wanted``.

    ``wanted`` gives hit, weight and the rows that count by name; all of them use the same draws. Every row draws its own
    Poisson(1) multiplicity per replicate from a seeded hash of its key, so replicates need no resampling join. Rows are dealt
    out by number, since few bytes of rows are many draws; draws are made in blocks of a batch times some replicates and added
    up in the task, and ``n_boot`` sums a task are all that is shuffled. Rows whose weight is null, and those with a null key,
    are not drawn; a null hit is a miss.
    """
    own = F.xxhash64(key) if dict(df.dtypes)[key] == "string" else F.col(key).cast("bigint")
    cols = []
    for n, (hit, weight, where) in enumerate(wanted.values()):
        w = F.when(where, weight.cast("double"))
        cols += [(w * hit.cast("double")).alias(f"_h{n}"), w.alias(f"_w{n}"), F.coalesce(where, F.lit(False)).alias(f"_in{n}")]
    base = cut_lineage(df.select(own.alias("_k"), *cols))
    drawn = base.where(F.col("_k").isNotNull()).select("_k", *[f"_{c}{n}" for n in range(len(wanted)) for c in "hw"])
    n_sums = 2 * len(wanted)
    spread = drawn.repartition(max(1, -(-base.count() // DRAW_ROWS)))
    sums = spread.mapInArrow(replicate_sums(n_boot, seed, n_sums), ", ".join(["_b bigint", *(f"_s{c} double" for c in range(n_sums))]))
    per = sums.groupBy("_b").agg(*[F.try_divide(F.sum(f"_s{2 * n}"), F.sum(f"_s{2 * n + 1}")).alias(f"_q{n}") for n in range(len(wanted))])
    ci = per.agg(*[F.percentile(f"_q{n}", [0.025, 0.975]).alias(f"_q{n}") for n in range(len(wanted))])
    point = base.agg(*[c for n in range(len(wanted)) for c in (F.try_divide(F.sum(f"_h{n}"), F.sum(f"_w{n}")).alias(f"_v{n}"), F.count_if(F.col(f"_in{n}")).alias(f"_n{n}"))])
    rows = [
        F.struct(F.lit(name).alias("name"), F.col(f"_v{n}").alias("value"), F.col(f"_q{n}")[0].alias("ci95_lo"), F.col(f"_q{n}")[1].alias("ci95_hi"), F.col(f"_n{n}").alias("n"))
        for n, name in enumerate(wanted)
    ]
    return point.crossJoin(ci).select(F.inline(F.array(*rows)))


def poisson_bootstrap(df: DataFrame, key: str, hit: Column, weight: Column, n_boot: int, seed: int) -> DataFrame:
    """:func:`poisson_bootstraps` of one share over all rows: ``value, ci95_lo, ci95_hi, n``."""
    return poisson_bootstraps(df, key, {"": (hit, weight, F.lit(True))}, n_boot, seed).drop("name")


def _quotas(total: int, parts: int) -> list[int]:
    base, extra = divmod(total, parts)
    return [base + (1 if k < extra else 0) for k in range(parts)]


def labelling_list(rows: DataFrame, matched: DataFrame, forced: list, windows: dict[str, Column], seed: int) -> DataFrame:
    """Stratified list of buildings to label: ``bid, stratum``; no building is listed twice.

    ``rows``: ``bid, archetype, bundled_label, area_m2, floors, pred_class, pred_confidence`` and the columns
    the ``windows`` conditions use; ``matched``: ``val_id, bid`` of labelled buildings, which only the forced
    ids may repeat. Strata are filled in order, each without the rows taken before.
    """
    spark = rows.sparkSession
    matched = cut_lineage(matched.select("val_id", "bid"))  # each stratum reads it
    q = rules.LIST_QUOTAS
    conf = F.col("pred_confidence")
    chosen = matched.where(F.col("val_id").isin(forced)).select("bid", F.concat(F.lit("reassess_"), F.col("val_id").cast("string")).alias("stratum"))
    chosen = cut_lineage(chosen)
    labelled = matched.select("bid")

    def cut(pool: DataFrame, value: Column, q: list[float]) -> list[float]:
        vals = {r["q"]: r["value"] for r in exact_quantiles(pool, value, q).collect()}
        return [vals[k] if k in vals else float("nan") for k in q]

    def grab(pools: list[tuple[str, Column, int]]) -> None:
        """Draw several disjoint strata in one job."""
        nonlocal chosen
        tag = F.lit(None).cast("string")
        for name, cond, _ in reversed(pools):
            tag = F.when(F.coalesce(cond, F.lit(False)), F.lit(name)).otherwise(tag)
        quota = lookup(spark, ["stratum", "quota"], [(n, k) for n, _, k in pools])
        free = rows.withColumn("stratum", tag).where(F.col("stratum").isNotNull()).select("bid", "stratum")
        free = free.join(labelled, "bid", "left_anti").join(chosen.select("bid"), "bid", "left_anti")
        got = draw_per_group(free.join(F.broadcast(quota), "stratum"), ["stratum"], F.col("quota"), seed, "stratum", "bid")
        chosen = cut_lineage(chosen.unionByName(got.select("bid", "stratum")))

    hotel = F.col("archetype") == "hotel"
    lo, hi = cut(rows.where(hotel), conf, [0.333, 0.667])
    grab([("hotel_high_conf", hotel & (conf >= hi), q["hotel"] // 2)])
    grab([("hotel_low_conf", hotel & (conf <= lo), q["hotel"] - q["hotel"] // 2)])

    bundle = F.col("bundled_label")
    a1, a2, a3 = cut(rows.where(bundle), F.col("area_m2"), [0.25, 0.5, 0.75])
    area = F.col("area_m2")
    quart = [area <= a1, (area > a1) & (area <= a2), (area > a2) & (area <= a3), area > a3]
    grab([(f"sport_culture_fp_q{k + 1}", bundle & c, n) for k, (c, n) in enumerate(zip(quart, _quotas(q["bundle"], 4)))])

    edges = rules.LIST_FLOOR_EDGES
    bins = [(f"floors_{a}_{b - 1}", F.col("floors").between(a, b - 1), q["floors"]) for a, b in zip(edges, edges[1:])]
    grab([*bins, (f"floors_{edges[-1]}plus", F.col("floors") >= edges[-1], q["floors"])])

    for key, cond in windows.items():
        (third,) = cut(rows.where(cond), conf, [0.333])
        grab([(f"low_conf_{key}", cond & (conf <= third), q["window"])])

    (tenth,) = cut(rows, conf, [0.1])
    outside = F.lit(True)
    for cond in windows.values():
        outside = outside & ~cond
    pool = rows.where((conf <= tenth) & outside).select("bid", "pred_class")
    pool = pool.join(labelled, "bid", "left_anti").join(chosen.select("bid"), "bid", "left_anti")
    city = round_robin(pool, "pred_class", q["low_conf"], seed, "bid").select("bid", F.lit("low_conf_citywide").alias("stratum"))
    return cut_lineage(chosen.unionByName(city))


SHEET = [
    "bid", "district", "lat_wgs84", "lon_wgs84", "lat_bd09", "lon_bd09", "label_rule", "euluc_class", "floors", "footprint_m2",
    "pred_class", "pred_confidence", "stratum", "actual_class", "actual_floors", "notes",
]


def labelling_sheet(listed: DataFrame, rows: DataFrame, lon: Column, lat: Column) -> DataFrame:
    """The list with what a labeller needs (``SHEET``): both positions, rule label, prediction, and three empty columns.

    ``rows`` are those of :func:`labelling_list` with ``district, label_rule, euluc_class``; ``lon, lat`` are in degrees.
    """
    j = listed.join(rows, "bid")
    blon, blat = wgs84_to_bd09(lon, lat)
    places = {"lat_wgs84": lat, "lon_wgs84": lon, "lat_bd09": blat, "lon_bd09": blon}
    blank = {c: F.lit("") for c in SHEET[-3:]}
    j = j.withColumns({**{n: half_even(c, 7) for n, c in places.items()}, **blank, "footprint_m2": half_even(F.col("area_m2"), 1)})
    return j.withColumn("pred_confidence", half_even(F.col("pred_confidence"), 3)).select(*SHEET)


def round_robin(pool: DataFrame, group: str, k: int, seed: int, key: str) -> DataFrame:
    """Take rows from the groups in turn until ``k`` are picked."""
    w = Window.partitionBy(group).orderBy(draw_order(seed, F.col(key)))
    ranked = pool.withColumn("_turn", F.row_number().over(w)).where(F.col("_turn") <= k)
    return ranked.orderBy("_turn", group).limit(k).drop("_turn")
