"""Same-model dedup, window sampling and seeded draws."""

from __future__ import annotations

from pyspark.sql import functions as F

from cityloom import rules
from cityloom.operators import dedup as D, sampling as R
from cityloom.plans.inputs import slim
from cityloom.plans.registry import register
from cityloom.sources.views import Inputs, stored, stored_tables


def models(i: Inputs):
    return slim(i).select(
        F.col("bid").alias("id"), F.col("rep_x").alias("x"), F.col("rep_y").alias("y"),
        F.col("area_m2").alias("area"), F.col("height").cast("double").alias("height"),
    )


def clusters(i: Inputs):
    return stored(i, "clusters", lambda: D.same_model_clusters(models(i)), ("orders",))


def sampled(i: Inputs):
    return stored_tables(i, "window-sample", lambda: R.sample_windows(models(i), PLANE_WINDOWS), ("orders",))


PAIRS = {
    "mb": """
SELECT bid AS id, rx AS x, ry AS y, area_m2 AS area, CAST(height AS DOUBLE) AS height,
  CAST(floor(rx/250) AS INT) AS cx, CAST(floor(ry/250) AS INT) AS cy FROM g26""",
    "mp": """
SELECT a.id, b.id AS o_id FROM mb a JOIN (SELECT mb.* REPLACE (cx + dx AS cx, cy + dy AS cy) FROM mb,
   (VALUES (-1), (0), (1)) u(dx), (VALUES (-1), (0), (1)) v(dy)) b
 ON a.cx = b.cx AND a.cy = b.cy AND a.height = b.height AND a.id <> b.id
WHERE abs(a.area-b.area)/greatest(a.area, b.area) <= CAST(0.05 AS DOUBLE)
  AND sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y)) <= 250""",
}
CLUSTERS = {
    **PAIRS,
    "cl": """
WITH RECURSIVE cc(id, lab) USING KEY (id) AS (
  SELECT id, id FROM mb
  UNION
  SELECT p.id, min(c.lab) FROM cc c JOIN mp p ON p.o_id = c.id JOIN recurring.cc r ON r.id = p.id
  WHERE c.lab < r.lab GROUP BY p.id)
SELECT id, lab AS cluster_root FROM cc""",
}


@register("j10_same_model_pairs", "SELECT id, count(*) AS n_partners, min(o_id) AS first_partner FROM mp GROUP BY id", PAIRS)
def j10_same_model_pairs(i: Inputs):
    """Same-model partners counted per building; pairs go straight into the aggregate."""
    p = D.partners(D.model_pairs(models(i)))
    return p.groupBy("id").agg(F.count(F.lit(1)).alias("n_partners"), F.min("o_id").alias("first_partner"))


@register("j11_same_model_clusters", "SELECT id, cluster_root FROM cl", CLUSTERS)
def j11_same_model_clusters(i: Inputs):
    return D.same_model_clusters(models(i)).select("id", "cluster_root")


@register(
    "w1_keep_three",
    "SELECT id, cluster_root, row_number() OVER (PARTITION BY cluster_root ORDER BY id) AS rank_in_cluster FROM cl QUALIFY rank_in_cluster <= 3",
    CLUSTERS,
)
def w1_keep_three(i: Inputs):
    return D.keep_first(clusters(i)).select("id", "cluster_root", "rank_in_cluster")


@register(
    "w6_cluster_size",
    "SELECT id, count(*) OVER (PARTITION BY cluster_root) AS cluster_size FROM cl",
    CLUSTERS,
)
def w6_cluster_size(i: Inputs):
    from cityloom.operators.skew import with_group_stats

    c = clusters(i).select("id", "cluster_root")
    return with_group_stats(c, "cluster_root", {"cluster_size": F.count(F.lit(1))}).select("id", "cluster_size")


@register(
    "f15_cluster_note",
    """SELECT id, CASE WHEN n >= 2 THEN '同款约 ' || n || ' 栋(自动识别)' ELSE '' END AS note
FROM (SELECT id, count(*) OVER (PARTITION BY cluster_root) AS n FROM cl)""",
    CLUSTERS,
)
def f15_cluster_note(i: Inputs):
    return w6_cluster_size(i).select("id", R.cluster_note(F.col("cluster_size")).alias("note"))


@register(
    "a24_cluster_histogram",
    """
SELECT b.bucket, count(s.n) AS n FROM (VALUES ('1'), ('2'), ('3'), ('4-6'), ('7+')) b(bucket)
LEFT JOIN (SELECT CASE WHEN count(*) <= 3 THEN CAST(count(*) AS VARCHAR) WHEN count(*) <= 6 THEN '4-6' ELSE '7+' END AS bucket, 1 AS n
  FROM cl GROUP BY cluster_root) s USING (bucket) GROUP BY 1""",
    CLUSTERS,
)
def a24_cluster_histogram(i: Inputs):
    return D.size_histogram(D.cluster_sizes(clusters(i)))


# windows on the metric plane of the views: key, centre, first half-width, quota
PLANE_WINDOWS = [(k, 400.0 + 550.0 * n, 150.0, 60 + 20 * n, 40) for n, (k, *_rest) in enumerate(rules.WINDOWS)]


@register(
    "f4_window_filter",
    "SELECT w.k AS window, g.bid FROM g26 g JOIN (VALUES " + ", ".join(f"('{k}', {x}, {y}, {h})" for k, x, y, h, _ in PLANE_WINDOWS)
    + ") w(k, cx, cy, h) ON g.rx BETWEEN w.cx - w.h AND w.cx + w.h AND g.ry BETWEEN w.cy - w.h AND w.cy + w.h",
)
def f4_window_filter(i: Inputs):
    from cityloom.sources.tables import lookup

    rows = [(k, x, y, float(h)) for k, x, y, h, _ in PLANE_WINDOWS]
    w = F.broadcast(lookup(i.spark, ["window", "cx", "cy", "half"], rows))
    box = R.in_window(F.col("rep_x"), F.col("rep_y"), F.col("cx"), F.col("cy"), F.col("half"))
    return slim(i).join(w, box).select("window", "bid")


@register("f6_area_floor", "SELECT bid, area_m2 FROM g26 WHERE area_m2 >= 100")
def f6_area_floor(i: Inputs):
    return slim(i).where(F.col("area_m2") >= rules.MIN_FOOTPRINT_M2).select("bid", "area_m2")


# every half-width a window may get, the rows each holds, clusters of the three first that hold enough rows, and the first
# of those that keeps enough
WINDOW_SAMPLE = {
    **PAIRS,
    "wins": "SELECT * FROM (VALUES " + ", ".join(f"('{k}', {n}, {x}, {y}, {h}, {q})" for n, (k, x, y, h, q) in enumerate(PLANE_WINDOWS)) + ") w(k, no, cx0, cy0, h0, quota)",
    "steps": f"""SELECT k, no, cx0, cy0, h0, quota, s, CAST(h0 + s*{rules.HALFWIDTH_STEP_M} AS DOUBLE) AS half
FROM wins, (SELECT unnest(range(0, 40)) AS s) WHERE s = 0 OR h0 + (s-1)*{rules.HALFWIDTH_STEP_M} < {rules.MAX_HALFWIDTH_M}""",
    "held": f"""SELECT t.k, t.s, t.quota, t.half, b.* FROM steps t JOIN mb b ON b.area >= {rules.MIN_FOOTPRINT_M2}
 AND b.x BETWEEN t.cx0 - t.half AND t.cx0 + t.half AND b.y BETWEEN t.cy0 - t.half AND t.cy0 + t.half""",
    "able": "SELECT k, min(s) AS s0 FROM (SELECT k, s FROM held GROUP BY k, s, quota HAVING count(*) >= quota) GROUP BY k",
    "cand": "SELECT h.* FROM held h JOIN able USING (k) WHERE s BETWEEN s0 AND s0 + 2",
    "linked": "SELECT a.k, a.s, a.id, p.o_id FROM cand a JOIN mp p ON p.id = a.id JOIN cand b ON b.k = a.k AND b.s = a.s AND b.id = p.o_id",
    "wcl": """
WITH RECURSIVE cc(k, s, id, lab) USING KEY (k, s, id) AS (
  SELECT k, s, id, id FROM cand
  UNION
  SELECT p.k, p.s, p.id, min(c.lab) FROM cc c JOIN linked p ON p.k = c.k AND p.s = c.s AND p.o_id = c.id JOIN recurring.cc r ON r.k = p.k AND r.s = p.s AND r.id = p.id
  WHERE c.lab < r.lab GROUP BY p.k, p.s, p.id)
SELECT k, s, id, lab AS cluster_root FROM cc""",
    "wkept": "SELECT * FROM wcl QUALIFY row_number() OVER (PARTITION BY k, s, cluster_root ORDER BY id) <= 3",
    "final": "SELECT k, min(s) AS s FROM (SELECT k, s FROM wkept JOIN wins USING (k) GROUP BY k, s, quota HAVING count(*) >= quota) GROUP BY k",
    "picked": f"""SELECT k, s, id, cluster_root FROM wkept JOIN final USING (k, s) JOIN wins USING (k)
QUALIFY row_number() OVER (PARTITION BY k ORDER BY md5('{rules.SAMPLE_SEED}:' || k || ':' || id)) <= quota""",
    "named": "SELECT p.*, 'V' || lpad(CAST(no*40 + row_number() OVER (PARTITION BY k ORDER BY id) AS VARCHAR), 3, '0') AS val_id FROM picked p JOIN wins USING (k)",
    "tally": """
SELECT k AS window, half AS final_half, n_kept AS candidates_kept, n_all - n_kept AS dropped_duplicates,
  cx0 - half AS box_xmin, cy0 - half AS box_ymin, cx0 + half AS box_xmax, cy0 + half AS box_ymax, CAST(h0 AS DOUBLE) AS initial_half, cx0, cy0
FROM final JOIN steps USING (k, s) JOIN (SELECT k, s, count(*) AS n_all FROM wcl GROUP BY k, s) USING (k, s)
 JOIN (SELECT k, s, count(*) AS n_kept FROM wkept GROUP BY k, s) USING (k, s)""",
}


@register(
    "r1_window_sample",
    "SELECT k AS window, p.id, area, height, half AS final_half FROM picked p JOIN steps USING (k, s) JOIN mb ON mb.id = p.id",
    WINDOW_SAMPLE,
)
def r1_window_sample(i: Inputs):
    res = R.sample_windows(models(i), PLANE_WINDOWS)
    return res["picked"].select("window", "id", "area", "height", F.col("half").alias("final_half"))


@register(
    "r2_window_run",
    """SELECT val_id, k AS window, n.id, x, y, CASE WHEN c >= 2 THEN '同款约 ' || c || ' 栋(自动识别)' ELSE '' END AS note
FROM named n JOIN mb ON mb.id = n.id JOIN (SELECT k, s, cluster_root, count(*) AS c FROM wcl GROUP BY ALL) USING (k, s, cluster_root)""",
    WINDOW_SAMPLE,
)
def r2_window_run(i: Inputs):
    """All windows with numbered ids and notes."""
    res = sampled(i)
    ids = R.window_ids(res["picked"], [w[0] for w in PLANE_WINDOWS])
    j = ids.join(res["sizes"], ["window", "cluster_root"])
    return j.select("val_id", "window", "id", "x", "y", R.cluster_note(F.col("cluster_size")).alias("note"))


@register("f16_window_ids", "SELECT val_id, k AS window, id FROM named", WINDOW_SAMPLE)
def f16_window_ids(i: Inputs):
    res = sampled(i)
    return R.window_ids(res["picked"], [w[0] for w in PLANE_WINDOWS]).select("val_id", "window", "id")


@register("a32_sampling_tally", "SELECT * EXCLUDE (initial_half, cx0, cy0) FROM tally", WINDOW_SAMPLE)
def a32_sampling_tally(i: Inputs):
    return sampled(i)["tally"].drop("initial_half", "cx", "cy")


@register(
    "s15_sampling_summary",
    """
SELECT tally."window", 42 AS seed, initial_half AS initial_halfwidth_m, final_half, candidates_kept, dropped_duplicates, round(121 + cx0/100000, 6) AS lon, round(30.9 + cy0/100000, 6) AS lat,
  box_xmin, box_ymin, box_xmax, box_ymax, first_id, last_id, n1, n2, n3, n4, n7
FROM tally JOIN (SELECT k AS "window", min(val_id) AS first_id, max(val_id) AS last_id FROM named GROUP BY k) USING ("window")
JOIN (SELECT k AS "window", count(*) FILTER (c = 1) AS n1, count(*) FILTER (c = 2) AS n2, count(*) FILTER (c = 3) AS n3, count(*) FILTER (c BETWEEN 4 AND 6) AS n4, count(*) FILTER (c >= 7) AS n7
  FROM (SELECT k, count(*) AS c FROM wcl JOIN final USING (k, s) GROUP BY k, cluster_root) GROUP BY k) USING ("window")""",
    WINDOW_SAMPLE,
)
def s15_sampling_summary(i: Inputs):
    """The summary documents, read back field by field."""
    res = sampled(i)
    ids = R.window_ids(res["picked"], [w[0] for w in PLANE_WINDOWS])
    centre = F.struct((F.lit(121.0) + F.col("cx") / 100000.0).alias("lon"), (F.lit(30.9) + F.col("cy") / 100000.0).alias("lat"))
    kind = """seed INT, initial_halfwidth_m DOUBLE, final_half DOUBLE, candidates_kept BIGINT, dropped_duplicates BIGINT, centre_wgs84 STRUCT<lon: DOUBLE, lat: DOUBLE>,
 box_xmin DOUBLE, box_ymin DOUBLE, box_xmax DOUBLE, box_ymax DOUBLE, id_range ARRAY<STRING>, histogram MAP<STRING, BIGINT>"""
    d = R.sampling_summary(res, ids, rules.SAMPLE_SEED, centre).select("window", F.from_json("summary", kind).alias("d"))
    flat = ["seed", "initial_halfwidth_m", "final_half", "candidates_kept", "dropped_duplicates", "box_xmin", "box_ymin", "box_xmax", "box_ymax"]
    bins = {"1": "n1", "2": "n2", "3": "n3", "4-6": "n4", "7+": "n7"}
    return d.select(
        "window", *(F.col(f"d.{c}") for c in flat), *(F.round(f"d.centre_wgs84.{c}", 6).alias(c) for c in ("lon", "lat")),
        F.col("d.id_range")[0].alias("first_id"), F.col("d.id_range")[1].alias("last_id"), *(F.col("d.histogram")[b].alias(n) for b, n in bins.items()),
    )


@register("t4_seeded_sample", "SELECT bid, height FROM b26 ORDER BY md5('42:' || bid) LIMIT 1000")
def t4_seeded_sample(i: Inputs):
    return R.draw(i.buildings().select("bid", "height"), 1000, rules.SAMPLE_SEED, "bid")


@register("r5_spot_check", "SELECT bid, district FROM b26 ORDER BY md5('20260712:' || bid) LIMIT 10")
def r5_spot_check(i: Inputs):
    return R.draw(i.buildings().select("bid", "district"), 10, rules.MODEL_SEED, "bid")


@register("t1_tallest", "SELECT bid, height FROM b26 ORDER BY height DESC, bid LIMIT 20")
def t1_tallest(i: Inputs):
    return i.buildings().select("bid", "height").orderBy(F.col("height").desc(), "bid").limit(20)


# the reference areas, moved to the extent of the views: a part of the plane each
AREAS = {k: tuple(c + n * 0.003 for c in (121.0, 30.9, 121.012, 30.915)) for n, k in enumerate(rules.STUDY_AREAS)}


@register(
    "d9_study_area",
    "SELECT a.area, bid FROM g26 JOIN (VALUES " + ", ".join(f"('{k}', {a[0]!r}::DOUBLE, {a[1]!r}::DOUBLE, {a[2]!r}::DOUBLE, {a[3]!r}::DOUBLE)" for k, a in AREAS.items())
    + """) a(area, w0, s0, e0, n0) ON 121 + rx/100000 BETWEEN w0 AND e0 AND 30.9::DOUBLE + ry/100000 BETWEEN s0 AND n0""",
)
def d9_study_area(i: Inputs):
    """Buildings of each named area, by the bounds in degrees that its name stands for."""
    b = slim(i).withColumns({"lon": F.lit(121.0) + F.col("rep_x") / 100000.0, "lat": F.lit(30.9) + F.col("rep_y") / 100000.0})
    return R.in_areas(b, AREAS).select("area", "bid")
