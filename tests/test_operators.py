"""Datum shift, dedup, sampling, quantiles, energy, guards and streaming on small literal inputs."""

import math
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from cityloom import rules
from cityloom.functions import geodesy as D
from cityloom.operators import dedup, energy as E, evaluation as V, graph, labelling as L, model as M, quantiles as Q, sampling as R, skew
from cityloom.sources import sinks, tables as S


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_datum_shift_published_example(spark):
    lon, lat = F.lit(116.397128), F.lit(39.916527)
    r = one(spark, *D.wgs84_to_gcj02(lon, lat), *D.wgs84_to_bd09(lon, lat))
    assert r[0] == pytest.approx(116.40342, abs=1e-3) and r[1] == pytest.approx(39.91784, abs=1e-3)
    assert r[2] == pytest.approx(116.40990, abs=1e-3) and r[3] == pytest.approx(39.92347, abs=1e-3)


def test_datum_shift_directions_and_inverse(spark):
    lon, lat = F.lit(121.5054), F.lit(31.2337)
    b = one(spark, *D.wgs84_to_bd09(lon, lat))
    assert 121.5054 < b[0] < 121.52 and 31.2337 < b[1] < 31.24
    assert tuple(one(spark, *D.wgs84_to_gcj02(F.lit(-74.006), F.lit(40.7128)))) == (-74.006, 40.7128)
    g = D.wgs84_to_gcj02(lon, lat)
    once, more = one(spark, *D.gcj02_to_wgs84(*g)), one(spark, *D.gcj02_to_wgs84(*g, steps=4))
    assert once[0] == pytest.approx(121.5054, abs=1e-4) and more[0] == pytest.approx(121.5054, abs=1e-9)


def test_marker_link(spark):
    lon, lat = F.lit(121.5054), F.lit(31.2337)
    url = one(spark, D.marker_link(lon, lat, F.lit("V001")))[0]
    assert url.startswith("https://api.map.baidu.com/marker?")
    for part in ("coord_type=wgs84", "location=31.2337000%2C121.5054000", "title=V001", "src=ubem.validation"):
        assert part in url
    other = one(spark, D.marker_link(lon, lat, F.lit("V001"), coord_type="bd09ll"))[0]
    assert "coord_type=bd09ll" in other and "location=31.2337000%2C121.5054000" not in other
    with pytest.raises(ValueError):
        D.marker_link(lon, lat, F.lit("x"), coord_type="other")


def test_projection_known_point_and_back(spark):
    # on the central meridian the easting is the false easting and the northing k0 times the meridian arc
    r = one(spark, *D.to_metric(F.lit(123.0), F.lit(31.0)))
    f = 1 / 298.257223563
    e2 = f * (2 - f)
    phi = (np.arange(200_000) + 0.5) * np.radians(31.0) / 200_000
    arc = 6378137.0 * (1 - e2) * np.mean((1 - e2 * np.sin(phi) ** 2) ** -1.5) * np.radians(31.0)
    assert r[0] == pytest.approx(500000.0, abs=1e-6) and r[1] == pytest.approx(0.9996 * arc, abs=0.001)
    x, y = D.to_metric(F.lit(121.5), F.lit(31.2), D.SAMPLING_GRID)
    back = one(spark, *D.to_geographic(x, y, D.SAMPLING_GRID))
    assert back[0] == pytest.approx(121.5, abs=1e-7) and back[1] == pytest.approx(31.2, abs=1e-7)


BASE = {"area": 500.0, "height": 30.0, "x": 0.0, "y": 0.0}


def sizes(spark, rows):
    df = spark.createDataFrame([(k, *[float({**BASE, **r}[c]) for c in ("x", "y", "area", "height")]) for k, r in enumerate(rows)],
                               "id bigint, x double, y double, area double, height double")
    c = dedup.same_model_clusters(df)
    return sorted(r["cluster_size"] for r in dedup.cluster_sizes(c).collect()), c


@pytest.mark.parametrize(
    "other,linked",
    [({"area": 530.5, "x": 50}, False), ({"area": 515.0, "x": 50}, True), ({"height": 30.6, "x": 50}, False), ({"height": 30.4, "x": 50}, True),
     ({"x": 300}, False), ({"x": 240}, True), ({"x": 250}, True), ({"height": 30.5}, True)],
)
def test_dedup_limits(spark, other, linked):
    assert sizes(spark, [{}, other])[0] == ([2] if linked else [1, 1])


def test_dedup_chain_keep_three_and_empty(spark):
    assert sizes(spark, [{}, {"x": 240}, {"x": 480}])[0] == [3]
    s, c = sizes(spark, [{"x": 100.0 * k} for k in range(5)])
    assert s == [5]
    assert [r["id"] for r in dedup.keep_first(c).orderBy("id").collect()] == [0, 1, 2]
    assert sizes(spark, [{"area": 0}, {"area": 0}])[0] == [1, 1]
    empty = spark.createDataFrame([], "id bigint, x double, y double, area double, height double")
    assert dedup.same_model_clusters(empty).count() == 0


def test_dedup_matches_brute_force(spark):
    rng = random.Random(3)
    rows = [{"x": rng.uniform(0, 2500), "y": rng.uniform(0, 2500), "area": rng.choice([100, 104, 108, 150]), "height": rng.choice([12, 12.5, 13, 20])}
            for _ in range(250)] + [{"x": 1.0, "y": 1.0}] * 40
    _, c = sizes(spark, rows)
    full = [{**BASE, **r} for r in rows]
    parent = list(range(len(full)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in range(len(full)):
        for b in range(a):
            p, q = full[a], full[b]
            near = ((p["x"] - q["x"]) ** 2 + (p["y"] - q["y"]) ** 2) ** 0.5 <= 250
            if near and abs(p["height"] - q["height"]) <= 0.5 and abs(p["area"] - q["area"]) / max(p["area"], q["area"]) <= 0.05:
                ra, rb = find(a), find(b)
                parent[max(ra, rb)] = min(ra, rb)
    assert {r["id"]: r["cluster_root"] for r in c.collect()} == {k: find(k) for k in range(len(full))}


def test_components_long_chain(spark):
    e = spark.range(200).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    comp = graph.connected_components(e).collect()
    assert len(comp) == 201 and {r["root"] for r in comp} == {0}


def grid(spark, n, **over):
    rng = np.random.default_rng(1)
    data = {"x": rng.uniform(-1500, 1500, n), "y": rng.uniform(-1500, 1500, n), "area": np.linspace(80, 400, n), "height": np.linspace(6, 200, n), **over}
    return spark.createDataFrame([(k, *[float(np.broadcast_to(data[c], n)[k]) for c in ("x", "y", "area", "height")]) for k in range(n)],
                                 "id bigint, x double, y double, area double, height double")


def test_window_sampling(spark):
    res = R.sample_windows(grid(spark, 200), [("t", 0.0, 0.0, 3000, 20)])
    a = [tuple(r) for r in res["picked"].select("id", "area").orderBy("id").collect()]
    b = [tuple(r) for r in R.sample_windows(grid(spark, 200), [("t", 0.0, 0.0, 3000, 20)])["picked"].select("id", "area").orderBy("id").collect()]
    assert a == b and len(a) == 20 and all(x[1] >= rules.MIN_FOOTPRINT_M2 for x in a)
    ids = R.window_ids(res["picked"], ["s", "t"], 20).orderBy("val_id").collect()
    assert ids[0]["val_id"] == "V021" and ids[-1]["val_id"] == "V040"


def test_window_growth_and_exhaustion(spark):
    far = grid(spark, 60, x=2500.0, y=0.0, area=np.linspace(150, 400, 60))
    res = R.sample_windows(far, [("t", 0.0, 0.0, 500, 10)])
    assert res["tally"].first()["final_half"] == 2600
    with pytest.raises(R.NotEnoughCandidates):
        R.sample_windows(grid(spark, 5), [("t", 0.0, 0.0, 2500, 40)])


@pytest.mark.parametrize("n", [1, 2, 5, 3000, 45000])
def test_exact_quantiles(spark, n):
    rng = np.random.default_rng(n)
    v = np.concatenate([rng.lognormal(0, 3, n - n // 3), np.full(n // 3, 1.5)])
    df = spark.createDataFrame([(float(x),) for x in v], "v double").repartition(3)
    qs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]
    got = {r["q"]: r["value"] for r in Q.exact_quantiles(df, F.col("v"), qs).collect()}
    for q in qs:
        assert got[q] == pytest.approx(float(np.quantile(v, q)), rel=1e-12)


def test_wide_brackets_are_narrowed(spark):
    rng = np.random.default_rng(8)
    v = np.concatenate([rng.normal(size=60_000), np.full(30_000, 0.25), np.round(rng.normal(size=10_000), 1)])
    df = spark.createDataFrame([(float(x), "a" if k % 3 else "b") for k, x in enumerate(v)], "v double, g string")
    qs = [0.0, 0.01, 0.5, 0.62, 0.999, 1.0]
    for by, parts in ([], {None: v}), (["g"], {"a": v[np.arange(len(v)) % 3 > 0], "b": v[::3]}):
        got = {(r["g"] if by else None, r["q"]): r["value"] for r in Q.exact_quantiles(df, F.col("v"), qs, by, fit=20).collect()}
        assert len(got) == len(qs) * len(parts)
        assert all(got[g, q] == pytest.approx(float(np.quantile(x, q)), rel=1e-12) for g, x in parts.items() for q in qs)


@pytest.mark.parametrize("hot_right", [False, True])
def test_hot_keys_are_split(spark, hot_right):
    """A key that is hot on one side only: same rows as the plain join, and no task holds the key's rows."""
    many = spark.createDataFrame([(1 if k % 3 else k, k) for k in range(900)] + [(None, 5)], "k int, id int")
    few = spark.createDataFrame([(k, k * 10) for k in range(0, 900, 2)] + [(1, 7), (1, 8)], "k int, w int")
    big, small = (few, many) if hot_right else (many, few)
    for how in ("inner", "left", "left_semi", "left_anti"):
        got = skew.balanced_join(big, small, ["k"], how, min_rows=50)
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, big.join(small, ["k"], how).collect()), key=repr)
    (hot,) = skew.hot_keys(big, small, ["k"], 50).collect()
    assert hot.k == 1 and (hot._fs > 1) == hot_right and (hot._fb > 1) != hot_right
    assert skew.hot_keys(big, small, ["k"]).collect() == []


def test_group_stats(spark):
    big = spark.createDataFrame([(1 if k % 3 else k, k) for k in range(900)], "k int, id int")
    g = skew.with_group_stats(big.withColumn("k", F.when(F.col("k") != 0, F.col("k"))), "k", {"n": F.count("*")})
    assert g.where("k = 1").first()["n"] == 600 and g.where("k is null").first()["n"] is None


def test_code_lists_are_whole(spark):
    from cityloom.operators import features, model

    df = spark.range(1500).select(F.col("id").alias("ep"), F.concat(F.lit("c"), "id").alias("truth_arch"))
    assert len(features.distinct_codes(df, "ep")) == 1500 and len(model.class_labels(df)) == 1500
    with pytest.raises(ValueError):
        features.distinct_codes(df, "ep", most=1000)


def test_numeric_text(spark):
    from cityloom.sources import tables

    df = spark.createDataFrame([("12",), ("12.0",), (" 24.0 ",), ("1.5",), ("x",), (None,)], "height string")
    assert [r.height for r in tables.scan_buildings(df, ["height"]).collect()] == [12, 12, 24, 1, None, None]
    floors = tables.scan_buildings_2023(spark.createDataFrame([("24.0",)], "FLOOR string")).first()
    assert (floors.floor23, floors.floors_2023) == (24, 12)
    half = tables.scan_buildings_2023(spark.createDataFrame([("25.5",), ("-0.5",), ("nan",)], "FLOOR string")).collect()
    assert [(r.floor23, r.floors_2023) for r in half] == [(25, 12), (0, 0), (None, None)]
    with pytest.raises(Exception, match="odd FLOOR"):
        tables.scan_buildings_2023(spark.createDataFrame([("25.0",)], "FLOOR string")).collect()
    odd = [("a'b\\",), ("x\\ny",)]
    assert [tuple(r) for r in tables.lookup(spark, ["v"], odd).collect()] == odd


def test_stop_word_names_match_nothing(spark):
    from cityloom.operators import poi

    points = spark.createDataFrame([(1, "广场"), (2, "静安大厦"), (3, None)], "val_id long, name string").select(
        "val_id", F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), poi.name_tokens(F.col("name")).alias("tok")
    )
    pois = spark.createDataFrame([(1, "静安寺", 1.0, 1.0), (2, "广场", 2.0, 2.0)], "id long, name string, x double, y double")
    got = {r.val_id: (r.n_near, r.n_match) for r in poi.token_matches(points, pois, "tok", 50.0).collect()}
    assert got == {1: (2, 0), 2: (2, 1), 3: (2, 0)}


def test_end_of_life_by_product(spark):
    from cityloom.operators import energy

    rows = [("CMU", "bricks_masonry"), ("Medium density concrete block", "bricks_masonry"), ("AAC", "bricks_masonry"), ("Clay brick", "x"), ("Reclaimed brick", "x"),
            ("C30 concrete", "concrete"), ("Float glass", "glass"), (None, "steel"), ("Profile", "aluminum"), ("wood", "wood")]
    df = spark.createDataFrame(rows, "p string, c string").select(energy.end_of_life_stage(F.col("p"), F.col("c")).alias("s"))
    assert [r.s for r in df.collect()] == ["C3-balancing", "C3-balancing", "C4", "C4", "C4", "C4", "C4", "C3", "C3", None]


def test_rows_without_a_partner_stay(spark):
    from cityloom.operators import energy, raster

    b = spark.createDataFrame([("office", 2, 8, 100.0), ("odd", 2, 8, 50.0), ("office", None, None, 9.0)], "archetype string, floors int, height int, area_m2 double")
    eui = spark.createDataFrame([("office", "low", 1, 2.0)], "archetype string, height_bin string, month int, eui_kwh_m2 double")
    got = sorted(((r.archetype, r.height_bin, r.n, r.gfa_m2, r.kwh) for r in energy.city_energy(b, eui).collect()), key=repr)
    assert got == [("odd", "low", 1, 100.0, None), ("office", "low", 1, 200.0, 400.0), ("office", "unknown", 1, 0.0, None)]
    marks = spark.createDataFrame([("a", 0, 0, 9.0), ("b", 50, 50, 9.0)], "name string, col int, prow int, true_h double")
    px = spark.createDataFrame([(1, 1, 4.0), (0, 0, float("nan"))], "col int, prow int, h double")
    assert {r.name: r.window_max for r in raster.focal_max(marks, px).collect()} == {"a": 4.0, "b": None}


def test_label_priority(spark):
    rows = [(1, 1, True, True, 5), (2, 2, True, False, 5), (3, 0, False, True, 5), (4, 0, False, False, 10), (5, 0, False, False, None),
            (6, 9, False, False, 2), (7, 3, False, False, 2), (8, None, False, False, 2), (9, 1, False, False, 2)]
    df = spark.createDataFrame(rows, "bid int, euluc_class int, mall_signal boolean, hotel_signal boolean, floors int")
    got = {r["bid"]: (r["archetype"], r["label_rule"], r["bundled_label"]) for r in L.label_rules(df).collect()}
    assert got == {
        1: ("mixed_use", "mixed_use_candidate", False), 2: ("shopping_mall", "mall", False), 3: ("hotel", "hotel", False),
        4: ("residential_high_rise", "euluc_direct", False), 5: ("residential_mid_rise", "euluc_direct", False),
        6: ("sport_culture", "euluc_direct", True), 7: ("unknown", "unknown", False), 8: ("unknown", "unknown", False), 9: ("office", "euluc_direct", False),
    }


def test_half_even_floors(spark):
    df = spark.createDataFrame([(10,), (14,), (6,), (159,), (160,)], "height int")
    assert [r["floors"] for r in L.with_floors(df).collect()] == [2, 4, 2, 40, None]


def test_code_lookup_stops_at_skip(spark):
    codes = ["120203", "120201", "120305", "120900", "160301", "160100", "060200", "061900", "990000", "555555"]
    got = [r["vote"] for r in L.map_codes(spark.createDataFrame([(k, c) for k, c in enumerate(codes)], "k int, code string")).orderBy("k").collect()]
    assert got == ["mixed_use", "office", "residential", "other_public", None, "office", None, None, None, None]


def test_odd_floor_code_stops(spark):
    ok = S.scan_buildings_2023(spark.createDataFrame([("8",), ("x",)], "FLOOR string")).collect()
    assert [r["floors_2023"] for r in ok] == [4, None]
    with pytest.raises(Exception, match="odd FLOOR"):
        S.scan_buildings_2023(spark.createDataFrame([("7",)], "FLOOR string")).collect()


def test_monthly_parse(spark):
    j = rules.J_PER_KWH
    cols = ["run", "month", "InteriorLights:Electricity [J](Monthly)", "InteriorEquipment:Electricity [J](Monthly)",
            "DistrictCooling:Facility [J](Monthly)", "DistrictHeatingWater:Facility [J](Monthly)", "A:Zone Ideal Loads Supply Air Total Cooling Energy"]
    rows = [("m", k, j * 100, j * 200, j * 350, j * 250, 0.0) for k in range(1, 13)] + [("z", k, 0.0, 0.0, 0.0, 0.0, j * 350) for k in range(1, 13)]
    runs = spark.createDataFrame([("m", 100.0, 3.5, 2.5), ("z", 100.0, 3.5, 2.5)], "run string, area_m2 double, cop_cooling double, cop_heating double")
    out = {(r["run"], r["month"]): r for r in E.parse_monthly(spark.createDataFrame(rows, cols), runs).collect()}
    m = out["m", 1]
    assert [m[f"{u}_kwh_m2"] for u in ("lighting", "equipment", "cooling", "heating", "total")] == [1.0, 2.0, 1.0, 1.0, 5.0]
    assert out["z", 4]["cooling_kwh_m2"] == 1.0
    with pytest.raises(Exception, match="not 12 months"):
        E.parse_monthly(spark.createDataFrame(rows[:11], cols), runs).collect()


@pytest.mark.parametrize("sim,want", [([10, 20, 30], 0.0), ([11, 22, 33], 10.0), ([9, 18, 27], -10.0)])
def test_nmbe(spark, sim, want):
    df = spark.createDataFrame([(float(s), float(o)) for s, o in zip(sim, [10, 20, 30])], "s double, o double")
    assert df.agg(E.nmbe(F.col("s"), F.col("o"))).first()[0] == pytest.approx(want)


def test_nmbe_and_month_gates(spark):
    with pytest.raises(Exception, match="zero or empty"):
        spark.createDataFrame([(1.0, 0.0)], "s double, o double").agg(E.nmbe(F.col("s"), F.col("o"))).collect()
    sim = spark.createDataFrame([("a", k, 1.0) for k in range(1, 12)], "archetype string, month int, sim double")
    with pytest.raises(Exception, match="not 12 months"):
        E.monthly_comparison(sim, sim.withColumnRenamed("sim", "obs")).collect()


def test_blind_export_guard(spark):
    df = spark.createDataFrame([(1, 42.0)], "val_id int, height double")
    with pytest.raises(sinks.HiddenColumnError):
        sinks.blind_export(df, ["val_id"])
    with pytest.raises(ValueError):
        sinks.blind_export(df.drop("height"), ["val_id", "area"])
    assert sinks.blind_export(df.drop("height"), ["val_id"]).columns == ["val_id"]


def test_report_csv_comments_and_mark(spark, tmp_path):
    p = tmp_path / "r.csv"
    p.write_text("﻿# made by a job\n# second line\nband,n\n1-3,5\n", encoding="utf-8")
    rows = S.read_report_csv(spark, str(p), "band string, n int").collect()
    assert [tuple(r) for r in rows] == [("1-3", 5)]


def test_spatial_folds_keep_cells_together(spark):
    df = spark.createDataFrame([(k, float(k % 13) * 5000 + 1, 1.0) for k in range(130)], "id int, x double, y double")
    f = M.spatial_folds(M.with_cell(df, "x", "y"))
    assert f.groupBy("cell").agg(F.count_distinct("fold").alias("n")).where("n > 1").count() == 0
    per = [r["count"] for r in f.groupBy("fold").count().collect()]
    assert len(per) == 5 and max(per) - min(per) <= 10


def test_folds_are_dealt_without_labels_and_features(spark, small, monkeypatch):
    from cityloom.plans import model as P
    from cityloom.sources.views import Inputs

    def wide(*_):
        raise AssertionError("folds need places only")

    for name in ("master", "parcels", "feature_rows"):
        monkeypatch.setattr(P, name, wide)
    assert P.b7_spatial_folds(Inputs(spark, small)).columns == ["val_id", "bid", "cell", "fold"]


def test_bootstrap_interval_holds_the_estimate(spark):
    df = spark.createDataFrame([(k, k % 4 != 0, 1.0 + k % 3) for k in range(200)], "id bigint, h boolean, w double")
    r = R.poisson_bootstrap(df, "id", F.col("h"), F.lit(1.0), 2000, 1).first()
    assert r["value"] == 0.75 and r["ci95_lo"] < 0.75 < r["ci95_hi"]
    assert r["ci95_hi"] - r["ci95_lo"] == pytest.approx(2 * 1.96 * (0.75 * 0.25 / 200) ** 0.5, rel=0.15)
    assert r == R.poisson_bootstrap(df.repartition(5), "id", F.col("h"), F.lit(1.0), 2000, 1).first()


def test_forest_learns_and_repeats(spark):
    from pyspark.ml.linalg import Vectors

    rows = [(k, k, "a" if k % 2 else "b", Vectors.dense([float(k % 2), float(k)])) for k in range(60)]
    df = spark.createDataFrame(rows, ["val_id", "bid", "truth_arch", "features"]).withColumn("fold", (F.col("bid") % 5).cast("int"))
    labels = M.class_labels(df)
    a = [tuple(r) for r in M.predict(M.fit_forest(df, labels, 20), df, labels, ["bid"]).orderBy("bid").collect()]
    b = [tuple(r) for r in M.predict(M.fit_forest(df, labels, 20), df, labels, ["bid"]).orderBy("bid").collect()]
    assert a == b and all(0.5 <= r[2] <= 1.0 for r in a)
    assert M.out_of_fold(df, labels, 5, 10).where("pred_class = truth_arch").count() == 60


def test_labelling_list_is_disjoint(spark):
    rows = [(k, "hotel" if k % 5 == 0 else "sport_culture" if k % 5 == 1 else "office", k % 5 == 1, float(k % 97), k % 40, "ab"[k % 2], (k * 7919 % 1000) / 1000, float(k))
            for k in range(1500)]
    df = spark.createDataFrame(rows, "bid bigint, archetype string, bundled_label boolean, area_m2 double, floors int, pred_class string, pred_confidence double, x double")
    matched = spark.createDataFrame([(9, 5), (96, 6), (7, 7), (8, 8)], "val_id int, bid bigint")
    out = R.labelling_list(df, matched, [9, 96], {"lingang": F.col("x") < 300, "zhangjiang": F.col("x") > 1200}, 1).collect()
    per = {}
    for r in out:
        per[r["stratum"]] = per.get(r["stratum"], 0) + 1
    assert len({r["bid"] for r in out}) == len(out) and not {7, 8} & {r["bid"] for r in out}
    assert per["reassess_9"] == 1 and per["hotel_high_conf"] == 8 and per["hotel_low_conf"] == 8
    assert [per[f"sport_culture_fp_q{k}"] for k in (1, 2, 3, 4)] == [5, 5, 4, 4]
    assert all(per[s] == 7 for s in ("floors_1_3", "floors_4_6", "floors_7_9", "floors_10_18", "floors_19_32", "floors_33plus"))
    assert per["low_conf_lingang"] == 10 and per["low_conf_zhangjiang"] == 10 and per["low_conf_citywide"] == 20


def test_confidence_bins_at_edges(spark):
    df = spark.createDataFrame([(0.0,), (0.1,), (0.3,), (0.7,), (1.0,)], "pred_confidence double")
    got = {r["bin"]: r["n"] for r in V.confidence_histogram(df).collect()}
    assert got == {0: 1, 1: 1, 2: 0, 3: 1, 4: 0, 5: 0, 6: 0, 7: 1, 8: 0, 9: 1}
    assert statistics.fmean(got.values()) == 0.5


def _nearest_brute(asks, spots, same):
    out = {}
    for px, py in asks:
        best = min(((math.hypot(px - x, py - y), k) for k, (x, y) in enumerate(spots) if not same or (x, y) != (px, py)), default=None)
        if best:
            out[px, py] = best
    return out


@pytest.mark.parametrize("shape, same", [("even", True), ("even", False), ("hot cell", True), ("hot cell", False), ("far apart", True), ("one", True), ("one", False)])
def test_quadtree_finds_the_nearest(spark, shape, same):
    from cityloom.operators import quadtree

    rng = random.Random(len(shape))
    if shape == "even":
        pts = [(rng.random() * 1000, rng.random() * 1000) for _ in range(400)]
    elif shape == "hot cell":  # most spots within a millimetre-wide corner
        pts = [(rng.random() * 0.5, rng.random() * 0.5) for _ in range(400)] + [(1000.0 * k, 900.0 * k) for k in range(1, 8)]
    elif shape == "far apart":
        pts = [(0.0, 0.0), (0.0, 1.0), (1e6, 1e6), (5e5, 3.0), (1e6, 0.0)]
    else:
        pts = [(3.0, 4.0)]
    pts = list(dict.fromkeys(pts))
    asks = pts if same else [(rng.uniform(-500, 1500), rng.uniform(-500, 1500)) for _ in range(60)] + pts[:5]
    spots = spark.createDataFrame([(x, y, k) for k, (x, y) in enumerate(pts)], "_tx double, _ty double, id int")
    tree = quadtree.build(spots)
    assert tree.spots.count() == len(pts)
    most = tree.spots.groupBy(*quadtree.KEY).count().agg(F.max("count")).first()[0]
    assert most <= quadtree.CAPACITY
    rows = quadtree.nearest(tree, spark.createDataFrame(asks, "_px double, _py double").distinct(), same, ["id"]).collect()
    want = _nearest_brute(asks, pts, same)
    assert {(r._px, r._py): r.id for r in rows} == {k: i for k, (_, i) in want.items()}
    assert all(r.dist == pytest.approx(want[r._px, r._py][0], rel=1e-12) for r in rows)


def test_quadtree_reads_only_reachable_cells(spark):
    """A hot corner far from every asker: its spots never meet an asker beyond its nearest leaf."""
    from cityloom.operators import quadtree

    pts = [(k / 1000.0, (k * 7 % 1000) / 1000.0) for k in range(1000)] + [(100.0, 100.0), (100.0, 101.0)]
    tree = quadtree.build(spark.createDataFrame(pts, "_tx double, _ty double"))
    bounds = quadtree._first_bounds(tree, spark.createDataFrame([(100.0, 100.5)], "_px double, _py double"), 1).collect()
    assert [round(b._bound, 6) for b in bounds] == [0.5]
    assert quadtree.build(spark.createDataFrame([], "_tx double, _ty double")) is None


def test_many_near_identical_rows_stay_linear(spark):
    """5,000 rows in two neighbouring buckets: boxes link them, no pair of rows is made; groups are told apart by (group, id)."""
    rng = random.Random(1)
    rows = [(k, 125.0 + rng.uniform(-60, 60), 10.0 + rng.uniform(-5, 5), 500.0 + rng.uniform(-1, 1), 30.0 + rng.uniform(-0.01, 0.01)) for k in range(5000)]
    df = spark.createDataFrame(rows, "id bigint, x double, y double, area double, height double")
    kinds = df.withColumn("node", F.when(F.col("x") < 125, 0).otherwise(1))
    assert [tuple(r) for r in dedup.touching_buckets(kinds, []).collect()] == [(0, 1)]
    both = df.withColumn("g", F.lit("a")).unionByName(df.where("id % 2 = 0").withColumn("g", F.lit("b")))
    got = dedup.same_model_clusters(both, ["g"]).groupBy("g").agg(F.count_distinct("cluster_root").alias("n"), F.min("cluster_root").alias("low")).orderBy("g").collect()
    assert [tuple(r) for r in got] == [("a", 1, 0), ("b", 1, 0)]


def test_buckets_meet_once_from_few_copies(spark):
    """Boxes are offered in a few cells each (about twenty when every neighbour cell got a copy), and no touching pair is lost or doubled."""
    rng = random.Random(9)
    rows = [(k, rng.uniform(-4000, 4000), rng.uniform(-4000, 4000), rng.uniform(60, 250), rng.choice([12.0, 12.5, 13.0, 30.0])) for k in range(1500)]
    kinds = spark.createDataFrame(rows, "node bigint, x double, y double, area double, height double")
    boxes = dedup._boxed(kinds, [], 0)
    assert dedup._offered(boxes).count() < 6 * boxes.count()
    some, _ = dedup._least_and_most()
    got = [(min(r.a_node, r.b_node), max(r.a_node, r.b_node)) for r in dedup.near_buckets(kinds, []).where(some).collect()]
    want = {
        (p[0], q[0]) for p in rows for q in rows
        if p[0] < q[0] and abs(p[4] - q[4]) <= 0.5 and abs(p[3] - q[3]) / max(p[3], q[3]) <= 0.05 and math.hypot(p[1] - q[1], p[2] - q[2]) <= 250
    }
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 100


def test_undecided_buckets_are_refined(spark):
    """Two buckets whose boxes say nothing: one pair of rows within the limits links them, else they stay apart."""
    west, east = [(0.0, 0.0), (120.0, 0.0)], [(371.0, 0.0), (480.0, 0.0)]
    for extra, linked in (([], False), ([(121.5, 0.0)], True)):
        rows = [(x, y, 500.0, 30.0, 0) for x, y in west + extra] + [(x, y, 500.0, 30.0, 9) for x, y in east]
        kinds = spark.createDataFrame(rows, "x double, y double, area double, height double, node int")
        assert (dedup.touching_buckets(kinds, []).count() == 1) == linked


def test_ingest_knows_earlier_keys_without_state(spark, tmp_path):
    from cityloom.streaming import poi_stream as ST

    src, out, log, counts = (str(tmp_path / n) for n in ("src", "out", "log", "counts"))
    row = "named_struct('event_id', id, 'ts', timestamp'2024-01-01 10:00:00', 'event_type', if(id % 2 = 0, 'a', 'b'), 'value', 1.0D, 'cell_id', 1, 'capped', false)"
    for lo, hi in ((0, 60), (40, 100)):  # the second delivery repeats twenty keys, and every key twice
        spark.range(lo, hi).unionByName(spark.range(lo, hi)).select(F.expr(row).alias("r")).select("r.*").write.mode("append").json(src)
        ST.ingest(ST.read_records(spark, src, files_per_batch=3), "event_id", out, log, counts, F.col("event_type"))
        ids = [r.event_id for r in spark.read.parquet(out).select("event_id").collect()]
        assert sorted(ids) == list(range(hi))
        assert {(r.kind, r.n) for r in ST.totals(spark, counts).collect()} == {("a", hi // 2), ("b", hi // 2)}
    assert not (tmp_path / "log" / "state").exists()  # no state is kept
    # a micro-batch that is repeated after a failure finds the same rows
    records = spark.read.schema(ST.RECORD).json(src).where("event_id < 3")
    assert ST.new_rows(records, "event_id", out, 0).count() == 3 and ST.new_rows(records, "event_id", out, 99).count() == 0


def test_name_index_finds_what_contains_finds(spark):
    from cityloom.operators import poi

    names = ["green hall", "hall", "h", "", None, "Green", "xhally", "绿地大厦"]
    rows = [(k, n, 10.0 * k, 0.0) for k, n in enumerate(names)] + [(99, "hall", 500.0, 0.0)]
    pois = spark.createDataFrame(rows, "id int, name string, x double, y double")
    pts = spark.createDataFrame([(1, 0.0, 0.0, ["hall"]), (2, 0.0, 0.0, ["h"]), (3, 0.0, 0.0, []), (4, 0.0, 0.0, ["绿地", "green", ""]), (5, 900.0, 900.0, ["hall"])], "val_id int, x double, y double, tok array<string>")
    df = poi.token_matches(pts, pois, "tok", 100.0)
    got = {r.val_id: (r.n_near, r.n_match, r.first_ids) for r in df.collect()}
    assert got == {1: (8, 3, "0,1,6"), 2: (8, 4, "0,1,2"), 3: (8, 0, None), 4: (8, 2, "0,7"), 5: (0, 0, None)}
    assert "_gram" in df._jdf.queryExecution().optimizedPlan().toString()


def test_report_csv_is_one_report(spark, tmp_path):
    df = spark.createDataFrame([(1, "a,b", 1.5), (2, None, None), (3, 'say "x"', 2.0)], "id int, name string, v double").repartition(3)
    sinks.write_commented_csv(df, str(tmp_path / "r"), ["line one", "line two"])
    assert sorted(map(tuple, S.read_report_csv(spark, str(tmp_path / "r"), "id int, name string, v double").collect())) == [(1, "a,b", 1.5), (2, None, None), (3, 'say "x"', 2.0)]
