"""Building features: shape, scale, neighbourhood, parcel, and the model matrix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cityloom import rules
from cityloom.functions import geometry as G, ranks
from cityloom.operators import spatial
from cityloom.operators.quantiles import exact_quantiles
from cityloom.operators.skew import balanced_join, with_group_stats
from cityloom.session import cut_lineage


def convexity(buildings: DataFrame) -> DataFrame:
    """Area over hull area; 1 where the hull has none."""
    h = buildings.withColumn("_h", G.hull_measures("geom"))
    ratio = F.when(F.col("_h.hull_area") > 0, F.col("area_m2") / F.greatest(F.col("_h.hull_area"), F.lit(1e-9)))
    return h.withColumn("convexity", F.coalesce(ratio, F.lit(1.0))).drop("_h")


def _fill_with(df: DataFrame, column: str, value: Column, where: Column | None = None) -> DataFrame:
    """Fill nulls of ``column`` with the exact median of ``value`` over the rows ``where`` (one broadcast row)."""
    base = df if where is None else df.where(where)
    med = exact_quantiles(base, value, [0.5]).agg(F.max("value").alias("_med"))
    return df.crossJoin(F.broadcast(med)).withColumn(column, F.coalesce(F.col(column), "_med")).drop("_med")


def aspect_ratio(buildings: DataFrame) -> DataFrame:
    """Sides of the minimum rotated rectangle; degenerate footprints get the global median."""
    h = buildings.withColumn("_h", G.hull_measures("geom"))
    long_side, short_side = F.col("_h.long_side"), F.col("_h.short_side")
    ok = ~F.isnan(short_side) & (short_side >= rules.ASPECT_MIN_SIDE_M)
    h = h.withColumn("aspect_ratio", F.when(ok, long_side / F.greatest(short_side, F.lit(1e-9)))).drop("_h")
    return _fill_with(cut_lineage(h.select("bid", "aspect_ratio")), "aspect_ratio", F.col("aspect_ratio"))


def shape_features(buildings: DataFrame) -> DataFrame:
    """``perimeter_m, compactness, convexity, aspect_ratio`` with one hull pass."""
    h = buildings.withColumn("_h", G.hull_measures("geom"))
    ratio = F.when(F.col("_h.hull_area") > 0, F.col("area_m2") / F.greatest(F.col("_h.hull_area"), F.lit(1e-9)))
    ok = ~F.isnan("_h.short_side") & (F.col("_h.short_side") >= rules.ASPECT_MIN_SIDE_M)
    out = h.select(
        "bid",
        "perimeter_m",
        G.compactness(F.col("area_m2"), F.col("perimeter_m")).alias("compactness"),
        F.coalesce(ratio, F.lit(1.0)).alias("convexity"),
        F.when(ok, F.col("_h.long_side") / F.greatest(F.col("_h.short_side"), F.lit(1e-9))).alias("aspect_ratio"),
    )
    # the median needs two more passes; the narrow measures are stored so the hulls are built once
    return _fill_with(cut_lineage(out), "aspect_ratio", F.col("aspect_ratio"))


def scale_features(master: DataFrame) -> DataFrame:
    """Floors with supertall gaps filled by the supertall median, floor area, supertall flag as number."""
    base = master.select("bid", "area_m2", "floors", "is_supertall", F.col("floors").cast("double").alias("floors_feat"))
    tall = F.col("is_supertall") & F.col("floors").isNotNull()
    out = _fill_with(base, "floors_feat", F.col("floors"), tall)
    return out.select(
        "bid",
        "floors_feat",
        (F.col("area_m2") * F.col("floors_feat")).alias("gfa_m2"),
        F.col("is_supertall").cast("int").alias("is_supertall_int"),
    )


#: side of a tile in radii, and asking spots that a block of a tile holds on average
TILE_RADII = 4.0
BLOCK_SPOTS = 512


def neighbour_stats(master: DataFrame, radius: float = rules.NEIGHBOUR_RADIUS_M, block: int = BLOCK_SPOTS) -> DataFrame:
    """``bid, n_bld_100m, nbr_fp_med_m2``: neighbours within ``radius`` and their median footprint, 0 without.

    Rows are first collapsed to (spot, footprint) with a multiplicity, so stacked copies are met once. The spots of a
    tile are dealt out to blocks of bounded size; whatever lies around the tile passes by each block in order of
    footprint, once to count each spot's neighbours and once to step through the ranks to the middle. No pair leaves a
    task. Rows without position or footprint are no neighbours and have none.
    """
    size = radius * TILE_RADII
    keys = ["rep_x", "rep_y", "area_m2"]
    known = master.where(F.col("rep_x").isNotNull() & F.col("rep_y").isNotNull() & F.col("area_m2").isNotNull())
    cols = [F.col(c).cast("double").alias(a) for c, a in zip(keys, ("x", "y", "value"), strict=True)]
    spots = cut_lineage(known.select(*cols).groupBy("x", "y", "value").agg(F.count(F.lit(1)).alias("n")))
    tile = {"tx": F.floor(F.col("x") / size), "ty": F.floor(F.col("y") / size)}
    tiles = cut_lineage(spots.withColumns(tile).groupBy("tx", "ty").agg(F.ceil(F.count(F.lit(1)) / F.lit(float(block))).cast("int").alias("parts")))
    place = F.pmod(F.xxhash64("x", "y", "value"), F.col("parts")).cast("int").alias("part")
    asks = balanced_join(spots.withColumns(tile), tiles, ["tx", "ty"]).select("tx", "ty", place, F.lit(ranks.ASK).alias("role"), "x", "y", "value", "n")

    def span(c: str) -> Column:
        return F.explode(F.sequence(F.floor((F.col(c) - radius) / size), F.floor((F.col(c) + radius) / size)))

    near = balanced_join(spots.withColumn("tx", span("x")).withColumn("ty", span("y")), tiles, ["tx", "ty"])
    near = near.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    near = near.select("tx", "ty", "part", F.explode(F.array(F.lit(ranks.COUNT), F.lit(ranks.PICK))).alias("role"), "x", "y", "value", "n")
    stream = asks.unionByName(near).repartition("tx", "ty", "part").sortWithinPartitions("tx", "ty", "part", "role", "value")
    stats = stream.mapInArrow(ranks.medians(radius), "x double, y double, value double, n long, median double")
    keyed = stats.select(*[F.col(a).alias(c) for c, a in zip(keys, ("x", "y", "value"), strict=True)], F.col("n").alias("_n"), F.col("median").alias("_med"))
    j = balanced_join(master.select("bid", *keys), cut_lineage(keyed), keys, "left")
    return j.select("bid", F.coalesce("_n", F.lit(0)).alias("n_bld_100m"), F.coalesce("_med", F.lit(0.0)).alias("nbr_fp_med_m2"))


def nearest_neighbour(master: DataFrame, start_radius: float = 32.0) -> DataFrame:
    pts = master.select("bid", F.col("rep_x").alias("x"), F.col("rep_y").alias("y"))
    nn = spatial.nearest_unbounded(pts, pts, "bid", "bid", same_table=True, out_id="_other")
    return nn.select("bid", F.col("dist").alias("nn_dist_m"))


def neighbourhood_features(master: DataFrame) -> DataFrame:
    return neighbour_stats(master).join(nearest_neighbour(master), "bid", "left")


def parcel_features(rows: DataFrame, parcels: DataFrame) -> DataFrame:
    """``bid, parcel_area_m2, n_bld_in_parcel, gfa_share_parcel, in_parcel`` from ``bid, parcel_id, gfa_m2``."""
    stats = {"n_bld_in_parcel": F.count(F.lit(1)), "_gfa": F.sum("gfa_m2")}
    j = with_group_stats(rows.select("bid", "parcel_id", "gfa_m2"), "parcel_id", stats)
    areas = parcels.select("parcel_id", F.col("area_m2").alias("parcel_area_m2"))
    j = balanced_join(j, areas, ["parcel_id"], "left")
    share = F.when(F.col("_gfa") > 0, F.col("gfa_m2") / F.col("_gfa"))
    return j.select(
        "bid",
        F.coalesce("parcel_area_m2", F.lit(0.0)).alias("parcel_area_m2"),
        F.coalesce("n_bld_in_parcel", F.lit(0)).alias("n_bld_in_parcel"),
        F.coalesce(share, F.lit(0.0)).alias("gfa_share_parcel"),
        F.col("parcel_id").isNotNull().cast("int").alias("in_parcel"),
    )


def class_agreement(a: DataFrame, b: DataFrame, key: str, column: str) -> DataFrame:
    """Share of rows where two joins give the same class, over rows where both give one."""
    j = a.select(key, F.col(column).alias("_a")).join(b.select(key, F.col(column).alias("_b")), key)
    both = j.where(F.col("_a").isNotNull() & F.col("_b").isNotNull())
    return both.agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("_a") == F.col("_b")).cast("double")).alias("agreement"))


NUMERIC = [
    "area_m2",
    "perimeter_m",
    "compactness",
    "aspect_ratio",
    "convexity",
    "floors_feat",
    "gfa_m2",
    "is_supertall_int",
    "n_bld_100m",
    "nbr_fp_med_m2",
    "nn_dist_m",
    "parcel_area_m2",
    "n_bld_in_parcel",
    "gfa_share_parcel",
    "in_parcel",
]


#: a category column with more codes than this is not a codebook
MAX_CODES = 10_000


def one_hot(df: DataFrame, column: str, prefix: str, codes: list[int]) -> tuple[DataFrame, list[str]]:
    """0/1 columns per code plus one for missing values."""
    cols = {f"{prefix}_{c}": F.coalesce((F.col(column) == c).cast("double"), F.lit(0.0)) for c in codes}
    cols[f"{prefix}_nan"] = F.col(column).isNull().cast("double")
    return df.withColumns(cols), list(cols)


def distinct_codes(df: DataFrame, column: str, most: int = MAX_CODES) -> list:
    """All category codes present in the data, at most ``most`` (the codebooks have 11 and 14 entries); more stop the job."""
    rows = df.where(F.col(column).isNotNull()).select(column).distinct().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"{column} has more than {most} codes")
    return sorted(r[0] for r in rows)


def feature_table(master: DataFrame, buildings: DataFrame, parcels: DataFrame) -> tuple[DataFrame, list[str]]:
    """One row per building with every model feature, and the ordered feature names."""
    scale = scale_features(master)
    base = master.select("bid", "area_m2", "rep_x", "rep_y", "euluc_class", "ep", "parcel_id").join(scale, "bid")
    out = base.join(shape_features(buildings), "bid").join(neighbourhood_features(master), "bid", "left")
    out = out.join(parcel_features(base, parcels), "bid")
    out, c1 = one_hot(out, "euluc_class", "euluc", distinct_codes(master, "euluc_class"))
    out, c2 = one_hot(out, "ep", "ep", distinct_codes(master, "ep"))
    names = NUMERIC + c1 + c2
    return out.select("bid", "rep_x", "rep_y", *[F.col(c).cast("double").alias(c) for c in names]), names


def require_finite(df: DataFrame, names: list[str]) -> DataFrame:
    """Stop the job on a null, NaN or infinite feature."""
    bad = F.lit(False)
    for c in names:
        v = F.col(c)
        bad = bad | v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    guard = F.when(bad, F.raise_error(F.concat(F.lit("feature not finite for "), F.col("bid").cast("string"))))
    return df.withColumn("_ok", guard.cast("boolean")).where(F.col("_ok").isNull()).drop("_ok")
