"""POI kinds, scan cells around labelled points, request budget, name matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from cityloom import rules
from cityloom.functions import geometry as G
from cityloom.operators import spatial
from cityloom.operators.skew import balanced_join
from cityloom.sources.tables import lookup

CELL_M = 500.0


def poi_kind(typecode: Column) -> Column:
    """Kind from the prefix of the whole code string, not of each part."""
    return (
        F.when(typecode.startswith("0601"), F.lit("mall"))
        .when(typecode.startswith("1001") | typecode.startswith("1002"), F.lit("hotel"))
        .otherwise(F.lit("other"))
    )


def first_by_keyword(poi: DataFrame, keywords: list[str]) -> DataFrame:
    """First POI (lowest id) whose name holds each keyword; nulls where there is none."""
    keys = lookup(poi.sparkSession, ["keyword"], [(k,) for k in keywords])
    words = F.array(*[F.lit(k) for k in keywords])
    tagged = poi.withColumn("keyword", F.explode(F.filter(words, lambda k: F.col("name").contains(k))))
    first = tagged.groupBy("keyword").agg(F.min_by(F.struct("id", "x", "y", "name"), "id").alias("_r"))
    return keys.join(first, "keyword", "left").select("keyword", "_r.*")


def cell_overlaps(cells: DataFrame, parcels: DataFrame, size: float = CELL_M) -> DataFrame:
    """Overlay of scan cells and parcels: ``cell_id, parcel_id, class, inter`` (area of the piece)."""
    return spatial.overlap_pairs(cells, parcels, size, "cell_id", "parcel_id", ["class"]).select(
        "cell_id", "parcel_id", "class", "inter"
    )


def cell_metadata(cells: DataFrame, parcels: DataFrame) -> DataFrame:
    """Hectares of target land use per cell and whether any of it is business or commercial."""
    target = parcels.where(F.col("class").isin(rules.TARGET_CLASSES))
    o = cell_overlaps(cells, target)
    return o.groupBy("cell_id").agg(
        (F.sum("inter") / 1e4).alias("area_ha"), F.bool_or(F.col("class").isin(rules.DENSE_CLASSES)).alias("dense")
    )


def request_budget(meta: DataFrame, extra_pages: float, budget: float) -> DataFrame:
    """Cells, dense cells and estimated requests per area threshold; the first feasible threshold is marked."""
    th = F.explode(F.array(*[F.lit(t) for t in rules.AREA_THRESHOLDS_HA])).alias("threshold_ha")
    per = meta.select(th, "area_ha", "dense").groupBy("threshold_ha").agg(
        F.count_if(F.col("area_ha") >= F.col("threshold_ha")).alias("n_cells"),
        F.count_if((F.col("area_ha") >= F.col("threshold_ha")) & F.col("dense")).alias("n_dense"),
    )
    est = F.floor((F.col("n_cells") + F.col("n_dense") * extra_pages * 0.5) * rules.REQUEST_BUFFER)
    per = per.withColumn("estimate", est).withColumn("feasible", F.col("estimate") <= budget - rules.REQUEST_RESERVE)
    go = per.agg(F.min(F.when(F.col("feasible"), F.col("threshold_ha"))).alias("_go"))
    return per.crossJoin(F.broadcast(go)).withColumn(
        "chosen", F.coalesce(F.col("threshold_ha") == F.col("_go"), F.lit(False))
    ).drop("_go")


def work_list(meta: DataFrame, done: DataFrame, threshold_ha: float) -> DataFrame:
    """Cells still to scan, dense ones first, then by area."""
    todo = meta.where(F.col("area_ha") >= threshold_ha).join(done, "cell_id", "left_anti")
    return todo.orderBy(F.col("dense").desc(), F.col("area_ha").desc(), "cell_id")


def point_cells(points: DataFrame, cells: DataFrame) -> DataFrame:
    """Scan cell holding each labelled point: ``val_id, cell_id``."""
    pts = points.select("val_id", F.col("x").alias("p_x"), F.col("y").alias("p_y"))
    return spatial.points_within(pts, cells, CELL_M, "p_x", "p_y", "val_id", "cell_id", [])


def point_status(points: DataFrame, cells: DataFrame, done: DataFrame) -> DataFrame:
    """outside, scanned or dropped per labelled point."""
    hit = point_cells(points, cells)
    flags = done.select("cell_id", F.lit(True).alias("_done"))
    j = points.select("val_id", "status", "archetype").join(hit, "val_id", "left").join(flags, "cell_id", "left")
    state = F.when(F.col("cell_id").isNull(), F.lit("outside")).when(F.col("_done"), F.lit("scanned")).otherwise(F.lit("dropped"))
    return j.select("val_id", "status", "archetype", "cell_id", state.alias("scan_status"))


def cells_around(points: DataFrame, cells: DataFrame, poi_counts: DataFrame, radius: float) -> DataFrame:
    """Cells within ``radius`` of each point with POI counts per kind (0 where a cell has none)."""
    pts = points.select("val_id", F.col("x").alias("p_x"), F.col("y").alias("p_y"))
    shapes = cells.select("cell_id", "geom", *spatial.BOX)
    pairs = spatial.point_polygon_pairs(pts, shapes, 4 * CELL_M, "p_x", "p_y", "val_id", radius)
    near = pairs.withColumn("dist", G.distance("geom", "p_x", "p_y").dist).where(F.col("dist") <= radius)
    out = near.select("val_id", "cell_id", "dist").join(poi_counts, "cell_id", "left")
    return out.na.fill(0, ["n_poi", "n_mall", "n_hotel"])


def counts_by_cell(poi_cells: DataFrame) -> DataFrame:
    kind = poi_kind(F.col("typecode"))
    return poi_cells.groupBy("cell_id").agg(
        F.count(F.lit(1)).alias("n_poi"), F.count_if(kind == "mall").alias("n_mall"), F.count_if(kind == "hotel").alias("n_hotel")
    )


def nearest_of_kind(points: DataFrame, poi: DataFrame, kind: str, start_radius: float = 100.0) -> DataFrame:
    """Nearest POI of one kind at any distance, the lowest id of equally near ones: its row with ``val_id`` and ``dist``."""
    own = poi.where(poi_kind(F.col("typecode")) == kind)
    hit = spatial.nearest_unbounded(points.select("val_id", "x", "y"), own.select("id", "x", "y"), "val_id", "id")
    return hit.join(own, "id").select("val_id", "dist", *own.columns)


def nearest_of_code(points: DataFrame, poi: DataFrame, prefix: str, start_radius: float = 100.0) -> DataFrame:
    targets = poi.where(F.col("typecode").startswith(prefix)).select("id", "x", "y")
    return spatial.nearest_unbounded(points.select("val_id", "x", "y"), targets, "val_id", "id")


# Bracketed text and stop words removed from a name, and the shape of a usable token.
NAME_STRIP = r"[((].*?[))]|上海市?|广场|购物中心|商场|大厦"
TOKEN_PATTERN = "[\\u4e00-\\u9fff]{2,}"


def clean_token(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, NAME_STRIP, ""))


def name_tokens(text: Column, pattern: str = TOKEN_PATTERN) -> Column:
    """Usable tokens of a name after its stop words are gone: a list, empty when nothing usable is left."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(F.regexp_replace(text, NAME_STRIP, " "), F.lit("")), F.lit(f"({pattern})"), F.lit(1)))


def _grams(text: Column) -> Column:
    """The distinct characters and pairs of adjacent characters of a text."""
    ones = F.transform(F.sequence(F.lit(1), F.length(text)), lambda k: F.substring(text, k, F.lit(1)))
    twos = F.transform(F.sequence(F.lit(1), F.length(text) - 1), lambda k: F.substring(text, k, F.lit(2)))
    return F.when(F.length(text) > 1, F.array_distinct(F.concat(ones, twos))).when(F.length(text) == 1, F.array(text))


def name_index(poi: DataFrame, cell: float) -> DataFrame:
    """Postings of POI names: ``_cx, _cy, _gram, id, name, q_x, q_y``, a row per distinct gram of a name."""
    at = [F.floor(F.col(c) / cell).alias(f"_c{c}") for c in "xy"]
    return poi.select(*at, F.explode(_grams(F.col("name"))).alias("_gram"), "id", "name", F.col("x").alias("q_x"), F.col("y").alias("q_y"))


def token_matches(points: DataFrame, poi: DataFrame, token: str, radius: float, keep: int = 3) -> DataFrame:
    """POIs within ``radius`` whose name holds one of the point's tokens: number near, number matching, first few ids.

    ``token`` is a list column, see :func:`name_tokens`; a point without a token matches nothing. Tokens meet the names of
    their surroundings through :func:`name_index`, by cell and the token's first two characters; only those names are
    searched. Counts and the lowest ids are map-side combined; no per-point list is built.
    """
    spots = points.select("val_id", F.col("x").alias("p_x"), F.col("y").alias("p_y"))
    near = spatial.radius_pairs(spots, poi.select("id", F.col("x").alias("q_x"), F.col("y").alias("q_y")), radius, ("p_x", "p_y"), ("q_x", "q_y"))
    counts = near.groupBy("val_id").agg(F.count(F.lit(1)).alias("n_near"))
    asks = points.select("val_id", F.col("x").alias("p_x"), F.col("y").alias("p_y"), F.explode(token).alias("_tok")).where(F.length("_tok") > 0)
    asks = asks.withColumn("_gram", F.substring("_tok", 1, 2))
    for c in "xy":
        cell = F.floor(F.col(f"p_{c}") / radius)
        asks = asks.withColumn(f"_c{c}", F.explode(F.sequence(cell - 1, cell + 1)))
    met = balanced_join(name_index(poi, radius), asks, ["_cx", "_cy", "_gram"])
    hit = met.where((F.hypot(F.col("p_x") - F.col("q_x"), F.col("p_y") - F.col("q_y")) <= radius) & F.col("name").contains(F.col("_tok")))
    hit = hit.select("val_id", "id").distinct()
    matched = hit.groupBy("val_id").agg(F.count(F.lit(1)).alias("n_match"))
    rank = F.row_number().over(Window.partitionBy("val_id").orderBy("id"))
    top = hit.withColumn("_r", rank).where(F.col("_r") <= keep)
    firsts = top.groupBy("val_id").agg(F.array_join(F.sort_array(F.collect_list("id")), ",").alias("first_ids"))
    j = points.select("val_id").join(counts, "val_id", "left").join(matched, "val_id", "left").join(firsts, "val_id", "left")
    return j.select("val_id", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.coalesce("n_match", F.lit(0)).alias("n_match"), "first_ids")


def category_counts(hits: DataFrame, codes: DataFrame) -> DataFrame:
    """Distinct POI codes that touch a building, with POI and building counts."""
    j = hits.select("id", "bid").join(codes, "id")
    return j.groupBy("code").agg(F.count_distinct("id").alias("n_poi"), F.count_distinct("bid").alias("n_buildings"))


def category_entropy(hits: DataFrame, codes: DataFrame) -> DataFrame:
    """Shannon entropy of the POI codes attached to each building."""
    j = hits.select("id", "bid").join(codes, "id")
    per = j.groupBy("bid", "code").agg(F.count(F.lit(1)).cast("double").alias("_n"))
    # H = ln(total) - sum(n ln n) / total, so no second join is needed
    return per.groupBy("bid").agg((F.log(F.sum("_n")) - F.sum(F.col("_n") * F.log("_n")) / F.sum("_n")).alias("entropy"))


def votes_fallback(buildings: DataFrame, hits: DataFrame, coded: DataFrame) -> DataFrame:
    """Why a building gets no POI label: no POI at all, or only codes without a vote."""
    j = hits.select("id", "bid").join(coded, "id")
    per = j.groupBy("bid").agg(F.bool_and(F.col("vote").isNull()).alias("_skip"))
    out = buildings.select("bid").join(per, "bid", "left")
    reason = F.when(F.col("_skip").isNull(), F.lit("no_poi_hit")).when(F.col("_skip"), F.lit("all_skip_hits"))
    return out.withColumn("reason", reason).where(F.col("reason").isNotNull()).select("bid", "reason")
