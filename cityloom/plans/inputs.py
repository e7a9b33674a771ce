"""Shared building blocks of the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cityloom.functions import geometry as G
from cityloom.operators import labelling as L
from cityloom.sources import tables as S
from cityloom.sources.views import Inputs, stored


PREP_CELL_M = 500.0


def _spatial_order(df: DataFrame, key: str) -> DataFrame:
    """Outlines near each other (by their first vertex) end up in the same file. The key is part of the range order, so even a
    single crowded cell is split over several partitions. Ranges are sampled by a pass of its own, so measures come after."""
    first = F.get(F.get("geom", F.lit(0)), F.lit(0))
    cell = [F.floor(first[c] / PREP_CELL_M).alias(f"_c{c}") for c in ("y", "x")]
    ranged = df.select("*", *cell).repartitionByRange("_cy", "_cx", key)
    return ranged.sortWithinPartitions("_cy", "_cx", key).drop("_cy", "_cx")


def shaped(i: Inputs) -> DataFrame:
    """2026 footprints with their measures, computed from the source."""
    return G.with_shape(i.buildings())


def buildings(i: Inputs) -> DataFrame:
    """The prepared footprint table: outlines, measures and interior points, stored once."""
    return stored(i, "footprints", lambda: G.with_shape(_spatial_order(i.buildings(), "bid")), ("orders",))


def slim(i: Inputs) -> DataFrame:
    """Building measures without the outlines."""
    return buildings(i).drop("geom", *G.MEASURES[2:6])


def buildings_2023(i: Inputs) -> DataFrame:
    def build() -> DataFrame:
        return S.scan_buildings_2023(G.with_shape(_spatial_order(i.buildings_2023(), "bid23")))

    return stored(i, "footprints-2023", build, ("orders",))


def parcels(i: Inputs) -> DataFrame:
    return G.with_shape(i.parcels())


def build_master(i: Inputs) -> DataFrame:
    return L.build_master(buildings(i), buildings_2023(i), parcels(i), i.view("poi"))


def master(i: Inputs) -> DataFrame:
    """The labelled building table, stored once; reports and features read it back."""
    return stored(i, "master", lambda: build_master(i))


def annotated_master(i: Inputs) -> DataFrame:
    return L.evaluated(i.view("truth"), buildings(i), master(i))
