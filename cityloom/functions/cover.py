"""Cells of a grid that a polygon covers whole, and those its outline crosses with just the edges a point there must be tested on.

The number of outline crossings to the right decides whether a point is inside. Within one cell, edges left of it never
count, edges beyond its right side that span its whole height always do (their number's parity is kept), and only the
others are stored. Results equal the test on the whole polygon to the last bit, because stored edges are the original ones.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, types as T
from pyspark.sql.functions import arrow_udf

from cityloom.functions.geometry import _Edges

cloudpickle.register_pickle_by_value(sys.modules[__name__])

EDGES = "array<struct<x:double,y:double,x2:double,y2:double>>"
COVER = f"_cx bigint, _cy bigint, _full boolean, _odd boolean, _edges {EDGES}"
_MARGIN = 1e-6


def _runs(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of each range ``lo..hi`` (inclusive, may be empty), repeated, with its members."""
    n = np.maximum(hi - lo + 1, 0)
    i = np.repeat(np.arange(len(n)), n)
    return i, lo[i] + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)


def _cover(e: _Edges, size: float):
    """Polygon, column, row, and for crossed cells parity, edge numbers and how many edges; the crossed cells come first."""
    low, high = np.minimum(e.y, e.y2), np.maximum(e.y, e.y2)
    edge, band = _runs(np.floor(low / size).astype(np.int64), np.floor(high / size).astype(np.int64))
    bottom, top = band * size, (band + 1) * size
    x, y, dx, dy = e.x[edge], e.y[edge], (e.x2 - e.x)[edge], (e.y2 - e.y)[edge]
    flat = dy == 0
    slope = dx / np.where(flat, 1.0, dy)
    at = [np.where(flat, end, x + slope * (np.clip(v, low[edge], high[edge]) - y)) for v, end in ((bottom, x), (top, x + dx))]
    margin = _MARGIN * size
    left, right = np.minimum(*at) - margin, np.maximum(*at) + margin
    poly = e.row[edge]
    # crossed cells
    i, col = _runs(np.floor(left / size).astype(np.int64), np.floor(right / size).astype(np.int64))
    crossed = np.unique(np.stack([poly[i], band[i], col], 1), axis=0) if len(i) else np.zeros((0, 3), np.int64)
    # cells between an odd and the next even crossing of the middle of their row are inside, unless crossed
    middle = (band + 0.5) * size
    cut = (y > middle) != (y + dy > middle)
    order = np.lexsort(((x + slope * (middle - y))[cut], band[cut], poly[cut]))
    xs, bands, polys = ((v[cut])[order] for v in (x + slope * (middle - y), band, poly))
    i, col = _runs(np.floor(xs[::2] / size).astype(np.int64) + 1, np.floor(xs[1::2] / size).astype(np.int64) - 1)
    inner = np.stack([polys[::2][i], bands[::2][i], col], 1) if len(i) else np.zeros((0, 3), np.int64)
    if len(inner) and len(crossed):
        both = np.concatenate([crossed, inner])
        _, first = np.unique(both, axis=0, return_index=True)
        inner = both[np.sort(first[first >= len(crossed)])]
    # edges of the row that matter to a crossed cell
    rank = np.lexsort((band, poly))
    key = poly[rank] * np.int64(1 << 40) + band[rank]
    want = crossed[:, 0] * np.int64(1 << 40) + crossed[:, 1]
    k, place = _runs(np.searchsorted(key, want, "left"), np.searchsorted(key, want, "right") - 1)
    pair, column = rank[place], crossed[k, 2]
    near = right[pair] >= column * size
    always = (left[pair] >= (column + 1) * size) & (low[edge[pair]] <= bottom[pair]) & (high[edge[pair]] >= top[pair])
    odd = np.bincount(k[near & always], minlength=len(crossed)) % 2 == 1
    keep = near & ~always
    return crossed, inner, odd, edge[pair[keep]], np.bincount(k[keep], minlength=len(crossed))


def covering(size: float, geom: str):
    """For ``mapInArrow``: the rows of polygons, one per cell of side ``size``, with the columns of ``COVER``."""

    def run(batches):
        for batch in batches:
            e = _Edges(batch.column(geom))
            if not np.isfinite(e.x).all() or not np.isfinite(e.y).all():
                raise ValueError("a polygon has a vertex without finite coordinates")
            crossed, inner, odd, edges, count = _cover(e, size)
            cells = np.concatenate([crossed, inner])
            rows = batch.take(pa.array(cells[:, 0]))
            offsets = np.concatenate([[0], np.cumsum(count), np.full(len(inner), count.sum())])
            flat = pa.StructArray.from_arrays([pa.array(v[edges]) for v in (e.x, e.y, e.x2, e.y2)], ["x", "y", "x2", "y2"])
            full = np.arange(len(cells)) >= len(crossed)
            yield pa.RecordBatch.from_arrays(
                [
                    *(rows.column(n) for n in rows.schema.names if n != geom),
                    pa.array(cells[:, 2]),
                    pa.array(cells[:, 1]),
                    pa.array(full),
                    pa.array(np.concatenate([odd, np.zeros(len(inner), bool)])),
                    pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat),
                ],
                names=[*(n for n in rows.schema.names if n != geom), "_cx", "_cy", "_full", "_odd", "_edges"],
            )

    return run


def _holds(edges: pa.Array, odd: np.ndarray, qx: np.ndarray, qy: np.ndarray) -> np.ndarray:
    count = np.diff(edges.offsets.to_numpy())
    flat = edges.flatten()
    x, y, x2, y2 = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("x", "y", "x2", "y2"))
    row = np.repeat(np.arange(len(count)), count)
    px, py, dx, dy = qx[row], qy[row], x2 - x, y2 - y
    with np.errstate(divide="ignore", invalid="ignore"):
        cross = ((y > py) != (y2 > py)) & (px < dx * (py - y) / dy + x)
    on = dx * (py - y) == dy * (px - x)
    on &= (px >= np.minimum(x, x2)) & (px <= np.maximum(x, x2)) & (py >= np.minimum(y, y2)) & (py <= np.maximum(y, y2))
    crossings = np.bincount(row, weights=cross, minlength=len(count)) + odd
    return (crossings % 2 == 1) & (np.bincount(row, weights=on, minlength=len(count)) == 0)


@arrow_udf(T.BooleanType())
def in_any_part(parts: pa.Array, px: pa.Array, py: pa.Array) -> pa.Array:
    """Point strictly inside one of the ``array<struct<odd, edges>>`` of its cell; boundary points are outside."""
    n = np.diff(parts.offsets.to_numpy())
    flat = parts.flatten()
    row = np.repeat(np.arange(len(n)), n)
    qx, qy = (c.to_numpy(zero_copy_only=False).astype(float)[row] for c in (px, py))
    inside = _holds(flat.field("edges"), flat.field("odd").to_numpy(zero_copy_only=False), qx, qy)
    return pa.array(np.bincount(row, weights=inside, minlength=len(n)) > 0)


def cell(value: Column, size: float) -> Column:
    from pyspark.sql import functions as F

    return F.floor(value / size).cast("bigint")
