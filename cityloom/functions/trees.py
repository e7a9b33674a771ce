"""Classification trees over binned features: grown level by level and applied as numpy blocks inside Arrow tasks."""

from __future__ import annotations

import sys
from typing import NamedTuple

import numpy as np
from pyspark import cloudpickle

# tasks get these functions with the plan, so executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: bits of a sort key for the multiplicity (more where rows are merged) and for the bin
_T_BITS, _B_BITS = 4, 6
MAX_BINS = 1 << (_B_BITS - 1)
#: scale of stored class shares: sums of whole numbers do not depend on their order
VOTE = 1 << 30


class Tree(NamedTuple):
    """Nodes in level order. ``feature`` is -1 at a leaf; ``left`` is the first of two children, or a leaf's row of ``votes``."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    votes: np.ndarray

    def dump(self) -> list[bytes]:
        return [a.tobytes() for a in self]

    @staticmethod
    def load(parts: list[bytes], n_classes: int) -> Tree:
        kinds = (np.int16, np.uint8, np.int32, np.int32)
        a = [np.frombuffer(p, k) for p, k in zip(parts, kinds, strict=True)]
        return Tree(*a[:3], a[3].reshape(-1, n_classes))


def binned(values: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """Number of cuts below each value, a column per feature."""
    out = np.empty(values.shape, np.uint8)
    for f, c in enumerate(cuts):
        out[:, f] = np.searchsorted(c, values[:, f], "left")
    return out


_MARK = np.random.default_rng(20240711).integers(1, 1 << 63, 1 << 14, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order that puts equal rows of bytes side by side, and the places in it where a new row begins."""
    if not x.shape[1] or x.shape[1] > len(_MARK):
        order = np.lexsort(x.T[::-1]) if x.shape[1] else np.arange(len(x))
        h = None
    else:
        h = x.astype(np.uint64) @ _MARK[: x.shape[1]]
        order = np.argsort(h, kind="stable")
    rows = x[order]
    new = np.concatenate([[True], (rows[1:] != rows[:-1]).any(axis=1)])[: len(x)]
    if h is not None and (new[1:] & (h[order][1:] == h[order][:-1])).any():  # different rows of one hash
        order = np.lexsort(x.T[::-1])
        rows = x[order]
        new[1:] = (rows[1:] != rows[:-1]).any(axis=1)
    return order, np.flatnonzero(new)


def choices(rng: np.random.Generator, n: int, n_features: int, k: int) -> np.ndarray:
    """``k`` different features for each of ``n`` nodes."""
    cards = np.tile(np.arange(n_features, dtype=np.int16), (n, 1))
    rows = np.arange(n)
    for j in range(k):
        other = rng.integers(j, n_features, n)
        cards[rows, j], cards[rows, other] = cards[rows, other], cards[rows, j].copy()
    return cards[:, :k]


def shares(weights: np.ndarray) -> np.ndarray:
    return np.rint(weights / weights.sum(axis=1, keepdims=True) * VOTE).astype(np.int32)


def _best_cuts(key: np.ndarray, counts: np.ndarray, cw: np.ndarray, y_bits: int, t_bits: int):
    """Best cut per node of sorted keys (node, bin, class, times): ``node, bin, score``; nodes of a single bin have none."""
    low = t_bits + y_bits
    cell = key >> low
    end = np.flatnonzero(cell[1:] != cell[:-1])
    nodes = cell >> _B_BITS
    end = end[nodes[end] == nodes[end + 1]]
    if not len(end):
        return end, end, np.zeros(0)
    at = nodes[end]
    label, times = (key >> t_bits) & ((1 << y_bits) - 1), key & ((1 << t_bits) - 1)
    wl, ql, wr, qr = (np.zeros(len(end)) for _ in range(4))
    for c in range(len(cw)):
        before = np.cumsum(counts[:, c]) - counts[:, c]
        n = np.cumsum(np.where(label == c, times, 0))[end] - before[at]
        a, b = n * cw[c], (counts[at, c] - n) * cw[c]
        wl, ql, wr, qr = wl + a, ql + a * a, wr + b, qr + b * b
    score = ql / wl + qr / wr
    return _first_best(at, cell[end] & ((1 << _B_BITS) - 1), score)


def _best_dense(place: np.ndarray, bins: np.ndarray, y: np.ndarray, t: np.ndarray, counts: np.ndarray, cw: np.ndarray, n_bins: int):
    """The same by a histogram of every node; a cut counts where rows of its bin and rows beyond it exist."""
    n, n_classes = counts.shape
    h = np.bincount((place * n_bins + bins) * n_classes + y, weights=t, minlength=n * n_bins * n_classes).reshape(n, n_bins, n_classes)
    here = h.sum(axis=2)
    below = here.cumsum(axis=1)
    ok = (here > 0) & (below < below[:, -1:])
    at, b = np.nonzero(ok)
    if not len(at):
        return at, at, np.zeros(0)
    a = h.cumsum(axis=1)[at, b]
    a, c = a * cw, (counts[at] - a) * cw
    score = (a * a).sum(axis=1) / a.sum(axis=1) + (c * c).sum(axis=1) / c.sum(axis=1)
    return _first_best(at, b, score)


def _first_best(at: np.ndarray, b: np.ndarray, score: np.ndarray):
    """First of the highest scores of each node; nodes come in order."""
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    top = np.maximum.reduceat(score, first)
    hit = np.flatnonzero(score == np.repeat(top, np.diff(np.r_[first, len(at)])))
    hit = hit[np.r_[True, at[hit][1:] != at[hit][:-1]]]
    return at[hit], b[hit], top


def grow(x: np.ndarray, y: np.ndarray, t: np.ndarray, cw: np.ndarray, k: int, depth: int, rng: np.random.Generator) -> tuple[Tree, np.ndarray]:
    """Tree of rows with bins ``x``, class ``y`` and multiplicity ``t``, and its impurity decrease per feature.

    Each mixed node takes the cut of highest decrease in weighted Gini impurity among ``k`` drawn features; ``depth`` levels
    of cuts at most. Only counts decide, so the order of the rows does not matter, nor whether equal ones are merged.
    """
    n_features, n_classes = x.shape[1], len(cw)
    y_bits, t_bits = max(1, (n_classes - 1).bit_length()), max(_T_BITS, int(t.max()).bit_length())
    narrow = 31 - _B_BITS - t_bits - y_bits
    flat, base = np.ascontiguousarray(x).ravel(), np.arange(len(y), dtype=np.int64) * n_features
    tail, node = (y.astype(np.int64) << t_bits) | t, np.zeros(len(y), np.int64)
    y, t = y.astype(np.int64), t.astype(float)
    n_bins = int(x.max()) + 1
    gains, levels, width, offset, n_leaves = np.zeros(n_features), [], 1, 0, 0
    while width:
        counts = np.bincount(node * n_classes + y, weights=t, minlength=width * n_classes).reshape(width, n_classes).astype(np.int64)
        w = counts * cw
        feature, cut = np.full(width, -1, np.int16), np.zeros(width, np.uint8)
        ask = np.flatnonzero((counts > 0).sum(axis=1) > 1) if depth > 0 else np.zeros(0, np.int64)
        if len(ask):
            drawn = choices(rng, len(ask), n_features, k)
            rank = np.full(width, -1, np.int64)
            rank[ask] = np.arange(len(ask))
            place = rank[node]
            kept = place >= 0
            place, rows, rest = place[kept], base[kept], tail[kept]
            q = (w[ask] ** 2).sum(axis=1) / w[ask].sum(axis=1)
            best = q + 1e-10 * w[ask].sum(axis=1)
            own, few = counts[ask], len(ask) * n_bins * n_classes <= 2 * len(rows)
            yk, tk = (y[kept], t[kept]) if few else (None, None)
            for j in range(k):
                bins = flat[rows + drawn[place, j]].astype(np.int64)
                if few:
                    at, where, score = _best_dense(place, bins, yk, tk, own, cw, n_bins)
                else:
                    key = (((place << _B_BITS) | bins) << (t_bits + y_bits)) | rest
                    key = key.astype(np.int32) if narrow > 0 and len(ask) < 1 << narrow else key
                    key.sort()
                    at, where, score = _best_cuts(key, own, cw, y_bits, t_bits)
                better = score > best[at]
                at, where = at[better], where[better]
                best[at], feature[ask[at]], cut[ask[at]] = score[better], drawn[at, j], where
            split = feature[ask] >= 0
            gains += np.bincount(feature[ask[split]], weights=(best - q)[split], minlength=n_features)
        inner = feature >= 0
        order = np.cumsum(inner) - 1
        left = np.where(inner, offset + width + 2 * order, n_leaves + np.cumsum(~inner) - 1).astype(np.int32)
        levels.append((feature, cut, left, shares(w[~inner])))
        offset, n_leaves, width, depth = offset + width, n_leaves + int((~inner).sum()), 2 * int(inner.sum()), depth - 1
        kept = inner[node]
        node, base, tail, y, t = node[kept], base[kept], tail[kept], y[kept], t[kept]
        node = 2 * order[node] + (flat[base + feature[node]] > cut[node])
    return Tree(*[np.concatenate([lv[a] for lv in levels]) for a in range(4)]), gains


def leaves(feature: np.ndarray, cut: np.ndarray, left: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Leaf that each row of bins reaches."""
    flat, n_features = np.ascontiguousarray(x).ravel(), x.shape[1]
    at, live, now = np.zeros(len(x), np.int32), np.arange(len(x)), np.zeros(len(x), np.int32)
    while len(live):
        f = feature[now]
        inner = f >= 0
        if not inner.all():
            at[live[~inner]] = now[~inner]
            live, now, f = live[inner], now[inner], f[inner]
        now = left[now] + (flat[live * n_features + f] > cut[now])
    return at


def votes(tree: Tree, x: np.ndarray) -> np.ndarray:
    return tree.votes[tree.left[leaves(tree.feature, tree.cut, tree.left, x)]]


def histogram(x: np.ndarray, y: np.ndarray, t: np.ndarray, features: np.ndarray, n_classes: int) -> np.ndarray:
    """Per drawn feature and bin: multiplicities by class, and rows (last column)."""
    bins, wide = 1 << _B_BITS, n_classes + 1
    out = np.zeros((len(features), bins, wide), np.int64)
    for j, f in enumerate(features):
        b = x[:, f].astype(np.int64)
        out[j, :, :n_classes] = np.bincount(b * n_classes + y, weights=t, minlength=bins * n_classes).reshape(bins, n_classes)
        out[j, :, n_classes] = np.bincount(b, minlength=bins)
    return out


def best_of_histogram(h: np.ndarray, features: np.ndarray, cw: np.ndarray):
    """``feature, cut, gain, rows left, rows right`` of the best cut (feature -1 if none) and the class weights of the node."""
    w = h[0, :, :-1].sum(axis=0) * cw
    q = (w**2).sum() / w.sum()
    found, best = (-1, 0, 0.0, 0, 0), q + 1e-10 * w.sum()
    for j, f in enumerate(features):
        below = h[j].cumsum(axis=0)
        above = below[-1] - below
        a, b = below[:, :-1] * cw, above[:, :-1] * cw
        with np.errstate(invalid="ignore", divide="ignore"):
            score = (a**2).sum(axis=1) / a.sum(axis=1) + (b**2).sum(axis=1) / b.sum(axis=1)
        score[(below[:, -1] == 0) | (above[:, -1] == 0)] = -1.0
        at = int(score.argmax())
        if score[at] > best:
            best, found = score[at], (int(f), at, float(score[at] - q), int(below[at, -1]), int(above[at, -1]))
    return found, w
