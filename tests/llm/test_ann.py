"""Hierarchical k-means search: recall against brute force, ties, copies, depth, and rows that take no part."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cityloom.llm import ann

SCHEMA = "vec_id long, embedding array<float>, label int"


def _brute(rows, top, queries):
    out = {}
    ids = np.array([r[0] for r in rows])
    x = np.array([r[1] for r in rows], np.float32).astype(float)
    for q in queries:
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(1))
        out[q] = [(int(ids[k]), float(d[k])) for k in np.lexsort((ids, d)) if ids[k] != q][:top]
    return out


def _lists(df):
    got = {}
    for r in df.collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    for v in got.values():
        v.sort()
        assert [x[0] for x in v] == list(range(1, len(v) + 1))
        assert all((a[2], a[1]) < (b[2], b[1]) for a, b in zip(v, v[1:]))
    return {k: [x[1:] for x in v] for k, v in got.items()}


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(30, 16))
    x = centres[rng.integers(0, 30, 3000)] + 0.2 * rng.normal(size=(3000, 16))
    return [(k, [float(np.float32(c)) for c in v], 0) for k, v in enumerate(x)]


@pytest.mark.parametrize("shape", [{}, {"leaf": 40, "branch": 4, "most_leaves": 8, "sample": 500}])
def test_recall_on_any_depth(spark, rows, shape):
    df = spark.createDataFrame(rows, SCHEMA)
    index = ann.build(df, **shape)
    assert len(index.rounds) == (1 if not shape else 2) or len(index.rounds) > 2
    assert index.leaves.count() == 3000  # every row is indexed
    assert index.leaves.groupBy("block").count().agg(F.max("count")).first()[0] <= 4 * shape.get("leaf", ann.LEAF)
    index = ann.calibrate(index)
    got = _lists(ann.search(index, df.where("vec_id % 50 = 0")))
    want = _brute(rows, 10, range(0, 3000, 50))
    assert got.keys() == want.keys() and all(len(v) == 10 for v in got.values())
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.93 * 10 * len(want)
    exact = {q: dict(_brute(rows, 3000, [q])[q]) for q in list(want)[:5]}
    assert all(s == pytest.approx(exact[q][i], abs=1e-12) for q in exact for i, s in got[q])


def test_copies_ties_and_unusable_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(k, [1.0, 0.0], 0) for k in range(40)]  # one vector, forty times
    rows += [(100, [0.0, 1.0], 0), (101, [0.0, -1.0], 0), (102, [2.0, 0.0], 0), (100, [0.0, 1.0], 0)]  # a repeated row, equal distances
    rows += [(200, None, 0), (300, [0.0, 0.0], 0), (400, [nan, 1.0], 0), (500, [inf, 1.0], 0), (600, [None, 1.0], 0), (700, [], 0), (None, [1.0, 1.0], 0), (800, [1.0, 2.0, 3.0], 0)]
    rows += [(900, [-0.0, 3.0], 0), (901, [0.0, 3.0], 0)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(f"own {c}") for c in ("v", "ids", "block", "ask", "rank", "score")})
    index = ann.calibrate(ann.build(df))
    got = _lists(ann.search(index, df.where("vec_id % 100 = 0 OR vec_id IS NULL")))
    assert sorted(got) == [0, 100, 900]  # 800 has no candidate of its size
    assert got[0] == [(k, 0.0) for k in range(1, 11)]  # of equal ones the smallest ids
    assert [i for i, _ in got[100]] == list(range(10)) and got[100][0][1] == 2**0.5
    assert got[900][0] == (901, 0.0) and got[900][1] == (100, 2.0)
    few = df.where("vec_id IN (0, 100, 101, 102)").dropDuplicates(["vec_id"])
    assert _lists(ann.search(ann.calibrate(ann.build(few)), few.where("vec_id = 0"))) == {0: [(102, 1.0), (100, 2**0.5), (101, 2**0.5)]}
    none = df.limit(0)
    empty = ann.calibrate(ann.build(none))
    assert ann.search(empty, none).collect() == [] and ann.search(empty, df.where("vec_id = 0")).collect() == []
    with pytest.raises(ValueError):
        ann.search(index, df, top=11)


def test_walk_is_best_bin_first():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(800, 4))
    tree = ann.Tree.fit(x, 1.0, leaf=20, branch=4, most=64)
    own = tree.descend(x)
    held = np.bincount(own, minlength=tree.leaf.max() + 1)
    again = ann.Tree.unpack(tree.pack())
    for k, leaves in enumerate(again.walk(x[:50], 5, held, 1)):
        assert leaves[0] == own[k] and len(set(leaves)) == 5
    assert all(sorted(v) == sorted(np.flatnonzero(held)) for v in tree.walk(x[:3], 10_000, held, 1))
    assert all(held[v].sum() >= 100 for v in tree.walk(x[:5], 1, held, 100))
