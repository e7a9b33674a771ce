"""Merkle manifest: closed-form places, proofs over several tiers against brute force, edge cases."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cityloom.llm import merkle


def _h(*x):
    return hashlib.sha256("".join(x).encode()).hexdigest()


def _value(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def _up(row):
    out = [row]
    while len(row) > 1:
        row = [_h(*row[i : i + 2]) for i in range(0, len(row), 2)]
        out.append(row)
    return out


def _proof(levels, i):
    out = []
    for row in levels[:-1]:
        j = i ^ 1
        out.append(row[j] if j < len(row) else "")
        i >>= 1
    return out


def _brute(rows):
    leaves = sorted(((lang, doc_id, _h(*map(_value, (doc_id, source, lang, n, text)))) for doc_id, text, lang, source, n in rows), key=lambda r: (r[0] is not None, (r[0] or "").encode(), r[1] is not None, r[1] or 0, r[2]))
    groups = {}
    for lang, doc_id, leaf in leaves:
        groups.setdefault(lang, []).append((doc_id, leaf))
    trees = {lang: _up([x for _, x in g]) for lang, g in groups.items()}
    top = _up([trees[lang][-1][0] for lang in groups])
    out = []
    for k, (lang, g) in enumerate(groups.items()):
        for i, (doc_id, leaf) in enumerate(g):
            out.append((doc_id, leaf, trees[lang][-1][0], top[-1][0], "".join(_proof(trees[lang], i) + _proof(top, k))))
    return sorted(out, key=repr)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 6, 7, 8, 13, 64, 77])
def test_places_are_a_postorder(n):
    done, nodes = set(), {}
    for level in range(merkle.height(n) + 1):
        for i in range(-(-n >> level)):
            nodes[int(merkle.postorder(level, i, n))] = (level, i)
    assert sorted(nodes) == list(range(len(nodes))) == list(range(int(merkle.subtree_size(merkle.height(n), 0, n))))
    for place in range(len(nodes)):
        level, i = nodes[place]
        if level:
            children = [(level - 1, j) for j in (2 * i, 2 * i + 1) if j < -(-n >> (level - 1))]
            assert children and all(c in done for c in children)
        done.add((level, i))
    assert (merkle.postorder(0, np.arange(n), n) == [merkle.postorder(0, i, n) for i in range(n)]).all()


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
ROWS = [(k * 3 % 101, f"text {k} é", ["en", "en", "en", "de", None, "x"][k % 6], None if k % 5 == 0 else "s", None if k % 7 == 0 else k) for k in range(100)]
ROWS += [(5, None, None, None, None), (5, "", "en", "", 0), (7, "same", "en", "s", 1), (7, "same", "en", "s", 1), (None, "x" * 50_000, "ß", "s", 2), (None, None, "en", None, None)]


@pytest.mark.parametrize("segment", [1, 2, 12])
def test_proofs_of_all_tiers(spark, segment):
    docs = spark.createDataFrame(ROWS, COLUMNS).repartition(5)
    docs = docs.withColumns({c: F.lit(f"own {c}") for c in ("g", "at", "N", "left", "root", "node", "leaf", "row", "part")})
    proven = merkle.manifest(docs, segment)
    rows = proven.withColumn("text", merkle.proof_text(F.col("left"), F.col("right"))).withColumn("good", merkle.fold(F.col("leaf"), F.col("left"), F.col("right"))).withColumn("bad", merkle.fold(F.col("tampered"), F.col("left"), F.col("right"))).collect()
    assert sorted(((r.doc_id, r["leaf"], r.subroot, r.root, r.text) for r in rows), key=repr) == _brute(ROWS)
    assert all(r.good == r.root and (r.bad == r.root) == (r.tampered == r["leaf"]) for r in rows)
    assert sum(r.tampered == r["leaf"] for r in rows) == sum(r[4] is None for r in ROWS)


def test_empty_and_single(spark):
    docs = spark.createDataFrame(ROWS[:1], COLUMNS)
    assert merkle.manifest(docs.limit(0)).collect() == []
    (r,) = merkle.manifest(docs).collect()
    assert r["leaf"] == r.subroot == r.root and r.left == [] and r.right == []


def test_other_columns_are_carried(spark):
    rows = spark.createDataFrame([("b", 2, "aa" * 32, "own"), ("a", 1, "bb" * 32, "own")], "grp string, k int, digest string, root string")
    out = merkle.prove(rows, "grp", "k", "digest")
    assert out.columns == ["grp", "k", "digest", "left", "right", "subroot", "root"]
    assert {r.root for r in out.collect()} == {_h("bb" * 32, "aa" * 32)}
