"""Spelling variants: near pairs against brute force, the word contract, chains of forms, edge cases."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cityloom.llm import spelling


def _near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def _brute(texts, every=31):
    n = Counter()
    for name, text in texts:
        for run in re.findall("[A-Za-z\u00C0-\u00FF]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{name}:{run}".encode())
            if name is not None and h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}
    out = {}
    for w in n:
        near = [o for o in n if _near(w, o)]
        form = min((o for o in near if n[o] >= 10 * n[w]), key=lambda o: (-n[o], o), default=None)
        out[w] = [n[w], len(near), form, form and n[form]]
    for w in out:
        root = w
        while out[root][2]:
            root = out[root][2]
        out[w].append(root)
    return {w: tuple(v) for w, v in out.items()}


def test_variants_equal_brute_force(spark):
    rng = random.Random(2)
    base = ["".join(rng.choice("abcdeéàÿ") for _ in range(rng.randint(7, 11))) for _ in range(60)]

    def change(w):
        k, c = rng.randrange(len(w)), rng.choice("abcÉ")
        return rng.choice([w[:k] + w[k + 1 :], w[:k] + c + w[k:], w[:k] + c + w[k + 1 :], w.upper(), w + c, c + w])

    texts = []
    for name in range(120):
        some = [w if rng.random() < 0.7 else change(w) for w in rng.choices(base, k=60)]
        some += [change(change(w)) for w in rng.choices(base, k=4)]
        texts.append((name, rng.choice([" ", ", ", "_", "1"]).join(some)))
    texts += [(500, None), (501, ""), (None, "nullname nullname " * 3), (502, "short words onlyy"), (502, "short words onlyy"), (503, "x" * 30_000 + " " + "x" * 30_000)]
    texts += [(504, "aaaaaaa aaaaaaa aaaaaaaa aaaaaaaa bbbbbbb bbbbbbb" * 2), (505, "\u00d7\u00f7\u00d7\u00f7\u00d7\u00f7\u00d7 " * 2)]
    df = spark.createDataFrame(texts, "doc_id long, text string").withColumns({c: F.lit(f"own {c}") for c in ("word", "N", "key", "other", "root")})
    got = {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in spelling.variants(df.repartition(4)).collect()}
    want = _brute(texts)
    assert got == want and sum(v[1] > 0 for v in want.values()) > 50 and sum(v[2] is not None for v in want.values()) > 10


@pytest.mark.parametrize("options", [{"keep": 8}, {"zones": 3}, {"short": 2, "long": 5}, {"zones": 1}])
def test_parameters_do_not_change_results(spark, options):
    rng = random.Random(3)
    words = {"".join(rng.choice("abc") for _ in range(rng.randint(7, 9))) for _ in range(250)}
    df = spark.createDataFrame([(w, k + 2) for k, w in enumerate(sorted(words))], "word string, n long")
    got = {(r.word, r.other) for r in spelling.near_pairs(df, **options).collect()}
    assert got == {(a, b) for a in words for b in words if _near(a, b)}


def test_decomposition_takes_the_longest_known_gram():
    points = np.array([[ord(c) for c in "abcabd"]], np.uint64)
    grams = {g: spelling._grams(np.array([[ord(c) for c in g]], np.uint64), len(g))[0, 0] for g in ("ab", "abc", "bc", "ca", "bd", "cab")}
    known = np.sort(np.array([grams["abc"], grams["cab"]], np.uint64))
    assert spelling.decompose(points, known).tolist() == [[grams["abc"], grams["bc"], grams["cab"], grams["ab"], grams["bd"]]]


def test_chains_and_empty_tables(spark):
    forms = spark.createDataFrame([(f"w{k}", f"w{k + 1}") for k in range(9)] + [("x", "w4")], "word string, form string")
    assert {r.word: r.root for r in spelling.roots(forms).collect()} == {**{f"w{k}": "w9" for k in range(9)}, "x": "w9"}
    none = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.variants(none).collect() == []
    assert spelling.variants(spark.createDataFrame([(1, "one two three")], "doc_id long, text string")).collect() == []
