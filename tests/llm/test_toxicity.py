"""Toxicity: four-grams of real characters, every occurrence, both classes, against a plain count and a full table."""

from collections import Counter

import numpy as np
import pyarrow as pa

from cityloom.llm import textkit, toxicity as T

TEXTS = ["Idiot idiot,  you", "", None, "дом ДОМ том", "a😀b 日本語\tA1 a2 a3", "\n x", "é" * 9 + " e e"]


def _plain(text):
    out = []
    for word in (text or "").translate({9: " ", 10: " "}).split(" "):
        units = "".join(c.lower() if c.isascii() else c for c in word).encode("utf-16-le")
        seq = [0, 0, 0, *np.frombuffer(units, np.uint16).tolist(), 0]
        out += [tuple(seq[k : k + 4]) for k in range(len(seq) - 3)] if word else []
    return out


def test_every_occurrence_of_real_characters():
    (_, _, buf, at), = textkit.blocks(pa.array(TEXTS))
    doc, key = T.expressions(buf, at)
    for k, text in enumerate(TEXTS):
        got = [tuple(int(x >> np.uint64(s)) & 0xFFFF for s in (48, 32, 16, 0)) for x in key[doc == k]]
        assert got == _plain(text)


def _full(counts):
    """Log ratios by the formula for a full table of two symbols and the boundary, in all contexts."""
    names = sorted({s for g in counts for s in g})
    at = {s: k for k, s in enumerate(names)}
    n = np.zeros((2, *[len(names)] * 4))
    for g, both in counts.items():
        n[(slice(None), *(at[s] for s in g))] = both
    spread = [(n.sum(axis=0) > 0).astype(float)]
    while spread[-1].ndim > 1:
        spread.append((spread[-1].sum(axis=0) if len(spread) == 1 else (spread[-1] > 0).sum(axis=0)).astype(float))
    low = np.full((1, len(names)), 1 / T.SYMBOLS)
    for x in reversed(spread[1:]):
        x = x.reshape(-1, len(names))
        low = T.interpolate(x, low, np.minimum(0.75, x))
    p = []
    for own in n.astype(int).reshape(2, -1, len(names)):
        p.append(T.interpolate(own, low, np.minimum(T.discounts(own)[np.minimum(own, 3)], own)))
    return names, np.log(p[1]) - np.log(p[0])


def test_log_ratios_against_the_full_table(spark):
    rng = np.random.default_rng(5)
    counts = {}
    for label, odds in ((0, [0.5, 0.3, 0.2]), (1, [0.2, 0.3, 0.5])):
        for _ in range(40):
            word = "".join(rng.choice(list("ab日"), rng.integers(1, 7), p=odds))
            for g, n in Counter(_plain(word)).items():
                counts.setdefault(g, [0, 0])[label] += n
    packed = {g: int(np.array(sum(s << 16 * (3 - k) for k, s in enumerate(g)), np.uint64).view(np.int64)) for g in counts}
    df = spark.createDataFrame([(packed[g], *n) for g, n in counts.items()], "key long, n0 long, n1 long")
    model = T._gathered(T.log_ratios(df))
    names, want = _full(counts)
    every = [(a, b, c, d) for a in names for b in names for c in names for d in names]
    key = np.array([sum(s << 16 * (3 - k) for k, s in enumerate(g)) for g in every], np.uint64)
    assert np.abs(model.of(key) / T.SCALE - want.reshape(-1)).max() < 1e-4


def test_passage_is_the_highest_and_counts_both_signs():
    (_, _, buf, at), = textkit.blocks(pa.array(["aaaa " * 30 + "bbbb " * 3, "aaaa " * 30, "b", None]))
    _, key = T.expressions(buf, at)
    keys = np.unique(key)
    told = np.where((keys & np.uint64(0xFFFF)) == ord("b"), 2 * T.SCALE, -T.SCALE).astype(np.int32)
    x = T._difference(buf, at, T.Ratios(keys, told, np.zeros(0, np.uint64), np.zeros(0, np.int32)))
    best = max(sum(2 if s == "b" else -1 for s in ("bbbb0" * 3)[k : k + T.PASSAGE]) for k in range(2))
    assert x[0] == best / T.PASSAGE and x[1] == -1 and x[2] == (2 - 1) / T.PASSAGE and x[3] == 0
