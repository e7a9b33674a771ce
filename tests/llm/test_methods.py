"""The methods themselves against brute force, libraries and closed forms."""

import io
import math
import random
import re
import struct
import zipfile
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from cityloom.llm import decontaminate, langid, mixing, neardup, quality, substring, textkit, tokencount, toxicity, urlfilter, warc


def _buffer(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="ab \t\né.'", max_size=30), max_size=6), st.integers(3, 40))
def test_scan_finds_the_words(texts, piece):
    buf, at = _buffer(texts)
    words = textkit.scan(buf, at, textkit.PLAIN, piece)
    own = [re.findall(rb"[^\x20\x09-\x0D]+", t.encode()) for t in texts]
    assert [buf[s:e].tobytes() for s, e in zip(words.start, words.end, strict=True)] == [w for t in own for w in t]
    assert np.diff(words.first).tolist() == [len(t) for t in own]
    again = textkit.scan(buf, at, textkit.PLAIN)
    assert (again.hash == words.hash).all()


def test_difference_cover():
    assert substring.is_cover(13, (0, 1, 3, 9)) and not substring.is_cover(13, (0, 1, 3))


def _removed(texts, window=20):
    seen, out = {}, []
    for d, t in enumerate(texts):
        w = t.split()
        gone = set()
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            if k in seen:
                gone.update(range(i, i + window))
            seen.setdefault(k, (d, i))
        out.append(" ".join(x for i, x in enumerate(w) if i not in gone))
    return out


def test_substring_against_brute_force(spark):
    rng = random.Random(5)
    stock = [" ".join(rng.choice("abcdefgh") for _ in range(60)) for _ in range(6)]
    texts = []
    for _ in range(80):
        parts = []
        for _ in range(rng.randint(0, 5)):
            w = rng.choice(stock).split()
            a = rng.randint(0, 40)
            parts += w[a : a + rng.randint(5, 40)] if rng.random() < 0.7 else [rng.choice("xyz") * rng.randint(1, 3) for _ in range(rng.randint(1, 25))]
        texts.append(" ".join(parts))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r.doc_id: r.text for r in substring.remove_repeats(df).collect()}
    assert [got[k] for k in range(len(texts))] == _removed(texts)


@pytest.fixture(scope="module")
def bpe():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = str(public_tokenizers.path("byte_bpe_50k.json"))
    return tokencount.merges(path), Tokenizer.from_file(path)


PARTS = [*"abestrdmvl' \n\t.,!-é中�🙂\x1c\x85½²01", "'s", "'re", "'ll", " 've", "<|endoftext|>", "<|endoftext", "  ", "the", " and", "ᲊ", "==", "aaaa"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PARTS), max_size=30).map("".join), min_size=1, max_size=5), st.sampled_from([1, 7, 1 << 20]))
def test_tokens_as_the_library(bpe, texts, piece):
    model, known = bpe
    want = [len(e.ids) for e in known.encode_batch(texts, add_special_tokens=False)]
    assert tokencount.count_tokens(model, *_buffer(texts), piece).tolist() == want


def test_tokens_after_a_restart(bpe, monkeypatch):
    model, known = bpe
    monkeypatch.setattr(tokencount, "MAX_STATES", 50)
    rng = random.Random(1)
    texts = ["".join(rng.choice(PARTS) for _ in range(200)) for _ in range(20)]
    want = [len(e.ids) for e in known.encode_batch(texts, add_special_tokens=False)]
    assert tokencount.count_tokens(model, *_buffer(texts)).tolist() == want
    model._clear()


def test_samples_meet_with_the_weighted_jaccard_probability():
    rng = np.random.default_rng(3)
    h = np.sort(rng.integers(0, 2**63, 300, dtype=np.uint64))
    w1, w2 = rng.random(300).astype(np.float32) + 0.1, rng.random(300).astype(np.float32) + 0.1
    w2[:150] = w1[:150]
    doc = np.zeros(300, np.int64)
    a, b = neardup.samples(doc, h, w1, 3000), neardup.samples(doc, h, w2, 3000)
    want = np.minimum(w1, w2).sum() / np.maximum(w1, w2).sum()
    assert abs((a == b).mean() - want) < 0.03
    assert abs(neardup.weighted_jaccard(h, w1, h, w2) - want) < 1e-5


def _classes(texts, k=5, least=0.8):
    sets = {i: Counter(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) or Counter([tuple(w)] if w else []) for i, w in ((i, t.split()) for i, t in texts)}
    df = Counter(s for x in sets.values() for s in x)
    weight = {s: float(neardup.idf_weight(len(texts), np.array([n]))[0]) for s, n in df.items()}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            x, y = sets[a], sets[b]
            top = sum(weight[s] * v for s, v in (x | y).items())
            if top and sum(weight[s] * v for s, v in (x & y).items()) >= least * top:
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {i: find(i) for i in ids}


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(2)
    vocabulary = [f"w{k}" for k in range(4000)]
    texts = []
    for _ in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(30, 300))]
        for _ in range(rng.randint(1, 9)):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2]) if len(base) > 120 else rng.choice([0, 0, len(base) // 4])):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append(" ".join(copy))
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    got = {r.doc_id: r.class_id for r in neardup.duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == _classes(rows)


def test_near_copies_of_a_hot_text_against_brute_force_on_plain_jaccard(spark):
    rng = random.Random(4)
    word = lambda: f"w{rng.randrange(10**6)}"
    hot = [word() for _ in range(100)]
    rows = []
    for i in range(240):  # a third: exact copies of one text, and copies with one word changed
        text = list(hot) if i % 3 == 0 else [word() for _ in range(100)]
        if i % 3 == 0 and i % 2:
            text[rng.randrange(5, 95)] = word()
        rows.append((i, " ".join(text)))
    sets = {i: {tuple(w[j : j + 5]) for j in range(len(w) - 4)} for i, w in ((i, t.split()) for i, t in rows)}
    want = {i: min([k for k in sets if len(sets[i] & sets[k]) >= 0.8 * len(sets[i] | sets[k])]) for i in sets}
    assert len(set(want.values())) == 161
    got = {r.doc_id: r.class_id for r in neardup.duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def test_permutation_and_tree():
    for n in (1, 2, 5, 257, 4096):
        assert sorted(mixing.permute(np.arange(n), n, 9).tolist()) == list(range(n))
    tree = mixing.SplitTree([1000, 0, 3000, 77], 13)
    shard = [tree.locate(np.full(q, k), np.arange(q)) for k, q in enumerate([1000, 0, 3000, 77])]
    size = np.bincount(np.concatenate(shard), minlength=13)
    assert size.sum() == 4077 and size.max() - size.min() <= 1
    assert (np.bincount(shard[2], minlength=13) > 150).all()
    other = mixing.SplitTree([1000, 0, 3000, 77], 13)
    assert (other.locate(np.full(5, 2), np.array([0, 10, 2999, 500, 7])) == shard[2][[0, 10, 2999, 500, 7]]).all()


def test_large_draws_are_hypergeometric():
    for good, bad, n in ((9, 14, 11), (3, 200, 50), (120, 80, 190), (1, 1, 1)):
        rng = np.random.default_rng(3)
        got = Counter(mixing._hypergeometric(rng, good, bad, n, most=0) for _ in range(20_000))
        for k in range(max(0, n - bad), min(good, n) + 1):
            p = math.comb(good, k) * math.comb(bad, n - k) / math.comb(good + bad, n)
            assert abs(got[k] / 20_000 - p) < 5 * math.sqrt(p * (1 - p) / 20_000) + 2e-4
    rng = np.random.default_rng(4)
    good, bad, n = 7_000_000_000, 13_000_000_000, 9_000_000_000
    draws = np.array([mixing._hypergeometric(rng, good, bad, n) for _ in range(60)], float)
    mean, deviation = n * 0.35, math.sqrt(n * 0.35 * 0.65 * (11 / 20))
    assert abs(draws.mean() - mean) < 5 * deviation / math.sqrt(60) and 0.6 < draws.std() / deviation < 1.5


def test_rows_alike_but_for_the_text_keep_their_pieces(spark):
    rows = [(1, "s", f"a{k} b c d e") for k in range(40)] + [(2, "t", "x " * 300)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    first, again = (sorted((r.text, r.taken, str(r.pieces)) for r in mixing.draw(mixing.measure(d)).collect()) for d in (df.repartition(7), df.orderBy(F.desc("text"))))
    assert first == again and len({t for _, t, _ in first}) > 1


def test_statistics_of_repeats_against_brute_force(spark):
    rng = random.Random(8)
    texts = [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 60))) for _ in range(60)] + ["a b\n c\na b\n\n \n c#$", "", " ".join(["q"] * 5000)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r.doc_id: r for r in quality.statistics(df).collect()}
    for k, t in enumerate(texts):
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        covered = {i + j for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for j in range(5)}
        lines = [x for x in t.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered))
        assert tuple(got[k][c] for c in quality.BASE) == want


def test_phrases_and_proximity_against_brute_force(spark):
    rng = random.Random(9)
    docs = [[rng.choice("abcdefghijklmnop") + rng.choice("xyz") for _ in range(rng.randint(0, 80))] for _ in range(40)]
    items = [d[i : i + rng.randint(2, 4)] for d in docs if len(d) > 20 for i in (3, 11)]
    df = spark.createDataFrame([(k, " ".join(d)) for k, d in enumerate(docs)], "doc_id long, text string")
    ex = spark.createDataFrame([(k, " ".join(i)) for k, i in enumerate(items)], "item_id long, text string")
    source = df.select(*(v.alias(k) for k, v in {"doc": F.col("doc_id"), "ref": F.xxhash64("text"), "text": F.col("text")}.items()))
    index = decontaminate.Index(source, decontaminate.item_windows(ex, "item_id", "text", 13), 13)
    names = {r.win: tuple(items[int(r.item)]) for r in index.items.collect()}
    got = {(r.doc, names[r.win], r.start) for r in index.phrases().collect()}
    want = {(k, tuple(i), s) for k, d in enumerate(docs) for i in items for s in range(len(d) - len(i) + 1) if d[s : s + len(i)] == i}
    assert got == want and len(want) >= len(items) // 2
    rarest = {r.win: (r.words[r.o1], r.words[r.o2]) for r in index.windows.collect() if r.o2 is not None}
    hashes = {r.win: dict(zip(r.words, names[r.win], strict=True)) for r in index.windows.collect()}
    for distance in (1, 4):
        near = {(r.doc, r.win) for r in decontaminate.proximity_matches(index, distance).collect()}
        for win, (a, b) in rarest.items():
            x, y = hashes[win][a], hashes[win][b]
            for k, d in enumerate(docs):
                close = any(u == x and v == y and abs(i - j) <= distance for i, u in enumerate(d) for j, v in enumerate(d))
                assert ((k, win) in near) == close


def test_targets():
    got = mixing.targets({"a": 100, "b": 100, None: 100})
    assert sum(got.values()) == pytest.approx(450) and got["a"] == 200 and got["b"] == pytest.approx(250 / 3) and got[None] == pytest.approx(500 / 3)
    assert mixing.targets({}) == {} and mixing.targets({"a": 0}) == {"a": 0}


def test_decision_list_finds_the_rule():
    rng = np.random.default_rng(1)
    x = rng.random((3000, len(quality.FEATURES)))
    bad = ((x[:, 2] > 0.8) & (x[:, 3] < 0.5)) | (x[:, 5] < 0.1)
    rules = quality.learn(x, bad)
    hit = np.zeros(len(x), bool)
    for rule in rules:
        hit |= quality._holds(rule, x)
    assert (hit == bad).mean() > 0.97


def test_kneser_ney_is_a_distribution():
    rng = np.random.default_rng(0)
    counts = np.zeros((2, toxicity.CELLS), np.int64)
    counts[:, rng.integers(0, toxicity.CELLS, 5000)] = rng.integers(1, 9, 5000)
    own = counts[0].reshape(-1, toxicity.SYMBOLS)
    off = np.minimum(toxicity.discounts(own)[np.minimum(own, 3)], own)
    p = toxicity.interpolate(own, np.full((1, toxicity.SYMBOLS), 1 / toxicity.SYMBOLS), off)
    assert np.allclose(p.sum(axis=1), 1) and (p > 0).all()


def test_clusters_are_unit_vectors():
    x = np.abs(np.random.default_rng(0).normal(size=(50, 20)))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    assert np.allclose(np.linalg.norm(langid.cluster(x, 3), axis=1), 1)


def test_zip_directory_against_the_library():
    out = io.BytesIO()
    package = warc.ZipWriter(out)
    package.member("a/b", iter([b"hello ", b"world"]))
    package.member("ü", iter([]))
    package.close()
    body = out.getvalue()
    with zipfile.ZipFile(io.BytesIO(body)) as z:
        assert z.read("a/b") == b"hello world" and z.testzip() is None
    members = warc.directory(lambda o, n: body[o : o + n], len(body))
    assert body[members["a/b"][0] :][: members["a/b"][1]] == b"hello world" and members["ü"][1] == 0
    plain = io.BytesIO()
    with zipfile.ZipFile(plain, "w", zipfile.ZIP_STORED) as z:
        z.writestr("x", b"123")
    body = plain.getvalue()
    at, size = warc.directory(lambda o, n: body[o : o + n], len(body))["x"]
    assert body[at : at + size] == b"123"
    with pytest.raises(ValueError):
        warc.directory(lambda o, n: b"no"[o : o + n], 2)
    assert struct.calcsize("<4s5H3I2H") == 30


def test_url_cut():
    assert urlfilter.calibrate({(True, 10): 5, (False, 3): 5}) == pytest.approx(10 * 2 * 5 / 2000 - 5)
    assert urlfilter.calibrate({(True, 10): 5}) == 0.0
