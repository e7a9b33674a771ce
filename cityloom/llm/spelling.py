"""Spelling variants: words that differ by one code point, found through an index of variable-length grams.

1. Words are counted in their texts; each task adds up what it reads before anything is shuffled.
2. Gram dictionary: substrings of more than ``SHORT`` and at most ``LONG`` code points that are frequent among the words. A
   gram stays if at least one in ``KEEP`` of all places holds it, so there are at most ``KEEP`` of each length whatever the
   vocabulary; its size does not change results.
3. A word is decomposed into one gram per place, the longest in the dictionary, else one of ``SHORT`` code points.
4. Affected grams: a word's places are cut into ``ZONES`` zones. An edit in a zone can affect the grams that overlap it or, to
   its left, could have been longer; all others keep their distance from the start (left) or from the end (right). A
   partner with its edit in that zone is on the lists of all these grams, so the lists of a zone are merged into one key
   that stands for the whole intersection.
5. Words that share a key are verified by their edit distance. Rare and common grams are treated alike, no list is cut.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cityloom.llm import textkit
from cityloom.llm.storage import ship, table

LETTERS = "[A-Za-zÀ-ÿ]"
LEAST = 7
TWICE = 2
TIMES = 10
SHORT = 2
LONG = 3
KEEP = 1 << 17
ZONES = 8
ALTER = 31
_FLUSH = 200_000
_LOWER = {c: c + 32 for c in range(65, 91)}
_BASE = np.uint64(0x9E3779B97F4A7C15)


def lower(text: str) -> str:
    """``text`` with A-Z lower-cased."""
    return text.lower() if text.isascii() else text.translate(_LOWER)


def altered(name: str | None, run: str, every: int = ALTER) -> str:
    """``run`` without one code point where ``every`` divides the crc32 of ``name:run``; a null name alters nothing."""
    if name is None or not every:
        return run
    h = zlib.crc32(f"{name}:{run}".encode())
    if h % every:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def _count(least: int, every: int):
    runs = re.compile(f"{LETTERS}{{{least},}}")

    def flush(seen: Counter):
        return pa.RecordBatch.from_pydict({"word": pa.array(list(seen), pa.string()), "n": pa.array(list(seen.values()), pa.int64())})

    def run(batches):
        seen: Counter = Counter()
        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py()
                if not text:
                    continue
                for word, n in Counter(map(lower, runs.findall(text))).items():
                    word = altered(name, word, every)
                    if len(word) >= least:
                        seen[word] += n
                if len(seen) >= _FLUSH:
                    yield flush(seen)
                    seen.clear()
        if seen:
            yield flush(seen)

    return run


def words(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = LEAST, twice: int = TWICE, every: int = ALTER) -> DataFrame:
    """``word, n``: the words of at least ``least`` code points that occur ``twice`` or more.

    A word is a maximal run of letters, A-Z lower-cased; of one run in ``every`` (0: none) per text a code point is missing
    (:func:`altered`). Null and empty texts have no words; a row with a null id counts unaltered; repeated rows count again.
    """
    ship(docs.sparkSession)
    found = docs.select(F.col(doc_id).cast("string"), F.col(text)).mapInArrow(_count(least, every), "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= twice)


def _by_length(column: pa.Array):
    """Places of the words of each length, with their code points as a matrix."""
    values = column.to_pylist()
    sizes = np.fromiter(map(len, values), np.int64, len(values))
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        points = np.frombuffer("".join(values[r] for r in rows).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(rows), -1)
        yield rows, points.astype(np.uint64)


def _grams(points: np.ndarray, size: int) -> np.ndarray:
    """Hash of the gram of ``size`` code points at each place of each word."""
    n = points.shape[1] - size + 1
    h = np.full((len(points), max(n, 0)), size, np.uint64)
    for j in range(size):
        h = h * _BASE + points[:, j : j + max(n, 0)]
    return textkit.mix(h)


def _frequencies(short: int, long: int):
    def run(batches):
        for batch in batches:
            for _, points in _by_length(batch.column(0)):
                for size in range(short + 1, long + 1):
                    gram, n = np.unique(_grams(points, size), return_counts=True)
                    yield pa.RecordBatch.from_pydict({"gram": pa.array(gram.view(np.int64)), "n": pa.array(n.astype(np.int64))})

    return run


def dictionary(words: DataFrame, short: int = SHORT, long: int = LONG, keep: int = KEEP) -> np.ndarray:
    """Sorted hashes of the frequent grams, at most ``keep`` of each length."""
    total = words.agg(F.sum(F.length("word"))).first()[0] or 0
    often = max(TWICE, -(-total // keep))
    found = words.select("word").mapInArrow(_frequencies(short, long), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    rows = found.where(F.col("n") >= often).select("gram").toPandas()  # keep * (long - short) at most
    return np.sort(rows.gram.to_numpy(np.int64).view(np.uint64))


def decompose(points: np.ndarray, known: np.ndarray, short: int = SHORT, long: int = LONG) -> np.ndarray:
    """Hash of the variable-length gram at each place of words of one length."""
    out = _grams(points, short)
    open_ = np.ones(out.shape, bool)
    for size in range(short + 1, long + 1):
        gram = _grams(points, size)
        at = np.searchsorted(known, gram)
        at[at == len(known)] = 0
        hit = known[at] == gram if len(known) else np.zeros(gram.shape, bool)
        open_ = open_[:, : gram.shape[1]] & hit  # a longer gram has its beginnings in the dictionary
        out[:, : gram.shape[1]][open_] = gram[open_]
    return out


def _chains(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the first ``k`` and of the last ``k`` grams of each word, for every ``k``."""
    n = grams.shape[1]
    left, right = np.zeros((len(grams), n + 1), np.uint64), np.zeros((len(grams), n + 1), np.uint64)
    for k in range(n):
        left[:, k + 1] = textkit.mix(left[:, k] * _BASE + grams[:, k])
        right[:, k + 1] = textkit.mix(right[:, k] * _BASE + grams[:, n - 1 - k])
    return left, right


def zone_keys(points: np.ndarray, known: np.ndarray, size: int, short: int = SHORT, long: int = LONG, zones: int = ZONES) -> list[np.ndarray]:
    """Keys of words of one length for partners of ``size`` code points (their own length or one less).

    Zone ``[lo, hi)`` of the shorter word leaves alone the grams whose longest form ends before ``lo``, and those that start
    in the last ``size - hi`` code points.
    """
    left, right = _chains(decompose(points, known, short, long))
    out = []
    for z in range(zones):
        lo, hi = size * z // zones, size * (z + 1) // zones
        if lo == hi:
            continue
        before, after = max(lo - long + 1, 0), max(size - hi - short + 1, 0)
        tag = textkit.mix(np.array([size * 1000 + z], np.uint64))
        out.append(textkit.mix(left[:, before] + textkit.mix(right[:, after] + tag)))
    return out


def _keys(known, short: int, long: int, zones: int):
    def run(batches):
        for batch in batches:
            for rows, points in _by_length(batch.column("word")):
                some = batch.take(pa.array(rows))
                for longer in (False, True):
                    for key in zone_keys(points, known.value, points.shape[1] - longer, short, long, zones):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(key.view(np.int64)), some.column("word"), some.column("n"), pa.array(np.full(len(rows), longer))], names=["key", "word", "n", "longer"]
                        )

    return run


def near_pairs(words: DataFrame, short: int = SHORT, long: int = LONG, keep: int = KEEP, zones: int = ZONES) -> DataFrame:
    """``word, n, other, other_n``: pairs at an edit distance of exactly 1 (code points), in both directions.

    ``words`` are distinct. Words of fewer than ``zones`` code points have fewer zones; an empty table has no pairs.
    """
    spark = words.sparkSession
    ship(spark)
    known = spark.sparkContext.broadcast(dictionary(words, short, long, keep))
    listed = table(words.select("word", "n").mapInArrow(_keys(known, short, long, zones), "key long, word string, n long, longer boolean"), "lists")
    mine = listed.where("not longer").select("key", "word", "n").hint("merge")
    others = listed.select("key", F.col("word").alias("other"), F.col("n").alias("other_n"), "longer")
    met = mine.join(others, "key").where((F.col("longer") | (F.col("word") < F.col("other"))) & (F.levenshtein("word", "other", 1) == 1))
    met = table(met.select("word", "n", "other", "other_n"), "met")
    back = met.select(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n"))
    return met.unionByName(back).distinct()


def roots(forms: DataFrame) -> DataFrame:
    """``word, root``: where following ``forms`` (``word, form``, without cycles) ends; each round doubles the steps."""
    at = table(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = table(at.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        at = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return at


def variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", times: int = TIMES, least: int = LEAST, twice: int = TWICE, every: int = ALTER) -> DataFrame:
    """``word, n, n_near, form, form_n, root`` for every word of ``docs`` (:func:`words`).

    ``n_near``: words at an edit distance of 1. ``form``: the most frequent of them (ties: the smallest in code-point order)
    if it occurs ``times`` as often as the word or more, else null. ``root``: the end of the chain of forms, the word itself
    without a form. Only the two named columns are read.
    """
    counted = table(words(docs, doc_id, text, least, twice, every), "words")
    near = near_pairs(counted)
    best = F.min(F.when(F.col("other_n") >= times * F.col("n"), F.struct((-F.col("other_n")).alias("m"), F.col("other").alias("form"))))
    best = table(near.groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best")).select("word", "n_near", "best.form", (-F.col("best.m")).alias("form_n")), "near")
    ends = roots(best.where("form is not null"))
    found = counted.join(best, "word", "left").join(ends, "word", "left")
    return found.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form", "form_n", F.coalesce("root", "word").alias("root"))
