"""Toxicity by class-conditional Kneser-Ney language models.

One interpolated Kneser-Ney model per class over the characters of words: four-grams of UTF-16 code units, all of which are
symbols of their own (only A-Z are lower-cased, and white space ends a word). Both classes back off to the same continuation
counts of lower order, gathered from all labelled text, so a form that is rare in one class is judged by the contexts it has
in either. Every occurrence counts, for either class: the score of a text is the difference of the two log-likelihoods per
symbol in the passage of ``PASSAGE`` symbols where it is highest, since averages over whole texts drown a few words. It is
calibrated on labelled documents that the counts leave out.

Four-grams are counted and turned into log ratios by Spark; the model grows with the number of different ones and is broadcast.
Log ratios are whole numbers of ``1 / SCALE``, so no order of adding changes a score.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from cityloom.llm import textkit
from cityloom.llm.storage import ship, table

ORDER = 4
#: code units; a four-gram of them fills a 64-bit key
SYMBOLS = 1 << 16
CELLS = SYMBOLS
PASSAGE = 14
SCALE = 1 << 16
CUT = 0.7
AT_NOTHING = 0.05
CALIBRATION = 5
_BINS = 4096
_RANGE = 16.0
_LOWER_DISCOUNT = 0.75
#: different four-grams that a task holds before it hands them on
_HELD = 1 << 21

#: 0 boundary; letters without case
_SYMBOL = np.arange(SYMBOLS, dtype=np.uint16)
_SYMBOL[[9, 10, 11, 12, 13, 32]] = 0
_SYMBOL[65:91] += 32


def _units(buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-16 code units of a block and the offsets of its texts."""
    raw = buf.tobytes()
    try:
        units = np.frombuffer(raw.decode().encode("utf-16-le"), np.uint16)
    except UnicodeDecodeError:
        each = [raw[a:b].decode(errors="replace").encode("utf-16-le") for a, b in zip(at[:-1], at[1:], strict=True)]
        return np.frombuffer(b"".join(each), np.uint16), np.cumsum([0, *(len(e) // 2 for e in each)])
    size = np.zeros(len(buf) + 1, np.int64)
    np.cumsum(((buf & 0xC0) != 0x80).astype(np.int64) + (buf >= 0xF0), out=size[1:])
    return units, size[at]


def expressions(buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Document and key of every four-gram of each text in order, a word's end included; places before a word are 0."""
    units, ends = _units(buf, at)
    symbol = np.insert(_SYMBOL[units], ends[1:], 0)
    doc = np.insert(np.repeat(np.arange(len(ends) - 1), np.diff(ends)), ends[1:], np.arange(len(ends) - 1))
    keep = symbol != 0
    keep[1:] |= symbol[:-1] != 0
    symbol, doc = symbol[keep].astype(np.uint64), doc[keep]
    key, inside = symbol.copy(), np.ones(len(symbol), bool)
    for k in range(1, ORDER):
        before = np.zeros_like(symbol)
        before[k:] = symbol[:-k]
        inside &= before != 0
        key |= np.where(inside, before, np.uint64(0)) << np.uint64(16 * k)
    return doc, key


def _summed(held: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Keys of several blocks and their counts by label as those of one."""
    keys, place = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
    counts = np.zeros((2, len(keys)), np.int64)
    np.add.at(counts, (slice(None), place), np.concatenate([n for _, n in held], axis=1))
    return [(keys, counts)]


def _count(batches):
    """Occurrences of each four-gram by label in one task: ``key, n0, n1``."""
    held = []

    def out():
        (keys, n), = _summed(held)
        return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n[0]), pa.array(n[1])], names=["key", "n0", "n1"])

    for batch in batches:
        labels = batch.column(0).to_numpy()
        for lo, _, buf, at in textkit.blocks(batch.column(1)):
            doc, key = expressions(buf, at)
            keys, place = np.unique(key, return_inverse=True)
            label = labels[lo + doc]
            held.append((keys, np.stack([np.bincount(place[label == c], minlength=len(keys)) for c in (0, 1)])))
            if len(held) >= 16 or sum(len(k) for k, _ in held) > _HELD:
                held = _summed(held)
                if len(held[0][0]) > _HELD:
                    yield out()
                    held = []
    if held:
        yield out()


def _discounts(seen: list[int]) -> np.ndarray:
    n1, n2, n3, n4 = (max(n, 1) for n in seen)
    y = n1 / (n1 + 2 * n2)
    d = np.array([0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3])
    return np.clip(d, [0, 0.1, 0.2, 0.3], [0, 1, 2, 3])


def discounts(counts: np.ndarray) -> np.ndarray:
    """Discounts for counts of 1, 2 and more (Chen and Goodman's modified Kneser-Ney), from counts of counts."""
    return _discounts([int((counts == k).sum()) for k in (1, 2, 3, 4)])


def interpolate(counts: np.ndarray, lower: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Probabilities by (context, symbol): discounted counts plus the freed mass spread by the lower order.

    The formula for a full table; :func:`log_ratios` works it out for the four-grams that occur.
    """
    total = counts.sum(axis=1, keepdims=True)
    lower = np.tile(lower, (len(counts) // len(lower), 1))
    return np.where(total > 0, (counts - off + off.sum(axis=1, keepdims=True) * lower) / np.maximum(total, 1), lower)


def _shared(grams: DataFrame) -> DataFrame:
    """``low, p``: probability of the last symbol of every three-gram after its other two, the same for both classes.

    Counts are those of different symbols before, all the way down. A context has at most ``SYMBOLS`` rows.
    """
    orders = []
    for k in range(ORDER - 1, 0, -1):
        longer = orders[0].select(F.col("low").alias("key")) if orders else grams.select("key")
        low = F.col("key").bitwiseAND(F.lit((1 << 16 * k) - 1))
        orders.insert(0, longer.groupBy(low.alias("low")).agg(F.count(F.lit(1)).alias("n")))
    known = None
    for k, rows in enumerate(orders):
        after = Window.partitionBy(F.shiftrightunsigned("low", 16))
        rows = rows.withColumns({"all": F.sum("n").over(after), "kinds": F.count(F.lit(1)).over(after)})
        if known is None:
            rows = rows.withColumn("below", F.lit(1 / SYMBOLS))
        else:
            rows = rows.withColumn("shorter", F.col("low").bitwiseAND(F.lit((1 << 16 * k) - 1)))
            rows = rows.join(known.select(F.col("low").alias("shorter"), F.col("p").alias("below")), "shorter")
        known = rows.select("low", ((F.col("n") - _LOWER_DISCOUNT + _LOWER_DISCOUNT * F.col("kinds") * F.col("below")) / F.col("all")).alias("p"))
    return known


def log_ratios(grams: DataFrame) -> DataFrame:
    """``key, context, seen, unseen`` from ``key, n0, n1``: log of toxic over ordinary probability in units of ``1 / SCALE``.

    ``seen`` is that of the four-gram; ``unseen`` that of any other symbol after its context, for which the shared lower
    order cancels out. After a context that occurs nowhere both classes agree.
    """
    counted = grams.agg(*[F.count_if(F.col(c) == k) for c in ("n0", "n1") for k in (1, 2, 3, 4)]).first()
    off = [_discounts(list(counted[4 * c : 4 * c + 4])) for c in (0, 1)]
    context = F.shiftrightunsigned("key", 16).alias("context")
    sizes = [x for c in ("n0", "n1") for x in (F.sum(c).alias(f"all_{c}"), *(F.count_if(at(F.col(c))).alias(f"{k}_{c}") for k, at in _SIZES.items()))]
    contexts = grams.groupBy(context).agg(*sizes)
    rows = grams.select("*", context, F.col("key").bitwiseAND(F.lit((1 << 48) - 1)).alias("low"))
    rows = rows.join(contexts, "context").join(_shared(grams), "low")
    seen, unseen = [], []
    for c, d in zip(("n0", "n1"), off, strict=True):
        n, total = F.col(c), F.col(f"all_{c}")
        free = sum(float(x) * F.col(f"{k}_{c}") for k, x in zip(_SIZES, d[1:], strict=True))
        own = F.when(n == 0, 0.0).when(n == 1, float(d[1])).when(n == 2, float(d[2])).otherwise(float(d[3]))
        seen.append(F.log(F.when(total > 0, (n - own + free * F.col("p")) / total).otherwise(F.col("p"))))
        unseen.append(F.log(F.when(total > 0, free / total).otherwise(1.0)))
    whole = [F.round((x[1] - x[0]) * SCALE).cast("int").alias(a) for x, a in ((seen, "seen"), (unseen, "unseen"))]
    return rows.select("key", "context", *whole)


_SIZES = {"one": lambda n: n == 1, "two": lambda n: n == 2, "more": lambda n: n > 2}


class Ratios:
    """Log ratios by four-gram, and by context for those that never occurred; keys in order."""

    def __init__(self, key: np.ndarray, seen: np.ndarray, context: np.ndarray, unseen: np.ndarray):
        (self.key, self.seen), (self.context, self.unseen) = ((k[o], v[o]) for k, v in ((key, seen), (context, unseen)) for o in [np.argsort(k)])

    @staticmethod
    def _found(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(keys):
            return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
        at = np.searchsorted(keys, wanted)
        at[at == len(keys)] = 0
        hit = keys[at] == wanted
        return np.where(hit, values[at], 0), hit

    def of(self, key: np.ndarray) -> np.ndarray:
        out, hit = self._found(self.key, self.seen, key)
        out = out.astype(np.int64)
        rest = np.flatnonzero(~hit)
        out[rest] = self._found(self.context, self.unseen, key[rest] >> np.uint64(16))[0]
        return out


def _gathered(rows: DataFrame) -> Ratios:
    """The model for the tasks: 12 bytes for each different four-gram and context of labelled text."""
    grams = rows.select("key", "seen").toArrow()
    contexts = rows.groupBy("context").agg(F.max("unseen").alias("unseen")).toArrow()
    parts = [t.column(c).combine_chunks().to_numpy() for t, names in ((grams, ("key", "seen")), (contexts, ("context", "unseen"))) for c in names]
    return Ratios(parts[0].view(np.uint64), parts[1], parts[2].view(np.uint64), parts[3])


def _difference(buf: np.ndarray, at: np.ndarray, ratios: Ratios) -> np.ndarray:
    """Log-likelihood difference per symbol of each text's highest passage; a shorter text is one passage."""
    doc, key = expressions(buf, at)
    out = np.zeros(len(at) - 1)
    if not len(doc):
        return out
    sums = np.concatenate([[0], np.cumsum(ratios.of(key))])
    first = np.searchsorted(doc, np.arange(len(at)))
    place = np.arange(len(doc))
    end = np.minimum(place + PASSAGE, first[doc + 1])
    best = np.where((end - place == PASSAGE) | (place == first[doc]), sums[end] - sums[place], np.iinfo(np.int64).min)
    some = np.flatnonzero(np.diff(first))
    out[some] = np.maximum.reduceat(best, first[some]) / (PASSAGE * SCALE)
    return out


def _histogram(ratio):
    def run(batches):
        hist = np.zeros((2, _BINS), np.int64)
        for batch in batches:
            labels = batch.column(0).to_numpy()
            for lo, hi, buf, at in textkit.blocks(batch.column(1)):
                x = _difference(buf, at, ratio.value)
                bins = (x / _RANGE * _BINS).astype(np.int64).clip(0, _BINS - 1)
                np.add.at(hist, (labels[lo:hi], bins), 1)
        place = np.flatnonzero(hist)
        yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(hist.reshape(-1)[place])], names=["bin", "n"])

    return run


def calibrate(hist: np.ndarray) -> float:
    """The cut with the highest F1 from label counts by score bin; of equal ones the middle."""
    above = hist[:, ::-1].cumsum(axis=1)[:, ::-1]
    f1 = 2 * above[1] / np.maximum(above.sum(axis=0) + hist[1].sum(), 1)
    best = np.flatnonzero(f1[1:] == f1[1:].max()) + 1
    return float(best[len(best) // 2] * _RANGE / _BINS)


class Model:
    """Log ratios and the cut."""

    def __init__(self, ratio: Ratios, cut: float):
        self.ratio, self.cut = ratio, cut


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic") -> Model:
    """Models of all rows of ``docs`` with a label 0 or 1 in ``labels``; the caller leaves out what must not be learned from.

    Several labels of a document count as its highest. Rows without id or label are not learned from. Without any label
    of one class every document scores the same, below the cut.
    """
    ship(docs.sparkSession)
    marks = labels.where(F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("__id")).agg(F.max(toxic).cast("int").alias("label"))
    known = docs.select(F.col(doc_id).alias("__id"), F.col(text).alias("text"), F.crc32(F.col(doc_id).cast("string")).alias("fold"))
    known = known.join(marks.where("label IN (0, 1)").hint("merge"), "__id").select("label", "text", (F.floor(F.col("fold") / 3) % CALIBRATION == 0).alias("held"))
    known = table(known, "labelled")
    rows = known.where("NOT held").select("label", "text").mapInArrow(_count, "key long, n0 long, n1 long")
    grams = table(rows.groupBy("key").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")), "grams")
    total = grams.agg(F.sum("n0"), F.sum("n1")).first()
    if not total[0] or not total[1]:
        return Model(Ratios(*(np.zeros(0, t) for t in (np.uint64, np.int32) * 2)), 1.0)
    ratio = _gathered(table(log_ratios(grams), "ratios"))
    shared = docs.sparkSession.sparkContext.broadcast(ratio)
    hist = np.zeros(2 * _BINS, np.int64)
    bins = known.where("held").select("label", "text").mapInArrow(_histogram(shared), "bin long, n long")
    for r in bins.groupBy("bin").agg(F.sum("n").alias("n")).collect():  # at most 2 * _BINS rows
        hist[r.bin] = r.n
    hist = hist.reshape(2, -1)
    return Model(ratio, calibrate(hist) if hist[1].any() else 1.0)


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", cut: float = CUT) -> DataFrame:
    """``doc_id, score, predicted`` for every row; texts only are read.

    A null or wordless text scores as one that both models find equally likely. Null ids and repeated rows are kept row by row.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model.ratio)
    at_cut, base = model.cut, np.log(AT_NOTHING / (1 - AT_NOTHING))
    slope = (np.log(cut / (1 - cut)) - base) / model.cut

    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            for lo, hi, buf, at in textkit.blocks(batch.column(1)):
                x = _difference(buf, at, shared.value)
                p = np.where(x == at_cut, cut, 1 / (1 + np.exp(-(slope * x + base))))
                yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), pa.array(p), pa.array((p >= cut).astype(np.int32))], names=["doc_id", "score", "predicted"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, score double, predicted int")
