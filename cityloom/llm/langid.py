"""Language identification by nearest centroid.

Texts are vectors of hashed character n-grams (one to three bytes of lower-cased text, everything but letters as blanks),
weighted by logarithmic term frequency and inverse document frequency and scaled to length one. Each language has several
centroids, found by spherical k-means; a text takes the language of the centroid with the largest cosine and is rejected
when even that one is too far away.

Document frequencies count all labelled texts. Centroids are fitted on at most ``SAMPLE`` distinct texts of each language,
chosen by a hash of the text, one language per task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from cityloom.llm import textkit
from cityloom.llm.storage import ship, table

DIMENSIONS = 4096
SAMPLE = 400
CENTROIDS = 3
SNIPPET = 24
UNKNOWN = "und"
_GROUP = 256
_PARTS = 16

_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = _FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def _counts(buf: np.ndarray, at: np.ndarray):
    """Groups of documents ``lo, hi`` with the matrix of their n-gram counts."""
    symbol = _FOLD[buf].astype(np.uint64)
    n = len(at) - 1
    for lo in range(0, n, _GROUP):
        hi = min(lo + _GROUP, n)
        out = np.zeros((hi - lo) * DIMENSIONS)
        a, end = at[lo], at[hi]
        while a < end:  # a long text a piece at a time; pieces overlap by the n-grams across the cut
            b = min(a + 4 * textkit.BLOCK_BYTES, end)
            first = a - (2 if a > at[lo] else 0)
            s = symbol[first:b]
            doc = np.searchsorted(at[lo : hi + 1], np.arange(first, b), "right") - 1
            code = np.ones(len(s), np.uint64)
            for k in range(3):
                code[k:] = (code[k:] << np.uint64(8)) | s[: len(s) - k]
                fits = np.zeros(len(s), bool)
                fits[k:] = doc[k:] == doc[: len(s) - k]
                fits[: a - first] = False
                if k:
                    fits[1:] &= (s[1:] != 32) | (s[:-1] != 32)
                else:
                    fits &= s != 32
                place = (textkit.mix(code[fits] + np.uint64(k << 32)) >> np.uint64(52)).astype(np.int64)
                out += np.bincount(doc[fits] * DIMENSIONS + place, minlength=len(out))
            a = b
        yield lo, hi, out.reshape(hi - lo, DIMENSIONS)


def _unit(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts) * idf
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norm > 0, norm, 1)


def _frequencies(batches):
    df, n = np.zeros(DIMENSIONS, np.int64), 0
    for batch in batches:
        for _, _, buf, at in textkit.blocks(batch.column(0)):
            for _, _, counts in _counts(buf, at):
                df += (counts > 0).sum(axis=0)
                n += len(counts)
    if n:
        parts = np.split(df, _PARTS)
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(_PARTS), pa.int32()), pa.array([p.tolist() for p in parts], pa.list_(pa.int64())), pa.array([n] + [0] * (_PARTS - 1), pa.int64())],
            names=["part", "df", "n"],
        )


def _add(batches):
    sums: dict[int, list] = {}
    for batch in batches:
        for part, df, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            own = sums.setdefault(part, [np.zeros(len(df), np.int64), 0])
            own[0] += np.array(df)
            own[1] += n
    if sums:
        yield pa.RecordBatch.from_arrays(
            [pa.array(sums.keys(), pa.int32()), pa.array([v.tolist() for v, _ in sums.values()], pa.list_(pa.int64())), pa.array([n for _, n in sums.values()], pa.int64())],
            names=["part", "df", "n"],
        )


def cluster(x: np.ndarray, k: int, turns: int = 20) -> np.ndarray:
    """Spherical k-means of unit vectors, from the mean and then the vectors farthest from what is there."""
    centres = x.mean(axis=0, keepdims=True)
    centres /= max(np.linalg.norm(centres), 1e-12)
    while len(centres) < min(k, len(x)):
        centres = np.vstack([centres, x[np.argmin((x @ centres.T).max(axis=1))]])
    for _ in range(turns):
        own = (x @ centres.T).argmax(axis=1)
        new = np.vstack([x[own == c].mean(axis=0) if (own == c).any() else centres[c] for c in range(len(centres))])
        new /= np.maximum(np.linalg.norm(new, axis=1, keepdims=True), 1e-12)
        if np.allclose(new, centres):
            break
        centres = new
    return centres


class Model:
    """Inverse document frequencies, centroids by language, and the smallest cosine of each language that is accepted."""

    def __init__(self, idf: np.ndarray, langs: list[str], owner: np.ndarray, centres: np.ndarray, least: np.ndarray):
        self.idf, self.langs, self.owner, self.centres, self.least = idf, langs, owner, centres, least


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", sample: int = SAMPLE, centroids: int = CENTROIDS) -> Model:
    """Model of the rows with a language and a text; the caller leaves out what must not be learned from.

    A language's least cosine is half the first percentile that the first ``SNIPPET`` bytes of its sample texts reach, so
    only texts unlike the language's shortest snippets are rejected. Without labelled rows the model knows no language.
    """
    spark = docs.sparkSession
    ship(spark)
    known = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    rows = known.select("text").mapInArrow(_frequencies, "part int, df array<long>, n long").repartition("part")
    df, n = np.zeros(DIMENSIONS, np.int64), 0
    for r in rows.mapInArrow(_add, "part int, df array<long>, n long").collect():  # DIMENSIONS counts
        df.reshape(_PARTS, -1)[r.part] += np.array(r.df)
        n += r.n
    idf = np.log((n + 1) / (df + 1)) + 1
    hashed = known.withColumn("h", F.xxhash64("text"))
    chosen = hashed.groupBy("lang", F.pmod("h", F.lit(sample)).alias("slot")).agg(F.min("h").alias("h")).select("lang", "h")
    texts = table(hashed.join(chosen, ["lang", "h"]).groupBy("lang", "h").agg(F.first("text").alias("text")), "sample")

    def centre(key, part):
        column = part.column("text").combine_chunks()
        order = np.argsort(part.column("h").to_numpy())
        column = column.take(pa.array(order))
        buf, at = textkit.texts(column)
        x = np.vstack([_unit(c, idf) for _, _, c in _counts(buf, at)])
        short = [(v or "").encode()[:SNIPPET] for v in column.to_pylist()]
        y = np.vstack([_unit(c, idf) for _, _, c in _counts(np.frombuffer(b"".join(short), np.uint8), np.cumsum([0, *map(len, short)]))])
        full = x[np.linalg.norm(x, axis=1) > 0]
        if not len(full):
            return out_schema.empty_table()
        c = cluster(full, centroids)
        near = (y[np.linalg.norm(y, axis=1) > 0] @ c.T).max(axis=1)
        least = float(np.percentile(near, 1)) / 2 if len(near) else 0.0
        return pa.table({"lang": [key[0].as_py()], "centres": [c.astype(np.float32).ravel().tolist()], "least": [least]}, schema=out_schema)

    out_schema = pa.schema([("lang", pa.string()), ("centres", pa.list_(pa.float32())), ("least", pa.float64())])
    found = texts.groupBy("lang").applyInArrow(centre, "lang string, centres array<float>, least double").collect()  # a few vectors a language
    found = sorted(found, key=lambda r: r.lang)
    centres = [np.array(r.centres).reshape(-1, DIMENSIONS) for r in found]
    owner = np.repeat(np.arange(len(found)), [len(c) for c in centres]) if found else np.zeros(0, int)
    return Model(idf, [r.lang for r in found], owner, np.vstack(centres) if found else np.zeros((0, DIMENSIONS)), np.array([r.least for r in found]))


def _has_letter(value: bytes) -> bool:
    folded = _FOLD[np.frombuffer(value, np.uint8)]
    return bool(((folded >= 97) & (folded < 123)).any()) or (bool((folded >= 128).any()) and any(c.isalpha() for c in value.decode()))


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` (the cosine, 0 to 1) and ``rejected``, replacing columns of these names.

    A null text or one without a letter is ``und`` with score 0 and rejected. A rejected text still carries its nearest
    language. Of equal cosines the first language by code point wins. Rows are judged one by one: repeated rows, null ids
    and further columns pass through.
    """
    ship(docs.sparkSession)
    docs = docs.drop("lang_pred", "score", "rejected")
    names = docs.columns
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for batch in batches:
            column = batch.column(text)
            langs, scores, gone = [], [], []
            for _, _, buf, at in textkit.blocks(column):
                for lo, hi, counts in _counts(buf, at):
                    letters = [_has_letter(buf[at[d] : at[d + 1]].tobytes()) for d in range(lo, hi)]
                    if not m.langs:
                        langs += [UNKNOWN] * (hi - lo)
                        scores += [0.0] * (hi - lo)
                        gone += [True] * (hi - lo)
                        continue
                    near = _unit(counts, m.idf) @ m.centres.T
                    best = near.argmax(axis=1)
                    cosine = np.clip(near[np.arange(hi - lo), best], 0, 1)
                    for row, ok in enumerate(letters):
                        own = m.owner[best[row]]
                        langs.append(m.langs[own] if ok else UNKNOWN)
                        scores.append(float(cosine[row]) if ok else 0.0)
                        gone.append(not ok or bool(cosine[row] < m.least[own]))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(gone, pa.bool_())],
                names=[*names, "lang_pred", "score", "rejected"],
            )

    return docs.mapInArrow(run, T.StructType([*docs.schema, *T.StructType.fromDDL("lang_pred string, score double, rejected boolean")]))
