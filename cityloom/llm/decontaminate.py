"""Benchmark decontamination by a distributed positional inverted index.

1. The test items are cut into windows of ``window`` words (a shorter item is one window), equal windows once.
2. Corpus frequencies of all terms of the windows are counted over every text; each window is represented by its two
   rarest terms and their offsets.
3. The index stores the postings of those terms: document, position and the hashes of the surrounding words.
4. A window's candidates are the postings of its rarest term, shifted by its offset, that the shifted postings of the
   second term confirm; the stored surroundings then decide the exact phrase (or, for :func:`proximity_matches`, whether
   both terms stand within a distance).

The windows are the query set. They are handled in blocks of ``block_items`` items, so what is sent to the tasks has a
bound that does not grow with the corpus or with the number of items.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cityloom.llm import textkit
from cityloom.llm.storage import ship, table

WINDOW = 13
BLOCK_ITEMS = 20_000


def _lowered(column: pa.Array):
    for lo, hi, buf, at in textkit.blocks(column):
        yield lo, hi, textkit.scan(textkit.LOWER[buf], at, textkit.ALNUM)


def item_windows(items: DataFrame, item_id: str, text: str, window: int) -> DataFrame:
    """``item, win, words``: windows of each item; ``win`` is a 64-bit hash of the window and ``words`` the word hashes."""

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for lo, _, words in _lowered(batch.column(1)):
                out = []
                for d in range(len(words.first) - 1):
                    h = words.hash[words.first[d] : words.first[d + 1]]
                    n = min(window, len(h))
                    if n:
                        parts = np.lib.stride_tricks.sliding_window_view(h, n)
                        keys = textkit.mix((parts * textkit.powers(n)).sum(axis=1, dtype=np.uint64) + np.uint64(n)).view(np.int64)
                        out += [(ids[lo + d], int(k), p.view(np.int64).tolist()) for k, p in zip(keys, parts.copy(), strict=True)]
                if out:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.list_(pa.int64()))],
                        names=["item", "win", "words"],
                    )

    plain = items.where(F.col(item_id).isNotNull()).select(F.col(item_id).cast("string"), F.col(text))
    return plain.mapInArrow(run, "item string, win long, words array<long>").distinct()


def _spread(values: np.ndarray, sorted_terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of ``values`` that are among ``sorted_terms``, and their places there."""
    if not len(sorted_terms):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    bits = (values >> np.uint64(44)).astype(np.int64)
    first = np.zeros(1 << 20, bool)
    first[(sorted_terms >> np.uint64(44)).astype(np.int64)] = True
    maybe = np.flatnonzero(first[bits])
    at = np.searchsorted(sorted_terms, values[maybe])
    at[at == len(sorted_terms)] = 0
    hit = sorted_terms[at] == values[maybe]
    return maybe[hit], at[hit]


def _frequencies(terms):
    def run(batches):
        wanted = terms.value
        total = np.zeros(len(wanted), np.int64)
        for batch in batches:
            for _, _, words in _lowered(batch.column(0)):
                total += np.bincount(_spread(words.hash, wanted)[1], minlength=len(wanted))
        hit = np.flatnonzero(total)
        if len(hit):
            yield pa.RecordBatch.from_arrays([pa.array(wanted[hit].view(np.int64)), pa.array(total[hit])], names=["term", "n"])

    return run


def _postings(terms, reach: int):
    """One row per text: number of words and the postings of the wanted terms with the words around each."""

    def run(batches):
        wanted = terms.value
        for batch in batches:
            ids, key = batch.column(0), batch.column(1)
            for lo, hi, words in _lowered(batch.column(2)):
                at, _ = _spread(words.hash, wanted)
                doc = words.doc[at]
                pad = np.concatenate([np.zeros(reach, np.uint64), words.hash, np.zeros(reach, np.uint64)]).view(np.int64)
                around = np.lib.stride_tricks.sliding_window_view(pad, 2 * reach + 1)[at] if len(at) else np.zeros((0, 2 * reach + 1), np.int64)
                place = at[:, None] + np.arange(-reach, reach + 1)
                around = np.where((place >= words.first[doc][:, None]) & (place < words.first[doc + 1][:, None]), around, 0) if len(at) else around
                cut = np.searchsorted(doc, np.arange(hi - lo + 1)).astype(np.int32)
                fields = [
                    pa.array(words.hash[at].view(np.int64)),
                    pa.array((at - words.first[doc]).astype(np.int32)),
                    pa.FixedSizeBinaryArray.from_buffers(pa.binary(8 * (2 * reach + 1)), len(at), [None, pa.py_buffer(np.ascontiguousarray(around).tobytes())]).cast(pa.binary()),
                ]
                lists = pa.ListArray.from_arrays(pa.array(cut), pa.StructArray.from_arrays(fields, names=["term", "pos", "around"]))
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(lo, hi - lo), key.slice(lo, hi - lo), pa.array(np.diff(words.first)), lists], names=["doc", "ref", "n_words", "postings"]
                )

    return run


def _phrases(reach: int):
    """Keep the candidates whose stored surroundings hold the window's words at the offset."""

    def run(batches):
        for batch in batches:
            around = batch.column("around").to_pylist()
            words, offset = batch.column("words").to_pylist(), batch.column("o1").to_pylist()
            hit = [
                row
                for row, (a, w, o) in enumerate(zip(around, words, offset, strict=True))
                if np.frombuffer(a, np.int64)[reach - o : reach - o + len(w)].tolist() == w
            ]
            if hit:
                take = pa.array(hit)
                yield pa.RecordBatch.from_arrays([batch.column(c).take(take) for c in ("doc", "ref", "win", "start", "len")], names=["doc", "ref", "win", "start", "len"])

    return run


def _longs(rows: list, spark):
    return spark.sparkContext.broadcast(np.sort(np.array([r[0] for r in rows], np.int64).view(np.uint64)))


class Index:
    """Windows of a block of items and the stored postings that answer them."""

    def __init__(self, source: DataFrame, items: DataFrame, window: int):
        spark = source.sparkSession
        self.window, reach = window, window - 1
        self.items = table(items, "windows")
        wins = self.items.groupBy("win").agg(F.first("words").alias("words"))
        term = F.explode("words").alias("term")
        # at most block_items * words of an item; the bound is the block's, not the corpus's
        terms = _longs(self.items.select(term).distinct().collect(), spark)
        found = source.select("text").mapInArrow(_frequencies(terms), "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
        found = table(found, "frequencies")
        placed = wins.select("win", F.posexplode("words").alias("o", "term"))
        ranked = placed.join(found, "term", "left").groupBy("win").agg(
            F.sort_array(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "term", "o"))).alias("by"), F.min(F.coalesce("n", F.lit(0))).alias("low")
        )
        # a window with a term that no text holds cannot occur
        chosen = ranked.where("low > 0").select(
            "win", F.col("by")[0]["term"].alias("t1"), F.col("by")[0]["o"].alias("o1"),
            F.when(F.size("by") > 1, F.col("by")[1]["term"]).alias("t2"), F.when(F.size("by") > 1, F.col("by")[1]["o"]).alias("o2"),
        )
        self.windows = table(chosen.join(wins, "win"), "chosen")
        rare = _longs(self.windows.select(F.explode(F.array("t1", "t2")).alias("t")).where("t IS NOT NULL").distinct().collect(), spark)
        self.texts = table(source.mapInArrow(_postings(rare, reach), "doc long, ref long, n_words long, postings array<struct<term: long, pos: int, around: binary>>"), "index")
        self.postings = self.texts.select("doc", "ref", F.inline("postings")).withColumnRenamed("pos", "place")

    def phrases(self) -> DataFrame:
        """``doc, ref, win, start, len`` of every exact occurrence of a window."""
        first = self.postings.join(self.windows, F.col("term") == F.col("t1")).where("place >= o1").withColumn("start", F.col("place") - F.col("o1"))
        one = first.where("t2 IS NULL").select("doc", "ref", "win", "start", "around", "words", "o1", F.size("words").alias("len"))
        second = self.postings.select(F.col("doc").alias("d2"), F.col("ref").alias("r2"), F.col("term").alias("t"), F.col("place").alias("p2"))
        two = first.join(second, (F.col("doc") == F.col("d2")) & (F.col("ref") == F.col("r2")) & (F.col("t2") == F.col("t")) & (F.col("start") + F.col("o2") == F.col("p2")), "left_semi")
        both = one.unionByName(two.select("doc", "ref", "win", "start", "around", "words", "o1", F.size("words").alias("len")))
        return both.mapInArrow(_phrases(self.window - 1), "doc long, ref long, win long, start int, len int")


def proximity_matches(index: Index, distance: int) -> DataFrame:
    """``doc, ref, win`` where the two rarest terms of a window stand at most ``distance`` words apart, in any order."""
    first = index.postings.join(index.windows, F.col("term") == F.col("t1")).select("doc", "ref", "win", "t2", "place")
    second = index.postings.select(F.col("doc").alias("d2"), F.col("ref").alias("r2"), F.col("term").alias("t"), F.col("place").alias("p2"))
    near = (F.col("doc") == F.col("d2")) & (F.col("ref") == F.col("r2")) & (F.col("t2") == F.col("t"))
    return first.join(second, near & (F.abs(F.col("place") - F.col("p2")) <= distance)).select("doc", "ref", "win").distinct()


def _keyed(docs: DataFrame, doc_id: str, text: str) -> dict:
    return {"__doc": F.coalesce(F.col(doc_id).cast("long"), F.lit(-(2**63))), "__ref": F.xxhash64(F.col(doc_id).isNull(), F.col(doc_id), F.col(text))}


def report(
    docs: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    block_items: int = BLOCK_ITEMS,
) -> DataFrame:
    """``__doc, __ref, n_words, n_hit, item_list``: per row of ``docs`` the words, words hit and matched items.

    Words are runs of letters, digits and non-ASCII characters after lower-casing A-Z. An item with fewer than ``window``
    words, but at least one, is a single window. ``item_list`` holds the distinct item ids as sorted strings. Null or empty
    texts have no words and no hits; null or empty items, and items without an id, match nothing. Without items nothing is
    hit. Repeated rows give a result row each; rows that share an id but not the text are judged apart.
    """
    ship(docs.sparkSession)
    source = docs.select(*(v.alias(k) for k, v in _keyed(docs, doc_id, text).items()), F.col(text).alias("text"))
    wins = item_windows(items, item_id, item_text, window)
    n_blocks = -(-items.select(item_id).distinct().count() // block_items) or 1
    hits, texts = None, None
    for b in range(n_blocks):
        own = wins if n_blocks == 1 else wins.where(F.pmod(F.xxhash64("item"), F.lit(n_blocks)) == b)
        index = Index(source, own, window)
        texts = index.texts.select("doc", "ref", "n_words") if texts is None else texts
        found = table(index.phrases().join(index.items.select("win", "item"), "win"), "phrases")
        hits = found if hits is None else hits.unionByName(found)
    spans = hits.groupBy("doc", "ref", "start").agg(F.max("len").alias("len"))
    spans = spans.groupBy("doc", "ref").agg(F.sort_array(F.collect_list(F.struct("start", "len"))).alias("s"))
    ends = F.aggregate(
        "s",
        F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
        lambda acc, x: F.struct(
            F.greatest(acc["end"], x["start"] + x["len"]).alias("end"),
            (acc["n"] + F.greatest(F.lit(0), x["start"] + x["len"] - F.greatest(acc["end"], x["start"]))).alias("n"),
        ),
    )
    n_hit = spans.select("doc", "ref", ends["n"].alias("n_hit"))
    by_item = hits.select("doc", "ref", "item").distinct().groupBy("doc", "ref").agg(F.sort_array(F.collect_list("item")).alias("item_list"))
    out = texts.join(n_hit.join(by_item, ["doc", "ref"]), ["doc", "ref"], "left")
    return out.select(
        F.col("doc").alias("__doc"), F.col("ref").alias("__ref"), "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("item_list", F.array().cast("array<string>")).alias("item_list"),
    )


def contaminated(n_hit, n_words):
    """The contract's rule: some word hit, and at least one word in twenty."""
    return (n_hit > 0) & (20 * n_hit >= n_words)


def keep_clean(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that are not contaminated; columns unchanged."""
    found = report(docs, items, doc_id, text, **options).where(contaminated(F.col("n_hit"), F.col("n_words"))).select("__doc", "__ref")
    names = docs.columns
    return docs.withColumns(_keyed(docs, doc_id, text)).join(found, ["__doc", "__ref"], "left_anti").select(*names)
