"""Substring dedup by difference-cover anchors.

A match of ``window`` words between two places is found through a shorter anchor that starts at a *cover position*:
word positions whose remainder modulo ``period`` lies in a difference cover. For any two places some shift below
``period`` brings both onto cover positions, so with anchors of ``window - period + 1`` words every long match shares an
aligned anchor, while only ``len(cover) / period`` of the positions are hashed and shuffled. Windows around repeated
anchors are then extended to the full length and decided exactly by their 64-bit hash and order.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from cityloom.llm import textkit
from cityloom.llm.storage import ship, table

WINDOW = 20
PERIOD = 13
COVER = (0, 1, 3, 9)

_LAST = np.iinfo(np.int64).max


def is_cover(period: int, cover: tuple[int, ...]) -> bool:
    """Whether every remainder is a difference of two members."""
    return {(a - b) % period for a in cover for b in cover} == set(range(period))


def _first_of_runs(*keys: np.ndarray) -> np.ndarray:
    """For sorted keys: True where a row differs from the one before."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return new


def _places(doc: np.ndarray, ref: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(ref), pa.array(at.astype(np.int32))], names=["doc", "ref", "at"])


def _lists(column: pa.Array) -> list[np.ndarray]:
    """Rows of a list column as integer arrays; a null list is empty."""
    at, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False).astype(np.int64)
    return [values[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


def _anchor_rows(anchor: int, period: int, cover: tuple[int, ...]):
    wanted = np.zeros(period, bool)
    wanted[list(cover)] = True

    def run(batches):
        for batch in batches:
            doc_ids, refs = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            found = []
            for lo, _, buf, at in textkit.blocks(batch.column(2)):
                words = textkit.scan(buf, at, textkit.PLAIN)
                i, h = textkit.windows(words, anchor)
                place = i - words.first[words.doc[i]]
                keep = wanted[place % period]
                found.append((h[keep], words.doc[i[keep]] + lo, place[keep]))
            if not found:
                continue
            h, row, place = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.argsort(h, kind="stable")
            h, row, place = h[order], row[order], place[order]
            first = _first_of_runs(h)
            again = np.zeros(len(h), bool)  # repeated inside this batch
            again[:-1] |= ~first[1:]
            again |= ~first
            # one row per batch and anchor travels by its hash; the others are settled already and travel by document
            key = np.where(first, h.view(np.int64), refs[row])
            for a in range(0, len(h), 200_000):
                s = slice(a, a + 200_000)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(key[s]),
                        pa.array(h[s].view(np.int64)),
                        pa.array(again[s]),
                        pa.array(doc_ids[row[s]]),
                        pa.array(refs[row[s]]),
                        pa.array(place[s].astype(np.int32)),
                    ],
                    names=["key", "h", "again", "doc", "ref", "place"],
                )

    return run


def _columns(batches, *names: str) -> list[np.ndarray]:
    parts = [[b.column(n).to_numpy(zero_copy_only=False) for n in names] for b in batches]
    return [np.concatenate([p[k] for p in parts]) for k in range(len(names))] if parts else [np.zeros(0, np.int64) for _ in names]


def _repeated_anchors(batches):
    """A partition of anchors: the places of those found more than once."""
    h, again, doc, ref, place = _columns(batches, "h", "again", "doc", "ref", "place")
    if not len(h):
        return
    order = np.argsort(h, kind="stable")
    h, again, doc, ref, place = h[order], again[order].astype(bool), doc[order], ref[order], place[order]
    first = _first_of_runs(h)
    group = np.cumsum(first) - 1
    size = np.bincount(group)
    known = np.bincount(group, weights=again) > 0
    keep = again | (size[group] > 1) | known[group]
    if keep.any():
        yield _places(doc[keep], ref[keep], place[keep])


def _window_rows(window: int, anchor: int):
    """Windows that contain a repeated anchor: the first of each hash inside the batch by order, the others as settled."""

    def run(batches):
        for batch in batches:
            doc_ids, refs = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            marks = _lists(batch.column(3))
            found = []
            for lo, hi, buf, at in textkit.blocks(batch.column(2)):
                words = textkit.scan(buf, at, textkit.PLAIN)
                near = np.zeros(len(words.hash) + 1, np.int32)
                for row in range(lo, hi):
                    places = marks[row]
                    base = words.first[row - lo]
                    np.add.at(near, np.maximum(places + anchor - window, 0) + base, 1)
                    np.add.at(near, places + 1 + base, -1)
                covered = np.cumsum(near[:-1]) > 0
                i, h = textkit.windows(words, window)
                keep = covered[i]
                i, h = i[keep], h[keep]
                found.append((h, words.doc[i] + lo, i - words.first[words.doc[i]]))
            if not found:
                continue
            h, row, start = (np.concatenate(x) for x in zip(*found, strict=True))
            doc, ref = doc_ids[row], refs[row]
            order = np.lexsort((start, ref, doc, h))
            h, doc, ref, start = h[order], doc[order], ref[order], start[order]
            first = _first_of_runs(h)
            lead = np.flatnonzero(first)[np.cumsum(first) - 1] if len(h) else first
            keep = first | (doc != doc[lead]) | (ref != ref[lead]) | (start != start[lead])  # a repeated row counts once
            h, doc, ref, start, first = h[keep], doc[keep], ref[keep], start[keep], first[keep]
            key = np.where(first, h.view(np.int64), ref)
            for a in range(0, len(h), 200_000):
                s = slice(a, a + 200_000)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(key[s]),
                        pa.array(h[s].view(np.int64)),
                        pa.array(first[s]),
                        pa.array(doc[s]),
                        pa.array(ref[s]),
                        pa.array(start[s].astype(np.int32)),
                    ],
                    names=["key", "h", "head", "doc", "ref", "start"],
                )

    return run


def _later_windows(batches):
    """A partition of windows: the places of all but the earliest of each hash."""
    h, head, doc, ref, start = _columns(batches, "h", "head", "doc", "ref", "start")
    if not len(h):
        return
    head = head.astype(bool)
    gone = [(doc[~head], ref[~head], start[~head])]
    h, doc, ref, start = h[head], doc[head], ref[head], start[head]
    order = np.lexsort((start, ref, doc, h))
    h, doc, ref, start = h[order], doc[order], ref[order], start[order]
    if len(h):
        first = _first_of_runs(h)
        lead = np.flatnonzero(first)[np.cumsum(first) - 1]
        later = (doc != doc[lead]) | (ref != ref[lead]) | (start != start[lead])  # a repeated row is not later than itself
        gone.append((doc[later], ref[later], start[later]))
    doc, ref, start = (np.concatenate(x) for x in zip(*gone, strict=True))
    if len(doc):
        yield _places(doc, ref, start)


def _settle(names: list[str], text: str, window: int, with_text: bool):
    """Cut the marked windows out of each text and fill the result columns.

    A text without marks stays as it is; a row whose ``__at`` is set is left open for the windows to come.
    """

    def run(batches):
        for batch in batches:
            values, marks = batch.column(text).to_pylist(), _lists(batch.column("__marks"))
            later = batch.column("__at").is_valid().to_pylist() if "__at" in batch.schema.names else [False] * len(values)
            n_words, n_removed, digest = [], [], []
            for row, value in enumerate(values):
                if later[row]:
                    n_words.append(None), n_removed.append(None), digest.append(None)
                    continue
                words = (value or "").encode().split()
                n_words.append(len(words))
                starts = marks[row]
                if len(starts):
                    step = np.zeros(len(words) + 1, np.int32)
                    np.add.at(step, starts, 1)
                    np.add.at(step, starts + window, -1)
                    left = [words[k] for k in np.flatnonzero(np.cumsum(step[:-1]) <= 0)]
                    n_removed.append(len(words) - len(left))
                    body = b" ".join(left)
                    values[row] = body.decode()
                else:
                    n_removed.append(0)
                    body = b" ".join(words)
                digest.append(hashlib.sha256(body).hexdigest())
                if not with_text:
                    values[row] = None
            columns = {c: batch.column(c) for c in names if c in batch.schema.names}
            columns |= {
                text: pa.array(values, pa.string()),
                "n_words": pa.array(n_words, pa.int64()),
                "n_removed": pa.array(n_removed, pa.int64()),
                "kept_sha256": pa.array(digest, pa.string()),
            }
            yield pa.RecordBatch.from_arrays([columns[c] for c in names], names=names)

    return run


def _by_document(places: DataFrame, name: str) -> DataFrame:
    return places.groupBy(F.col("doc").alias("__doc"), F.col("ref").alias("__ref")).agg(F.collect_list("at").alias(name))


def remove_repeats(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    window: int = WINDOW,
    period: int = PERIOD,
    cover: tuple[int, ...] = COVER,
    with_text: bool = True,
) -> DataFrame:
    """``docs`` with every word removed that a window covers whose words also start earlier.

    Earlier means a smaller ``doc_id``, or the same document and a smaller start; all windows are judged on the input.
    Adds ``n_words, n_removed, kept_sha256`` (of the kept words joined by single spaces), replacing columns of these
    names. A text that loses words is its kept words joined by single spaces; any other text is unchanged. With
    ``with_text=False`` the text column comes back null.

    Null text: no words, stays null. Null id: after all other ids. Rows that share an id are ordered by a hash of their
    text; rows equal in id and text are one document and both keep what it keeps. Texts shorter than a window keep
    everything. Empty table: empty result. Other columns pass through; names that start with ``__`` are reserved.
    """
    if not is_cover(period, cover) or window <= period:
        raise ValueError("cover must be a difference cover of a period below the window")
    anchor = window - period + 1
    ship(docs.sparkSession)
    docs = docs.drop("n_words", "n_removed", "kept_sha256")
    keyed = docs.withColumns(
        {
            "__doc": F.coalesce(F.col(doc_id).cast("long"), F.lit(int(_LAST))),
            "__ref": F.xxhash64(F.col(doc_id).isNull(), F.col(doc_id), F.col(text)),
        }
    )
    source = keyed.select("__doc", "__ref", text)
    anchors = source.mapInArrow(
        _anchor_rows(anchor, period, cover),
        "key long, h long, again boolean, doc long, ref long, place int",
    )
    hits = table(
        anchors.repartition("key").mapInArrow(_repeated_anchors, "doc long, ref long, at int"), "anchors"
    )
    near = _by_document(hits, "__at")
    key = ["__doc", "__ref"]
    extra = [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType())]
    result = T.StructType([*docs.schema.fields, *extra])
    judged = keyed.join(near, key, "left")
    held = T.StructType([*judged.schema.fields, *extra])
    nothing = F.lit(None).cast("array<int>")
    # texts without a repeated anchor are settled in the same pass and do not travel again
    judged = table(
        judged.withColumn("__marks", nothing).mapInArrow(_settle(held.fieldNames(), text, window, with_text), held), "anchored"
    )
    open_ = judged.where(F.col("__at").isNotNull())
    rows = open_.select("__doc", "__ref", text, "__at").mapInArrow(
        _window_rows(window, anchor), "key long, h long, head boolean, doc long, ref long, start int"
    )
    later = table(rows.repartition("key").mapInArrow(_later_windows, "doc long, ref long, at int"), "windows")
    marks = _by_document(later, "__marks")
    hit = open_.select(*key, *docs.columns).join(marks, key, "left").drop(*key)
    hit = hit.mapInArrow(_settle(result.fieldNames(), text, window, with_text), result)
    return judged.where(F.col("__at").isNull()).select(*result.fieldNames()).unionByName(hit)
