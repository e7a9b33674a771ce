"""Near-duplicate classes by consistent weighted sampling over TF-IDF shingles.

1. Document frequencies of hashed word shingles over all distinct texts, in a table of fixed size.
2. Each text becomes a bag of shingles weighted by term frequency and a bounded inverse document frequency. Improved
   consistent weighted sampling (Ioffe, 2010) draws samples that two texts share with the probability of their weighted
   Jaccard similarity; ``rows`` samples make a band, and texts that share a band are candidates. As many bands again are
   of smallest hashes of the plain set of shingles: in a large group of near copies the shared shingles weigh little, and
   the weighted similarity of a pair falls with the size of its group, the plain one does not.
3. What a text has in common with any other candidate, by weight and by number, bounds its similarities to them from
   above, in the bands of either kind; texts whose bound is too low leave. The others are verified exactly and linked if the weighted or the
   plain Jaccard similarity reaches the limit, first every text of a band
   against a few leaders of the band and of similar size. Where a band still holds several classes, the texts outside its
   largest class are verified against all others with which they share a rare shingle (:func:`rare_pairs`). So no link is
   lost, and a group of k copies costs about k comparisons, not k squared.
4. Classes are connected components of the links. Equal texts are one node throughout.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from cityloom.llm import textkit
from cityloom.llm.storage import ship, table
from cityloom.operators.graph import connected_components

WORDS = 5
SIMILARITY = 0.8
BANDS = 8
ROWS = 2
DF_BITS = 20
LEADERS = 3
SIZE_CLASS = 0.1
SLICES = 16
_CHUNK = 1 << 16

_DRAWS = np.random.default_rng(7919)
_R = _DRAWS.gamma(2.0, 1.0, 1 << 16).astype(np.float32)
_LOG_C = np.log(_DRAWS.gamma(2.0, 1.0, 1 << 16)).astype(np.float32)
_BETA = _DRAWS.random(1 << 16).astype(np.float32)


def shingles(buf: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, textkit.Words]:
    """Distinct shingles of each document: document, hash and count, sorted by document and hash.

    A text of fewer than ``k`` words, but at least one, is a single shingle of all its words.
    """
    words = textkit.scan(buf, at, textkit.PLAIN)
    i, h = textkit.windows(words, k)
    doc = words.doc[i]
    whole, own = textkit.digests(words)
    short = np.diff(words.first)[whole] < k
    doc, h = np.concatenate([doc, whole[short]]), np.concatenate([h, own[short]])
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    head = np.flatnonzero(new)
    return doc[head], h[head], np.diff(np.append(head, len(h))), words


def _count_frequencies(k: int, bits: int):
    def run(batches):
        total, seen = np.zeros(1 << bits, np.int64), 0
        for batch in batches:
            for lo, hi, buf, at in textkit.blocks(batch.column(0)):
                _, h, _, _ = shingles(buf, at, k)
                total += np.bincount((h >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
                seen += hi - lo
        if seen:
            parts = total.reshape(-1, min(_CHUNK, 1 << bits)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(len(parts)), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary()), pa.array([seen] + [0] * (len(parts) - 1), pa.int64())],
                names=["part", "counts", "docs"],
            )

    return run


def _add_frequencies(batches):
    """Sum of the count vectors of each part in a partition."""
    sums: dict[int, list] = {}
    for batch in batches:
        for part, counts, docs in zip(*(batch.column(c).to_pylist() for c in ("part", "counts", "docs")), strict=True):
            v = np.frombuffer(counts, np.int32).astype(np.int64)
            if part in sums:
                sums[part][0] += v
                sums[part][1] += docs
            else:
                sums[part] = [v, docs]
    if sums:
        yield pa.RecordBatch.from_arrays(
            [pa.array(sums.keys(), pa.int32()), pa.array([v.tobytes() for v, _ in sums.values()], pa.binary()), pa.array([n for _, n in sums.values()], pa.int64())],
            names=["part", "counts", "docs"],
        )


def idf_weight(n: int, df: np.ndarray) -> np.ndarray:
    """Inverse document frequency, levelled off at both ends.

    A shingle in at most a hundredth of the ``n`` texts (or in four) has weight 1, so that groups of copies are compared
    as unweighted sets are; one in every text has 0.3, so that boilerplate alone makes no duplicates.
    """
    most = max(min(100.0, n / 4), 1.5)
    return np.clip(np.log(np.maximum(n / np.maximum(df, 1), 1)) / np.log(most), 0.3, 1).astype(np.float32)


def inverse_frequencies(docs: DataFrame, text: str, k: int = WORDS, bits: int = DF_BITS) -> np.ndarray:
    """:func:`idf_weight` by hashed shingle; equal texts count once.

    The table has ``2**bits`` entries whatever the input; a rare shingle's frequency is overstated by what shares its
    entry, at most one text in a few thousand, which leaves it at full weight.
    """
    rows = (
        docs.groupBy(F.xxhash64(text), F.xxhash64(F.lit(1), text))
        .agg(F.first(text).alias(text))
        .select(text)
        .mapInArrow(_count_frequencies(k, bits), "part int, counts binary, docs long")
        .repartition("part")
        .mapInArrow(_add_frequencies, "part int, counts binary, docs long")
        .collect()  # 2**bits counts
    )
    df = np.zeros(1 << bits, np.int64)
    for r in rows:
        v = np.frombuffer(r.counts, np.int64)
        df[r.part * len(v) : (r.part + 1) * len(v)] += v
    n = max(sum(r.docs for r in rows), 1)
    return idf_weight(n, df)


def samples(doc: np.ndarray, h: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """``n`` consistent weighted samples per document (rows in order of document), as 64-bit identities."""
    head = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
    size = np.diff(np.append(head, len(doc)))
    log_w = np.log(weight)
    out = np.empty((len(head), n), np.uint64)
    for j in range(n):
        draw = textkit.mix(h + np.uint64((j + 1) * 0x9E3779B97F4A7C15 % 2**64))
        r = _R[(draw & np.uint64(0xFFFF)).astype(np.int64)]
        beta = _BETA[((draw >> np.uint64(16)) & np.uint64(0xFFFF)).astype(np.int64)]
        t = np.floor(log_w / r + beta)
        a = _LOG_C[((draw >> np.uint64(32)) & np.uint64(0xFFFF)).astype(np.int64)] - r * (t - beta + 1)
        low = np.minimum.reduceat(a, head)
        hit = np.flatnonzero(a == np.repeat(low, size))
        at = hit[np.searchsorted(hit, head)]  # of equal values the smallest hash
        out[:, j] = textkit.mix(h[at] + t[at].astype(np.int64).astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))
    return out


def minima(doc: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """``n`` smallest hashes per document (rows in order of document), shared with the probability of the plain Jaccard similarity."""
    head = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
    out = np.empty((len(head), n), np.uint64)
    for j in range(n):
        out[:, j] = np.minimum.reduceat(textkit.mix(h ^ np.uint64((j + 1) * 0xA0761D6478BD642F % 2**64)), head)
    return out


def _signatures(k: int, bits: int, idf, bands: int, rows: int):
    def run(batches):
        weights = idf.value
        for batch in batches:
            ids = batch.column(0)
            for lo, hi, buf, at in textkit.blocks(batch.column(1)):
                doc, h, tf, words = shingles(buf, at, k)
                if not len(doc):
                    continue
                w = tf * weights[(h >> np.uint64(64 - bits)).astype(np.int64)]
                sig = np.hstack([samples(doc, h, w.astype(np.float32), bands * rows), minima(doc, h, bands * rows)])
                key = np.zeros((len(sig), 2 * bands), np.uint64)
                for j in range(rows):
                    key = textkit.mix(key * np.uint64(0x9E3779B97F4A7C15) + sig[:, j::rows])
                whole, same = textkit.digests(words)
                _, check = textkit.digests(words, np.uint64(0xC2B2AE3D27D4EB4F))
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(lo, hi - lo).take(pa.array(whole)),
                        pa.array(same.view(np.int64)),
                        pa.array(check.view(np.int64)),
                        pa.array(list(key.view(np.int64)), pa.list_(pa.int64())),
                    ],
                    names=["node", "t1", "t2", "bands"],
                )

    return run


def _vectors(k: int, bits: int, idf):
    def run(batches):
        weights = idf.value
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for lo, _, buf, at in textkit.blocks(batch.column(1)):
                doc, h, tf, _ = shingles(buf, at, k)
                w = (tf * weights[(h >> np.uint64(64 - bits)).astype(np.int64)]).astype(np.float32)
                part = (h % np.uint64(SLICES)).astype(np.int64)
                head = np.flatnonzero(np.append(True, doc[1:] != doc[:-1])) if len(doc) else []
                tail = np.append(head[1:], len(doc)) if len(doc) else []
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([ids[lo + doc[a]] for a in head], pa.int64()),
                        pa.array([h[a:b].tobytes() for a, b in zip(head, tail, strict=True)], pa.binary()),
                        pa.array([w[a:b].tobytes() for a, b in zip(head, tail, strict=True)], pa.binary()),
                        pa.array([float(w[a:b].sum(dtype=np.float64)) for a, b in zip(head, tail, strict=True)], pa.float64()),
                        pa.array([np.bincount(part[a:b], weights=w[a:b], minlength=SLICES).tolist() for a, b in zip(head, tail, strict=True)], pa.list_(pa.float64())),
                        pa.array([float(b - a) for a, b in zip(head, tail, strict=True)], pa.float64()),
                        pa.array([np.bincount(part[a:b], minlength=SLICES).astype(float).tolist() for a, b in zip(head, tail, strict=True)], pa.list_(pa.float64())),
                    ],
                    names=["node", "h", "w", "total", "slices", "number", "parts"],
                )

    return run


def _entries(batches):
    for batch in batches:
        for node, h, w in zip(*(batch.column(c).to_pylist() for c in ("node", "h", "w")), strict=True):
            h = np.frombuffer(h, np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(h), pa.array(np.full(len(h), node, np.int64)), pa.array(np.frombuffer(w, np.float32))], names=["h", "node", "w"]
            )


def _bounds(vectors: DataFrame) -> DataFrame:
    """``node, total, common``: the weight of each text, and by slice of the hashes (``SLICES``) at most how much of it any
    other text of ``vectors`` holds; ``number, alike``: the same with every shingle counted as 1. Two texts share at most
    the sum over slices of the smaller ``common`` or ``alike``."""
    mine = vectors.select("node", "h", "w").mapInArrow(_entries, "h long, node long, w float")
    # a shingle that only one candidate holds cannot be shared
    mine = mine.groupBy("h").agg(F.count("*").alias("n"), F.min("node").alias("node"), F.min("w").alias("w")).where("n = 1")
    at = F.pmod("h", F.lit(SLICES))
    own, alone = ([F.sum(F.when(at == k, x).otherwise(0.0)) for k in range(SLICES)] for x in (F.col("w"), F.lit(1.0)))
    mine = mine.groupBy("node").agg(F.array(*own).alias("own"), F.array(*alone).alias("alone"))
    every, each = (F.array(*(F.sum(F.get(c, F.lit(k))) for k in range(SLICES))) for c in ("slices", "parts"))
    weights = vectors.groupBy("node").agg(F.min("total").alias("total"), every.alias("slices"), F.min("number").alias("number"), each.alias("parts"))
    weights = weights.join(mine, "node", "left")
    none = F.array_repeat(F.lit(0.0), SLICES)
    rest = F.zip_with("slices", F.coalesce("own", none), lambda a, o: a * (1 + 1e-6) - o)
    left = F.zip_with("parts", F.coalesce("alone", none), lambda a, o: a - o)
    return weights.select("node", "total", rest.alias("common"), "number", left.alias("alike"))


def weighted_jaccard(h1: np.ndarray, w1: np.ndarray, h2: np.ndarray, w2: np.ndarray) -> float:
    """Sum of minima over sum of maxima of two weighted sets given by sorted hashes."""
    at = np.searchsorted(h2, h1)
    at[at == len(h2)] = 0
    both = h2[at] == h1
    low = float(np.minimum(w1[both], w2[at[both]]).sum(dtype=np.float64))
    top = float(w1.sum(dtype=np.float64) + w2.sum(dtype=np.float64)) - low
    return low / top if top else 0.0


def plain_jaccard(h1: np.ndarray, h2: np.ndarray) -> float:
    """Jaccard similarity of two sets given by sorted distinct hashes."""
    both = len(np.intersect1d(h1, h2, assume_unique=True))
    return both / max(len(h1) + len(h2) - both, 1)


def _verify(similarity: float):
    def run(batches):
        for batch in batches:
            u, v = batch.column("u").to_pylist(), batch.column("v").to_pylist()
            sides = [batch.column(c).to_pylist() for c in ("h", "w", "h2", "w2")]
            hit = []
            for row, (h1, w1, h2, w2) in enumerate(zip(*sides, strict=True)):
                h1, h2 = np.frombuffer(h1, np.uint64), np.frombuffer(h2, np.uint64)
                s = weighted_jaccard(h1, np.frombuffer(w1, np.float32), h2, np.frombuffer(w2, np.float32))
                if s >= similarity or plain_jaccard(h1, h2) >= similarity:
                    hit.append(row)
            yield pa.RecordBatch.from_arrays([pa.array([u[r] for r in hit], pa.int64()), pa.array([v[r] for r in hit], pa.int64())], names=["u", "v"])

    return run


def rare_pairs(vectors: DataFrame, similarity: float) -> DataFrame:
    """``u, v``: pairs of different ``root``, one of them ``outside``, that can reach ``similarity``; complete, by prefixes.

    The shingles of a text are put in order of how many of ``vectors`` hold them. A pair at the limit shares the fraction
    ``s / (1 + s)`` of both sizes; its rarest shared shingle therefore lies where at least so much is left of either text.
    Only these beginnings are joined, by shingle and class of size, for numbers and for weights of shingles alike. What is
    common to a whole group of near copies lies behind the beginnings of texts that differ from the group, so their
    candidates are the few that share their own shingles.
    """
    entries = vectors.select("node", "h", "w").mapInArrow(_entries, "h long, node long, w float")
    often = entries.groupBy("h").agg(F.count("*").alias("n")).where("n > 1")  # what one text alone holds cannot be shared
    rest = Window.partitionBy("node").orderBy(F.desc("n"), F.desc("h"))
    placed = entries.join(often, "h").select("node", "h", F.count("*").over(rest).cast("double").alias("left"), F.sum(F.col("w").cast("double")).over(rest).alias("heavy"))
    kinds = F.inline(F.array(F.struct(F.lit(0).alias("kind"), F.col("number").alias("size"), F.col("left").alias("rest")), F.struct(F.lit(1).alias("kind"), F.col("total").alias("size"), F.col("heavy").alias("rest"))))
    placed = placed.join(vectors.select("node", "root", "outside", "number", "total"), "node").select("node", "root", "outside", "h", kinds)
    slack = 1 - 1e-6
    tokens = table(placed.where(F.col("rest") >= similarity * slack * F.col("size")), "beginnings")
    width = float(np.log(1.05))
    grade = lambda size: F.floor(F.log(size) / width)
    share = similarity / (1 + similarity) * slack
    mine = tokens.where("outside").withColumn("grade", F.explode(F.sequence(grade(F.col("size") * similarity * slack), grade(F.col("size") / similarity / slack))))
    least = F.greatest(F.exp(F.col("grade") * width), F.col("size") * similarity)
    mine = mine.where(F.col("rest") >= share * (F.col("size") + least)).drop("outside")
    other = tokens.select("kind", "h", grade(F.col("size")).alias("grade"), *(F.col(c).alias(f"o_{c}") for c in ("node", "root", "size", "rest")))
    reach = F.least("rest", "o_rest") >= share * (F.col("size") + F.col("o_size"))
    met = mine.join(other, ["kind", "h", "grade"]).where((F.col("root") != F.col("o_root")) & reach)
    return met.select(F.least("node", "o_node").alias("u"), F.greatest("node", "o_node").alias("v")).distinct()


def duplicate_classes(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    words: int = WORDS,
    similarity: float = SIMILARITY,
    bands: int = BANDS,
    rows: int = ROWS,
    df_bits: int = DF_BITS,
) -> DataFrame:
    """``doc_id, class_id`` for every distinct non-null id; ``class_id`` is the smallest id of the near-duplicate class.

    Two texts are linked when their weighted or their plain Jaccard similarity over ``words``-word shingles reaches
    ``similarity``, and equal texts always are. Rows that share an id belong to one class. A null, empty or blank text has no shingles and is
    a class of its own, as is a text without a partner. Rows with a null id cannot be named and are not returned. Empty
    table: empty result. Only ``doc_id`` and ``text`` are read. A candidate pair at the threshold itself is missed with
    probability ``(1 - similarity**rows) ** bands`` (0.03 % by default) at most, nearer pairs far more rarely; there are
    ``bands`` bands for either similarity.
    """
    spark = docs.sparkSession
    ship(spark)
    source = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("node"), F.col(text).alias("text"))
    idf = spark.sparkContext.broadcast(inverse_frequencies(source, "text", words, df_bits))  # 4 * 2**df_bits bytes
    sig = table(
        source.mapInArrow(_signatures(words, df_bits, idf, bands, rows), "node long, t1 long, t2 long, bands array<long>"),
        "signatures",
    )
    # equal texts: the smallest id stands for all
    texts = table(sig.groupBy("t1", "t2").agg(F.min("node").alias("rep"), F.first("bands").alias("bands")), "texts")
    copies = sig.join(texts.select("t1", "t2", "rep"), ["t1", "t2"]).where("node <> rep").select(F.col("rep").alias("u"), F.col("node").alias("v"))
    member = texts.select("rep", F.posexplode("bands").alias("band", "key")).select("band", "key", F.col("rep").alias("node"))
    crowd = member.groupBy("band", "key").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    shared = table(member.join(crowd, ["band", "key"]), "bands")

    wanted = shared.select("node").distinct()
    vectors = table(
        source.join(wanted.hint("merge"), "node", "left_semi").mapInArrow(_vectors(words, df_bits, idf), "node long, h binary, w binary, total double, slices array<double>, number double, parts array<double>"), "vectors"
    )
    # from here on the bands of smallest hashes go by numbers of shingles, the others by weight
    plain = F.col("band") >= bands
    held = sum(F.get("common", F.lit(k)) for k in range(SLICES))
    shared = shared.join(_bounds(vectors), "node").select(
        "node", "band", "key", F.when(plain, F.col("number")).otherwise(F.col("total")).alias("total"), F.when(plain, F.col("alike")).otherwise(F.col("common")).alias("common")
    )
    shared = table(shared.withColumn("held", held).where(F.col("held") >= similarity * F.col("total")), "bands")

    def verified(pairs: DataFrame) -> DataFrame:
        left = vectors.select(F.col("node").alias("u"), "h", "w").hint("merge")
        right = vectors.select(F.col("node").alias("v"), F.col("h").alias("h2"), F.col("w").alias("w2")).hint("merge")
        return table(
            pairs.join(right, "v").join(left, "u").select("u", "v", "h", "w", "h2", "w2").mapInArrow(_verify(similarity), "u long, v long"), "links"
        )

    # every text of a band against a few leaders of its class of size: the text with the highest bound, the others by hash
    picks = [F.min_by("node", F.struct(-F.col("held") / F.col("total"), "node"))]
    picks += [F.min_by("node", F.xxhash64("node", F.lit(k))) for k in range(1, LEADERS)]
    lead = shared.groupBy("band", "key", F.floor(F.log("total") / SIZE_CLASS)).agg(F.array_distinct(F.array(*picks)).alias("nodes"))
    lead = shared.join(lead.select("band", "key", F.explode("nodes").alias("node")), ["band", "key", "node"])
    lead = lead.select("band", "key", *(F.col(c).alias(f"a_{c}") for c in ("node", "total", "common")))
    low = sum(F.least(F.get("common", F.lit(k)), F.get("a_common", F.lit(k))) for k in range(SLICES))
    link = (F.col("a_node") != F.col("node")) & (low >= similarity * (F.col("total") + F.col("a_total") - low))
    links = verified(lead.join(shared, ["band", "key"]).where(link).select(F.least("a_node", "node").alias("u"), F.greatest("a_node", "node").alias("v")).distinct())
    comp = table(connected_components(links), "classes")
    # bands that still hold several classes: texts outside the largest one against all others that share a rare shingle
    named = _with_classes(shared, comp)
    open_ = named.join(named.where("root <> main").select("band", "key").distinct(), ["band", "key"])
    open_ = table(open_.groupBy("node").agg(F.min("root").alias("root"), F.max(F.col("root") != F.col("main")).alias("outside")), "open")
    more = verified(rare_pairs(vectors.join(open_, "node"), similarity))
    edges = links.unionByName(more).unionByName(copies)
    final = table(connected_components(edges), "classes")
    return (
        source.select("node").distinct().join(final, "node", "left").select(F.col("node").alias("doc_id"), F.coalesce("root", "node").alias("class_id"))
    )


def _with_classes(shared: DataFrame, comp: DataFrame) -> DataFrame:
    """Band members with their class so far (``root``) and the largest class of the band (``main``)."""
    named = shared.select("band", "key", "node").join(comp, "node", "left").withColumn("root", F.coalesce("root", "node"))
    main = named.groupBy("band", "key", "root").count().groupBy("band", "key").agg(F.max_by("root", F.struct("count", "root")).alias("main"))
    return table(named.join(main, ["band", "key"]), "named")


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its class; rows with a null id stay. Columns are unchanged."""
    classes = duplicate_classes(docs, doc_id, text, **options)
    gone = classes.where("doc_id <> class_id").select(F.col("doc_id").alias("__gone"))
    return docs.join(gone, F.col(doc_id) == F.col("__gone"), "left_anti")
