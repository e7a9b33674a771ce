"""Nearest vectors through hierarchical k-means trees.

1. Equal vectors are one point that keeps its smallest ids: of more copies than a query may return none can be returned.
2. Points hang in blocks, one block per number of components at first. A block gets a k-means tree, fit on a bounded sample
   of its points: the leaf with the most points is split by k-means into ``BRANCH`` children until leaves are small or the
   tree has ``MOST_LEAVES``. All points of the block descend to a leaf. A leaf that is still crowded is a block of the next
   round, so the index deepens with the data, and no task ever holds more than one sample, tree or leaf.
3. A query walks the tree of a block best-bin-first: a priority queue holds open branches by the distance to their centre, the
   nearest is opened down to a leaf. Leaves that are blocks are walked in turn.
4. The number of leaves a walk visits is calibrated: for a sample of points the exact nearest neighbours are found by a scan,
   and the walk is widened until it reaches the leaves of the wanted share of them.
5. The first leaves give each query a bound, the distance of its last rank so far; the other leaves return only what is
   nearer. All distances are exact, in double precision, from the original vectors.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from cityloom.llm.storage import ship, table

TOP = 10
LEAF = 100
BRANCH = 8
MOST_LEAVES = 1024
SAMPLE = 16_384
RECALL = 0.97
JUDGES = 256
FIRST = 2
PIECE = 8192
ASKS = 2048
_ROUNDS = 8


def usable(vector: Column) -> Column:
    """Not null, no null or non-finite component, not zero."""
    big = F.lit(float("inf"))
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < big))
    return F.coalesce(vector.isNotNull() & sound & F.exists(vector, lambda x: x != 0), F.lit(False))


def points(rows: DataFrame, vec_id: str, vector: str, keep: int) -> DataFrame:
    """``v, ids``: the distinct usable vectors with their ``keep`` smallest ids."""
    sound = rows.where(usable(F.col(vector)) & F.col(vec_id).isNotNull())
    # adding 0 makes -0.0 and 0.0 alike
    sound = sound.select(F.transform(F.col(vector), lambda x: x.cast("double") + 0.0).alias("v"), F.col(vec_id).cast("long").alias("id"))
    place = F.dense_rank().over(Window.partitionBy("v").orderBy("id"))  # rows alike in id and vector are one
    return sound.withColumn("place", place).where(F.col("place") <= keep).groupBy("v").agg(F.array_sort(F.collect_set("id")).alias("ids"))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(flat, pa.ChunkedArray):
        flat = pa.concat_arrays(flat.chunks)
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of all rows of ``a`` to all of ``b``, from the differences."""
    out = np.empty((len(a), len(b)))
    step = max(1, (1 << 20) // max(b.size, 1))
    for lo in range(0, len(a), step):
        d = a[lo : lo + step, None, :] - b[None]
        out[lo : lo + step] = np.sqrt(np.einsum("ijk,ijk->ij", d, d))
    return out


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres**2).sum(1) - 2 * (x @ centres.T), axis=1)


def k_means(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = _ROUNDS) -> np.ndarray:
    """At most ``k`` centres of the rows of ``x``; centres that attract nothing are dropped."""
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        own = _nearest(x, centres)
        n = np.bincount(own, minlength=len(centres))
        sums = np.zeros((len(centres), x.shape[1]))
        np.add.at(sums, own, x)
        centres = sums[n > 0] / n[n > 0, None]
    return centres


@dataclass
class Tree:
    """Nodes in the order in which they were made, the root first: centres, first child and number of children, leaf number."""

    centres: np.ndarray
    child: np.ndarray
    children: np.ndarray
    leaf: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, scale: float, leaf: int = LEAF, branch: int = BRANCH, most: int = MOST_LEAVES) -> Tree:
        """Tree over a sample ``x`` of a block that holds ``scale`` points for each one of the sample."""
        rng = np.random.default_rng(len(x))
        centres, child, children = [x.mean(0)], [0], [0]
        queue, leaves = [(-len(x), 0, np.arange(len(x)))], 1
        while queue and leaves + branch <= most:
            size, node, rows = heapq.heappop(queue)
            if -size * scale <= leaf or len(rows) < 2:
                continue
            found = k_means(x[rows], branch, rng)
            own = _nearest(x[rows], found)
            parts = [(k, rows[own == k]) for k in range(len(found))]
            parts = [(k, r) for k, r in parts if len(r)]
            if len(parts) < 2:
                continue
            child[node], children[node] = len(centres), len(parts)
            leaves += len(parts) - 1
            for k, r in parts:
                heapq.heappush(queue, (-len(r), len(centres), r))
                centres.append(found[k])
                child.append(0)
                children.append(0)
        children = np.array(children, np.int32)
        number = np.where(children == 0, np.cumsum(children == 0) - 1, -1)
        return cls(np.array(centres), np.array(child, np.int32), children, number.astype(np.int32))

    def pack(self) -> dict:
        return {"centres": self.centres.tobytes(), "child": self.child.tobytes(), "children": self.children.tobytes(), "leaf": self.leaf.tobytes()}

    @classmethod
    def unpack(cls, row: dict) -> Tree:
        child, children, leaf = (np.frombuffer(row[c], np.int32) for c in ("child", "children", "leaf"))
        return cls(np.frombuffer(row["centres"]).reshape(len(child), -1), child, children, leaf)

    def descend(self, x: np.ndarray) -> np.ndarray:
        """Leaf number of each row."""
        at = np.zeros(len(x), np.int64)
        open_ = np.flatnonzero(self.children[at])
        while len(open_):
            nodes = at[open_]
            for node in np.unique(nodes):
                rows = open_[nodes == node]
                lo, n = self.child[node], self.children[node]
                at[rows] = lo + _nearest(x[rows], self.centres[lo : lo + n])
            open_ = open_[self.children[at[open_]] > 0]
        return self.leaf[at]

    def walk(self, x: np.ndarray, most: int, held: np.ndarray, least: int) -> list[list[int]]:
        """Leaves of each row in best-bin-first order: ``most`` of them, and more until they hold ``least`` points."""
        to = (self.centres**2).sum(1)[None] - 2 * (x @ self.centres.T)  # in the order of distances
        out = []
        for row in map(np.ndarray.tolist, to):
            seen, got, queue = [], 0, [(row[0], 0)]
            while queue and (len(seen) < most or got < least):
                node = heapq.heappop(queue)[1]
                while self.children[node]:
                    lo = int(self.child[node])
                    best, *rest = sorted((row[c], c) for c in range(lo, lo + int(self.children[node])))
                    for other in rest:
                        heapq.heappush(queue, other)
                    node = best[1]
                leaf = int(self.leaf[node])
                if held[leaf]:
                    seen.append(leaf)
                    got += held[leaf]
            out.append(seen)
        return out


_TREE = "centres binary, child binary, children binary, leaf binary"


def _fit(leaf: int, branch: int, most: int):
    def run(rows: pa.Table) -> pa.Table:
        x = _matrix(rows.column("v"))
        x = x[np.lexsort(x.T[::-1])]  # the order of arrival is no matter
        tree = Tree.fit(x, rows.column("total")[0].as_py() / len(x), leaf, branch, most)
        return pa.table({"block": rows.column("block").slice(0, 1), **{k: pa.array([v], pa.binary()) for k, v in tree.pack().items()}})

    return run


def _descend(rows: pa.Table, trees: pa.Table) -> pa.Table:
    if not len(rows):
        own = np.zeros(0, np.int32)
    else:
        own = Tree.unpack(trees.select(["centres", "child", "children", "leaf"]).to_pylist()[0]).descend(_matrix(rows.column("v")))
    names = [f"{b}.{n}" for b, n in zip(rows.column("block").to_pylist(), own.tolist(), strict=True)]
    return rows.select(["v", "ids"]).append_column("block", pa.array(names, pa.string()))


@dataclass
class Index:
    """``rounds``: per round the trees of its blocks with the points each leaf holds; ``leaves``: ``v, ids, block``."""

    rounds: list[DataFrame]
    leaves: DataFrame
    widths: list[int]
    keep: int


def _draw(salt: int) -> Column:
    """Number from 0 to 1 that follows from the vector."""
    return F.pmod(F.xxhash64("v", F.lit(salt)), F.lit(1 << 30)) / float(1 << 30)


def _sampled(rows: DataFrame, sizes: DataFrame, most: int) -> DataFrame:
    """About ``most`` points of each block, by a hash of the vector."""
    return rows.join(sizes, "block").where(_draw(17) * F.col("total") < most)


def build(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", keep: int = TOP + 1, leaf: int = LEAF, branch: int = BRANCH, most_leaves: int = MOST_LEAVES, sample: int = SAMPLE) -> Index:
    """Index of every usable row (:func:`points`), without widths."""
    ship(rows.sparkSession)
    open_ = table(points(rows, vec_id, vector, keep).withColumn("block", F.size("v").cast("string")), "points")
    rounds, done = [], None
    while True:
        sizes = open_.groupBy("block").agg(F.count("*").alias("total"))
        trees = _sampled(open_, sizes, sample).groupBy("block").applyInArrow(_fit(leaf, branch, most_leaves), f"block string, {_TREE}")
        trees = table(trees, "trees")
        # points of a block go to tasks in pieces, each with a copy of the tree
        pieces = F.ceil(F.col("total") / PIECE)
        cut = open_.join(sizes, "block").withColumn("piece", F.pmod(F.xxhash64("v"), pieces)).drop("total")
        copies = trees.join(sizes, "block").withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), pieces - 1))).drop("total")
        moved = cut.groupBy("block", "piece").cogroup(copies.groupBy("block", "piece")).applyInArrow(_descend, "v array<double>, ids array<long>, block string")
        moved = table(moved, "moved")
        held = moved.groupBy("block").agg(F.sum(F.size("ids")).alias("held"), F.count("*").alias("n"))
        held = held.select(F.regexp_extract("block", r"^(.*)\.", 1).alias("over"), F.regexp_extract("block", r"(\d+)$", 1).cast("int").alias("leaf_no"), "held", "n", "block")
        # a leaf with several times its due is a block of the next round, unless k-means could not part it
        single = held.groupBy("over").agg(F.count("*").alias("parts"))
        held = table(held.join(single, "over").withColumn("deeper", (F.col("n") > 4 * leaf) & (F.col("parts") > 1)), "held")
        lists = held.groupBy("over").agg(F.array_sort(F.collect_list(F.struct("leaf_no", "held", "deeper"))).alias("held"))  # most_leaves at most
        rounds.append(table(trees.join(lists, trees.block == lists.over).drop("over"), "round"))
        deeper = held.where("deeper").select("block")
        final = moved.join(deeper, "block", "left_anti")
        done = final if done is None else done.unionByName(final)
        if deeper.isEmpty():
            return Index(rounds, table(done, "leaves"), [], keep)
        open_ = table(moved.join(deeper, "block", "left_semi"), "open")


def _walk(most: int, least: int):
    def run(asks: pa.Table, trees: pa.Table) -> pa.Table:
        out: dict = {"ask": [], "block": [], "rank": [], "deeper": []}
        if len(asks) and len(trees):
            row = trees.select(["centres", "child", "children", "leaf", "held"]).to_pylist()[0]
            tree = Tree.unpack(row)
            held, deeper = np.zeros(len(tree.leaf), np.int64), set()
            for leaf in row["held"]:
                held[leaf["leaf_no"]] = leaf["held"]
                if leaf["deeper"]:
                    deeper.add(leaf["leaf_no"])
            block = trees.column("block")[0].as_py()
            for ask, leaves in zip(asks.column("ask").to_pylist(), tree.walk(_matrix(asks.column("v")), most, held, least), strict=True):
                out["ask"] += [ask] * len(leaves)
                out["block"] += [f"{block}.{n}" for n in leaves]
                out["rank"] += range(len(leaves))
                out["deeper"] += [n in deeper for n in leaves]
        return pa.table({"ask": pa.array(out["ask"], pa.int64()), "block": pa.array(out["block"], pa.string()), "rank": pa.array(out["rank"], pa.int32()), "deeper": pa.array(out["deeper"], pa.bool_())})

    return run


def _walked(asks: DataFrame, trees: DataFrame, most: int, least: int) -> DataFrame:
    """``ask, block, rank, deeper``: the leaves that ``asks`` (``ask, v, block``) visit in the trees of their blocks."""
    counts = asks.groupBy("block").agg(F.ceil(F.count("*") / ASKS).alias("pieces"))
    cut = asks.join(counts, "block").withColumn("piece", F.pmod(F.xxhash64("ask"), F.col("pieces"))).drop("pieces")
    copies = trees.join(counts, "block").withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1))).drop("pieces")
    found = cut.groupBy("block", "piece").cogroup(copies.groupBy("block", "piece")).applyInArrow(_walk(most, least), "ask long, block string, rank int, deeper boolean")
    return table(found, "walk")


def visits(index: Index, asks: DataFrame, widths: list[int]) -> DataFrame:
    """``ask, block, rank``: the leaves to search for ``asks`` (``ask, v``), nearest first within their block."""
    start = asks.withColumn("block", F.size("v").cast("string"))
    found, at = None, start
    for trees, most in zip(index.rounds, widths, strict=True):
        walk = _walked(at, trees, most, index.keep)
        ends = walk.where("not deeper").drop("deeper")
        found = ends if found is None else found.unionByName(ends)
        at = walk.where("deeper").join(asks, "ask").select("ask", "v", "block")
    return found


def _scan(judges, most: int):
    """Exact nearest points of a few vectors (broadcast) in the rows of a task."""

    def run(batches):
        ids, vectors = judges.value
        best: dict = {}
        for batch in batches:
            sizes = np.diff(batch.column("v").offsets.to_numpy())
            for dim in np.unique(sizes):
                pick = np.flatnonzero(sizes == dim)
                some = [k for k, v in enumerate(vectors) if len(v) == dim]
                if not some:
                    continue
                rows = batch.take(pa.array(pick))
                x, names = _matrix(rows.column("v")), rows.column("block").to_pylist()
                d = distances(np.array([vectors[k] for k in some]), x)
                for k, row in zip(some, d, strict=True):
                    for at in np.argsort(row, kind="stable")[: most + 1].tolist():
                        if row[at] > 0:  # not the vector itself
                            best.setdefault(k, []).append((float(row[at]), names[at]))
            best = {k: sorted(v)[:most] for k, v in best.items()}
        flat = [(ids[k], d, name) for k, v in best.items() for d, name in v]
        yield pa.RecordBatch.from_pydict({"ask": pa.array([f[0] for f in flat], pa.int64()), "d": pa.array([f[1] for f in flat], pa.float64()), "block": pa.array([f[2] for f in flat], pa.string())})

    return run


def calibrate(index: Index, recall: float = RECALL, top: int = TOP, judges: int = JUDGES) -> Index:
    """Index with the widths at which walks reach ``recall`` of the exact neighbours of about ``judges`` points.

    The sample and its ``top`` neighbours each are the only rows that come to the driver. Each round of an index is
    widened by itself until its walks reach the share ``recall ** (1 / rounds)``.
    """
    spark = index.leaves.sparkSession
    total = index.leaves.count()
    asked = index.leaves.where(_draw(29) * total < judges).select("v").collect()
    asked = sorted(r.v for r in asked)
    if not asked:
        return Index(index.rounds, index.leaves, [1] * len(index.rounds), index.keep)
    told = spark.sparkContext.broadcast((list(range(len(asked))), asked))
    near = index.leaves.select("v", "block").mapInArrow(_scan(told, top), "ask long, d double, block string")
    place = F.row_number().over(Window.partitionBy("ask").orderBy("d", "block"))
    near = table(near.withColumn("place", place).where(F.col("place") <= top).select("ask", "block"), "near")
    asks = spark.createDataFrame([(k, v) for k, v in enumerate(asked)], "ask long, v array<double>")
    widths = []
    for depth, trees in enumerate(index.rounds):
        # the leaf of this round in which each neighbour lies, and its rank in a walk of the whole tree
        steps = F.slice(F.split("block", r"\."), 1, depth + 2)
        wanted = near.where(F.size(F.split("block", r"\.")) >= depth + 2).select("ask", F.array_join(steps, ".").alias("block"))
        into = wanted.select("ask", F.regexp_extract("block", r"^(.*)\.", 1).alias("block")).distinct()
        full = _walked(into.join(asks, "ask"), trees, MOST_LEAVES + BRANCH, index.keep)
        ranks = sorted(r[0] for r in wanted.join(full, ["ask", "block"]).select("rank").collect())
        share = recall ** (1 / len(index.rounds))
        widths.append(ranks[min(len(ranks) - 1, int(np.ceil(share * len(ranks))) - 1)] + 1 if ranks else 1)
    return Index(index.rounds, index.leaves, widths, index.keep)


def _search(top: int):
    def run(asks: pa.Table, leaf: pa.Table) -> pa.Table:
        out: dict = {"ask": [], "vec_id": [], "score": []}
        if len(asks) and len(leaf):
            bound = asks.column("bound").to_numpy()
            d = distances(_matrix(asks.column("v")), _matrix(leaf.column("v")))
            ids = leaf.column("ids").to_pylist()
            for ask, own, far, row in zip(asks.column("ask").to_pylist(), asks.column("own").to_pylist(), bound, d, strict=True):
                near = np.flatnonzero(row <= far)
                if len(near) > top + 1:
                    last = np.partition(row[near], top)[top]
                    near = near[row[near] <= last]
                found = sorted((row[k], i) for k in near.tolist() for i in ids[k] if i != own)[:top]
                out["ask"] += [ask] * len(found)
                out["vec_id"] += [i for _, i in found]
                out["score"] += [float(s) for s, _ in found]
        return pa.table({"ask": pa.array(out["ask"], pa.int64()), "vec_id": pa.array(out["vec_id"], pa.int64()), "score": pa.array(out["score"], pa.float64())})

    return run


def _ranked(found: DataFrame, top: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("ask").orderBy("score", "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= top)


def _searched(index: Index, where: DataFrame, asks: DataFrame, top: int) -> DataFrame:
    """The ``top`` found per ask and leaf, no farther than the ask's ``bound``."""
    counts = where.groupBy("block").agg(F.ceil(F.count("*") / ASKS).alias("pieces"))
    cut = where.join(asks, "ask").join(counts, "block").withColumn("piece", F.pmod(F.xxhash64("ask"), F.col("pieces"))).drop("pieces")
    copies = index.leaves.join(counts, "block").withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1))).drop("pieces")
    return cut.groupBy("block", "piece").cogroup(copies.groupBy("block", "piece")).applyInArrow(_search(top), "ask long, vec_id long, score double")


def search(index: Index, queries: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", top: int = TOP) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``top`` nearest indexed rows found for each usable row of ``queries``.

    Nearest first, ties to the smaller id; a query's own id is no candidate, nor are vectors of another number of
    components. All candidates are returned if there are fewer than ``top``. Unusable queries and those without an id have
    no rows; rows alike in id and vector are one query, rows that share only the id one each. Empty table: no rows.
    """
    if top >= index.keep:
        raise ValueError(f"the index keeps {index.keep} ids of equal vectors; build it with keep > top")
    clean = queries.where(usable(F.col(vector)) & F.col(vec_id).isNotNull())
    clean = clean.select(F.col(vec_id).cast("long").alias("own"), F.transform(F.col(vector), lambda x: x.cast("double") + 0.0).alias("v")).distinct()
    asks = table(clean.withColumn("ask", F.monotonically_increasing_id()), "asks")
    where = table(visits(index, asks.select("ask", "v"), index.widths), "visits")
    open_ = asks.withColumn("bound", F.lit(float("inf")))
    first = table(_ranked(_searched(index, where.where(F.col("rank") < FIRST), open_, top), top), "first")
    bound = first.where(F.col("rank") == top).select("ask", F.col("score").alias("bound"))
    near = asks.join(bound, "ask", "left").withColumn("bound", F.coalesce("bound", F.lit(float("inf"))))
    more = _searched(index, where.where(F.col("rank") >= FIRST), near, top)
    final = _ranked(first.drop("rank").unionByName(more), top)
    return final.join(asks.select("ask", "own"), "ask").select(F.col("own").alias("query_id"), "rank", "vec_id", "score")
