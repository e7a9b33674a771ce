"""Building-type model: truth set, spatial folds, balanced random forest, out-of-fold and city predictions."""

from __future__ import annotations

import math
import sys
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from cityloom import rules
from cityloom.functions import resample, trees
from cityloom.operators import labelling as L
from cityloom.operators.features import distinct_codes
from cityloom.operators.skew import union_all
from cityloom.session import cut_lineage
from cityloom.sources.tables import lookup

# tasks get the helpers of this module with the plan, so executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])


class TruthMismatch(RuntimeError):
    """The matched truth set differs from the expected counts."""


def matched_truth(truth: DataFrame, buildings: DataFrame, exclude: list) -> DataFrame:
    """Annotated points matched to a building: ``val_id, bid, truth_arch, is_train``. Needs footprints only, no labels."""
    t = L.annotated(truth)
    m = L.match_labels(t, buildings).select("val_id", "bid").join(t.select("val_id", "truth_arch"), "val_id")
    return m.withColumn("is_train", ~F.col("val_id").isin(exclude) if exclude else F.lit(True))


def truth_set(truth: DataFrame, buildings: DataFrame, master: DataFrame, exclude: list, expected: dict[str, int] | None = None) -> DataFrame:
    """:func:`matched_truth` with ``in_parcel``: ``val_id, bid, truth_arch, in_parcel, is_train``.

    ``expected`` may hold ``matched`` and ``in_parcel``; other counts stop the job.
    """
    m = matched_truth(truth, buildings, exclude)
    out = m.join(master.select("bid", F.col("euluc_class").isNotNull().alias("in_parcel")), "bid")
    out = out.select("bid", "val_id", "truth_arch", "in_parcel", "is_train")
    if expected:
        got = out.agg(F.count("*").alias("matched"), F.count_if("in_parcel").alias("in_parcel")).first().asDict()
        off = {k: (got[k], v) for k, v in expected.items() if got[k] != v}
        if off:
            raise TruthMismatch(f"(found, expected): {off}")
    return out


def with_cell(df: DataFrame, x: str, y: str, size: float = rules.CV_CELL_M) -> DataFrame:
    return df.withColumn("cell", F.floor(F.col(x) / size).cast("bigint") * 100000 + F.floor(F.col(y) / size))


def spatial_folds(df: DataFrame, n_folds: int = rules.CV_FOLDS) -> DataFrame:
    """Add ``fold``: whole cells, largest first, each to the fold with the fewest rows so far.

    Only one count per 5 km cell reaches the driver, a number bounded by the area covered.
    """
    counts = df.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()
    load = [0] * n_folds
    rows = []
    for r in sorted(counts, key=lambda r: (-r["n"], r["cell"])):
        k = min(range(n_folds), key=lambda f: load[f])
        load[k] += r["n"]
        rows.append((r["cell"], k))
    return df.join(df.sparkSession.createDataFrame(rows, "cell bigint, fold int"), "cell")


def assemble(features: DataFrame, names: list[str], keep: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=names, outputCol="features", handleInvalid="error").transform(features).select(*keep, "features")


class Forest(NamedTuple):
    """Trees of one or more forests as a table (``forest, tree, branch`` and the arrays of :class:`trees.Tree`).

    ``cuts`` are the bin limits of each forest by feature; ``tops`` the upper nodes of trees with more rows than a task takes,
    whose leaves are the branches of the table; ``gains`` the impurity decrease by ``forest, tree, feature``.
    """

    trees: DataFrame
    gains: DataFrame
    cuts: dict[int, list[np.ndarray]]
    tops: dict[tuple[int, int], dict]
    n_classes: int


#: the forest of all rows; others are named by the fold they leave out
WHOLE = -1
#: rows of a block whose draws are made together, and of one that is predicted
TRAIN_BLOCK, APPLY_BLOCK = 8192, 65_536
#: merged rows whose branch is grown in one task; nodes of more are cut by histograms added up over all tasks
BRANCH_ROWS = 1 << 20
#: tasks that grow trees, at least, and merged rows that each of more is dealt
GROW_TASKS, GROW_ROWS = 96, 1 << 18
#: merged rows dealt to trees in one job, which bounds its shuffle
WAVE_ROWS = 1 << 27
#: rows and bytes of trees that meet in one task of the prediction
MEET_ROWS, MEET_BYTES = 1 << 19, 1 << 26

_FOREST = "forest int, tree int, branch int, feature binary, cut binary, left binary, votes binary, gains array<double>"


def _features(df: DataFrame) -> Column:
    """The feature vector as an array, whichever of both it is."""
    return F.col("features") if df.schema["features"].dataType.typeName() == "array" else vector_to_array("features")


def _matrix(column) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _bin_cuts(data: DataFrame, forests: list[int]) -> dict[int, list[np.ndarray]]:
    """Cuts per forest and feature: midpoints of all values where these are few, else quantiles of the forest's rows.

    A row per forest and feature reaches the driver, with at most ``MAX_BINS`` cuts.
    """
    few = trees.MAX_BINS

    def values(batches):
        seen = {}
        for batch in batches:
            fold, x = batch.column(0).to_numpy(), _matrix(batch.column(1))
            for forest in forests:
                mine = x[fold != forest]
                for f in range(x.shape[1]):
                    old = seen.get((forest, f), np.zeros(0))
                    seen[forest, f] = old if len(old) > few else np.unique(np.append(old, np.unique(mine[:, f])))[: few + 1]
        cols = [[k[0] for k in seen], [k[1] for k in seen], [v.tolist() for v in seen.values()]]
        yield _record(["forest", "f", "v"], cols, [pa.int32(), pa.int32(), pa.list_(pa.float64())])

    met = data.select("_fold", "_x").mapInArrow(values, "forest int, f int, v array<double>")
    known = met.groupBy("forest", "f").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("v")))), 1, few + 1).alias("v"))
    out, wide = {}, []
    for r in known.collect():
        v = np.array(r["v"])
        out[r["forest"], r["f"]] = (v[1:] + v[:-1]) / 2
        if len(v) > few:
            wide.append((r["forest"], r["f"]))
    if wide:
        fs = F.array(*[F.struct(F.lit(f).alias("f"), F.get("_x", F.lit(f)).alias("v")) for f in sorted({f for _, f in wide})])
        each = data.select(F.explode(F.array(*[F.lit(f) for f in forests])).alias("forest"), "_fold", "_x").where("forest <> _fold")
        each = each.select("forest", F.inline(fs)).groupBy("forest", "f")
        for r in each.agg(F.percentile_approx("v", [k / few for k in range(few)], 10_000).alias("v")).collect():
            if (r["forest"], r["f"]) in wide:
                out[r["forest"], r["f"]] = np.unique(r["v"])
    return {g: [out[g, f] for f in range(1 + max(f for _, f in out))] for g in forests}


def _routed(tops: dict, forest: int, tree: int, x: np.ndarray) -> np.ndarray:
    top = tops.get((forest, tree))
    return np.zeros(len(x), np.int32) if top is None else trees.leaves(*(np.array(top[c]) for c in ("feature", "cut", "left")), x)


def _merged(rows: DataFrame, forests: list[int], cuts: dict, n_rows: int) -> DataFrame:
    """Blocks of training rows for each forest: ``forest, n, k, starts, x, y``, rows with the same bins and class merged.

    Trees see bins and classes only, so rows are dealt out in order of these and a block names each of its ``n`` different
    ones once, with the keys of its rows from ``starts`` on. The key ends the order, so that copies of a row fill many blocks.
    """

    def bins(batches):
        for batch in batches:
            values = _matrix(batch.column(3))
            b = np.ascontiguousarray(np.concatenate([trees.binned(values, cuts[f]) for f in forests], axis=1))
            at = np.arange(len(b) + 1, dtype=np.int32) * b.shape[1]
            packed = pa.Array.from_buffers(pa.binary(), len(b), [None, pa.py_buffer(at.tobytes()), pa.py_buffer(b.tobytes())])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], packed], names=["_k", "_y", "_fold", "_b"])

    def pack(batches):
        held = []

        def out():
            key, label, fold = (np.concatenate([b.column(c).to_numpy() for b in held]) for c in range(3))
            x = np.frombuffer(b"".join(v for b in held for v in b.column(3).to_pylist()), np.uint8).reshape(len(key), len(forests), -1)
            for n, forest in enumerate(forests):
                mine = np.flatnonzero(fold != forest)
                if not len(mine):
                    continue
                own, y = x[mine, n], label[mine].astype(np.int16)
                order, starts = trees.distinct(np.concatenate([own, y.view(np.uint8).reshape(-1, 2)], axis=1))
                first = order[starts]
                parts = [key[mine][order].astype(np.int64), starts.astype(np.int32), own[first], y[first]]
                cols = [[forest], [len(starts)], *([a.tobytes()] for a in parts)]
                yield _record(["forest", "n", "k", "starts", "x", "y"], cols, [pa.int32(), pa.int64()] + [pa.binary()] * 4)
            held.clear()

        for batch in batches:
            held.append(batch)
            if sum(len(b) for b in held) >= TRAIN_BLOCK:
                yield from out()
        if held:
            yield from out()

    ranged = rows.mapInArrow(bins, "_k bigint, _y int, _fold int, _b binary")
    ranged = ranged.repartitionByRange(max(1, -(-n_rows // TRAIN_BLOCK)), "_b", "_y", "_k")
    return cut_lineage(ranged.mapInArrow(pack, "forest int, n bigint, k binary, starts binary, x binary, y binary"), frees=True)


def _dealt(batches, lots: list[tuple[int, int, int]], seed: int):
    """For each block and tree of its lot (forest, first tree, end): merged rows and the sums of their multiplicities."""
    for batch in batches:
        for own, *parts in zip(*(batch.column(c).to_pylist() for c in ("forest", "k", "starts", "x", "y")), strict=True):
            k, starts, x, y = (np.frombuffer(p, t) for p, t in zip(parts, (np.int64, np.int32, np.uint8, np.int16), strict=True))
            x, draws = x.reshape(len(y), -1), resample.Draws(seed, k)
            for _, lo, hi in (lot for lot in lots if lot[0] == own):
                for a in range(lo, hi, 64):
                    ids = np.arange(a, min(a + 64, hi), dtype=np.int64)
                    times = np.add.reduceat(draws(ids + 1), starts, axis=1, dtype=np.int32)
                    for tree, t in zip(ids, times, strict=True):
                        got = t > 0
                        if got.any():
                            yield own, int(tree), x[got], y[got], t[got]


def _record(names: list[str], columns: list[list], kinds: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def _grown(data: DataFrame, lots: list, cuts: dict, tops: dict, weights: dict, k: int, max_depth: int, seed: int, n_merged: int) -> DataFrame:
    """One row per branch of the trees of ``lots``: blocks are dealt to branches, each branch is grown in a task."""
    closed = {(f, t, n) for (f, t), top in tops.items() for n in top["closed"]}

    def deal(batches):
        rows, size = [], 0

        def out():
            return _record(["forest", "tree", "branch", "x", "y", "t"], list(map(list, zip(*rows, strict=True))), [pa.int32()] * 3 + [pa.binary()] * 3)

        for forest, tree, x, y, t in _dealt(batches, lots, seed):
            at = _routed(tops, forest, tree, x)
            for branch in np.unique(at):
                if (forest, tree, int(branch)) not in closed:
                    m = at == branch
                    rows.append((forest, tree, int(branch), x[m].tobytes(), y[m].tobytes(), t[m].tobytes()))
                    size += x.shape[1] * int(m.sum())
            if size > 1 << 22 or len(rows) > 256:
                yield out()
                rows, size = [], 0
        if rows:
            yield out()

    def build(key, table):
        forest, tree, branch = (int(v.as_py()) for v in key)
        x, y, t = (np.frombuffer(b"".join(table.column(c).to_pylist()), d) for c, d in (("x", np.uint8), ("y", np.int16), ("t", np.int32)))
        top = tops.get((forest, tree))
        depth = max_depth - (top["depth"][branch] if top else 0)
        rng = np.random.default_rng([seed, forest + 1, tree, branch])
        grown, gains = trees.grow(x.reshape(len(y), -1), y, t, weights[forest], k, depth, rng)
        cols = [[forest], [tree], [branch], *([b] for b in grown.dump()), [gains.tolist()]]
        kinds = [pa.int32()] * 3 + [pa.binary()] * 4 + [pa.list_(pa.float64())]
        return pa.table([pa.array(c, d) for c, d in zip(cols, kinds, strict=True)], names=[c.split()[0] for c in _FOREST.split(", ")])

    by = ["forest", "tree", "branch"]
    n_trees = sum(hi - lo for _, lo, hi in lots)
    parts = min(n_trees + sum(len(t["left"]) for t in tops.values()), max(GROW_TASKS, n_trees * n_merged // GROW_ROWS))
    dealt = data.mapInArrow(deal, "forest int, tree int, branch int, x binary, y binary, t binary")
    return dealt.repartition(min(parts, 2000), *by).groupBy(*by).applyInArrow(build, _FOREST)


def _tops(data: DataFrame, lots: list, cuts: dict, weights: dict, k: int, max_depth: int, seed: int, n_rows: int, most: int) -> dict:
    """Upper nodes of trees with more than ``most`` rows: a round adds up histograms of the open nodes over all tasks.

    A few nodes a tree for each ``most`` rows reach the driver.
    """
    if n_rows <= most:
        return {}
    pairs = [(f, t) for f, lo, hi in lots for t in range(lo, hi)]
    tops = {p: {"feature": [-1], "cut": [0], "left": [0], "depth": [0], "closed": {}, "gains": []} for p in pairs}
    held = {p: {0} for p in pairs}

    def drawn(forest: int, tree: int, node: int, n_features: int) -> np.ndarray:
        return trees.choices(np.random.default_rng([seed, forest + 1, tree, node, 1]), 1, n_features, k)[0]

    while held:
        nodes, now = held, tops

        def sums(batches):
            total = {}
            for forest, tree, x, y, t in _dealt(batches, lots, seed):
                wanted = nodes.get((forest, tree), ())
                at = _routed(now, forest, tree, x) if wanted else None
                for node in wanted:
                    m = at == node
                    h = trees.histogram(x[m], y[m].astype(np.int64), t[m], drawn(forest, tree, node, x.shape[1]), len(weights[forest]))
                    total[forest, tree, node] = total.get((forest, tree, node), 0) + h
            for (forest, tree, node), h in total.items():
                yield _record(["forest", "tree", "node", "h"], [[forest], [tree], [node], [h.tobytes()]], [pa.int32()] * 3 + [pa.binary()])

        def pick(key, table):
            forest, tree, node = (int(v.as_py()) for v in key)
            h = sum(np.frombuffer(b, np.int64) for b in table.column("h").to_pylist()).reshape(k, -1, len(weights[forest]) + 1)
            best, w = trees.best_of_histogram(h, drawn(forest, tree, node, len(cuts[forest])), weights[forest])
            cols = [[forest], [tree], [node], *([b] for b in best), [w.tolist()]]
            kinds = [pa.int32()] * 5 + [pa.float64(), pa.int64(), pa.int64(), pa.list_(pa.float64())]
            return pa.table([pa.array(c, d) for c, d in zip(cols, kinds, strict=True)], names=["forest", "tree", "node", "feature", "cut", "gain", "below", "above", "w"])

        found = data.mapInArrow(sums, "forest int, tree int, node int, h binary").groupBy("forest", "tree", "node")
        schema = "forest int, tree int, node int, feature int, cut int, gain double, below bigint, above bigint, w array<double>"
        held = {}
        for r in sorted(found.applyInArrow(pick, schema).collect(), key=lambda r: r[:3]):
            pair, node = (r["forest"], r["tree"]), r["node"]
            top = tops[pair]
            if r["feature"] < 0 or top["depth"][node] >= max_depth:
                top["closed"][node] = r["w"]
                continue
            top["feature"][node], top["cut"][node], top["left"][node] = r["feature"], r["cut"], len(top["left"])
            top["gains"].append((r["feature"], r["gain"]))
            for rows in (r["below"], r["above"]):
                if rows > most:
                    held.setdefault(pair, set()).add(len(top["left"]))
                for c, v in (("feature", -1), ("cut", 0), ("left", 0), ("depth", top["depth"][node] + 1)):
                    top[c].append(v)
    return tops


def _top_rows(tops: dict, n_features: int) -> list[tuple]:
    """Branches that cannot be cut as trees of a single leaf, and the decrease of the upper nodes (no nodes, branch -1)."""
    rows = []
    for (forest, tree), top in tops.items():
        for node, w in top["closed"].items():
            leaf = trees.Tree(np.array([-1], np.int16), np.zeros(1, np.uint8), np.zeros(1, np.int32), trees.shares(np.array([w])))
            rows.append((forest, tree, node, *map(bytearray, leaf.dump()), [0.0] * n_features))
        gains = [0.0] * n_features
        for f, g in top["gains"]:
            gains[f] += g
        rows.append((forest, tree, -1, *[bytearray()] * 4, gains))
    return rows


def fit_forests(train: DataFrame, labels: list[str], forests: list[int], n_trees: int, seed: int, max_depth: int,
                branch_rows: int = BRANCH_ROWS) -> Forest:
    """A balanced random forest for each name in ``forests``: over all rows (``WHOLE``) or all but those of that ``fold``.

    Every row draws its Poisson(1) multiplicity per tree from a seeded hash. Rows with the same bins and class are merged to one
    with the sum of their multiplicities. Blocks of merged rows are dealt to the trees, a branch of at most ``branch_rows`` is grown in one task, and the nodes above are cut by histograms that all tasks add up. Each
    node looks at the root of the number of features (rounded up), binned by at most ``MAX_BINS`` cuts. Trees stay in a table.
    """
    index = lookup(train.sparkSession, ["truth_arch", "_y"], [(x, k) for k, x in enumerate(labels)])
    own = [c for c in train.columns if c != "features"]
    key = F.pmod(F.xxhash64(*own), F.lit(2147483647)).alias("_k")
    fold = F.col("fold").cast("int") if "fold" in own else F.lit(len(forests)).cast("int")
    rows = train.select(key, "truth_arch", fold.alias("_fold"), _features(train).alias("_x"))
    stored = cut_lineage(rows.join(F.broadcast(index), "truth_arch").select("_k", F.col("_y").cast("int").alias("_y"), "_fold", "_x"))
    counts = stored.groupBy("_fold", "_y").agg(F.count(F.lit(1)).alias("n")).collect()  # folds times classes
    n_rows = sum(r["n"] for r in counts)
    weights = {}
    for f in forests:
        n = np.array([sum(r["n"] for r in counts if r["_y"] == c and r["_fold"] != f) for c in range(len(labels))], float)
        weights[f] = np.divide(n.sum(), n * (n > 0).sum(), out=np.zeros(len(n)), where=n > 0)
    cuts = _bin_cuts(stored, forests)
    data = _merged(stored, forests, cuts, n_rows)
    n_merged = max((r["n"] for r in data.groupBy("forest").agg(F.sum("n").alias("n")).collect()), default=0)
    n_features = len(cuts[forests[0]])
    k = math.ceil(math.sqrt(n_features))
    size = max(1, WAVE_ROWS // max(n_merged, 1))
    todo = [(f, t) for f in forests if weights[f].any() for t in range(n_trees)]
    done, tops = [], {}
    for a in range(0, len(todo), size):
        wave = todo[a : a + size]
        lots = [(f, min(t for g, t in wave if g == f), max(t for g, t in wave if g == f) + 1) for f in dict.fromkeys(g for g, _ in wave)]
        some = _tops(data, lots, cuts, weights, k, max_depth, seed, n_merged, branch_rows)
        tops.update(some)
        done.append(cut_lineage(_grown(data, lots, cuts, some, weights, k, max_depth, seed, n_merged), frees=True))
    if tops:
        done.append(cut_lineage(train.sparkSession.createDataFrame(_top_rows(tops, n_features), _FOREST)))
    table = union_all(done)
    gains = table.select("forest", "tree", F.posexplode("gains").alias("f", "g")).groupBy("forest", "tree", "f").agg(F.sum("g").alias("g"))
    return Forest(table.where("branch >= 0").drop("gains"), gains, cuts, tops, len(labels))


def fit_forest(train: DataFrame, labels: list[str], trees: int = rules.MODEL_TREES, seed: int = rules.MODEL_SEED,
               max_depth: int = rules.MODEL_MAX_DEPTH) -> Forest:
    """Random forest on ``features, truth_arch``; trees stop at depth 30."""
    return fit_forests(train, labels, [WHOLE], trees, seed, max_depth)


def importances(forest: Forest, which: int = WHOLE) -> list[float]:
    """Decrease in impurity by feature, scaled to one in each tree, then over all; a number per feature reaches the driver."""
    g = forest.gains.where(F.col("forest") == which)
    total = g.groupBy("tree").agg(F.sum("g").alias("_t")).where("_t > 0")
    per = g.join(total, "tree").groupBy("f").agg(F.sum(F.col("g") / F.col("_t")).alias("g"))
    found = {r["f"]: r["g"] for r in per.collect()}
    whole = sum(found.values()) or 1.0
    return [found.get(k, 0.0) / whole for k in range(len(forest.cuts[which]))]


def _blocks(rows: DataFrame, keep: list[str], cuts: dict) -> DataFrame:
    """Rows packed for their forest: ``forest, part``, kept columns as an Arrow stream, the ``n`` different rows of bins and each row's."""

    def pack(batches):
        from pyspark import TaskContext

        held, number, place = {}, 0, TaskContext.get().partitionId()

        def out(forest):
            nonlocal number
            kept, bins = zip(*held.pop(forest), strict=True)
            number += 1
            table = pa.Table.from_batches(kept)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema) as w:
                w.write_table(table)
            x = np.concatenate(bins)
            order, starts = trees.distinct(x)
            at = np.empty(len(x), np.int32)
            at[order] = np.repeat(np.arange(len(starts)), np.diff(starts, append=len(x)))
            cols = [[forest], [place * (1 << 32) + number], [len(starts)], [sink.getvalue().to_pybytes()], [x[order[starts]].tobytes()], [at.tobytes()]]
            return _record(["forest", "part", "n", "kept", "x", "at"], cols, [pa.int32(), pa.int64(), pa.int64()] + [pa.binary()] * 3)

        for batch in batches:
            owner = batch.column(0).to_numpy()
            for forest in np.unique(owner):
                m = np.flatnonzero(owner == forest)
                some = batch.take(pa.array(m))
                x = trees.binned(_matrix(some.column(1)), cuts[int(forest)])
                held.setdefault(int(forest), []).append((pa.RecordBatch.from_arrays(some.columns[2:], names=keep), x))
                if sum(len(b) for _, b in held[int(forest)]) >= APPLY_BLOCK:
                    yield out(int(forest))
        for forest in list(held):
            yield out(forest)

    owned = rows.select("_forest", _features(rows).alias("_x"), *keep).where(F.col("_forest").isin(list(cuts)))
    return cut_lineage(owned.mapInArrow(pack, "forest int, part bigint, n bigint, kept binary, x binary, at binary"))


def predict_rows(forest: Forest, rows: DataFrame, labels: list[str], keep: list[str]) -> DataFrame:
    """``*keep, pred_class, pred_confidence`` of rows with ``features`` by the forest named in ``_forest``.

    Blocks of different rows meet groups of trees, each group adds up the class shares of its trees for the block, and the
    sums of a block are added and given to all rows alike. Shares are whole numbers, so no order of adding changes a result.
    """
    cuts, tops, n_classes = forest.cuts, forest.tops, forest.n_classes
    blocks = _blocks(rows, keep, cuts)
    size = forest.trees.agg(F.sum(sum(F.length(c).cast("bigint") for c in ("feature", "cut", "left", "votes"))), F.count_distinct("forest")).first()
    n_rows = blocks.agg(F.sum("n")).first()[0] or 0
    spread, n_forests = max(1, -(-n_rows // MEET_ROWS)), size[1] or 1
    groups = max(1, -(-(size[0] or 0) // (MEET_BYTES * n_forests)), -(-64 // (spread * n_forests)))

    def add(left, right):
        done, n_features = [], len(next(iter(cuts.values())))
        loaded = [(int(f), int(t), int(b), trees.Tree.load(p, n_classes)) for f, t, b, *p in zip(*(right.column(c).to_pylist() for c in ("forest", "tree", "branch", "feature", "cut", "left", "votes")), strict=True)]
        for part, x in zip(left.column("part").to_pylist(), left.column("x").to_pylist(), strict=True):
            x = np.frombuffer(x, np.uint8).reshape(-1, n_features)
            total, routes = np.zeros((len(x), n_classes), np.int64), {}
            for f, t, b, tree in loaded:
                if (f, t) not in tops:
                    total += trees.votes(tree, x)
                    continue
                if (f, t) not in routes:
                    routes[f, t] = _routed(tops, f, t, x)
                m = np.flatnonzero(routes[f, t] == b)
                total[m] += trees.votes(tree, x[m])
            done.append((part, total.tobytes()))
        cols = list(zip(*done, strict=True)) or [[], []]
        return pa.table([pa.array(list(cols[0]), pa.int64()), pa.array(list(cols[1]), pa.binary())], names=["part", "v"])

    by, n_parts = ["forest", "_s", "_g"], min(3 * spread * groups * n_forests, 4000)
    left = blocks.select("forest", "part", "x", F.pmod(F.xxhash64("part"), F.lit(spread)).alias("_s"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("_g"))
    right = forest.trees.withColumn("_g", F.pmod(F.col("tree"), F.lit(groups))).withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(spread - 1)).cast("array<bigint>")))
    left, right = (d.repartition(n_parts, *by).groupBy(*by) for d in (left, right))
    added = cut_lineage(left.cogroup(right).applyInArrow(add, "part bigint, v binary"), frees=True)

    kinds = [f for f in rows.select(*keep).schema.fields]

    def finish(left, right):
        kept = pa.ipc.open_stream(left.column("kept")[0].as_py()).read_all()
        total = sum(np.frombuffer(v, np.int64) for v in right.column("v").to_pylist()).reshape(-1, n_classes)
        at = np.frombuffer(left.column("at")[0].as_py(), np.int32)
        best, share = total.argmax(axis=1).astype(np.int32) + 1, total.max(axis=1) / total.sum(axis=1)
        return kept.append_column("_best", pa.array(best[at])).append_column("pred_confidence", pa.array(share[at]))

    schema = StructType([*kinds, StructField("_best", IntegerType()), StructField("pred_confidence", DoubleType())])
    out = blocks.groupBy("part").cogroup(added.groupBy("part")).applyInArrow(finish, schema)
    names = F.array(*[F.lit(x) for x in labels])
    return out.select(*keep, F.element_at(names, F.col("_best")).alias("pred_class"), "pred_confidence")


def predict(model: Forest, rows: DataFrame, labels: list[str], keep: list[str]) -> DataFrame:
    """``*keep, pred_class, pred_confidence``: label of the highest class probability."""
    return predict_rows(model, rows.withColumn("_forest", F.lit(WHOLE)), labels, keep)


def class_labels(train: DataFrame) -> list[str]:
    """All class labels of the training rows; more than a codebook can hold stop the job."""
    return distinct_codes(train, "truth_arch")


def out_of_fold(train: DataFrame, labels: list[str], n_folds: int = rules.CV_FOLDS, trees: int = rules.MODEL_TREES,
                seed: int = rules.MODEL_SEED) -> DataFrame:
    """Prediction of every training row by the model fitted without its fold. The forests of all folds grow side by side."""
    train = cut_lineage(train.withColumn("features", _features(train)))
    folds = sorted(r[0] for r in train.select(F.col("fold").cast("int")).distinct().collect() if 0 <= r[0] < n_folds)
    forest = fit_forests(train, labels, folds, trees, seed, rules.MODEL_MAX_DEPTH)
    return predict_rows(forest, train.withColumn("_forest", F.col("fold").cast("int")), labels, ["val_id", "bid", "truth_arch", "fold"])
