"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

The documents of a source, in the order of a hash, form one stream of words that is cut into blocks. A source's target is
so many whole passes plus a part of one; the part takes blocks in the order of a keyed permutation, so draws are disjoint,
and ends inside a block where the target does. The drawn blocks of all sources are dealt out over shards by a binary tree:
each node splits the exact block quotas of all sources between its two halves by a multivariate hypergeometric draw seeded
with the node's number, so every shard gets its share of blocks, every block one shard, and any task can work out its own
part of the tree. Inside a shard blocks are ordered by a hash.

The only data that passes the driver is one row per source.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from cityloom.llm.storage import fresh, ship

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2.0
BLOCK = 256
SHARD_BLOCKS = 4096
SEED = 20240607
MAX_SOURCES = 1_000_000
_BUCKETS = 4096

PIECE = "struct<shard: long, place: long, epoch: int, start: long, n: long>"


def targets(sizes: dict[str | None, int], weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST) -> dict[str | None, float]:
    """Words per source: ``share`` of all words by weight (repeating by code point of the source, null last), at most
    ``most`` times the source's own; what a source cannot take goes to the others by weight until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    left, open_, out = share * sum(sizes.values()), names, {}
    while open_:
        unit = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if unit * weight[s] > most * sizes[s]]
        if not full:
            return out | {s: unit * weight[s] for s in open_}
        out |= {s: most * sizes[s] for s in full}
        left -= sum(most * sizes[s] for s in full)
        open_ = [s for s in open_ if s not in set(full)]
    return out


def _key(*parts) -> int:
    return int.from_bytes(hashlib.blake2b(repr(parts).encode(), digest_size=8).digest(), "little")


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def permute(values: np.ndarray, n: int, key: int) -> np.ndarray:
    """Places of ``values`` in a keyed permutation of ``0 .. n-1`` (a Feistel network, walked until inside the range)."""
    half = np.uint64(max(1, (int(n - 1).bit_length() + 1) // 2))
    mask = (np.uint64(1) << half) - np.uint64(1)
    out = np.asarray(values).astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> half, out[todo] & mask
        for turn in range(4):
            left, right = right, left ^ (_mix(right + np.uint64((key + turn * 0x9E3779B97F4A7C15) % 2**64)) & mask)
        out[todo] = left << half | right
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


@dataclass(frozen=True)
class Plan:
    """What is drawn from one source: whole passes, and from the part pass ``blocks`` whole blocks and ``words`` of the next."""

    number: int
    size: int
    target: float
    passes: int
    blocks: int
    words: int
    key: int

    @property
    def full(self) -> int:
        return self.size // BLOCK

    @property
    def per_pass(self) -> int:
        return -(-self.size // BLOCK)

    @property
    def units(self) -> int:
        return self.passes * self.per_pass + self.blocks + (self.words > 0)


def plan(sizes: dict[str | None, int], seed: int = SEED, **options) -> dict[str | None, Plan]:
    goal, out = targets(sizes, **options), {}
    for number, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or ""))):
        words = round(goal[s])
        passes, rest = divmod(words, sizes[s]) if sizes[s] else (0, 0)
        blocks = min(rest // BLOCK, sizes[s] // BLOCK)
        out[s] = Plan(number, sizes[s], goal[s], passes, blocks, rest - blocks * BLOCK, _key(seed, s))
    return out


class SplitTree:
    """Deals units of all sources over shards; nodes are drawn when first needed and kept."""

    def __init__(self, quotas: list[int], shards: int, seed: int = SEED):
        self.quotas, self.shards, self.seed = np.array(quotas, np.int64), shards, seed
        self.left: dict[tuple[int, int], np.ndarray] = {}

    def split(self, lo: int, hi: int, quotas: np.ndarray) -> np.ndarray:
        """How many units of each source go to the left half of the shards ``lo:hi``."""
        got = self.left.get((lo, hi))
        if got is None:
            total, mid = int(quotas.sum()), (lo + hi) // 2
            n = total * (mid - lo) // (hi - lo)
            rng = np.random.default_rng([self.seed, lo, hi])
            got = np.zeros_like(quotas)
            for k in range(len(quotas)):  # one source after the other: hypergeometric given the rest
                own, rest = int(quotas[k]), total - int(quotas[k])
                got[k] = _hypergeometric(rng, own, rest, n)
                n, total = n - int(got[k]), rest
            self.left[lo, hi] = got
        return got

    def locate(self, source: np.ndarray, unit: np.ndarray) -> np.ndarray:
        """Shard of each (source number, unit number)."""
        out = np.zeros(len(unit), np.int64)
        stack = [(0, self.shards, self.quotas, np.arange(len(unit)), np.asarray(unit, np.int64))]
        while stack:
            lo, hi, quotas, rows, place = stack.pop()
            if not len(rows):
                continue
            if hi - lo == 1:
                out[rows] = lo
                continue
            left, mid = self.split(lo, hi, quotas), (lo + hi) // 2
            cut = left[source[rows]]
            go = place < cut
            stack.append((lo, mid, left, rows[go], place[go]))
            stack.append((mid, hi, quotas - left, rows[~go], (place - cut)[~go]))
        return out


#: populations below this are drawn by numpy, which takes no larger ones
_DRAW = 1_000_000_000


def _hypergeometric(rng, good: int, bad: int, n: int, most: int = _DRAW) -> int:
    """How many good units are among ``n`` drawn from ``good + bad``.

    From ``most`` units on by inversion: probabilities relative to the mode follow from the ratios of neighbours, twelve
    deviations to either side; what lies beyond weighs less than 10**-30.
    """
    if n == 0 or good == 0:
        return 0
    if bad == 0:
        return n
    if good + bad < most:
        return int(rng.hypergeometric(good, bad, n))
    total = good + bad
    deviation = np.sqrt(n * (good / total) * (bad / total) * ((total - n) / max(total - 1, 1)))
    least, top = max(0, n - bad), min(good, n)
    mode = min(max((n + 1) * (good + 1) // (total + 2), least), top)
    reach = int(12 * deviation) + 50
    up = np.arange(mode, min(mode + reach, top), dtype=np.float64)
    down = np.arange(mode, max(mode - reach, least), -1, dtype=np.float64)
    higher = np.cumprod((good - up) * (n - up) / ((up + 1) * (bad - n + up + 1)))
    lower = np.cumprod(down * (bad - n + down) / ((good - down + 1) * (n - down + 1)))
    upto = np.cumsum(np.concatenate([lower[::-1], [1.0], higher]))
    return mode - len(down) + int(np.searchsorted(upto, rng.random() * upto[-1], "right").clip(0, len(upto) - 1))


def measure(docs: DataFrame, text: str = "text", size: str = "size") -> DataFrame:
    """``docs`` with the number of words of ``text`` as ``size``; null has none."""
    return docs.withColumn(size, F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long"), F.lit(0).cast("long")))


def draw(
    measured: DataFrame, doc_id: str = "doc_id", source: str = "source", size: str = "size", seed: int = SEED, shard_blocks: int = SHARD_BLOCKS, **options
) -> DataFrame:
    """``measured`` with ``source_size, target, taken, pieces``: what the mix takes of each row.

    ``pieces`` are ``shard, place, epoch, start, n``: ``n`` words from ``start`` on (from 0) go to ``place`` in ``shard``.
    A row is taken at most ``most`` times, rounded up; each source's words add up to its target rounded to a whole word.
    A null source is a source; documents without words get no pieces; an empty table gives an empty result. Null ids and
    repeated rows are rows like others; rows equal in every column may swap their pieces between reruns, all else is the
    same. Columns named as the new ones are replaced. More than ``MAX_SOURCES`` sources are an error.
    """
    ship(measured.sparkSession)
    measured = measured.drop("source_size", "target", "taken", "pieces")
    sums = measured.groupBy(F.col(source).alias("s")).agg(F.sum(size).alias("n")).limit(MAX_SOURCES + 1).collect()  # a row per source
    if len(sums) > MAX_SOURCES:
        raise ValueError("too many sources to weigh")
    plans = plan({r.s: int(r.n or 0) for r in sums}, seed, **options)
    quotas = [p.units for p in sorted(plans.values(), key=lambda p: p.number)]
    shards = max(1, -(-sum(quotas) // shard_blocks))

    # running sum of each source's stream in two steps, so that a large source is many tasks
    columns = measured.columns
    plain = [c for c in columns if not isinstance(measured.schema[c].dataType, (T.MapType, T.VariantType))]
    own_source, order, tie, bucket, at, base, n = fresh(columns, "__source", "__order", "__tie", "__bucket", "__at", "__base", "__n")
    keyed = measured.withColumns(
        {
            own_source: F.coalesce(F.concat(F.lit("="), F.col(source)), F.lit("")),
            order: F.xxhash64(F.lit(seed), F.col(doc_id), F.col(size)),
            tie: F.xxhash64(*plain),
        }
    ).withColumn(bucket, F.shiftrightunsigned(order, 64 - _BUCKETS.bit_length() + 1))
    sums = keyed.groupBy(own_source, bucket).agg(F.sum(size).alias(n))
    before = Window.partitionBy(own_source).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(own_source, bucket, F.coalesce(F.sum(n).over(before), F.lit(0)).alias(base))
    inside = Window.partitionBy(own_source, bucket).orderBy(order, doc_id, tie).rowsBetween(Window.unboundedPreceding, -1)
    placed = keyed.join(sums, [own_source, bucket]).withColumn(at, F.col(base) + F.coalesce(F.sum(size).over(inside), F.lit(0)))
    placed = placed.select(*columns, at)
    shared = measured.sparkSession.sparkContext.broadcast((plans, quotas))

    def run(batches):
        plans, quotas = shared.value
        tree = SplitTree(quotas, shards, seed)
        for batch in batches:
            names = batch.column(source).to_pylist()
            own = [plans[s] for s in names]
            row, epoch, start, n, unit = _pieces(own, names, batch.column(at).to_numpy(), batch.column(size).to_numpy())
            number = np.array([p.number for p in own], np.int64)
            shard = tree.locate(number[row], unit)
            place = _mix((unit.astype(np.uint64) << np.uint64(20)) + number[row].astype(np.uint64) + np.uint64(seed)) >> np.uint64(1)
            cut = np.searchsorted(row, np.arange(len(own) + 1)).astype(np.int32)
            fields = [pa.array(shard), pa.array(place.astype(np.int64)), pa.array(epoch.astype(np.int32)), pa.array(start), pa.array(n)]
            pieces = pa.ListArray.from_arrays(pa.array(cut), pa.StructArray.from_arrays(fields, names=["shard", "place", "epoch", "start", "n"]))
            taken = np.bincount(row, weights=n, minlength=len(own)).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in columns), pa.array([p.size for p in own], pa.int64()), pa.array([p.target for p in own], pa.float64()), pa.array(taken), pieces],
                names=[*columns, "source_size", "target", "taken", "pieces"],
            )

    extra = T.StructType.fromDDL(f"source_size long, target double, taken long, pieces array<{PIECE}>")
    return placed.mapInArrow(run, T.StructType([*measured.schema, *extra]))


def _pieces(plans: list[Plan], names: list, at: np.ndarray, size: np.ndarray):
    """Parts of each document that fall into drawn blocks: row, epoch, first word, words, number of the draw in its source."""
    first = at // BLOCK
    count = np.where(size > 0, (at + size - 1) // BLOCK - first + 1, 0)
    row = np.repeat(np.arange(len(at)), count)
    block = np.repeat(first, count) + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    lo = np.maximum(block * BLOCK, at[row])
    hi = np.minimum((block + 1) * BLOCK, (at + size)[row])
    # by source: place of the block in the part pass; the short block at the end of a stream comes last
    rank = np.zeros(len(row), np.int64)
    of: dict[int, list[int]] = {}
    for k, p in enumerate(plans):
        of.setdefault(p.number, []).append(k)
    known = {p.number: p for p in plans}
    number = np.array([p.number for p in plans], np.int64)[row] if len(row) else np.zeros(0, np.int64)
    for s in np.unique(number).tolist():
        p, mine = known[s], np.flatnonzero(number == s)
        whole = mine[block[mine] < p.full]
        rank[whole] = permute(block[whole], p.full, p.key) if p.full else 0
        rank[mine[block[mine] >= p.full]] = p.full
    get = lambda name: np.array([getattr(p, name) for p in plans], np.int64)[row] if len(row) else np.zeros(0, np.int64)
    passes, per_pass, blocks, words = get("passes"), get("per_pass"), get("blocks"), get("words")
    parts = []
    for epoch in range(int(passes.max()) + 1 if len(row) else 0):
        done = epoch < passes
        last = np.where(done, hi, np.where((epoch == passes) & (rank < blocks), hi, np.where((epoch == passes) & (rank == blocks), np.minimum(hi, block * BLOCK + words), lo)))
        hit = np.flatnonzero(last > lo)
        parts.append((row[hit], np.full(len(hit), epoch), lo[hit] - at[row[hit]], (last - lo)[hit], epoch * per_pass[hit] + rank[hit]))
    if not parts:
        return (np.zeros(0, np.int64),) * 5
    row, epoch, start, n, unit = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((start, epoch, row))
    return row[order], epoch[order], start[order], n[order], unit[order]


def shards(drawn: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source") -> DataFrame:
    """The mixed corpus: ``shard, place, doc_id, source, epoch, start, n, text`` per piece, shards together and in order.

    A piece's text is its words joined by single spaces.
    """
    words = F.regexp_extract_all(text, F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))
    rows = drawn.where("taken > 0").select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), words.alias("__words"), "pieces")
    cut = F.transform("pieces", lambda p: p.withField("text", F.array_join(F.slice("__words", (p["start"] + 1).cast("int"), p["n"].cast("int")), " ")))
    rows = rows.select("doc_id", "source", F.inline(cut))
    return rows.select("shard", "place", "doc_id", "source", "epoch", "start", "n", "text").repartition("shard").sortWithinPartitions("shard", "place", "epoch", "doc_id", "start")
