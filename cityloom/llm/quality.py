"""Quality rules as a learned decision list, in DataFrame operations only.

Text statistics are Spark expressions over the whole text. A decision list of threshold conjunctions is learned from
labelled statistics by sequential covering: a rule grows by the condition with the largest information gain on one part of
the sample and is pruned back on the other, the texts it covers are set aside, and so on while rules stay pure enough. The
list becomes one ordered conditional expression.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from cityloom.llm.storage import table

#: labelled rows the list is learned from, chosen by a hash of the id; the statistics themselves cover every row
SAMPLE = 20_000
PURITY = 0.95
MIN_COVER = 8
MAX_RULES = 24
MAX_CONDITIONS = 4
_CUTS = 64

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("n_words", "mean_word", "symbol_share", "dup_line_share", "repeat_share", "distinct_share", "upper_share", "mark_share")

_SPACE = r"[\x20\x09-\x0D]"


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the columns of :data:`BASE` and :data:`FEATURES`, replacing columns of these names.

    Null and empty texts have no words and all statistics 0. Repeated five-word windows are found by sorting 64-bit window
    hashes with their places inside each row: no shuffle, ``n log n`` for a text of ``n`` words.
    """
    docs = docs.drop(*BASE, *FEATURES)
    t = F.coalesce(F.col(text), F.lit(""))
    count = lambda pattern: F.regexp_count(t, F.lit(pattern))
    lines = F.filter(F.split(t, "\n"), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]")))
    out = docs.select("*", F.array_remove(F.split(t, _SPACE + "+"), "").alias("__words"), lines.alias("__lines"))
    n = F.size("__words")
    window = lambda i: F.xxhash64(*(F.get("__words", i + k) for k in range(5)))
    none = F.array().cast("array<bigint>")
    out = out.select(
        "*",
        n.cast("long").alias("n_words"),
        (F.length(t) - count(_SPACE)).cast("long").alias("word_chars"),
        count(r"[#*$%&|<>]").cast("long").alias("n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.size("__lines").alias("__n_lines"),
        F.size(F.array_distinct("__words")).alias("__n_distinct"),
        count(r"[A-Z]").alias("__upper"),
        count(r"[!?]").alias("__marks"),
        F.when(n >= 5, F.transform(F.sequence(F.lit(0), n - 5), window)).otherwise(none).alias("__h"),
    ).drop("__words", "__lines")
    # texts without a repeated window need no more
    placed = F.transform("__h", lambda x, i: F.struct(x.alias("h"), i.cast("long").alias("at")))
    out = out.withColumn("__sorted", F.when(F.size(F.array_distinct("__h")) < F.size("__h"), F.sort_array(placed)).otherwise(F.slice(placed, 1, 0)))
    same = lambda x, y: F.coalesce(x["h"] == y["h"], F.lit(False))
    twice = F.filter("__sorted", lambda x, k: same(x, F.get("__sorted", k - 1)) | same(x, F.get("__sorted", k + 1)))
    places = F.sort_array(F.transform(twice, lambda x: x["at"]))
    covered = F.aggregate(
        places,
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end")),
        lambda acc, p: F.struct((acc["n"] + p + 5 - F.greatest(acc["end"], p)).alias("n"), (p + 5).alias("end")),
    )
    out = out.withColumn("n_repeat_words", covered["n"]).drop("__h", "__sorted")
    share = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return out.select(
        *docs.columns,
        *BASE,
        share("word_chars", "n_words").alias("mean_word"),
        share("n_symbols", "word_chars").alias("symbol_share"),
        share("n_dup_lines", "__n_lines").alias("dup_line_share"),
        share("n_repeat_words", "n_words").alias("repeat_share"),
        share("__n_distinct", "n_words").alias("distinct_share"),
        share("__upper", "word_chars").alias("upper_share"),
        share("__marks", "n_words").alias("mark_share"),
    )


@dataclass(frozen=True)
class Condition:
    feature: int
    above: bool
    cut: float

    def holds(self, x: np.ndarray) -> np.ndarray:
        return (x[:, self.feature] > self.cut) if self.above else (x[:, self.feature] <= self.cut)

    def expression(self) -> Column:
        c = F.col(FEATURES[self.feature])
        return (c > self.cut) if self.above else (c <= self.cut)


def _holds(rule: list[Condition], x: np.ndarray) -> np.ndarray:
    hit = np.ones(len(x), bool)
    for c in rule:
        hit &= c.holds(x)
    return hit


def _grow(x: np.ndarray, bad: np.ndarray) -> list[Condition]:
    """Add the condition with the largest gain (positives kept times the rise of the log share) until the rule is pure."""
    rule, hit = [], np.ones(len(x), bool)
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, _CUTS + 1)[:-1])) for f in range(x.shape[1])]
    while len(rule) < MAX_CONDITIONS and bad[hit].mean() < 1:
        share, best, gain = bad[hit].mean(), None, 1e-9
        for f in range(x.shape[1]):
            order = np.sort(x[hit & bad, f]), np.sort(x[hit, f])
            for cut in np.unique(np.concatenate([cuts[f], np.quantile(order[1], np.linspace(0, 1, 9)[1:-1])])):
                low = np.searchsorted(order[0], cut, "right"), np.searchsorted(order[1], cut, "right")
                for above, (p, n) in ((False, low), (True, (len(order[0]) - low[0], len(order[1]) - low[1]))):
                    if n >= MIN_COVER and p:
                        g = p * (np.log2(p / n) - np.log2(share))
                        if g > gain:
                            best, gain = Condition(f, above, float(cut)), g
        if best is None:
            break
        higher = x[hit, best.feature]
        higher = higher[higher > best.cut]
        if len(higher):  # half-way to the next value seen
            best = Condition(best.feature, best.above, (best.cut + float(higher.min())) / 2)
        rule.append(best)
        hit &= best.holds(x)
    return rule


def _prune(rule: list[Condition], x: np.ndarray, bad: np.ndarray) -> list[Condition]:
    """The beginning of the rule with the best balance of covered bad and good texts."""

    def worth(part: list[Condition]) -> float:
        hit = _holds(part, x)
        p, n = int((hit & bad).sum()), int((hit & ~bad).sum())
        return (p - n) / (p + n) if p + n else -1.0

    return max((rule[:k] for k in range(len(rule), 0, -1)), key=worth)


def learn(x: np.ndarray, bad: np.ndarray) -> list[list[Condition]]:
    """Ordered rules that reject; ``x`` by :data:`FEATURES`, rows in a fixed order. Empty without both kinds of labels."""
    held = np.arange(len(x)) % 3 == 2
    open_ = np.ones(len(x), bool)
    rules: list[list[Condition]] = []
    while len(rules) < MAX_RULES:
        grow, prune = open_ & ~held, open_ & held
        if not bad[grow].any() or not (~bad[grow]).any():
            break
        rule = _grow(x[grow], bad[grow])
        if not rule:
            break
        rule = _prune(rule, x[prune], bad[prune]) if prune.any() else rule
        hit = open_ & _holds(rule, x)
        if hit.sum() < MIN_COVER or (bad[hit].sum() + 1) / (hit.sum() + 2) < PURITY and bad[hit].mean() < PURITY:
            break
        rules.append(rule)
        open_ &= ~hit
    return rules


def verdict(rules: list[list[Condition]]) -> Column:
    """True to keep: the first rule that holds rejects, no rule keeps."""
    out = None
    for rule in rules:
        test = rule[0].expression()
        for c in rule[1:]:
            test = test & c.expression()
        out = F.when(test, False) if out is None else out.when(test, False)
    return F.lit(True) if out is None else out.otherwise(True)


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE) -> list[list[Condition]]:
    """Decision list from about ``sample`` labelled rows (all, if there are fewer), quality 0 to be rejected.

    Several labels of a document count as its lowest; null ids and labels are not learned from.
    """
    marks = labels.where(F.col(doc_id).isNotNull() & F.col(label).isin(0, 1)).groupBy(F.col(doc_id).alias("__id")).agg(F.min(label).alias("__label"))
    n = marks.count()
    if n > sample:  # the hash is uniform, so the chosen rows stay within a few standard deviations of the bound
        marks = marks.where(F.pmod(F.xxhash64("__id"), F.lit(1 << 30)) < int(sample / n * (1 << 30)))
    chosen = docs.select(F.col(doc_id).alias("__id"), F.col(text).alias("text")).join(F.broadcast(marks), "__id")
    rows = statistics(chosen).select("__id", "__label", *FEATURES)
    rows = sorted(table(rows, "labelled").collect())  # the bounded sample
    x = np.array([[float(v) for v in r[2:]] for r in rows]).reshape(len(rows), len(FEATURES))
    return learn(x, np.array([r[1] == 0 for r in rows], bool))


def judge(docs: DataFrame, rules: list[list[Condition]], text: str = "text") -> DataFrame:
    """:func:`statistics` with ``base_failed`` and ``kept``.

    ``base_failed``: fewer than ten words, or more than a fifth of the words in repeated windows. ``kept``: not that, and
    no learned rule rejects. Repeated rows and null ids are judged row by row.
    """
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    out = statistics(docs.drop("base_failed", "kept"), text).withColumn("base_failed", failed)
    return out.withColumn("kept", ~F.col("base_failed") & verdict(rules))
