"""URL filter by the ratio of two character models, in DataFrame operations only.

URLs that a (host, path) rule decides are the labelled examples. For accepted and rejected ones a variable-order Markov
model over a small alphabet is counted: each character given up to ``ORDER`` characters before it, longer contexts smoothed
by shorter ones (Witten-Bell), unseen contexts falling back to the longest that was seen. A URL without a rule is scored by
the difference of the two log-likelihoods per character against a cut that is calibrated on labelled URLs the counts leave
out.

The alphabet and the order bound the model to ``SIZE ** ORDER`` rows (12 MB), whatever the number of URLs, so it is broadcast
to the characters of the distinct URLs that no rule decides.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from cityloom.llm.storage import fresh, table

#: symbol 0 is the edge of the URL, the last one any character not listed; digits share one symbol
ALPHABET = "0abcdefghijklmnopqrstuvwxyz./-_?=&#%:~+"
SIZE = len(ALPHABET) + 2
ORDER = 3
CALIBRATION = 4
_BINS = 2000
_RANGE = 5.0


@dataclass(frozen=True)
class Rule:
    """``allow`` or block the host and its subdomains where the path starts with ``path``."""

    host: str
    path: str
    allow: bool

    @property
    def name(self) -> str:
        return self.host + self.path


#: the rules of the production query (fixed values)
RULES = (
    Rule("net", "/", False),
    Rule("example.net", "/en/", True),
    Rule("example.com", "/de/", False),
    Rule("org", "/fr/", True),
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Lower-cased host and path of a URL; both empty without ``://`` or for null."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    rest = F.regexp_extract(F.coalesce(rest, F.lit("")), r"(?s)^([^/?#]*)([^?#]*)", 0)
    split = F.instr(rest, "/")
    host = F.when(split > 0, F.substring(rest, F.lit(1), split - 1)).otherwise(rest)
    path = F.when(split > 0, F.substring(rest, split, F.length(rest))).otherwise("")
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def matching_rule(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """``struct(rule, allow)`` of the longest rule that fits, or null; of equally long ones the first given."""
    choice = F.lit(None).cast("struct<rule: string, allow: boolean>")
    for r in sorted(rules, key=lambda r: len(r.name)):
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        choice = F.when(fits, F.struct(F.lit(r.name).alias("rule"), F.lit(r.allow).alias("allow"))).otherwise(choice)
    return choice


def _symbols(text: Column) -> Column:
    """Symbols of a string, with the edge symbol before and after it."""
    low = F.translate(F.lower(text), "123456789", "000000000")
    other = SIZE - 1
    code = F.transform(F.split(low, ""), lambda c: F.coalesce(F.nullif(F.call_function('instr', F.lit(ALPHABET), c), F.lit(0)), F.lit(other)))
    code = F.when(F.length(low) > 0, code).otherwise(F.array().cast("array<int>"))
    return F.concat(F.array_repeat(F.lit(0), ORDER), code, F.array(F.lit(0)))


def _context(symbols: Column, i: Column, order: int) -> Column:
    """Number of the ``order`` symbols before place ``i`` (from 0)."""
    out = F.lit(0)
    for k in range(order, 0, -1):
        out = out * SIZE + F.get(symbols, i - k)
    return out


def _vectors(grams: DataFrame) -> list[DataFrame]:
    """By order: ``allow, context, p``, the smoothed next-symbol probabilities of every context that was seen."""
    lower = None
    out = []
    base = F.array_repeat(F.lit(1.0 / SIZE), SIZE)
    for order in range(ORDER + 1):
        mod = F.lit(SIZE**order)
        cells = grams.groupBy("allow", (F.col("context") % mod).alias("context"), "symbol").agg(F.sum("n").alias("n"))
        seen = cells.groupBy("allow", "context").agg(
            F.map_from_entries(F.collect_list(F.struct("symbol", "n"))).alias("m"), F.sum("n").alias("total"), F.count("*").alias("kinds")
        )
        if lower is not None:
            short = (F.col("context") % F.lit(SIZE ** (order - 1))).alias("short")
            seen = seen.select("*", short).join(lower.select("allow", F.col("context").alias("short"), F.col("p").alias("back")), ["allow", "short"])
        else:
            seen = seen.withColumn("back", base)
        p = F.transform("back", lambda q, i: (F.coalesce(F.element_at("m", i), F.lit(0)) + F.col("kinds") * q) / (F.col("total") + F.col("kinds")))
        lower = table(seen.select("allow", "context", p.alias("p")), "vectors")
        out.append(lower)
    return out


def model(labelled: DataFrame, spark) -> DataFrame:
    """``context, ratio``: for every full-order context the log of accepted over rejected probability by symbol.

    ``labelled`` has ``allow`` and ``symbols``. A context one class has not seen takes that class's longest seen suffix.
    """
    place = F.explode(F.sequence(F.lit(ORDER), F.size("symbols") - 1)).alias("i")
    grams = labelled.select("allow", "symbols", place).select(
        "allow", _context(F.col("symbols"), F.col("i"), ORDER).alias("context"), F.get("symbols", F.col("i")).alias("symbol")
    )
    grams = table(grams.groupBy("allow", "context", "symbol").agg(F.count("*").alias("n")), "grams")
    levels = _vectors(grams)
    every = spark.range(0, SIZE**ORDER, 1, 8).withColumnRenamed("id", "context")
    uniform = F.array_repeat(F.lit(1.0 / SIZE), SIZE)
    for allow in (True, False):
        side = f"p_{allow}"
        found = []
        for order, level in enumerate(levels):
            own = level.where(F.col("allow") == allow).select(F.col("context").alias(f"c{order}"), F.col("p").alias(f"p{order}"))
            every = every.join(own, F.col("context") % F.lit(SIZE**order) == F.col(f"c{order}"), "left").drop(f"c{order}")
            found.append(F.col(f"p{order}"))
        every = every.withColumn(side, F.coalesce(*reversed(found), uniform)).drop(*(f"p{k}" for k in range(ORDER + 1)))
    ratio = F.zip_with("p_True", "p_False", lambda a, b: F.log(a / b).cast("float"))
    return table(every.select(F.col("context").cast("int").alias("context"), ratio.alias("ratio")), "ratios")


def _scores(texts: DataFrame, ratios: DataFrame) -> DataFrame:
    """Mean log ratio per character for the ``symbols`` of each distinct key of ``texts`` (all other columns)."""
    keys = [c for c in texts.columns if c != "symbols"]
    place = F.explode(F.sequence(F.lit(ORDER), F.size("symbols") - 1)).alias("i")
    chars = texts.select(*keys, "symbols", place).select(*keys, _context(F.col("symbols"), F.col("i"), ORDER).alias("context"), F.get("symbols", F.col("i")).alias("symbol"))
    told = chars.join(F.broadcast(ratios), "context").select(*keys, F.get("ratio", F.col("symbol")).cast("double").alias("x"))
    return told.groupBy(*keys).agg(F.avg("x").alias("score"))


def filter_urls(pages: DataFrame, url: str = "url", rules: tuple[Rule, ...] = RULES, path_symbols: bool = True) -> DataFrame:
    """``pages`` with ``host, path, rule, verdict, score``, replacing columns of these names.

    A rule's verdict stands; otherwise a URL is allowed when its score reaches the calibrated cut. The score is over host and
    path (host alone without ``path_symbols``), so a null URL or one without ``://`` is judged as the empty text. If one of
    the classes has no example, every URL without a rule is allowed and has no score. Rows pass one by one: null ids, repeated
    rows and further columns are kept; an empty table gives an empty result.
    """
    spark = pages.sparkSession
    pages = pages.drop("host", "path", "rule", "verdict", "score")
    symbols_, choice_ = fresh(pages.columns, "__symbols", "__choice")
    host, path = host_and_path(F.col(url))
    judged = pages.select("*", host.alias("host"), path.alias("path"))
    body = F.concat("host", "path") if path_symbols else F.col("host")
    judged = judged.select("*", matching_rule(F.col("host"), F.col("path"), rules).alias(choice_), _symbols(body).alias(symbols_))
    known = judged.where(F.col(choice_).isNotNull()).select(
        "host", "path", F.col(choice_)["allow"].alias("allow"), F.col(symbols_).alias("symbols"), (F.pmod(F.xxhash64("host", "path"), F.lit(CALIBRATION)) == 0).alias("held")
    )
    known = table(known, "labelled")
    rule, allow = F.col(choice_)["rule"], F.col(choice_)["allow"]
    word = lambda c: F.when(c, "allow").otherwise("block")
    classes = {r.allow for r in known.select("allow").distinct().collect()}
    if classes != {True, False}:
        out = judged.withColumns({"rule": rule, "verdict": word(F.coalesce(allow, F.lit(True))), "score": F.lit(None).cast("double")})
        return out.drop(choice_, symbols_)
    ratios = model(known.where("NOT held"), spark)
    held = _scores(known.where("held").drop("held").distinct(), ratios)
    bins = held.groupBy("allow", F.floor((F.col("score") + _RANGE) / (2 * _RANGE) * _BINS).alias("bin")).count().collect()  # _BINS rows a class
    cut = calibrate({(r.allow, r.bin): r["count"] for r in bins})
    open_ = judged.where(F.col(choice_).isNull()).select("host", "path", F.col(symbols_).alias("symbols")).dropDuplicates(["host", "path"])
    scores = _scores(open_, ratios)
    out = judged.drop(symbols_).join(scores, ["host", "path"], "left")
    out = out.withColumns({"rule": rule, "score": F.when(F.col(choice_).isNull(), F.col("score"))})
    return out.withColumn("verdict", word(F.coalesce(allow, F.col("score") >= cut))).select(*pages.columns, "host", "path", "rule", "verdict", "score")


def calibrate(counts: dict[tuple[bool, int], int]) -> float:
    """The cut with the best balanced accuracy; of equal ones the middle; 0 without examples of both classes."""
    totals = {c: sum(n for (a, _), n in counts.items() if a == c) for c in (True, False)}
    if not all(totals.values()):
        return 0.0
    edges = sorted({b for _, b in counts} | {max(b for _, b in counts) + 1})
    right, best = {}, 0.0
    below = {True: 0, False: 0}
    for b in edges:
        right[b] = (totals[True] - below[True]) / totals[True] + below[False] / totals[False]
        best = max(best, right[b])
        for c in (True, False):
            below[c] += counts.get((c, b), 0)
    good = [b for b in edges if right[b] == best]
    return good[len(good) // 2] * 2 * _RANGE / _BINS - _RANGE
