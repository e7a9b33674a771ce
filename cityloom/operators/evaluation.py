"""Accuracy, confusion, confidence and importance tables of predicted labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from cityloom import rules
from cityloom.functions.numeric import closed_bin, half_even, safe_ratio
from cityloom.operators.quantiles import exact_quantiles
from cityloom.operators.sampling import poisson_bootstraps
from cityloom.sources.tables import lookup


def accuracy_with_intervals(pred: DataFrame, key: str, scopes: dict[str, Column], n_boot: int = rules.BOOTSTRAP_N, seed: int = rules.MODEL_SEED) -> DataFrame:
    """Both accuracies of each denominator with bootstrap intervals, in percent; a denominator is a condition on the rows."""
    hit = F.col("truth_arch") == F.col("pred_class")
    metrics = {"accuracy": F.lit(1.0), "gfa_weighted_accuracy": F.col("gfa_m2")}
    pairs = [(name, metric) for name in scopes for metric in metrics]
    wanted = {str(k): (hit, metrics[metric], scopes[name]) for k, (name, metric) in enumerate(pairs)}
    ci = poisson_bootstraps(pred, key, wanted, n_boot, seed)
    pct = [half_even(F.col(c) * 100, 1).alias(c) for c in ("value", "ci95_lo", "ci95_hi")]
    name, metric = (F.element_at(F.array(*[F.lit(p[c]) for p in pairs]), F.col("name").cast("int") + 1) for c in (0, 1))
    return ci.select(name.alias("denominator"), metric.alias("metric"), *pct, "n")


def confusion(pred: DataFrame, labels: list[str]) -> DataFrame:
    """Counts with one row per true label and one column per predicted label, zeros filled."""
    names = lookup(pred.sparkSession, ["truth"], [(x,) for x in labels])
    c = pred.groupBy(F.col("truth_arch").alias("truth")).pivot("pred_class", labels).agg(F.count(F.lit(1)))
    return names.join(c, "truth", "left").na.fill(0, labels)


def class_metrics(pred: DataFrame, labels: list[str]) -> DataFrame:
    """Precision, recall, F1 per label with zero for empty denominators; learnable from five true rows on."""
    names = lookup(pred.sparkSession, ["class"], [(x,) for x in labels])
    each = pred.select(
        F.inline(
            F.array(
                F.struct(F.col("truth_arch").alias("class"), F.lit(1).alias("t"), F.lit(0).alias("p"),
                         (F.col("truth_arch") == F.col("pred_class")).cast("int").alias("tp")),
                F.struct(F.col("pred_class").alias("class"), F.lit(0).alias("t"), F.lit(1).alias("p"), F.lit(0).alias("tp")),
            )
        )
    )
    s = each.groupBy("class").agg(F.sum("t").alias("n_truth"), F.sum("p").alias("_p"), F.sum("tp").alias("_tp"))
    j = names.join(s, "class", "left").na.fill(0)
    prec, rec = safe_ratio(F.col("_tp"), F.col("_p"), 0.0), safe_ratio(F.col("_tp"), F.col("n_truth"), 0.0)
    j = j.withColumns({"precision": prec, "recall": rec})
    f1 = safe_ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"), 0.0)
    return j.select(
        "class",
        "n_truth",
        half_even(F.col("precision"), 3).alias("precision"),
        half_even(F.col("recall"), 3).alias("recall"),
        half_even(f1, 3).alias("f1"),
        (F.col("n_truth") >= rules.MIN_LEARNABLE).alias("learnable"),
    )


def _exact_mean(c: Column) -> Column:
    """Mean over decimals: the same digits whatever order the rows arrive in."""
    return F.avg(c.cast("decimal(20,10)")).cast("double")


def confidence_histogram(pred: DataFrame) -> DataFrame:
    """Rows per 0.1 confidence bin (last bin closed), empty bins included, with their share."""
    edges = rules.CONFIDENCE_EDGES
    bins = lookup(pred.sparkSession, ["bin", "lo", "hi"], [(k, edges[k], edges[k + 1]) for k in range(len(edges) - 1)])
    counted = pred.groupBy(closed_bin(F.col("pred_confidence"), edges).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    total = counted.agg(F.sum("n").alias("_t"))
    j = bins.join(counted, "bin", "left").crossJoin(F.broadcast(total))
    n = F.coalesce("n", F.lit(0))
    return j.select("bin", "lo", "hi", n.alias("n"), half_even(100.0 * n / F.col("_t"), 2).alias("share_pct"))


def confidence_by_class(pred: DataFrame) -> DataFrame:
    s = pred.groupBy("pred_class").agg(F.count(F.lit(1)).alias("n"), half_even(_exact_mean(F.col("pred_confidence")), 3).alias("mean_confidence"))
    med = exact_quantiles(pred, F.col("pred_confidence"), [0.5], ["pred_class"])
    return s.join(med.select("pred_class", half_even(F.col("value"), 3).alias("median_confidence")), "pred_class")


def scope_diagnostics(pred: DataFrame, scopes: dict[str, Column], labels: list[str]) -> DataFrame:
    """Per scope: size, confidence, share outside parcels, share per predicted label (wide)."""
    names = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in scopes.items()]))
    d = pred.withColumn("scope", F.explode(names))
    shares = [half_even(100 * F.avg((F.col("pred_class") == x).cast("double")), 1).alias(f"share_{x}_pct") for x in labels]
    s = d.groupBy("scope").agg(
        F.count(F.lit(1)).alias("n"),
        half_even(_exact_mean(F.col("pred_confidence")), 3).alias("conf_mean"),
        half_even(100 * F.avg(F.col("euluc_out").cast("double")), 1).alias("euluc_out_share_pct"),
        *shares,
    )
    med = exact_quantiles(d, F.col("pred_confidence"), [0.5], ["scope"])
    return s.join(med.select("scope", half_even(F.col("value"), 3).alias("conf_median")), "scope")


def importance_table(spark, names: list[str], values: list[float]) -> DataFrame:
    """Ranked importances with a top-ten flag; as many rows as the model has features."""
    df = lookup(spark, ["feature", "importance"], [(n, float(v)) for n, v in zip(names, values)])
    return with_importance_rank(df)


def with_importance_rank(df: DataFrame) -> DataFrame:
    r = F.row_number().over(Window.orderBy(F.col("importance").desc(), "feature"))
    return df.withColumn("rank", r).withColumn("top10", F.col("rank") <= 10)


def combine_predictions(matched: DataFrame, out_of_fold: DataFrame, final: DataFrame) -> DataFrame:
    """Out-of-fold label where a row was trained on, else the final model's label."""
    j = matched.join(out_of_fold.select("val_id", F.col("pred_class").alias("_oof")), "val_id", "left")
    j = j.join(final.select("bid", F.col("pred_class").alias("_final")), "bid", "left")
    return j.withColumn("pred_class", F.coalesce("_oof", "_final")).drop("_oof", "_final")
