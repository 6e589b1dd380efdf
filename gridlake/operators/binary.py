"""Evaluation of binary predictions: confusion rates, curves, calibration error, thresholds and their policies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlake.operators import ordered


def f1_of(precision: Column, recall: Column) -> Column:
    """2 p r / (p + r); null where either is undefined or both are 0."""
    return F.try_divide(2 * precision * recall, precision + recall)


def binary_metrics(df: DataFrame, keys: list[str], observed: Column, score: str, threshold: float) -> DataFrame:
    """Counts, rates, precision, recall, F1, Brier, AUROC and average precision of each group, over rows with a score."""
    rows = df.where(F.col(score).isNotNull() & ~F.isnan(score)).withColumn("_y", F.coalesce(observed, F.lit(False)))
    hit, n = F.col(score) >= threshold, F.count(F.lit(1))
    tp, fp, fn, tn = (F.count_if(c) for c in (F.col("_y") & hit, ~F.col("_y") & hit, F.col("_y") & ~hit, ~F.col("_y") & ~hit))
    precision, recall = F.try_divide(tp, tp + fp), F.try_divide(tp, tp + fn)
    error = F.col(score) - F.col("_y").cast("int")
    counted = rows.groupBy(*keys).agg(
        n.alias("n"), (tp + fn).alias("positives"), ((tp + fn) / n).alias("positive_rate"), ((tp + fp) / n).alias("predicted_positive_rate"),
        tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), tn.alias("tn"), precision.alias("precision"), recall.alias("recall"), f1_of(precision, recall).alias("f1"),
        F.try_divide(fp, fp + tn).alias("false_positive_rate"), F.try_divide(fn, tp + fn).alias("false_negative_rate"), F.avg(error * error).alias("brier"),
    )
    curves = ordered.areas(rows, keys, F.col("_y"), score)
    same = F.lit(True)
    for k in keys:
        same &= F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    return counted.alias("a").join(curves.alias("b"), same).select("a.*", "b.auroc", "b.average_precision")


def calibration_error(df: DataFrame, keys: list[str], observed: Column, score: str, bins: int = 10) -> DataFrame:
    """Expected calibration error of each group: bins of equal width, each weighted by its rows."""
    y = F.coalesce(observed, F.lit(False)).cast("double")
    bin_ = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor(F.col(score) * bins).cast("int")))
    per = df.where(F.col(score).isNotNull() & ~F.isnan(score)).groupBy(*keys, bin_.alias("_bin")).agg(F.count(F.lit(1)).alias("_n"), F.avg(score).alias("_p"), F.avg(y).alias("_rate"))
    return per.groupBy(*keys).agg(F.sum("_n").alias("n"), (F.sum(F.col("_n") * F.abs(F.col("_p") - F.col("_rate"))) / F.sum("_n")).alias("ece"))


def reliability(df: DataFrame, observed: Column, score: str, bins: int = 10) -> DataFrame:
    """Mean score and observed rate of each bin that holds rows."""
    bin_ = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor(F.col(score) * bins).cast("int")))
    y = F.coalesce(observed, F.lit(False)).cast("double")
    return df.where(F.col(score).isNotNull()).groupBy(bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(score).alias("mean_score"), F.avg(y).alias("observed_rate"))


def logit(p: Column, epsilon: float = 1e-6) -> Column:
    clipped = F.greatest(F.lit(epsilon), F.least(F.lit(1 - epsilon), p))
    return F.log(clipped / (1 - clipped))


def platt(p: Column, slope: float, intercept: float) -> Column:
    """Calibrated probability: logistic in the logit of p."""
    return 1 / (1 + F.exp(-(F.lit(intercept) + F.lit(slope) * logit(p))))


def policy_thresholds(counts: DataFrame, min_precision: float) -> DataFrame:
    """The thresholds (policy, threshold, status) that three policies choose from confusion counts of a threshold grid.

    counts: threshold, tp, fp, fn, n. max_f1: F1, precision, the lower share of predicted positives, the larger
    threshold; 0.5 without positives. prevalence_match: the predicted share nearest to the observed one, then the larger
    threshold. min_precision: as max_f1 among thresholds of enough precision, else the last of the grid.
    """
    precision, recall = F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), F.try_divide(F.col("tp"), F.col("tp") + F.col("fn"))
    rows = counts.withColumn("precision", precision).withColumn("f1", f1_of(precision, recall)).withColumn("rate", (F.col("tp") + F.col("fp")) / F.col("n"))
    floor = lambda c: F.coalesce(c, F.lit(-1.0))
    best = F.struct(floor(F.col("f1")), floor(F.col("precision")), -F.col("rate"), F.col("threshold"))
    gap = F.struct(-F.abs(F.col("rate") - (F.col("tp") + F.col("fn")) / F.col("n")), F.col("threshold"))
    chosen = rows.agg(
        F.max_by(F.when(F.col("tp") + F.col("fn") > 0, F.col("threshold")), F.when(F.col("tp") + F.col("fn") > 0, best)).alias("f"), F.max_by("threshold", gap).alias("g"),
        F.max_by(F.when(F.col("precision") >= min_precision, F.col("threshold")), F.when(F.col("precision") >= min_precision, best)).alias("p"), F.max("threshold").alias("last"),
    )
    row = lambda policy, value, status: F.struct(F.lit(policy).alias("policy"), value.alias("threshold"), status.alias("status"))
    three = F.array(
        row("max_f1", F.coalesce("f", F.lit(0.5)), F.when(F.col("f").isNotNull(), "selected_from_validation_max_f1").otherwise("no_valid_validation_threshold")),
        row("prevalence_match", F.col("g"), F.lit("selected_from_validation_prevalence_match")),
        row("min_precision", F.coalesce("p", "last"), F.when(F.col("p").isNotNull(), "selected_from_validation_min_precision").otherwise("no_threshold_met_min_precision")),
    )
    return chosen.select(F.explode(three).alias("r")).select("r.*")
