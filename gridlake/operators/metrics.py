"""Aggregates: error metrics from sufficient statistics, totals rows, thresholds, leave-one-out means; ridge of a few features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def regression_metrics(y: Column, p: Column) -> list[Column]:
    """One pass of map-side combinable sums: rows, mae, rmse, r2, area sums and bias."""
    error, n = p - y, F.count(F.lit(1))
    return [
        n.alias("n"), F.round(F.avg(F.abs(error)), 6).alias("mae"), F.round(F.sqrt(F.avg(error * error)), 6).alias("rmse"),
        F.round(1 - F.try_divide(F.sum(error * error), F.sum(y * y) - F.sum(y) * F.sum(y) / n), 6).alias("r2"),
        F.round(F.sum(y), 4).alias("observed_area"), F.round(F.sum(p), 4).alias("predicted_area"),
        F.round(F.try_divide(F.sum(p) - F.sum(y), F.sum(y)), 6).alias("area_bias"),
    ]


def weighted_metrics(y: Column, p: Column, w: Column) -> list[Column]:
    """As regression_metrics with weights, and Pearson's correlation, from weighted sums of one pass; rows lacking a value
    are in no sum."""
    ok = y.isNotNull() & p.isNotNull() & w.isNotNull()
    total = lambda x: F.sum(F.when(ok, w * x))
    n, sy, sp = F.sum(F.when(ok, w)), total(y), total(p)
    syy, spp, syp, see = total(y * y), total(p * p), total(y * p), total((p - y) * (p - y))
    spread = lambda s, ss: ss - s * s / n
    return [
        F.count_if(ok).alias("n"), F.round(total(F.abs(p - y)) / n, 6).alias("mae"), F.round(F.sqrt(see / n), 6).alias("rmse"),
        F.round(1 - F.try_divide(see, F.nullif(spread(sy, syy), F.lit(0.0))), 6).alias("r2"),
        F.round(F.try_divide(syp - sy * sp / n, F.sqrt(spread(sy, syy)) * F.sqrt(spread(sp, spp))), 6).alias("pearson"),
        F.round(sy / n, 6).alias("mean_observed"), F.round(sp / n, 6).alias("mean_predicted"), F.round(100 * F.try_divide(sp - sy, sy), 6).alias("percent_bias"),
    ]


def combined(rows: DataFrame, keys: list[str], n: str, means: list[str], roots: list[str]) -> DataFrame:
    """Rows of summaries merged by keys: means weighted by n, roots of mean squares by the squares' means."""
    size = F.sum(n)
    return rows.groupBy(*keys).agg(size.alias(n), *[(F.sum(F.col(n) * F.col(c)) / size).alias(c) for c in means], *[F.sqrt(F.sum(F.col(n) * F.col(c) * F.col(c)) / size).alias(c) for c in roots])


def with_totals(df: DataFrame, key: str, aggregates: list[Column], total: str = "all") -> DataFrame:
    """Groups by key and one row over all, in one aggregation."""
    grouped = df.withColumn("_key", F.col(key).cast("string")).rollup("_key").agg(*aggregates, F.grouping("_key").alias("_all"))
    return grouped.withColumn(key, F.when(F.col("_all") == 1, F.lit(total)).otherwise(F.col("_key"))).drop("_key", "_all")


def level(score: Column, thresholds: list[float]) -> Column:
    """How many of the ascending thresholds a score reaches (null and NaN as comparisons have it: none, and all).

    On an even grid the place is computed and then checked against the thresholds on both sides of it, so that rounding
    decides nothing; on another one the thresholds are tried.
    """
    grid, n = F.array(*[F.lit(t) for t in thresholds]), len(thresholds)
    step = (thresholds[-1] - thresholds[0]) / (n - 1) if n > 1 else 0.0
    if step <= 0 or any(abs(t - thresholds[0] - i * step) > 0.01 * step for i, t in enumerate(thresholds)):
        return F.size(F.filter(grid, lambda t: score >= t))
    near = F.greatest(F.lit(-1.0), F.least(F.lit(float(n - 1)), (score.cast("double") - thresholds[0]) / step))
    k = (F.floor(near) + 1).cast("int")
    more, less = F.coalesce(score >= F.get(grid, k), F.lit(False)), F.coalesce(score < F.get(grid, k - 1), F.lit(False))
    placed = k + F.when(more, 1).otherwise(0) - F.when(less, 1).otherwise(0)
    return F.when(score.isNull(), 0).when(F.isnan(score.cast("double")), n).otherwise(placed).cast("int")


def threshold_sweep(df: DataFrame, observed: Column, score: Column, thresholds: list[float]) -> DataFrame:
    """Confusion counts at each threshold: scores are counted by the last threshold they reach, then summed from above."""
    reached = df.select(observed.alias("y"), level(score, thresholds).alias("k")).groupBy("k").agg(F.count_if("y").alias("pos"), F.count_if(~F.col("y")).alias("neg"))
    steps = F.array(*[F.struct(F.lit(i).alias("level"), F.lit(t).alias("threshold")) for i, t in enumerate(thresholds, 1)])
    levels = reached.sparkSession.range(1).select(F.explode(steps).alias("s")).select("s.level", "s.threshold")
    counts = levels.join(F.broadcast(reached), F.col("k") >= F.col("level"), "left").groupBy("threshold").agg(F.coalesce(F.sum("pos"), F.lit(0)).alias("tp"), F.coalesce(F.sum("neg"), F.lit(0)).alias("fp"))
    total = F.broadcast(reached.agg(F.sum("pos").alias("positives")))
    f1 = F.try_divide(2 * F.col("tp"), F.col("tp") + F.col("fp") + F.col("positives"))
    return counts.join(total).select("threshold", "tp", "fp", (F.col("positives") - F.col("tp")).alias("fn"), F.round(f1, 6).alias("f1"))


def best_threshold(counts: DataFrame) -> DataFrame:
    """One row (threshold, f1) of a threshold_sweep: the largest F1, then precision, then the lower share of predicted
    positives, then the larger threshold. F1 is compared unrounded. Without positives: 0.5 and null."""
    f1 = F.when(F.col("tp") > 0, 2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn")))
    precision = F.try_divide(F.col("tp"), F.col("tp") + F.col("fp"))
    rank = F.struct(F.coalesce(f1, F.lit(-1.0)), F.coalesce(precision, F.lit(-1.0)), -(F.col("tp") + F.col("fp")), F.col("threshold"))
    best = counts.where("tp + fn > 0").agg(F.max_by(F.struct("threshold", "f1"), rank).alias("r"))
    return best.select(F.coalesce("r.threshold", F.lit(0.5)).alias("threshold"), F.col("r.f1").alias("f1"))


def leave_one_out(df: DataFrame, key: str, value: str) -> DataFrame:
    """df with the mean of its key's other rows (null where there is none)."""
    whole = Window.partitionBy(key)
    return df.withColumn("loo_mean", F.try_divide(F.sum(value).over(whole) - F.col(value), F.count(value).over(whole) - 1))


def leave_one_out_chain(df: DataFrame, key: str, source: str, value: str) -> DataFrame:
    """df with loo_mean and reason: the mean of the other rows of its key, else of its source (null: 'unknown'), else of all.

    reason: cell, label_source, global, or none for a lone row, whose mean is null. Unlike the reference's fallback
    means, those of source and all leave the row itself out too. Null values are in no mean, but get one.
    """
    own, out = F.col(value).isNotNull().cast("int"), df.withColumn("_source", F.coalesce(source, F.lit("unknown")))
    means = []
    for i, by in enumerate((key, "_source", None)):
        sums = out.groupBy(*([F.col(by).alias(f"_by{i}")] if by else [])).agg(F.sum(value).alias(f"_s{i}"), F.count(value).alias(f"_n{i}"))
        out = out.join(sums, F.col(by).eqNullSafe(F.col(f"_by{i}"))) if by else out.join(F.broadcast(sums))
        means.append(F.try_divide(F.col(f"_s{i}") - F.coalesce(value, F.lit(0)), F.col(f"_n{i}") - own))
    reason = F.when(means[0].isNotNull(), "cell").when(means[1].isNotNull(), "label_source").when(means[2].isNotNull(), "global").otherwise("none")
    return out.select(*df.columns, F.coalesce(*means).alias("loo_mean"), reason.alias("reason"))


def ridge(df: DataFrame, features: list[str], target: str, alpha: float) -> list[float]:
    """Intercept and coefficients by normal equations; only sums of products leave the executors."""
    import numpy as np

    names = ["_one", *features]
    rows = df.withColumn("_one", F.lit(1.0))
    sums = [F.sum(F.col(a) * F.col(b)).alias(f"{i}_{j}") for i, a in enumerate(names) for j, b in enumerate([*names, target]) if j >= i]
    found = rows.agg(*sums).first()
    k = len(names)
    gram = np.array([[found[f"{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
    right = np.array([found[f"{i}_{k}"] for i in range(k)])
    return np.linalg.solve(gram + alpha * np.diag([0.0] + [1.0] * (k - 1)), right).tolist()
