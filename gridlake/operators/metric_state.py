"""Metrics of predictions as mergeable state: sums and maxima of batches, merged and finished apart.

A state is a row for each group whose columns combine by addition or by maximum. So any cut of the rows into batches,
in any order, finishes as one pass does, and a batch that is written again replaces what it wrote before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gridlake.functions import classify
from gridlake.sources.tables import replace_parts

#: The columns that combine by maximum; all others are sums.
MAXIMA = ("background_predicted_area_max",)


def _sums(threshold: float, high: float, background: str) -> dict[str, Column]:
    y, p, area, guess = (F.col(c) for c in ("observed", "predicted", "observed_area", "predicted_area"))
    known = lambda x: F.when(classify.known(x), x)
    total = lambda x: F.coalesce(F.sum(known(x)), F.lit(0.0))
    is_, said = (F.coalesce(classify.known(x) & (x >= threshold), F.lit(False)) for x in (y, p))
    tall = F.coalesce(classify.known(y) & (y >= high), F.lit(False))
    outside = F.coalesce(F.col("label_source") == background, F.lit(False))
    residual = area - guess
    return {
        "rows": F.count(F.lit(1)),
        "observed_sum": total(y),
        "predicted_sum": total(p),
        "observed_square_sum": total(y * y),
        "squared_error_sum": total((y - p) * (y - p)),
        "absolute_error_sum": total(F.abs(y - p)),
        "observed_area_sum": total(area),
        "predicted_area_sum": total(guess),
        "squared_area_error_sum": total(residual * residual),
        "absolute_area_error_sum": total(F.abs(residual)),
        "residual_area_sum": total(residual),
        "positives": F.count_if(is_),
        "predicted_positives": F.count_if(said),
        "true_positives": F.count_if(is_ & said),
        "false_positives": F.count_if(~is_ & said),
        "false_negatives": F.count_if(is_ & ~said),
        "background_rows": F.count_if(outside),
        "background_predicted_positives": F.count_if(outside & said),
        "background_predicted_area_sum": total(F.when(outside, guess)),
        "background_predicted_area_max": F.greatest(F.lit(0.0), F.coalesce(F.max(F.when(outside, known(guess))), F.lit(0.0))),
        "high_rows": F.count_if(tall),
        "high_residual_area_sum": total(F.when(tall, residual)),
    }


def partial(rows: DataFrame, keys: list[str], threshold: float = 0.1, high: float = 0.5, background: str = "assumed_background") -> DataFrame:
    """The state of rows (observed, predicted, observed_area, predicted_area, label_source) by keys. Nulls and NaN are in no
    sum and reach no threshold; a row counts all the same. Null keys are keys like others."""
    return rows.groupBy(*keys).agg(*[c.alias(n) for n, c in _sums(threshold, high, background).items()])


def merged(states: DataFrame, keys: list[str]) -> DataFrame:
    """States of one batch or many, combined by keys (all or some of those they were made with)."""
    names = list(_sums(0.0, 0.0, ""))
    return states.groupBy(*keys).agg(*[(F.max(n) if n in MAXIMA else F.sum(n)).alias(n) for n in names])


def finished(state: DataFrame, keys: list[str]) -> DataFrame:
    """Metrics of each row of a state; a ratio without a denominator is null, R2 also where nothing varies."""
    c = F.col
    mean = lambda x: F.try_divide(c(x), c("rows"))
    precision = F.try_divide(c("true_positives"), c("true_positives") + c("false_positives"))
    recall = F.try_divide(c("true_positives"), c("true_positives") + c("false_negatives"))
    spread = c("observed_square_sum") - F.try_divide(c("observed_sum") * c("observed_sum"), c("rows"))
    bias = lambda guess, true: 100 * F.try_divide(guess - true, true)
    return state.select(
        *keys,
        c("rows").alias("row_count"),
        mean("observed_sum").alias("observed_mean"),
        mean("predicted_sum").alias("predicted_mean"),
        c("observed_area_sum").alias("observed_area"),
        c("predicted_area_sum").alias("predicted_area"),
        (c("predicted_area_sum") - c("observed_area_sum")).alias("area_bias"),
        bias(c("predicted_area_sum"), c("observed_area_sum")).alias("area_percent_bias"),
        mean("absolute_error_sum").alias("mae"),
        F.sqrt(mean("squared_error_sum")).alias("rmse"),
        mean("absolute_area_error_sum").alias("area_mae"),
        F.sqrt(mean("squared_area_error_sum")).alias("area_rmse"),
        F.when(spread > 0, 1 - F.try_divide(c("squared_error_sum"), spread)).alias("r2"),
        "positives",
        "predicted_positives",
        precision.alias("precision"),
        recall.alias("recall"),
        F.try_divide(2 * precision * recall, precision + recall).alias("f1"),
        c("background_rows"),
        F.try_divide(c("background_predicted_positives"), c("background_rows")).alias("background_positive_rate"),
        c("background_predicted_area_sum").alias("background_predicted_area"),
        c("background_predicted_area_max"),
        c("high_rows"),
        F.try_divide(c("high_residual_area_sum"), c("high_rows")).alias("high_mean_residual"),
    )


def append(rows: DataFrame, batch: int, path: str, keys: list[str], **settings) -> None:
    """Write a batch's state at path, in the place of an earlier one of that batch."""
    replace_parts(partial(rows, keys, **settings).withColumn("batch", F.lit(batch).cast("long")), path, "batch")


def stream(rows: DataFrame, path: str, checkpoint: str, keys: list[str], **settings) -> StreamingQuery:
    """Start writing the states of a stream's micro-batches at path, until all that is there now has been read."""
    write = rows.writeStream.foreachBatch(lambda batch, number: append(batch, number, path, keys, **settings))
    return write.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def state_at(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The merged state of all batches at path."""
    return merged(spark.read.parquet(path), keys)
