"""Annual labels from quarterly area observations, and what is made of them: summaries, cells, framings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlake.functions import classify
from gridlake.operators import ordered

QUARTERS = ("area_q1", "area_q2", "area_q3", "area_q4")


def annual_labels(rows: DataFrame, cell_area: float = 900.0) -> DataFrame:
    """One row per (year, station) of rows (station, year, quarter, area): quarterly maxima, annual maximum, its share of
    the cell, the first quarter that reaches it, counts of valid and positive quarters, presence flags.

    Null areas are in no maximum; a station-year without any valid area keeps its row, with nulls and counts of 0.
    """
    quarters = [F.max(F.when(F.col("quarter") == q, F.col("area"))).alias(name) for q, name in enumerate(QUARTERS, 1)]
    found = rows.groupBy("year", "station").agg(*quarters)
    found = found.withColumn("area_max", F.greatest(*QUARTERS)).withColumn("fraction", F.col("area_max") / cell_area)
    count = lambda test: sum((F.when(test(F.col(q)), 1).otherwise(0) for q in QUARTERS), F.lit(0))
    first = F.coalesce(*[F.when(F.col(q) == F.col("area_max"), F.lit(i)) for i, q in enumerate(QUARTERS, 1)])
    flags = [F.coalesce(classify.present(F.col("fraction"), t), F.lit(False)).alias(n) for t, n in ((0.0, "present_gt0"), (0.01, "present_ge_1pct"), (0.05, "present_ge_5pct"), (0.10, "present_ge_10pct"))]
    return found.select("*", first.alias("max_area_quarter"), count(lambda c: c.isNotNull()).alias("valid_quarter_count"), count(lambda c: F.coalesce(c > 0, F.lit(False))).alias("nonzero_quarter_count"), *flags)


def label_summary(labels: DataFrame) -> DataFrame:
    """Counts, extremes, percentiles and sum of the annual maxima of each year."""
    n = F.count(F.lit(1))
    counts = labels.groupBy("year").agg(
        n.alias("row_count"), F.countDistinct("station").alias("station_count"), F.count("area_max").alias("valid_count"), (n - F.count("area_max")).alias("missing_count"),
        F.count_if(F.col("area_max") == 0).alias("zero_count"), *[F.count_if(f"present_{t}").alias(f"{t}_count") for t in ("gt0", "ge_1pct", "ge_5pct", "ge_10pct")],
        F.min("area_max").alias("min"), F.max("area_max").alias("max"), F.sum("area_max").alias("total_area"),
    )
    return counts.join(ordered.percentiles(labels, ["year"], "area_max", {"median": 0.5, "p95": 0.95, "p99": 0.99}), "year", "left")


def labels_of_cells(stations: DataFrame, values: list[str], metadata: list[str], flags: list[str]) -> DataFrame:
    """(year, cell) of stations (year, cell, station, ...): means of values, of metadata the first that is not null by
    station, any() of flags, the station's id where there is just one. Stations without a cell are left out."""
    rows = stations.where("cell IS NOT NULL")
    return rows.groupBy("year", "cell").agg(
        F.count("station").alias("station_count"), F.when(F.count("station") == 1, F.min("station")).alias("station"),
        *[F.avg(v).alias(v) for v in values], *[F.min_by(m, F.when(F.col(m).isNotNull(), F.col("station"))).alias(m) for m in metadata],
        *[F.bool_or(f).alias(f) for f in flags],
    )


def temporal_context(labels: DataFrame) -> DataFrame:
    """labels with positive_quarter_count, annual mean, max-to-mean ratio, seasonality, persistence and the first and last
    positive quarter ('missing' without valid quarters, 'none' without a positive one)."""
    valid, positive = F.col("valid_quarter_count"), F.col("nonzero_quarter_count")
    total = sum((F.coalesce(q, F.lit(0.0)) for q in QUARTERS), F.lit(0.0))
    mean = F.when(valid > 0, total / F.nullif(valid, F.lit(0)))
    places = [F.when(F.col(q) > 0, F.lit(i)) for i, q in enumerate(QUARTERS, 1)]
    named = lambda c: F.when(valid == 0, "missing").when(positive == 0, "none").otherwise(c.cast("string"))
    return labels.select(
        "*", mean.alias("annual_mean"), F.when(mean > 0, F.try_divide(F.col("area_max"), mean)).alias("max_to_mean"),
        classify.seasonality(valid, positive).alias("seasonality"), classify.persistence(valid, positive).alias("persistence"),
        named(F.least(*places)).alias("first_positive_quarter"), named(F.greatest(*places)).alias("last_positive_quarter"),
    )


def target_framings(threshold: float = 90.0) -> dict[str, Column]:
    """Other targets than the annual maximum: each a column of labels with its quarters."""
    q = [F.col(c) for c in QUARTERS]
    every = q[0].isNotNull() & q[1].isNotNull() & q[2].isNotNull() & q[3].isNotNull()
    return {
        "annual_mean": F.when(every, (q[0] + q[1] + q[2] + q[3]) / 4), "annual_min": F.when(every, F.least(*q)), "fall": q[3], "winter": q[0],
        "fall_minus_winter": q[3] - q[0], f"presence_ge_{threshold:g}": F.when(F.col("area_max").isNotNull(), (F.col("area_max") >= threshold).cast("double")),
    }


def framing_rows(labels: DataFrame, framings: dict[str, Column]) -> DataFrame:
    """labels once for each framing: framing, value, and area_max."""
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("framing"), v.cast("double").alias("value")) for n, v in framings.items()]))
    return labels.select("year", "station", "area_max", pairs.alias("f")).select("year", "station", "area_max", "f.framing", "f.value")
