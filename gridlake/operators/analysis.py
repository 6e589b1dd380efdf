"""Tables that describe a pipeline's own data: distributions by stage, health checks, mappings, compared policies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlake.functions import classify
from gridlake.operators import ordered
from gridlake.operators.joins import one_to_one

POINTS = {"median": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}
STAGE = ["stage", "split", "year"]


def stage_distribution(stages: dict[str, DataFrame], full: float = 900.0) -> DataFrame:
    """Counts, shares, percentiles and sums of the areas of each stage, split and year.

    stages: name to rows (station, year, area, and split where the stage has one; else it is 'all'). All stages are
    counted together: one aggregation and one order of values for them all. Values that are not known numbers count as missing.
    """
    parts = []
    for name, rows in stages.items():
        split = F.col("split") if "split" in rows.columns else F.lit("all")
        area = F.when(classify.known(F.col("area")), F.col("area").cast("double"))
        parts.append(rows.select(F.lit(name).alias("stage"), split.alias("split"), "year", "station", area.alias("area")))
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    n, valid = F.count(F.lit(1)), F.count("area")
    count = {"zero": F.count_if(F.col("area") == 0), "positive": F.count_if(F.col("area") > 0), "saturated": F.count_if(F.col("area") >= full)}
    shares = [c for name, found in count.items() for c in (found.alias(f"{name}_count"), F.try_divide(found, valid).alias(f"{name}_fraction"))]
    basic = every.groupBy(*STAGE).agg(
        n.alias("row_count"), F.countDistinct("station").alias("station_count"), valid.alias("valid_count"), (n - valid).alias("missing_count"),
        *shares, F.min("area").alias("min"), F.max("area").alias("max"), F.sum("area").alias("total_area"),
    )
    points = ordered.percentiles(every, STAGE, "area", POINTS)
    same = F.lit(True)
    for k in STAGE:
        same &= F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    return basic.alias("a").join(points.alias("b"), same, "left").select("a.*", *[f"b.{p}" for p in POINTS])


def data_health(rows: DataFrame, keys: list[str], checks: dict[str, tuple[Column, Column]]) -> DataFrame:
    """keys, check_name, row_count, reference_row_count and rate of each check: (what fails, what it is checked among).

    All checks of a group come from one aggregation and are turned into rows afterwards.
    """
    counts = [c for name, (bad, among) in checks.items() for c in (F.count_if(among & bad).alias(f"{name}_n"), F.count_if(among).alias(f"{name}_of"))]
    found = rows.groupBy(*keys).agg(*counts)
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("check_name"), F.col(f"{n}_n").alias("row_count"), F.col(f"{n}_of").alias("reference_row_count")) for n in checks]))
    told = found.select(*keys, each.alias("c")).select(*keys, "c.*")
    return told.withColumn("rate", F.try_divide(F.col("row_count"), F.col("reference_row_count")))


def quarter_mapping(times: DataFrame, time: str) -> DataFrame:
    """Each source time once, with the year, quarter and season that are derived from it."""
    each = times.select(F.col(time).alias("source_time")).where("source_time IS NOT NULL").distinct()
    year, quarter = F.year("source_time"), F.quarter("source_time")
    return each.select("source_time", year.alias("derived_year"), quarter.alias("derived_quarter"), classify.season_of(quarter).alias("season_label"))


def compared_policies(rows: DataFrame, keys: list[str], policies: dict[str, Column]) -> DataFrame:
    """For each group of keys and each policy (a predicate of predicted positives) its rows and rate, and how far the rate
    is from the first policy's."""
    n = F.count(F.lit(1))
    found = rows.groupBy(*keys).agg(n.alias("row_count"), *[F.count_if(p).alias(f"_{name}") for name, p in policies.items()])
    base = F.col(f"_{next(iter(policies))}")
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("policy"), F.col(f"_{name}").alias("predicted_positive_count")) for name in policies]))
    told = found.withColumn("c", each).select(*keys, "row_count", "c.*", base.alias("_base"))
    rate = lambda c: F.try_divide(c, F.col("row_count"))
    return told.withColumns({"predicted_positive_rate": rate(F.col("predicted_positive_count")), "difference": rate(F.col("predicted_positive_count") - F.col("_base"))}).drop("_base")


def method_comparison(base: DataFrame, other: DataFrame, keys: list[str], value: str, by: list[str]) -> DataFrame:
    """Two methods' tables joined one to one by keys: rows, rows of one side alone, and the differences by columns of base.

    A key that occurs twice on the other side stops the job. Differences are of rows that both methods have a value for.
    """
    met = one_to_one(base.withColumnRenamed(value, "_a"), other.select(*keys, F.col(value).alias("_b")), keys, required=F.lit(False))
    d = F.col("_b") - F.col("_a")
    return met.groupBy(*by).agg(
        F.count(F.lit(1)).alias("base_rows"), F.count(d).alias("both"), F.count_if(F.col("_b").isNull()).alias("other_missing"),
        F.avg(d).alias("mean_difference"), F.avg(F.abs(d)).alias("mean_absolute_difference"), F.max(F.abs(d)).alias("max_difference"),
    )
