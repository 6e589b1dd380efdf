"""Levels of scores on threshold grids, stages, health checks, compared policies and methods."""

import pytest
from pyspark.sql import functions as F

from gridlake.operators import analysis, metrics


@pytest.mark.parametrize("grid", [[i / 100 for i in range(1, 100)], [0.05 * i for i in range(1, 20)], [0.1, 0.2, 0.7, 0.71], [0.5]])
def test_level_is_the_number_of_thresholds_reached(spark, grid):
    near = [x for t in grid for x in (t, t - 1e-17, t + 1e-16, t * (1 + 2e-16), t * (1 - 2e-16), t + 0.004)]
    scores = [*near, -5.0, 0.0, 1.0, 1e308, float("inf"), float("-inf"), float("nan"), None]
    table = spark.createDataFrame([(s,) for s in scores], "s double")
    for row in table.select("s", metrics.level(F.col("s"), grid).alias("k"), F.size(F.filter(F.array(*map(F.lit, grid)), lambda t: F.col("s") >= t)).alias("want")).collect():
        assert row["k"] == row["want"], row


def test_stages_health_and_policies_on_pinned_rows(spark):
    rows = spark.createDataFrame([(1, 2000, 0.0), (2, 2000, 900.0), (2, 2000, None), (3, 2001, float("nan"))], "station long, year int, area double")
    split = rows.where("year = 2000").withColumn("split", F.lit("train"))
    got = {(r["stage"], r["split"], r["year"]): r for r in analysis.stage_distribution({"a": rows, "b": split}).collect()}
    assert set(got) == {("a", "all", 2000), ("a", "all", 2001), ("b", "train", 2000)}
    row = got["b", "train", 2000]
    assert (row["row_count"], row["station_count"], row["valid_count"], row["missing_count"], row["zero_fraction"], row["saturated_count"], row["median"]) == (3, 2, 2, 1, 0.5, 1, 450.0)
    assert got["a", "all", 2001]["median"] is None and got["a", "all", 2001]["zero_fraction"] is None
    health = analysis.data_health(rows, ["year"], {"none": (F.col("area").isNull(), F.lit(True)), "high": (F.col("area") > 1, F.col("station") == 2)})
    assert {tuple(r) for r in health.collect()} == {(2000, "none", 1, 3, 1 / 3), (2000, "high", 1, 2, 0.5), (2001, "none", 0, 1, 0.0), (2001, "high", 0, 0, None)}
    told = analysis.compared_policies(rows.where("area IS NOT NULL AND NOT isnan(area)"), ["year"], {"low": F.col("area") >= 0, "high": F.col("area") > 1})
    assert {(r["policy"], r["predicted_positive_count"], r["difference"]) for r in told.collect()} == {("low", 2, 0.0), ("high", 1, -0.5)}


def test_two_methods_join_one_to_one(spark):
    base = spark.createDataFrame([(1, "x", 1.0), (2, "x", 2.0), (3, "y", None), (4, "y", 4.0)], "k int, g string, v double")
    other = spark.createDataFrame([(1, 3.0), (2, 1.0), (3, 1.0)], "k int, v double")
    got = {r["g"]: tuple(r)[1:] for r in analysis.method_comparison(base, other, ["k"], "v", ["g"]).collect()}
    assert got == {"x": (2, 2, 0, 0.5, 1.5, 2.0), "y": (2, 0, 1, None, None, None)}
    with pytest.raises(Exception, match="two rows of one key"):
        analysis.method_comparison(base, other.unionByName(other), ["k"], "v", ["g"]).collect()
