"""Descriptions of the data itself: stages, health checks, quarters, compared policies and methods."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridlake.operators import analysis, masks
from gridlake.plans.base import SPLITS, query
from gridlake.plans.labels import ANNUAL, annual
from gridlake.plans.masks import MASK, mask
from gridlake.sources.tables import observations, scan

_SPLIT = "CASE WHEN year BETWEEN 1992 AND 1996 THEN 'train' WHEN year = 1997 THEN 'validation' WHEN year = 1998 THEN 'test' END"


@query(
    "stage_distribution",
    ANNUAL + f"""
, st AS (
  SELECT 'annual_labels' AS stage, 'all' AS split, year, station, area_max AS area FROM an
  UNION ALL
  SELECT 'model_input', 'all', year, cell_id, observed * 900 FROM o
  UNION ALL
  SELECT 'retained_rows', {_SPLIT}, year, cell_id, observed * 900 FROM o WHERE cell_id % 7 <> 0 AND year <= 1998)
SELECT stage, split, year, count(*) AS row_count, count(DISTINCT station) AS station_count, count(area) AS valid_count, count(*) - count(area) AS missing_count,
  count(*) FILTER (area = 0) AS zero_count, round(count(*) FILTER (area = 0) / count(area), 6) AS zero_fraction,
  count(*) FILTER (area > 0) AS positive_count, round(count(*) FILTER (area > 0) / count(area), 6) AS positive_fraction,
  count(*) FILTER (area >= 900) AS saturated_count, round(count(*) FILTER (area >= 900) / count(area), 6) AS saturated_fraction,
  round(min(area), 6) AS min, round(max(area), 6) AS max, round(sum(area), 4) AS total_area,
  round(quantile_cont(area, 0.5), 6) AS median, round(quantile_cont(area, 0.9), 6) AS p90, round(quantile_cont(area, 0.95), 6) AS p95, round(quantile_cont(area, 0.99), 6) AS p99
FROM st GROUP BY 1, 2, 3""",
)
def _(spark, d):
    rows = observations(spark, d).select(F.col("cell_id").alias("station"), "year", (F.col("observed") * 900).alias("area"))
    given = {"train": SPLITS["train"], "validation": SPLITS["validation"], "test": SPLITS["test"]}
    retained = masks.attach_split(rows.where("station % 7 <> 0 AND year <= 1998"), _no_manifest(spark), ["station", "year"], given)
    labels = annual(spark, d).select("station", "year", F.col("area_max").alias("area"))
    found = analysis.stage_distribution({"annual_labels": labels, "model_input": rows, "retained_rows": retained})
    digits = {c: 4 if c == "total_area" else 6 for c, kind in found.dtypes if kind == "double"}
    return found.withColumns({c: F.round(c, n) for c, n in digits.items()})


def _no_manifest(spark):
    return spark.createDataFrame([], "station long, year int, split string, used boolean")


@query(
    "data_health",
    MASK + """
, h AS (SELECT o.*, elevation, reason FROM o LEFT JOIN mk USING (cell_id)),
c AS (
  SELECT year, source, 'missing_mask' AS check_name, count(*) FILTER (elevation IS NULL) AS row_count, count(*) AS reference_row_count FROM h GROUP BY 1, 2
  UNION ALL
  SELECT year, source, 'saturated_prediction', count(*) FILTER (predicted >= 1), count(*) FROM h GROUP BY 1, 2
  UNION ALL
  SELECT year, source, 'positive_off_domain', count(*) FILTER (observed >= 0.1 AND reason LIKE 'dropped%'), count(*) FILTER (observed >= 0.1) FROM h GROUP BY 1, 2)
SELECT *, round(row_count / nullif(reference_row_count, 0), 6) AS rate FROM c""",
)
def _(spark, d):
    rows = observations(spark, d).join(mask(spark, d).select("cell_id", "elevation", "reason"), "cell_id", "left")
    seen, any_ = F.col("observed") >= 0.1, F.lit(True)
    checks = {
        "missing_mask": (F.col("elevation").isNull(), any_),
        "saturated_prediction": (F.col("predicted") >= 1, any_),
        "positive_off_domain": (F.col("reason").startswith("dropped"), seen),
    }
    return analysis.data_health(rows, ["year", "source"], checks).withColumn("rate", F.round("rate", 6))


@query(
    "quarter_mapping",
    """, t AS (SELECT DISTINCT CAST(date_trunc('month', l_shipdate) AS DATE) AS source_time FROM lineitem)
SELECT source_time, year(source_time) AS derived_year, quarter(source_time) AS derived_quarter,
  CASE quarter(source_time) WHEN 1 THEN 'winter' WHEN 2 THEN 'spring' WHEN 3 THEN 'summer' ELSE 'fall' END AS season_label FROM t""",
)
def _(spark, d):
    months = scan(spark, d, "lineitem", "l_shipdate").select(F.trunc("l_shipdate", "month").alias("month"))
    return analysis.quarter_mapping(months, "month")


@query(
    "stratum_policy_comparison",
    MASK + """
, h AS (SELECT year, reason, depth_bin, predicted FROM o JOIN mk USING (cell_id) WHERE source = 'N' AND year IN (1997, 1998)),
g AS (SELECT year, reason, depth_bin, count(*) AS n, count(*) FILTER (predicted >= 0.4) AS a, count(*) FILTER (predicted >= 0.6) AS b FROM h GROUP BY 1, 2, 3)
SELECT year, reason, depth_bin, n AS row_count, 'current' AS policy, a AS predicted_positive_count, round(a / n, 6) AS predicted_positive_rate, 0.0::DOUBLE AS difference FROM g
UNION ALL
SELECT year, reason, depth_bin, n, 'strict', b, round(b / n, 6), round((b - a) / n, 6) FROM g""",
)
def _(spark, d):
    rows = observations(spark, d).where("source = 'N' AND year IN (1997, 1998)").join(mask(spark, d).select("cell_id", "reason", "depth_bin"), "cell_id")
    found = analysis.compared_policies(rows, ["year", "reason", "depth_bin"], {"current": F.col("predicted") >= 0.4, "strict": F.col("predicted") >= 0.6})
    return found.withColumns({c: F.round(c, 6) for c in ("predicted_positive_rate", "difference")})


_METHODS = """, a AS (SELECT cell_id, year, avg(predicted) AS v FROM o GROUP BY 1, 2), b AS (SELECT cell_id, year + 1 AS year, avg(observed) AS v FROM o GROUP BY 1, 2)"""


@query(
    "method_comparison",
    _METHODS + """
SELECT year, count(*) AS base_rows, count(b.v) AS both, count(*) - count(b.v) AS other_missing, round(avg(b.v - a.v), 6) AS mean_difference,
  round(avg(abs(b.v - a.v)), 6) AS mean_absolute_difference, round(max(abs(b.v - a.v)), 6) AS max_difference
FROM a LEFT JOIN b USING (cell_id, year) GROUP BY 1""",
)
def _(spark, d):
    """The predictions against the year before, as two tables."""
    rows = observations(spark, d)
    model = rows.groupBy("cell_id", "year").agg(F.avg("predicted").alias("v"))
    before = rows.groupBy("cell_id", (F.col("year") + 1).alias("year")).agg(F.avg("observed").alias("v"))
    found = analysis.method_comparison(model, before, ["cell_id", "year"], "v", ["year"])
    return found.withColumns({c: F.round(c, 6) for c, kind in found.dtypes if kind == "double"})
