"""Annual labels and what is made of them; stations are lineitem's parts, areas its quantities."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridlake.functions import classify
from gridlake.operators import labels, ordered
from gridlake.plans.base import query
from gridlake.sources.tables import scan

#: Quarterly areas; the fill value -18 (quantity 1) is cleaned away.
STATIONS = ", q AS (SELECT l_partkey AS station, year(l_shipdate) AS year, quarter(l_shipdate) AS quarter, CASE WHEN l_quantity * 18 - 36 >= 0 THEN l_quantity * 18 - 36 END AS area FROM lineitem)"
_SUM = lambda test: " + ".join(f"CASE WHEN area_q{i} {test} THEN 1 ELSE 0 END" for i in (1, 2, 3, 4))
ANNUAL = (
    STATIONS
    + """, a0 AS (SELECT year, station, max(area) FILTER (quarter = 1) AS area_q1, max(area) FILTER (quarter = 2) AS area_q2, max(area) FILTER (quarter = 3) AS area_q3, max(area) FILTER (quarter = 4) AS area_q4 FROM q GROUP BY 1, 2),
 a1 AS (SELECT *, greatest(area_q1, area_q2, area_q3, area_q4) AS area_max FROM a0),
 an AS (SELECT *, area_max / 900 AS fraction, CASE WHEN area_q1 = area_max THEN 1 WHEN area_q2 = area_max THEN 2 WHEN area_q3 = area_max THEN 3 WHEN area_q4 = area_max THEN 4 END AS max_area_quarter, """
    + _SUM("IS NOT NULL") + " AS valid_quarter_count, " + _SUM("> 0") + """ AS nonzero_quarter_count, coalesce(area_max > 0, false) AS present_gt0, coalesce(area_max / 900 >= 0.01, false) AS present_ge_1pct,
 coalesce(area_max / 900 >= 0.05, false) AS present_ge_5pct, coalesce(area_max / 900 >= 0.1, false) AS present_ge_10pct FROM a1)"""
)


def quarterly(spark, d):
    rows = scan(spark, d, "lineitem", "l_partkey", "l_shipdate", "l_quantity")
    return rows.select(F.col("l_partkey").alias("station"), F.year("l_shipdate").alias("year"), F.quarter("l_shipdate").alias("quarter"), classify.cleaned_area(F.col("l_quantity") * 18 - 36).alias("area"))


def annual(spark, d):
    return labels.annual_labels(quarterly(spark, d))


@query("annual_labels", ANNUAL + " SELECT * REPLACE (round(fraction, 9) AS fraction) FROM an")
def _(spark, d):
    return annual(spark, d).withColumn("fraction", F.round("fraction", 9))


@query(
    "annual_label_summary",
    ANNUAL + """ SELECT year, count(*) AS row_count, count(DISTINCT station) AS station_count, count(area_max) AS valid_count, count(*) - count(area_max) AS missing_count, count(*) FILTER (area_max = 0) AS zero_count,
 count(*) FILTER (present_gt0) AS gt0_count, count(*) FILTER (present_ge_1pct) AS ge_1pct_count, count(*) FILTER (present_ge_5pct) AS ge_5pct_count, count(*) FILTER (present_ge_10pct) AS ge_10pct_count,
 min(area_max) AS min, max(area_max) AS max, sum(area_max) AS total_area, round(quantile_cont(area_max, 0.5), 6) AS median, round(quantile_cont(area_max, 0.95), 6) AS p95, round(quantile_cont(area_max, 0.99), 6) AS p99 FROM an GROUP BY 1""",
)
def _(spark, d):
    found = labels.label_summary(annual(spark, d))
    return found.withColumns({c: F.round(c, 6) for c in ("median", "p95", "p99")})


@query(
    "labels_of_cells",
    ANNUAL + """ SELECT year, station // 5 AS cell, count(*) AS station_count, CASE WHEN count(*) = 1 THEN min(station) END AS station, round(avg(area_max), 6) AS area_max, round(avg(fraction), 9) AS fraction,
 arg_min(max_area_quarter, station) FILTER (max_area_quarter IS NOT NULL) AS max_area_quarter, bool_or(present_gt0) AS present_gt0, bool_or(present_ge_10pct) AS present_ge_10pct FROM an GROUP BY 1, 2""",
)
def _(spark, d):
    stations = annual(spark, d).withColumn("cell", F.floor(F.col("station") / 5))
    found = labels.labels_of_cells(stations, ["area_max", "fraction"], ["max_area_quarter"], ["present_gt0", "present_ge_10pct"])
    return found.withColumns({"area_max": F.round("area_max", 6), "fraction": F.round("fraction", 9)})


@query("quarter_series", STATIONS + " SELECT year, quarter, CASE quarter WHEN 1 THEN 'winter' WHEN 2 THEN 'spring' WHEN 3 THEN 'summer' ELSE 'fall' END AS season, count(*) AS n, count(area) AS valid, count(*) FILTER (area > 0) AS positive, sum(area) AS area FROM q GROUP BY 1, 2")
def _(spark, d):
    rows = quarterly(spark, d).groupBy("year", "quarter").agg(F.count(F.lit(1)).alias("n"), F.count("area").alias("valid"), F.count_if(F.col("area") > 0).alias("positive"), F.sum("area").alias("area"))
    return rows.withColumn("season", classify.season_of(F.col("quarter")))


_TEMPORAL = ANNUAL + """, tc AS (SELECT *, CASE WHEN valid_quarter_count > 0 THEN (coalesce(area_q1, 0) + coalesce(area_q2, 0) + coalesce(area_q3, 0) + coalesce(area_q4, 0)) / valid_quarter_count END AS annual_mean,
 CASE WHEN valid_quarter_count = 0 THEN 'missing_quarters' WHEN nonzero_quarter_count = 0 THEN 'no_quarter_present' WHEN nonzero_quarter_count = 1 THEN 'one_quarter_spike' WHEN nonzero_quarter_count = valid_quarter_count THEN 'persistent_all_valid_quarters' ELSE 'intermittent_two_or_three_quarters' END AS seasonality,
 CASE WHEN valid_quarter_count = 0 THEN 'missing_quarters' WHEN nonzero_quarter_count = 0 THEN 'no_quarter_present' WHEN nonzero_quarter_count = valid_quarter_count THEN 'persistent_all_valid_quarters' WHEN nonzero_quarter_count = 1 THEN 'transient_one_quarter' ELSE 'intermittent_two_or_three_quarters' END AS persistence,
 CASE WHEN valid_quarter_count = 0 THEN 'missing' WHEN nonzero_quarter_count = 0 THEN 'none' WHEN area_q1 > 0 THEN '1' WHEN area_q2 > 0 THEN '2' WHEN area_q3 > 0 THEN '3' ELSE '4' END AS first_positive_quarter,
 CASE WHEN valid_quarter_count = 0 THEN 'missing' WHEN nonzero_quarter_count = 0 THEN 'none' WHEN area_q4 > 0 THEN '4' WHEN area_q3 > 0 THEN '3' WHEN area_q2 > 0 THEN '2' ELSE '1' END AS last_positive_quarter FROM an)"""


@query(
    "temporal_context",
    _TEMPORAL + """ SELECT seasonality, persistence, first_positive_quarter, last_positive_quarter, CASE WHEN annual_mean IS NULL THEN 'missing' WHEN annual_mean = 0 THEN '000_zero' WHEN annual_mean <= 1 THEN '(0, 1]' WHEN annual_mean <= 90 THEN '(1, 90]'
 WHEN annual_mean <= 225 THEN '(90, 225]' WHEN annual_mean <= 450 THEN '(225, 450]' WHEN annual_mean <= 810 THEN '(450, 810]' WHEN annual_mean <= 900 THEN '(810, 900]' ELSE '>900' END AS mean_bin,
 CASE WHEN annual_mean > 0 THEN CASE WHEN area_max / annual_mean <= 1.25 THEN '[1, 1.25]' WHEN area_max / annual_mean <= 2 THEN '(1.25, 2]' WHEN area_max / annual_mean <= 4 THEN '(2, 4]' ELSE '>4' END ELSE 'missing' END AS ratio_bin,
 count(*) AS n FROM tc GROUP BY ALL""",
)
def _(spark, d):
    rows = labels.temporal_context(annual(spark, d))
    bins = [classify.area_bins(F.col("annual_mean")).alias("mean_bin"), classify.ratio_bins(F.col("max_to_mean")).alias("ratio_bin")]
    return rows.groupBy("seasonality", "persistence", "first_positive_quarter", "last_positive_quarter", *bins).agg(F.count(F.lit(1)).alias("n"))


@query(
    "temporal_label_classes",
    _TEMPORAL + """ SELECT year, CASE WHEN station % 3 = 0 THEN 'assumed_background' WHEN seasonality = 'no_quarter_present' AND area_max > 0 THEN 'no_quarter_positive' WHEN seasonality = 'intermittent_two_or_three_quarters' THEN 'intermittent'
 WHEN seasonality = 'persistent_all_valid_quarters' THEN 'persistent' ELSE seasonality END AS label_class, count(*) AS n FROM tc GROUP BY 1, 2""",
)
def _(spark, d):
    rows = labels.temporal_context(annual(spark, d))
    source = F.when(F.col("station") % 3 == 0, "assumed_background").otherwise("observed")
    return rows.groupBy("year", classify.temporal_label(source, F.col("seasonality"), F.col("area_max")).alias("label_class")).agg(F.count(F.lit(1)).alias("n"))


_FRAMED = ANNUAL + """, fr AS (SELECT area_max, (area_q1 + area_q2 + area_q3 + area_q4) / 4 AS annual_mean, CASE WHEN area_q1 + area_q2 + area_q3 + area_q4 IS NOT NULL THEN least(area_q1, area_q2, area_q3, area_q4) END AS annual_min, area_q4 AS fall, area_q1 AS winter,
 area_q4 - area_q1 AS fall_minus_winter, CASE WHEN area_max IS NOT NULL THEN CAST(area_max >= 90 AS INT)::DOUBLE END AS presence_ge_90 FROM an),
 fu AS (SELECT framing, value, area_max FROM fr UNPIVOT (value FOR framing IN (annual_mean, annual_min, fall, winter, fall_minus_winter, presence_ge_90)) WHERE value IS NOT NULL AND area_max IS NOT NULL),
 rk AS (SELECT *, rank() OVER (PARTITION BY framing ORDER BY value) + (count(*) OVER (PARTITION BY framing, value) - 1) / 2.0 AS rv, rank() OVER (PARTITION BY framing ORDER BY area_max) + (count(*) OVER (PARTITION BY framing, area_max) - 1) / 2.0 AS ra FROM fu)"""


@query("target_framing_summary", _FRAMED + " SELECT framing, count(*) AS n, round(avg(value), 6) AS mean, min(value) AS min, max(value) AS max, round(corr(value, area_max), 6) AS pearson, round(corr(rv, ra), 6) AS spearman FROM rk GROUP BY 1")
def _(spark, d):
    rows = labels.framing_rows(annual(spark, d), labels.target_framings()).where("value IS NOT NULL AND area_max IS NOT NULL")
    basic = rows.groupBy("framing").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.min("value").alias("min"), F.max("value").alias("max"), F.round(F.corr("value", "area_max"), 6).alias("pearson"))
    return basic.join(ordered.spearman(rows, ["framing"], "value", "area_max").withColumn("spearman", F.round("spearman", 6)), "framing")


@query(
    "previous_year_context",
    ANNUAL + """ SELECT an.year, CASE WHEN p.area_max IS NULL THEN 'missing_previous_year' WHEN p.area_max >= 90 AND coalesce(an.area_max >= 90, false) THEN 'persistent_ge_10pct' WHEN p.area_max < 90 AND coalesce(an.area_max >= 90, false) THEN 'new_ge_10pct'
 WHEN p.area_max >= 90 THEN 'lost_ge_10pct' WHEN p.area_max > 0 THEN 'previous_low_canopy' ELSE 'stable_zero_or_background' END AS class, count(*) AS n FROM an LEFT JOIN an p ON p.station = an.station AND p.year = an.year - 1 GROUP BY 1, 2""",
)
def _(spark, d):
    from pyspark.sql import Window

    # One aggregate serves both years: the row before, if it is of the year before.
    before = Window.partitionBy("station").orderBy("year")
    rows = annual(spark, d).select("station", "year", "area_max", F.when(F.lag("year").over(before) == F.col("year") - 1, F.lag("area_max").over(before)).alias("previous"))
    return rows.groupBy("year", classify.previous_year(F.col("previous"), F.col("area_max")).alias("class")).agg(F.count(F.lit(1)).alias("n"))
