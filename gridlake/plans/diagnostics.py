"""What predictions get wrong: failure classes, residual bins and taxonomies, extremes, context tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridlake.functions import classify
from gridlake.operators import metrics, ordered, sampling
from gridlake.plans.base import P, Y, query
from gridlake.sources.tables import observations, scan

#: A two-part prediction: p of presence, an amount if present, their product.
FRAME = ", d AS (SELECT *, observed * 900 AS area, predicted AS p, least(900, predicted * 900 + weight * 50) AS amount, predicted * least(900, predicted * 900 + weight * 50) AS expected FROM o), e AS (SELECT *, area - expected AS residual FROM d)"
FLAGS = """, fl AS (SELECT *, (p >= 0.9 AND area < 90) OR (p < 0.1 AND area >= 90) AS high_confidence_wrong, area >= 90 AND p < 0.4 AS support_miss_positive, area = 0 AND p >= 0.4 AS support_leakage_zero, area < 90 AND expected - area > 45 AS amount_overprediction_low_or_zero,
 area >= 90 AND p >= 0.4 AND amount - expected >= 45 AND amount >= 225 AS composition_shrinkage, area >= 90 AND p >= 0.4 AND area - expected > 45 AS amount_underprediction_detected_positive, abs(residual) <= 45 AS near_correct FROM e),
 fc AS (SELECT *, CASE WHEN high_confidence_wrong THEN 'high_confidence_wrong' WHEN support_miss_positive THEN 'support_miss_positive' WHEN support_leakage_zero THEN 'support_leakage_zero' WHEN amount_overprediction_low_or_zero THEN 'amount_overprediction_low_or_zero' WHEN composition_shrinkage THEN 'composition_shrinkage'
 WHEN amount_underprediction_detected_positive THEN 'amount_underprediction_detected_positive' WHEN near_correct THEN 'near_correct' ELSE 'other_residual_or_context_mismatch' END AS failure_class FROM fl)"""
_AREA_BIN = "CASE WHEN {x} = 0 THEN '000_zero' WHEN {x} <= 1 THEN '(0, 1]' WHEN {x} <= 90 THEN '(1, 90]' WHEN {x} <= 225 THEN '(90, 225]' WHEN {x} <= 450 THEN '(225, 450]' WHEN {x} <= 810 THEN '(450, 810]' WHEN {x} <= 900 THEN '(810, 900]' ELSE '>900' END"
_P_BIN = "CASE WHEN p < 0.1 THEN '[0, .1)' WHEN p < 0.25 THEN '[.1, .25)' WHEN p < 0.5 THEN '[.25, .5)' WHEN p < 0.75 THEN '[.5, .75)' WHEN p < 0.9 THEN '[.75, .9)' ELSE '[.9, 1]' END"


def frame(spark, d):
    rows = observations(spark, d).select("*", (Y() * 900).alias("area"), P().alias("p"), F.least(F.lit(900.0), P() * 900 + F.col("weight") * 50).alias("amount"))
    rows = rows.withColumn("expected", F.col("p") * F.col("amount"))
    return rows.withColumn("residual", F.col("area") - F.col("expected"))


def failures(spark, d):
    flags = classify.failure_flags(F.col("area"), F.col("p"), F.col("amount"), F.col("expected"), 0.4, 45.0)
    return frame(spark, d).select("*", *[c.alias(n) for n, c in flags.items()]).withColumn("failure_class", classify.failure_class({n: F.col(n) for n in flags}))


@query("failure_classes", FRAME + FLAGS + " SELECT year, failure_class, count(*) AS n, round(avg(residual), 6) AS mean_residual, round(sum(abs(residual)), 3) AS absolute_residual FROM fc GROUP BY 1, 2")
def _(spark, d):
    return failures(spark, d).groupBy("year", "failure_class").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("residual"), 6).alias("mean_residual"), F.round(F.sum(F.abs("residual")), 3).alias("absolute_residual"))


_FLAG_NAMES = ("high_confidence_wrong", "support_miss_positive", "support_leakage_zero", "amount_overprediction_low_or_zero", "composition_shrinkage", "amount_underprediction_detected_positive", "near_correct")


@query(
    "failure_contexts",
    FRAME + FLAGS + f", cx AS (SELECT *, {_P_BIN} AS p_bin, {_AREA_BIN.format(x='area')} AS area_bin FROM fc), ct AS (SELECT 'source' AS context, source AS value, * FROM cx UNION ALL SELECT 'probability_bin', p_bin, * FROM cx UNION ALL SELECT 'area_bin', area_bin, * FROM cx UNION ALL SELECT 'year', year::VARCHAR, * FROM cx UNION ALL SELECT 'all', 'all', * FROM cx) SELECT context, value, count(*) AS n, " + ", ".join(f"count(*) FILTER ({f}) AS {f}" for f in _FLAG_NAMES) + ", round(avg(residual), 6) AS mean_residual FROM ct GROUP BY 1, 2",
)
def _(spark, d):
    # All contexts of a row in one pass and one aggregation.
    rows = failures(spark, d)
    pairs = {"source": F.col("source"), "probability_bin": classify.probability_bins(F.col("p")), "area_bin": classify.area_bins(F.col("area")), "year": F.col("year").cast("string"), "all": F.lit("all")}
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("context"), c.alias("value")) for n, c in pairs.items()]))
    return rows.select(each.alias("c"), *_FLAG_NAMES, "residual").groupBy("c.context", "c.value").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(f).alias(f) for f in _FLAG_NAMES], F.round(F.avg("residual"), 6).alias("mean_residual"))


@query(
    "residual_taxonomy",
    FRAME + """ SELECT source, CASE WHEN abs(residual) <= 1 THEN 'near_correct' WHEN area = 0 AND expected > 0 THEN 'observed_zero_false_positive' WHEN area >= 450 AND residual > 0 THEN 'high_canopy_underprediction' WHEN residual > 0 THEN 'positive_underprediction' ELSE 'low_canopy_overprediction' END AS class,
 count(*) AS n, round(avg(area), 6) AS mean_observed, round(avg(expected), 6) AS mean_predicted, round(avg(abs(residual)), 6) AS mae, round(sqrt(avg(residual ** 2)), 6) AS rmse FROM e GROUP BY 1, 2""",
)
def _(spark, d):
    residual = F.col("residual")
    named = classify.residual_taxonomy(F.col("area"), F.col("expected"), residual).alias("class")
    return frame(spark, d).groupBy("source", named).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("area"), 6).alias("mean_observed"), F.round(F.avg("expected"), 6).alias("mean_predicted"),
        F.round(F.avg(F.abs(residual)), 6).alias("mae"), F.round(F.sqrt(F.avg(residual * residual)), 6).alias("rmse"),
    )


@query("residual_by_observed_bin", FRAME + f" SELECT {_AREA_BIN.format(x='area')} AS bin, count(*) AS n, round(avg(residual), 6) AS mean_residual, round(quantile_cont(residual, 0.5), 6) AS median_residual, round(quantile_cont(abs(residual), 0.5), 6) AS median_absolute, round(sum(residual), 3) AS area_bias FROM e GROUP BY 1")
def _(spark, d):
    rows = frame(spark, d).select(classify.area_bins(F.col("area")).alias("bin"), "residual", F.abs("residual").alias("absolute"))
    out = rows.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("residual"), 6).alias("mean_residual"), F.round(F.sum("residual"), 3).alias("area_bias"))
    for value, name in (("residual", "median_residual"), ("absolute", "median_absolute")):
        out = out.join(ordered.percentiles(rows, ["bin"], value, {name: 0.5}).withColumn(name, F.round(name, 6)), "bin")
    return out


@query(
    "margin_bins",
    FRAME + f""" SELECT {_P_BIN} AS p_bin, CASE WHEN p - 0.4 < -0.5 THEN '<-.50' WHEN p - 0.4 < -0.25 THEN '[-.50, -.25)' WHEN p - 0.4 < -0.1 THEN '[-.25, -.10)' WHEN p - 0.4 < 0 THEN '[-.10, 0)' WHEN p - 0.4 < 0.1 THEN '[0, .10)' WHEN p - 0.4 < 0.25 THEN '[.10, .25)' WHEN p - 0.4 < 0.5 THEN '[.25, .50)' ELSE '>=.50' END AS margin_bin,
 CASE WHEN residual < -450 THEN '<-450' WHEN residual < -90 THEN '[-450, -90)' WHEN residual <= 90 THEN '[-90, 90]' WHEN residual <= 450 THEN '(90, 450]' ELSE '>450' END AS residual_bin,
 CASE WHEN area = 0 THEN '0' WHEN area < 90 THEN '(0, 90)' WHEN area = 900 THEN '900' WHEN area > 900 THEN '>900' WHEN area < 225 THEN '[90, 225)' WHEN area < 450 THEN '[225, 450)' WHEN area < 810 THEN '[450, 810)' ELSE '[810, 900)' END AS threshold_bin, count(*) AS n FROM e GROUP BY ALL""",
)
def _(spark, d):
    bins = [classify.probability_bins(F.col("p")).alias("p_bin"), classify.margin_bins(F.col("p") - 0.4).alias("margin_bin"), classify.residual_bins(F.col("residual")).alias("residual_bin"), classify.threshold_bins(F.col("area")).alias("threshold_bin")]
    return frame(spark, d).groupBy(*bins).agg(F.count(F.lit(1)).alias("n"))


_KEYED = FRAME + ", g AS (SELECT order_id * 10 + line AS row_id, * FROM e)"


@query(
    "top_residuals",
    _KEYED + " SELECT 'high' AS side, row_number() OVER (ORDER BY residual DESC, row_id) AS rank, row_id, cell_id, year, round(residual, 6) AS residual FROM g WHERE residual > 0 QUALIFY rank <= 25 UNION ALL SELECT 'low', row_number() OVER (ORDER BY residual, row_id) AS rank, row_id, cell_id, year, round(residual, 6) FROM g WHERE residual < 0 QUALIFY rank <= 25",
)
def _(spark, d):
    rows = frame(spark, d).select((F.col("order_id") * 10 + F.col("line")).alias("row_id"), "cell_id", "year", "residual")
    return sampling.top_of_each_sign(rows, "residual", "row_id", 25).select("side", "rank", "row_id", "cell_id", "year", F.round("residual", 6).alias("residual"))


@query("high_errors", FRAME + ", c AS (SELECT quantile_cont(abs(residual), 0.95) AS cut FROM e) SELECT year, count(*) AS n, count(*) FILTER (abs(residual) >= cut) AS high, round(any_value(cut), 6) AS cutoff FROM e, c GROUP BY 1")
def _(spark, d):
    rows = frame(spark, d).select("year", F.abs("residual").alias("absolute"))
    cut = F.broadcast(ordered.percentiles(rows, [], "absolute", {"cut": 0.95}))  # one row
    return rows.join(cut).groupBy("year").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("absolute") >= F.col("cut")).alias("high"), F.round(F.max("cut"), 6).alias("cutoff"))


@query(
    "mean_max_heat",
    f""", c AS (SELECT cell_id, year, avg(observed) * 900 AS mean_area, max(observed) * 900 AS max_area, max(observed) >= 0.5 AS y, max(predicted) >= 0.4 AS h FROM o GROUP BY 1, 2)
 SELECT {_AREA_BIN.format(x='mean_area')} AS mean_bin, {_AREA_BIN.format(x='max_area')} AS max_bin, count(*) AS n, count(*) FILTER (y AND h) AS tp, round(2.0::DOUBLE * count(*) FILTER (y AND h) / nullif(2 * count(*) FILTER (y AND h) + count(*) FILTER (y <> h), 0), 6) AS f1 FROM c GROUP BY 1, 2""",
)
def _(spark, d):
    cells = observations(spark, d).groupBy("cell_id", "year").agg((F.avg("observed") * 900).alias("mean_area"), (F.max("observed") * 900).alias("max_area"), (F.max("observed") >= 0.5).alias("y"), (F.max("predicted") >= 0.4).alias("h"))
    tp, wrong = F.count_if(F.col("y") & F.col("h")), F.count_if(F.col("y") != F.col("h"))
    return cells.groupBy(classify.area_bins(F.col("mean_area")).alias("mean_bin"), classify.area_bins(F.col("max_area")).alias("max_bin")).agg(F.count(F.lit(1)).alias("n"), tp.alias("tp"), F.round(F.try_divide(2 * tp, 2 * tp + wrong), 6).alias("f1"))


@query(
    "observed_subsets",
    FRAME + """, u AS (SELECT *, unnest(list_filter(['all', CASE WHEN area >= 90 THEN 'ge_10pct' END, CASE WHEN area >= 450 THEN 'ge_50pct' END, CASE WHEN area >= 810 THEN 'ge_90pct' END], lambda x: x IS NOT NULL)) AS subset FROM e WHERE area > 0)
 SELECT subset, count(*) AS n, round(avg(residual), 6) AS mean_residual, round(avg(abs(residual)), 6) AS mae, round(sqrt(avg(residual ** 2)), 6) AS rmse, round((sum(expected) - sum(area)) / sum(area), 6) AS area_bias FROM u GROUP BY 1""",
)
def _(spark, d):
    area, r = F.col("area"), F.col("residual")
    subsets = F.array_compact(F.array(F.lit("all"), *[F.when(area >= least, name) for name, least in (("ge_10pct", 90), ("ge_50pct", 450), ("ge_90pct", 810))]))
    return frame(spark, d).where(area > 0).withColumn("subset", F.explode(subsets)).groupBy("subset").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(r), 6).alias("mean_residual"), F.round(F.avg(F.abs(r)), 6).alias("mae"), F.round(F.sqrt(F.avg(r * r)), 6).alias("rmse"),
        F.round((F.sum("expected") - F.sum("area")) / F.sum("area"), 6).alias("area_bias"),
    )


@query(
    "weighted_regression",
    """ SELECT source, count(*) AS n, round(sum(weight * abs(predicted - observed)) / sum(weight), 6) AS mae, round(sqrt(sum(weight * (predicted - observed) ** 2) / sum(weight)), 6) AS rmse,
 round(1 - sum(weight * (predicted - observed) ** 2) / (sum(weight * observed ** 2) - sum(weight * observed) ** 2 / sum(weight)), 6) AS r2,
 round((sum(weight * observed * predicted) - sum(weight * observed) * sum(weight * predicted) / sum(weight)) / (sqrt(sum(weight * observed ** 2) - sum(weight * observed) ** 2 / sum(weight)) * sqrt(sum(weight * predicted ** 2) - sum(weight * predicted) ** 2 / sum(weight))), 6) AS pearson,
 round(sum(weight * observed) / sum(weight), 6) AS mean_observed, round(sum(weight * predicted) / sum(weight), 6) AS mean_predicted, round(100 * (sum(weight * predicted) - sum(weight * observed)) / sum(weight * observed), 6) AS percent_bias FROM o GROUP BY 1""",
)
def _(spark, d):
    return observations(spark, d).groupBy("source").agg(*metrics.weighted_metrics(Y(), P(), F.col("weight")))


@query(
    "rank_correlation",
    ", r AS (SELECT year, rank() OVER (PARTITION BY year ORDER BY observed) + (count(*) OVER (PARTITION BY year, observed) - 1) / 2.0 AS a, rank() OVER (PARTITION BY year ORDER BY predicted) + (count(*) OVER (PARTITION BY year, predicted) - 1) / 2.0 AS b FROM o) SELECT year, round(corr(a, b), 6) AS spearman FROM r GROUP BY 1",
)
def _(spark, d):
    return ordered.spearman(observations(spark, d), ["year"], "observed", "predicted").select("year", F.round("spearman", 6).alias("spearman"))


_POINTS = {"p0": 0.0, "p5": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95, "p99_9": 0.999, "p100": 1.0}


@query("prediction_distribution", FRAME + " SELECT source, count(*) AS n, count(*) FILTER (area = 900) AS saturated, round(avg(expected) FILTER (area = 900), 6) AS saturated_mean, " + ", ".join(f"round(quantile_cont(expected, {q}), 6) AS {n}" for n, q in _POINTS.items()) + " FROM e GROUP BY 1")
def _(spark, d):
    rows = frame(spark, d)
    full = F.col("area") == 900
    basic = rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if(full).alias("saturated"), F.round(F.avg(F.when(full, F.col("expected"))), 6).alias("saturated_mean"))
    return basic.join(ordered.percentiles(rows, ["source"], "expected", _POINTS).withColumns({n: F.round(n, 6) for n in _POINTS}), "source")


@query(
    "spatial_readiness",
    """, z AS (SELECT *, least(9, CAST(floor(("row" - lo) / (hi - lo)::DOUBLE * 10) AS INT)) AS band FROM o, (SELECT min("row") AS lo, max("row") AS hi FROM o)), s AS (SELECT band, count(*) AS n, count(DISTINCT cell_id) AS cells, count(*) FILTER (observed >= 0.5) AS positives FROM z GROUP BY 1)
 SELECT *, n >= 500 AND positives >= 100 AS supported, n >= (SELECT quantile_cont(n, 0.25) FROM s) AS above_quartile FROM s""",
)
def _(spark, d):
    rows = observations(spark, d)
    ends = F.broadcast(rows.agg(F.min("row").alias("lo"), F.max("row").alias("hi")))  # one row
    bands = rows.join(ends).withColumn("band", classify.equal_width_band(F.col("row"), F.col("lo"), F.col("hi"), 10)).groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("cell_id").alias("cells"), F.count_if(Y() >= 0.5).alias("positives"))
    cut = F.broadcast(bands.agg(F.percentile("n", 0.25).alias("cut")))  # of ten bands
    return bands.join(cut).select("band", "n", "cells", "positives", ((F.col("n") >= 500) & (F.col("positives") >= 100)).alias("supported"), (F.col("n") >= F.col("cut")).alias("above_quartile"))


@query(
    "method_difference",
    FRAME + " SELECT source, count(*) AS n, round(avg(abs(expected - predicted * 900)), 6) AS mean_difference, round(quantile_cont(abs(expected - predicted * 900), 0.5), 6) AS median_difference, round(quantile_cont(abs(expected - predicted * 900), 0.95), 6) AS p95_difference, round(max(abs(expected - predicted * 900)), 6) AS max_difference, count(*) FILTER (expected < predicted * 900) AS below FROM e GROUP BY 1",
)
def _(spark, d):
    rows = frame(spark, d).select("source", F.abs(F.col("expected") - P() * 900).alias("difference"), (F.col("expected") < P() * 900).alias("below"))
    basic = rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("difference"), 6).alias("mean_difference"), F.round(F.max("difference"), 6).alias("max_difference"), F.count_if("below").alias("below"))
    found = ordered.percentiles(rows, ["source"], "difference", {"median_difference": 0.5, "p95_difference": 0.95})
    return basic.join(found.withColumns({c: F.round(c, 6) for c in ("median_difference", "p95_difference")}), "source")


_REGIONS = ", rg AS (SELECT r_name AS region, c_custkey, c_acctbal, c_mktsegment FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"


@query("pooled_regions", _REGIONS + ", al AS (SELECT * FROM rg UNION ALL SELECT * REPLACE ('all' AS region) FROM rg) SELECT region, c_mktsegment AS segment, count(*) AS n, count(*) FILTER (c_acctbal > 0) AS positives, round(avg(c_acctbal), 4) AS mean, round(sqrt(avg(c_acctbal ** 2)), 4) AS root_mean_square FROM al GROUP BY 1, 2")
def _(spark, d):
    places = scan(spark, d, "nation", "n_nationkey", "n_regionkey").join(scan(spark, d, "region", "r_regionkey", "r_name"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = scan(spark, d, "customer", "c_nationkey", "c_acctbal", "c_mktsegment").join(places, F.col("c_nationkey") == F.col("n_nationkey"))
    parts = rows.groupBy(F.col("r_name").alias("region"), F.col("c_mktsegment").alias("segment")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("c_acctbal") > 0).alias("positives"), F.avg("c_acctbal").alias("mean"), F.sqrt(F.avg(F.col("c_acctbal") * F.col("c_acctbal"))).alias("root_mean_square"))
    # The row over all regions is merged from the regions' rows, without another pass.
    pooled = metrics.combined(parts.withColumn("region", F.lit("all")), ["region", "segment"], "n", ["mean"], ["root_mean_square"])
    pooled = pooled.join(parts.groupBy("segment").agg(F.sum("positives").alias("positives")), "segment")
    return parts.unionByName(pooled).withColumns({c: F.round(c, 4) for c in ("mean", "root_mean_square")})


@query(
    "inspection_points",
    _KEYED + """ SELECT row_id, CASE WHEN p >= 0.9 AND area < 90 THEN 'confident_wrong' WHEN abs(residual) >= 600 THEN 'large_residual' WHEN area = 900 THEN 'saturated' END AS bucket,
 concat_ws(';', CASE WHEN p >= 0.9 AND area < 90 THEN 'confident_wrong' END, CASE WHEN abs(residual) >= 600 THEN 'large_residual' END, CASE WHEN area = 900 THEN 'saturated' END) AS reasons, round(abs(residual), 6) AS score FROM g WHERE (p >= 0.9 AND area < 90) OR abs(residual) >= 600 OR area = 900
 ORDER BY CASE bucket WHEN 'confident_wrong' THEN 0 WHEN 'large_residual' THEN 1 ELSE 2 END, abs(residual) DESC, row_id LIMIT 500""",
)
def _(spark, d):
    rows = frame(spark, d).select((F.col("order_id") * 10 + F.col("line")).alias("row_id"), "p", "area", F.abs("residual").alias("score"))
    buckets = [("confident_wrong", (F.col("p") >= 0.9) & (F.col("area") < 90)), ("large_residual", F.col("score") >= 600), ("saturated", F.col("area") == 900)]
    return sampling.by_priority(rows, buckets, "score", "row_id", 500).select("row_id", "bucket", "reasons", F.round("score", 6).alias("score"))


@query("nearest_to_median", ", s AS (SELECT c_custkey AS id, c_acctbal AS x, c_nationkey::DOUBLE AS y FROM customer), m AS (SELECT quantile_cont(x, 0.5) AS mx, quantile_cont(y, 0.5) AS my FROM s) SELECT id, x, y, round(sqrt((x - mx) ** 2 + (y - my) ** 2), 6) AS distance FROM s, m ORDER BY sqrt((x - mx) ** 2 + (y - my) ** 2), id LIMIT 40")
def _(spark, d):
    points = scan(spark, d, "customer", "c_custkey", "c_acctbal", "c_nationkey").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("x"), F.col("c_nationkey").cast("double").alias("y"))
    return sampling.nearest_to_median(points, "x", "y", "id", 40).withColumn("distance", F.round("distance", 6))
