"""All registered queries and their SQL; further ones are in the modules imported at the end."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gridlake.functions import classify
from gridlake.operators import metrics, ordered, sampling, spatial
from gridlake.plans.base import _METRICS, EDGES, FLAGSHIP, QUERIES, SPLITS, SQL, P, Y, query
from gridlake.sources.tables import latest, observations, scan

__all__ = ["FLAGSHIP", "QUERIES", "SQL"]


@query("scan_pushed_filter", "SELECT order_id, line, cell_id, observed FROM o WHERE year = 1995 AND source = 'R' AND observed >= 0.5")
def _(spark, d):
    # Written on the stored columns, so that all three conditions reach the Parquet scan.
    stored = F.col("l_shipdate").between(F.lit("1995-01-01").cast("timestamp"), F.lit("1995-12-31 23:59:59.999999").cast("timestamp")) & (F.col("l_returnflag") == "R") & (F.col("l_quantity") >= 25)
    return observations(spark, d, stored).select("order_id", "line", "cell_id", "observed")


@query("area_bias_by_year", f"SELECT CAST(year AS VARCHAR) AS year, {_METRICS} FROM o GROUP BY o.year UNION ALL SELECT 'all', {_METRICS} FROM o")
def _(spark, d):
    return metrics.with_totals(observations(spark, d), "year", metrics.regression_metrics(Y(), P()))


@query("metrics_by_split", f"SELECT CASE WHEN year BETWEEN 1992 AND 1996 THEN 'train' WHEN year = 1997 THEN 'validation' WHEN year = 1998 THEN 'test' END AS split, source, {_METRICS} FROM o GROUP BY 1, 2")
def _(spark, d):
    rows = observations(spark, d).withColumn("split", classify.split_of_year(F.col("year"), SPLITS))
    return rows.groupBy("split", "source").agg(*metrics.regression_metrics(Y(), P()))


@query(
    "observed_area_bins",
    """SELECT CASE WHEN observed = 0 THEN '000_zero' WHEN observed <= 0.1 THEN '001_0_0.1' WHEN observed <= 0.25 THEN '002_0.1_0.25' WHEN observed <= 0.5 THEN '003_0.25_0.5'
 WHEN observed <= 0.9 THEN '004_0.5_0.9' WHEN observed <= 1 THEN '005_0.9_1' ELSE '006_above_1' END AS bin, count(*) AS n, round(avg(predicted - observed), 6) AS mean_residual FROM o GROUP BY 1""",
)
def _(spark, d):
    binned = observations(spark, d).withColumn("bin", classify.right_closed_bins(Y(), EDGES))
    return binned.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(P() - Y()), 6).alias("mean_residual"))


@query("binary_outcomes", "SELECT year, CASE WHEN observed >= 0.5 AND predicted >= 0.4 THEN 'TP' WHEN predicted >= 0.4 THEN 'FP' WHEN observed >= 0.5 THEN 'FN' ELSE 'TN' END AS outcome, count(*) AS n FROM o GROUP BY 1, 2")
def _(spark, d):
    return observations(spark, d).groupBy("year", classify.outcome(Y() >= 0.5, P() >= 0.4).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


@query("drop_reasons", "SELECT concat_ws(';', CASE WHEN observed < 0.1 THEN 'low_target' END, CASE WHEN predicted = 1 THEN 'saturated' END, CASE WHEN year = 1998 THEN 'held_out' END) AS reason, count(*) AS n FROM o GROUP BY 1")
def _(spark, d):
    named = classify.reasons([(Y() < 0.1, "low_target"), (P() == 1, "saturated"), (F.col("year") == 1998, "held_out")])
    return observations(spark, d).groupBy(named.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("label_lookup_default", "SELECT o.source, coalesce(p.p_brand, 'unknown') AS brand, count(*) AS n FROM o LEFT JOIN (SELECT * FROM part WHERE p_size > 25) p ON o.cell_id = p.p_partkey GROUP BY 1, 2")
def _(spark, d):
    labels = scan(spark, d, "part", "p_partkey", "p_brand", "p_size").where("p_size > 25")
    joined = observations(spark, d).join(labels, F.col("cell_id") == F.col("p_partkey"), "left")
    return joined.groupBy("source", F.coalesce("p_brand", F.lit("unknown")).alias("brand")).agg(F.count(F.lit(1)).alias("n"))


@query("missing_mask_cells", "SELECT count(DISTINCT cell_id) AS missing FROM o WHERE cell_id NOT IN (SELECT p_partkey FROM part WHERE p_size <= 40)")
def _(spark, d):
    mask = scan(spark, d, "part", "p_partkey", "p_size").where("p_size <= 40")
    return observations(spark, d).join(mask, F.col("cell_id") == F.col("p_partkey"), "left_anti").agg(F.countDistinct("cell_id").alias("missing"))


@query("retained_cells", "SELECT year, count(*) AS n FROM o WHERE cell_id IN (SELECT p_partkey FROM part WHERE p_size <= 40) GROUP BY 1")
def _(spark, d):
    mask = scan(spark, d, "part", "p_partkey", "p_size").where("p_size <= 40")
    return observations(spark, d).join(mask, F.col("cell_id") == F.col("p_partkey"), "left_semi").groupBy("year").agg(F.count(F.lit(1)).alias("n"))


@query(
    "stratified_sample",
    """, s AS (SELECT *, ((cell_id * 48271 + 7 * 7919) % 2147483647) / 2147483647.0::DOUBLE AS score FROM (SELECT DISTINCT year, source, cell_id FROM o)),
 r AS (SELECT *, row_number() OVER (PARTITION BY year, source ORDER BY score, cell_id) AS k, count(*) OVER (PARTITION BY year, source) AS population FROM s)
 SELECT year, source, cell_id, round(population::DOUBLE / least(population, 20), 6) AS weight FROM r WHERE k <= 20""",
)
def _(spark, d):
    cells = observations(spark, d).select("year", "source", "cell_id").distinct().withColumn("score", classify.sample_score(F.col("cell_id"), 7))
    size = cells.groupBy("year", "source").agg(F.count(F.lit(1)).alias("population"))
    first = cells.withColumn("k", F.row_number().over(Window.partitionBy("year", "source").orderBy("score", "cell_id"))).where("k <= 20")
    return first.join(size, ["year", "source"]).select("year", "source", "cell_id", F.round(F.col("population") / F.least("population", F.lit(20)), 6).alias("weight"))


@query(
    "stratified_sample_quota",
    """, s AS (SELECT *, ((cell_id * 48271 + 7 * 7919) % 2147483647) / 2147483647.0::DOUBLE AS score FROM (SELECT DISTINCT year, source, cell_id FROM o)),
 r AS (SELECT *, row_number() OVER (PARTITION BY year, source ORDER BY score, cell_id) AS k, count(*) OVER (PARTITION BY year, source) AS population FROM s WHERE source <> 'R'),
 q AS (SELECT *, least(population, CASE WHEN source = 'A' THEN least(greatest(ceil(population * 0.1::DOUBLE), 20), 200) ELSE greatest(ceil(population * 0.05::DOUBLE), 10) END) AS quota FROM r)
 SELECT year, source, cell_id, round(population::DOUBLE / quota, 6) AS weight FROM q WHERE k <= quota UNION ALL SELECT year, source, cell_id, 1.0::DOUBLE FROM s WHERE source = 'R'""",
)
def _(spark, d):
    cells = observations(spark, d).select("year", "source", "cell_id").distinct()
    source, score = F.col("source"), classify.sample_score(F.col("cell_id"), 7)
    taken = sampling.quota_sample(cells, source == "R", ["year", "source"], "cell_id", score, [(source == "A", 0.1, 20, 200)], (0.05, 10, None))
    return taken.withColumn("weight", F.round("weight", 6))


_YEARLY = ", c AS (SELECT cell_id, year, sum(observed) AS v FROM o GROUP BY 1, 2)"


def _yearly(spark, d):
    return observations(spark, d).groupBy("cell_id", "year").agg(F.sum("observed").alias("v"))


def _with_previous(yearly):
    """yearly with the value of the cell's year before: its previous row, if that is of the year before."""
    last = Window.partitionBy("cell_id").orderBy("year")
    return yearly.withColumn("before", F.when(F.lag("year").over(last) == F.col("year") - 1, F.lag("v").over(last)))


@query("previous_year_persistence", _YEARLY + " SELECT c.year, count(*) AS n, count(p.v) AS with_previous, round(avg(abs(c.v - p.v)), 9) AS mae FROM c LEFT JOIN c p ON p.cell_id = c.cell_id AND p.year = c.year - 1 GROUP BY 1")
def _(spark, d):
    joined = _with_previous(_yearly(spark, d))
    return joined.groupBy("year").agg(F.count(F.lit(1)).alias("n"), F.count("before").alias("with_previous"), F.round(F.avg(F.abs(F.col("v") - F.col("before"))), 9).alias("mae"))


@query("leave_one_year_out", _YEARLY + ", s AS (SELECT cell_id, sum(v) AS s, count(*) AS n FROM c GROUP BY 1) SELECT year, count(*) AS n, round(avg(abs(v - (s.s - v) / nullif(s.n - 1, 0))), 6) AS mae FROM c JOIN s USING (cell_id) GROUP BY 1")
def _(spark, d):
    rows = metrics.leave_one_out(_yearly(spark, d), "cell_id", "v")
    return rows.groupBy("year").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.abs(F.col("v") - F.col("loo_mean"))), 6).alias("mae"))


@query(
    "leave_one_year_out_chain",
    """, c AS (SELECT cell_id, year, min(source) AS source, sum(observed) AS v FROM o GROUP BY 1, 2), s AS (SELECT cell_id, sum(v) AS s, count(*) AS n FROM c GROUP BY 1),
 q AS (SELECT source, sum(v) AS s, count(*) AS n FROM c GROUP BY 1), a AS (SELECT sum(v) AS s, count(*) AS n FROM c),
 m AS (SELECT c.year, c.v, (s.s - c.v) / nullif(s.n - 1, 0) AS m0, (q.s - c.v) / nullif(q.n - 1, 0) AS m1, (a.s - c.v) / nullif(a.n - 1, 0) AS m2 FROM c JOIN s USING (cell_id) JOIN q ON q.source = c.source, a)
 SELECT year, CASE WHEN m0 IS NOT NULL THEN 'cell' WHEN m1 IS NOT NULL THEN 'label_source' WHEN m2 IS NOT NULL THEN 'global' ELSE 'none' END AS reason, count(*) AS n, round(avg(abs(v - coalesce(m0, m1, m2))), 6) AS mae FROM m GROUP BY 1, 2""",
)
def _(spark, d):
    yearly = observations(spark, d).groupBy("cell_id", "year").agg(F.min("source").alias("source"), F.sum("observed").alias("v"))
    rows = metrics.leave_one_out_chain(yearly, "cell_id", "source", "v")
    return rows.groupBy("year", "reason").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.abs(F.col("v") - F.col("loo_mean"))), 6).alias("mae"))


@query(
    "previous_year_class",
    _YEARLY + """ SELECT CASE WHEN c.v >= 0.5 AND coalesce(p.v, 0) >= 0.5 THEN 'persistent' WHEN c.v >= 0.5 THEN 'new' WHEN coalesce(p.v, 0) >= 0.5 THEN 'lost' ELSE 'low' END AS class, count(*) AS n
 FROM c LEFT JOIN c p ON p.cell_id = c.cell_id AND p.year = c.year - 1 GROUP BY 1""",
)
def _(spark, d):
    # Sums to 12 digits: one that is just the threshold reaches it, in whatever order its rows were summed.
    v, b = F.round("v", 12) >= 0.5, F.coalesce(F.round("before", 12), F.lit(0.0)) >= 0.5
    named = classify.chain([(v & b, "persistent"), (v, "new"), (b, "lost")], "low")
    return _with_previous(_yearly(spark, d)).groupBy(named.alias("class")).agg(F.count(F.lit(1)).alias("n"))


@query("weighted_means", "SELECT source, year, round(sum(weight * observed) / sum(weight), 6) AS weighted_observed, round(sum(weight * predicted) / sum(weight), 6) AS weighted_predicted FROM o GROUP BY 1, 2")
def _(spark, d):
    mean = lambda c: F.round(F.sum(F.col("weight") * F.col(c)) / F.sum("weight"), 6).alias(f"weighted_{c}")
    return observations(spark, d).groupBy("source", "year").agg(mean("observed"), mean("predicted"))


@query("residual_percentiles", "SELECT year, round(quantile_cont(predicted - observed, 0.05), 6) AS p05, round(quantile_cont(predicted - observed, 0.5), 6) AS p50, round(quantile_cont(predicted - observed, 0.95), 6) AS p95 FROM o GROUP BY 1")
def _(spark, d):
    rows = observations(spark, d).select("year", (P() - Y()).alias("residual"))
    found = ordered.percentiles(rows, ["year"], "residual", {"p05": 0.05, "p50": 0.5, "p95": 0.95})
    return found.select("year", *[F.round(c, 6).alias(c) for c in ("p05", "p50", "p95")])


@query("calibration_bins", "SELECT least(9, CAST(floor(predicted * 10) AS INT)) AS bin, count(*) AS n, round(avg(predicted), 6) AS mean_score, round(avg(CASE WHEN observed >= 0.5 THEN 1.0 ELSE 0.0 END), 6) AS rate FROM o GROUP BY 1")
def _(spark, d):
    bin_ = F.least(F.lit(9), F.floor(P() * 10).cast("int")).alias("bin")
    return observations(spark, d).groupBy(bin_).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(P()), 6).alias("mean_score"), F.round(F.avg(F.when(Y() >= 0.5, 1.0).otherwise(0.0)), 6).alias("rate"))


@query("brier_by_year", "SELECT year, round(avg((predicted - CASE WHEN observed >= 0.5 THEN 1 ELSE 0 END) ** 2), 6) AS brier FROM o GROUP BY 1")
def _(spark, d):
    error = P() - F.when(Y() >= 0.5, 1).otherwise(0)
    return observations(spark, d).groupBy("year").agg(F.round(F.avg(error * error), 6).alias("brier"))


_SWEEP = """, t AS (SELECT i / 20.0::DOUBLE AS threshold FROM range(1, 20) r(i)), k AS (SELECT threshold, CAST(count(*) FILTER (predicted >= threshold AND observed >= 0.5) AS BIGINT) AS tp,
 CAST(count(*) FILTER (predicted >= threshold AND observed < 0.5) AS BIGINT) AS fp, CAST(count(*) FILTER (predicted < threshold AND observed >= 0.5) AS BIGINT) AS fn FROM t, o GROUP BY 1),
 f AS (SELECT *, round(2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1 FROM k)"""


def _sweep(spark, d):
    return metrics.threshold_sweep(observations(spark, d), Y() >= 0.5, P(), [i / 20 for i in range(1, 20)])


@query("threshold_sweep", _SWEEP + " SELECT * FROM f")
def _(spark, d):
    return _sweep(spark, d)


@query("best_threshold", _SWEEP + " SELECT threshold, f1 FROM f ORDER BY f1 DESC, threshold LIMIT 1")
def _(spark, d):
    return _sweep(spark, d).orderBy(F.desc("f1"), "threshold").limit(1).select("threshold", "f1")


#: The whole grid of the reference, 0.01 to 0.99, and its choice of a threshold.
_FULL_SWEEP = """, t AS (SELECT i / 100.0::DOUBLE AS threshold FROM range(1, 100) r(i)), k AS (SELECT threshold, CAST(count(*) FILTER (predicted >= threshold AND observed >= 0.5) AS BIGINT) AS tp,
 CAST(count(*) FILTER (predicted >= threshold AND observed < 0.5) AS BIGINT) AS fp, CAST(count(*) FILTER (predicted < threshold AND observed >= 0.5) AS BIGINT) AS fn FROM t, o GROUP BY 1),
 f AS (SELECT *, round(2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1 FROM k)"""


def _full_sweep(spark, d):
    return metrics.threshold_sweep(observations(spark, d), Y() >= 0.5, P(), [i / 100 for i in range(1, 100)])


@query("threshold_sweep_full", _FULL_SWEEP + " SELECT * FROM f")
def _(spark, d):
    return _full_sweep(spark, d)


@query(
    "best_threshold_full",
    _FULL_SWEEP + """ SELECT coalesce(any_value(threshold), 0.5::DOUBLE) AS threshold, any_value(f1) AS f1 FROM (SELECT threshold, f1 FROM f WHERE tp + fn > 0
 ORDER BY CASE WHEN tp > 0 THEN 2.0::DOUBLE * tp / (2 * tp + fp + fn) END DESC NULLS LAST, tp::DOUBLE / nullif(tp + fp, 0) DESC NULLS LAST, tp + fp, threshold DESC LIMIT 1)""",
)
def _(spark, d):
    return metrics.best_threshold(_full_sweep(spark, d))


@query("latest_order_per_customer", "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders) WHERE k = 1")
def _(spark, d):
    rows = scan(spark, d, "orders", "o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")
    return latest(rows, "o_custkey", "o_orderdate", "o_orderkey").select("o_custkey", "o_orderkey", "o_totalprice")


@query("latitude_bands", "SELECT least(4, CAST(floor((\"row\" - lo) / (hi - lo)::DOUBLE * 5) AS INT)) AS band, count(*) AS n, round(avg(observed), 6) AS mean_observed FROM o, (SELECT min(\"row\") AS lo, max(\"row\") AS hi FROM o) GROUP BY 1")
def _(spark, d):
    rows = observations(spark, d)
    ends = F.broadcast(rows.agg(F.min("row").alias("lo"), F.max("row").alias("hi")))
    band = classify.equal_width_band(F.col("row"), F.col("lo"), F.col("hi"), 5).alias("band")
    return rows.join(ends).groupBy(band).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("observed"), 6).alias("mean_observed"))


_CELLS = ", g AS (SELECT \"row\", col, count(*) AS v FROM o WHERE observed >= 0.9 GROUP BY 1, 2)"


@query("grid_neighbourhood", _CELLS + " SELECT a.\"row\", a.col, any_value(a.v) AS v, CAST(sum(b.v) AS BIGINT) AS window_sum FROM g a JOIN g b ON abs(a.\"row\" - b.\"row\") <= 1 AND abs(a.col - b.col) <= 1 GROUP BY 1, 2")
def _(spark, d):
    cells = observations(spark, d).where("observed >= 0.9").groupBy("row", "col").agg(F.count(F.lit(1)).alias("v"))
    return spatial.neighbours(cells, "v")


@query("quarter_presence", "SELECT cell_id, year, count(DISTINCT quarter) AS quarters, min(quarter) AS first_quarter, max(quarter) AS last_quarter, CASE WHEN count(DISTINCT quarter) = 4 THEN 'all' WHEN count(DISTINCT quarter) = 1 THEN 'one' ELSE 'some' END AS class FROM o WHERE observed > 0 GROUP BY 1, 2")
def _(spark, d):
    # Four possible quarters: a bit mask replaces the distinct count and its second shuffle.
    found = observations(spark, d).where("observed > 0").groupBy("cell_id", "year").agg(F.bit_or(F.expr("shiftleft(1, quarter)")).alias("m"), F.min("quarter").alias("first_quarter"), F.max("quarter").alias("last_quarter"))
    n = F.bit_count("m").cast("long")
    return found.select("cell_id", "year", n.alias("quarters"), "first_quarter", "last_quarter", classify.chain([(n == 4, "all"), (n == 1, "one")], "some").alias("class"))


@query("ridge_scores", ", m AS (SELECT regr_slope(observed, predicted) AS b, regr_intercept(observed, predicted) AS a FROM o) SELECT year, round(avg(a + b * predicted), 5) AS mean_score, count(*) AS n FROM o, m GROUP BY 1")
def _(spark, d):
    rows = observations(spark, d)
    a, b = metrics.ridge(rows, ["predicted"], "observed", 0.0)
    return rows.groupBy("year").agg(F.round(F.avg(F.lit(a) + F.lit(b) * P()), 5).alias("mean_score"), F.count(F.lit(1)).alias("n"))


@query("expected_value_composition", "SELECT year, round(sum(predicted * observed), 4) AS expected, round(sum(CASE WHEN predicted >= 0.4 THEN observed ELSE 0 END), 4) AS gated FROM o GROUP BY 1")
def _(spark, d):
    return observations(spark, d).groupBy("year").agg(F.round(F.sum(P() * Y()), 4).alias("expected"), F.round(F.sum(F.when(P() >= 0.4, Y()).otherwise(0)), 4).alias("gated"))


from gridlake.plans import (  # noqa: E402, F401
    analyses,
    binary,
    comparisons,
    diagnostics,
    family_tables,
    grids,
    joins,
    labels,
    masks,
    model_plans,
    place_joins,
    split_plans,
    stored,
)
