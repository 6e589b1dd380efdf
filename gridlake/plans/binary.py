"""Binary evaluation: observed share of at least a half against the predicted share."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridlake.functions import classify
from gridlake.operators import binary, metrics
from gridlake.plans.base import SPLITS, P, Y, query
from gridlake.sources.tables import observations

_SPLIT = "CASE WHEN year BETWEEN 1992 AND 1996 THEN 'train' WHEN year = 1997 THEN 'validation' WHEN year = 1998 THEN 'test' ELSE 'later' END"
ROWS = f", b AS (SELECT *, {_SPLIT} AS split, observed >= 0.5 AS y, predicted AS p FROM o)"
#: Curves by group: average ranks for AUROC, one step a distinct score for average precision.
_CURVES = """, rk AS (SELECT {k}, y, rank() OVER (PARTITION BY {k} ORDER BY p) + (count(*) OVER (PARTITION BY {k}, p) - 1) / 2.0 AS r FROM {t}),
 au AS (SELECT {k}, (sum(r) FILTER (y) - count(*) FILTER (y) * (count(*) FILTER (y) + 1) / 2.0) / nullif(count(*) FILTER (y) * count(*) FILTER (NOT y), 0) AS auroc FROM rk GROUP BY ALL),
 st AS (SELECT {k}, p, count(*) FILTER (y) AS pos, count(*) AS n FROM {t} GROUP BY ALL),
 cu AS (SELECT *, sum(pos) OVER (PARTITION BY {k} ORDER BY p DESC) AS cp, sum(n) OVER (PARTITION BY {k} ORDER BY p DESC) AS cn, sum(pos) OVER (PARTITION BY {k}) AS tp FROM st),
 ap AS (SELECT {k}, sum(pos * cp::DOUBLE / cn) / nullif(any_value(tp), 0) AS average_precision FROM cu GROUP BY ALL),
 mt AS (SELECT {k}, count(*) AS n, count(*) FILTER (y) AS positives, count(*) FILTER (y AND p >= 0.4) AS tp, count(*) FILTER (NOT y AND p >= 0.4) AS fp, count(*) FILTER (y AND p < 0.4) AS fn, count(*) FILTER (NOT y AND p < 0.4) AS tn, avg((p - y::INT) ** 2) AS brier FROM {t} GROUP BY ALL)
 SELECT {k}, n, positives, round(positives / n, 6) AS positive_rate, round((tp + fp) / n, 6) AS predicted_positive_rate, tp, fp, fn, tn, round(tp / nullif(tp + fp, 0), 6) AS "precision", round(tp / nullif(tp + fn, 0), 6) AS recall,
 round(CASE WHEN tp > 0 THEN 2.0 * tp / (2 * tp + fp + fn) END, 6) AS f1, round(fp / nullif(fp + tn, 0), 6) AS false_positive_rate, round(fn / nullif(tp + fn, 0), 6) AS false_negative_rate, round(brier, 6) AS brier, round(auroc, 6) AS auroc, round(average_precision, 6) AS average_precision
 FROM mt JOIN au USING ({k}) JOIN ap USING ({k})"""
_ROUNDED = ("positive_rate", "predicted_positive_rate", "precision", "recall", "f1", "false_positive_rate", "false_negative_rate", "brier", "auroc", "average_precision")


def rows(spark, d):
    split = F.coalesce(classify.split_of_year(F.col("year"), SPLITS), F.lit("later"))
    return observations(spark, d).select("*", split.alias("split"), (Y() >= 0.5).alias("y"), P().alias("p"))


def _rounded(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


@query("binary_metrics", ROWS + _CURVES.format(k="split, year", t="b"))
def _(spark, d):
    return _rounded(binary.binary_metrics(rows(spark, d), ["split", "year"], F.col("y"), "p", 0.4), *_ROUNDED)


@query("binary_metrics_by_source", ROWS + ", b2 AS (SELECT * FROM b UNION ALL SELECT * REPLACE ('all' AS source) FROM b)" + _CURVES.format(k="split, source", t="b2"))
def _(spark, d):
    both = rows(spark, d).withColumn("source", F.explode(F.array("source", F.lit("all"))))
    return _rounded(binary.binary_metrics(both, ["split", "source"], F.col("y"), "p", 0.4), *_ROUNDED)


_ECE = ", eb AS (SELECT split, greatest(0, least(9, CAST(floor({p} * 10) AS INT))) AS bin, count(*) AS n, avg({p}) AS mp, avg(y::INT) AS rate FROM b GROUP BY 1, 2)"


@query("calibration_error", ROWS + _ECE.format(p="p") + " SELECT split, CAST(sum(n) AS BIGINT) AS n, round(sum(n * abs(mp - rate)) / sum(n), 6) AS ece FROM eb GROUP BY 1")
def _(spark, d):
    return _rounded(binary.calibration_error(rows(spark, d), ["split"], F.col("y"), "p"), "ece")


@query("reliability_points", ROWS + " SELECT greatest(0, least(9, CAST(floor(p * 10) AS INT))) AS bin, count(*) AS n, round(avg(p), 6) AS mean_score, round(avg(y::INT), 6) AS observed_rate FROM b WHERE split = 'validation' GROUP BY 1")
def _(spark, d):
    return _rounded(binary.reliability(rows(spark, d).where("split = 'validation'"), F.col("y"), "p"), "mean_score", "observed_rate")


_PLATT = "1 / (1 + exp(-(-0.3 + 1.7 * ln(greatest(1e-6, least(1 - 1e-6, p)) / (1 - greatest(1e-6, least(1 - 1e-6, p)))))))"


@query(
    "platt_applied",
    ROWS + f", pc AS (SELECT *, {_PLATT} AS c FROM b) SELECT split, source, count(*) AS n, round(avg((p - y::INT) ** 2), 6) AS raw_brier, round(avg((c - y::INT) ** 2), 6) AS calibrated_brier, round(avg(c), 6) AS mean_calibrated, count(*) FILTER (c >= 0.5) AS predicted FROM pc GROUP BY 1, 2",
)
def _(spark, d):
    scored = rows(spark, d).withColumn("c", binary.platt(F.col("p"), 1.7, -0.3))
    brier = lambda c: F.round(F.avg((F.col(c) - F.col("y").cast("int")) * (F.col(c) - F.col("y").cast("int"))), 6)
    return scored.groupBy("split", "source").agg(F.count(F.lit(1)).alias("n"), brier("p").alias("raw_brier"), brier("c").alias("calibrated_brier"), F.round(F.avg("c"), 6).alias("mean_calibrated"), F.count_if(F.col("c") >= 0.5).alias("predicted"))


_COUNTS = """, t AS (SELECT i / 100.0::DOUBLE AS threshold FROM range(1, 100) r(i)), k AS (SELECT threshold, count(*) FILTER (p >= threshold AND y) AS tp, count(*) FILTER (p >= threshold AND NOT y) AS fp, count(*) FILTER (p < threshold AND y) AS fn, count(*) AS n
 FROM t, b WHERE split = 'validation' GROUP BY 1), f AS (SELECT *, CASE WHEN tp > 0 THEN 2.0::DOUBLE * tp / (2 * tp + fp + fn) END AS f1, tp::DOUBLE / nullif(tp + fp, 0) AS "precision", (tp + fp)::DOUBLE / n AS rate FROM k)"""


@query(
    "threshold_policies",
    ROWS + _COUNTS + """ SELECT 'max_f1' AS policy, coalesce(any_value(threshold), 0.5::DOUBLE) AS threshold, CASE WHEN any_value(threshold) IS NOT NULL THEN 'selected_from_validation_max_f1' ELSE 'no_valid_validation_threshold' END AS status FROM (SELECT threshold FROM f WHERE tp + fn > 0 ORDER BY f1 DESC NULLS LAST, "precision" DESC NULLS LAST, rate, threshold DESC LIMIT 1)
 UNION ALL SELECT 'prevalence_match', threshold, 'selected_from_validation_prevalence_match' FROM (SELECT threshold FROM f ORDER BY abs(rate - (tp + fn)::DOUBLE / n), threshold DESC LIMIT 1)
 UNION ALL SELECT 'min_precision', coalesce(any_value(threshold), 0.99::DOUBLE), CASE WHEN any_value(threshold) IS NOT NULL THEN 'selected_from_validation_min_precision' ELSE 'no_threshold_met_min_precision' END FROM (SELECT threshold FROM f WHERE "precision" >= 0.6 ORDER BY f1 DESC NULLS LAST, "precision" DESC, rate, threshold DESC LIMIT 1)""",
)
def _(spark, d):
    validation = rows(spark, d).where("split = 'validation'")
    counts = metrics.threshold_sweep(validation, F.col("y"), F.col("p"), [i / 100 for i in range(1, 100)])
    size = F.broadcast(validation.agg(F.count(F.lit(1)).alias("n")))  # one row
    return binary.policy_thresholds(counts.join(size), 0.6)


@query(
    "threshold_rates",
    """, w AS (SELECT t.threshold, o.observed >= t.threshold AS y, o.predicted >= t.threshold AS h, weight FROM o, (VALUES (0.01::DOUBLE), (0.05::DOUBLE), (0.1::DOUBLE)) t(threshold)),
 s AS (SELECT threshold, sum(weight) AS n, coalesce(sum(weight) FILTER (y AND h), 0) AS tp, coalesce(sum(weight) FILTER (NOT y AND h), 0) AS fp, coalesce(sum(weight) FILTER (y AND NOT h), 0) AS fn FROM w GROUP BY 1)
 SELECT threshold, round((tp + fn) / n, 6) AS observed_rate, round((tp + fp) / n, 6) AS predicted_rate, round(tp / nullif(tp + fp, 0), 6) AS "precision", round(tp / nullif(tp + fn, 0), 6) AS recall, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1 FROM s""",
)
def _(spark, d):
    t, w = F.col("threshold"), F.col("weight")
    each = observations(spark, d).withColumn("threshold", F.explode(F.array(*[F.lit(x) for x in (0.01, 0.05, 0.1)])))
    total = lambda c: F.sum(F.when(c, w).otherwise(0.0))
    y, h = classify.present(Y(), 0.0) & (Y() >= t), P() >= t
    s = each.groupBy("threshold").agg(F.sum(w).alias("n"), total(y & h).alias("tp"), total(~y & h).alias("fp"), total(y & ~h).alias("fn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return s.select(
        "threshold", F.round((tp + fn) / F.col("n"), 6).alias("observed_rate"), F.round((tp + fp) / F.col("n"), 6).alias("predicted_rate"),
        F.round(F.try_divide(tp, tp + fp), 6).alias("precision"), F.round(F.try_divide(tp, tp + fn), 6).alias("recall"), F.round(F.try_divide(2 * tp, 2 * tp + fp + fn), 6).alias("f1"),
    )


@query(
    "class_balance",
    ROWS + " SELECT split, source, count(*) AS n, count(*) FILTER (y) AS positives, count(*) FILTER (observed = 0) AS zeros, round(count(*) FILTER (y) / count(*), 6) AS positive_rate, round(avg(observed), 6) AS mean_target, round(sum(observed), 4) AS area FROM b GROUP BY 1, 2",
)
def _(spark, d):
    n, positives = F.count(F.lit(1)), F.count_if("y")
    return rows(spark, d).groupBy("split", "source").agg(n.alias("n"), positives.alias("positives"), F.count_if(Y() == 0).alias("zeros"), F.round(positives / n, 6).alias("positive_rate"), F.round(F.avg(Y()), 6).alias("mean_target"), F.round(F.sum(Y()), 4).alias("area"))


@query("background_leakage", ROWS + " SELECT split, year, count(*) AS background, count(*) FILTER (p >= 0.4) AS leaked, round(count(*) FILTER (p >= 0.4) / count(*), 6) AS leakage_rate, round(coalesce(sum(p) FILTER (p >= 0.4), 0), 4) AS leaked_area FROM b WHERE source = 'N' AND observed < 0.1 GROUP BY 1, 2")
def _(spark, d):
    n, leaked = F.count(F.lit(1)), F.col("p") >= 0.4
    background = rows(spark, d).where((F.col("source") == "N") & (Y() < 0.1))
    return background.groupBy("split", "year").agg(n.alias("background"), F.count_if(leaked).alias("leaked"), F.round(F.count_if(leaked) / n, 6).alias("leakage_rate"), F.round(F.sum(F.when(leaked, F.col("p")).otherwise(0.0)), 4).alias("leaked_area"))


@query(
    "threshold_prevalence",
    ROWS + """ SELECT split, t.label, count(*) AS n, count(*) FILTER (CASE WHEN t.threshold = 0 THEN observed > 0 ELSE observed >= t.threshold END) AS positives,
 round(count(*) FILTER (CASE WHEN t.threshold = 0 THEN observed > 0 ELSE observed >= t.threshold END) / count(*), 6) AS prevalence FROM b, (VALUES ('gt0', 0.0::DOUBLE), ('ge_5pct', 0.05::DOUBLE), ('ge_10pct', 0.1::DOUBLE), ('ge_50pct', 0.5::DOUBLE)) t(label, threshold) GROUP BY 1, 2""",
)
def _(spark, d):
    targets = {"gt0": 0.0, "ge_5pct": 0.05, "ge_10pct": 0.1, "ge_50pct": 0.5}
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("label"), classify.present(Y(), t).alias("hit")) for n, t in targets.items()]))
    n, hits = F.count(F.lit(1)), F.count_if("t.hit")
    return rows(spark, d).select("split", each.alias("t")).groupBy("split", "t.label").agg(n.alias("n"), hits.alias("positives"), F.round(hits / n, 6).alias("prevalence"))
