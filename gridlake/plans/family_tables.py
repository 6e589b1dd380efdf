"""Context families: nine contexts below source and split; the masks, bins and flags are those of the single queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridlake.functions import classify
from gridlake.operators import families, joins, labels, ordered
from gridlake.plans.base import SPLITS, query
from gridlake.plans.binary import _SPLIT
from gridlake.plans.diagnostics import _AREA_BIN, _P_BIN, FLAGS, FRAME, failures
from gridlake.plans.labels import _TEMPORAL, annual
from gridlake.plans.masks import MASK, mask
from gridlake.sources.tables import observations

THRESHOLD = 0.4
BASE = ["source", "split"]
CONTEXTS = ("year", "quarter", "reason", "depth_bin", "elevation_bin", "area_bin", "p_bin", "persistence", "seasonality")
_ROWS = (
    MASK + FRAME + FLAGS + _TEMPORAL + f"""
, cx AS (
  SELECT fc.*, reason, depth_bin, elevation_bin, persistence, seasonality, {_SPLIT.replace("year", "fc.year")} AS split,
    area >= 90 AS y, p >= {THRESHOLD} AS h, CASE WHEN p >= {THRESHOLD} THEN amount ELSE 0 END AS gated,
    {_AREA_BIN.format(x="area")} AS area_bin, {_P_BIN} AS p_bin
  FROM fc LEFT JOIN mk USING (cell_id) LEFT JOIN tc ON tc.station = fc.cell_id AND tc.year = fc.year)"""
)


def _sql(measures: str) -> str:
    """The families in SQL: a plain grouping for each context."""
    one = "SELECT source, split, '{c}' AS context_type, coalesce(CAST({c} AS VARCHAR), 'missing') AS context_value, {m} FROM cx GROUP BY 1, 2, 4"
    return _ROWS + "\n" + "\nUNION ALL\n".join(one.format(c=c, m=measures) for c in CONTEXTS)


def rows(spark, d):
    context = labels.temporal_context(annual(spark, d)).select(F.col("station").alias("cell_id"), "year", "persistence", "seasonality")
    met = failures(spark, d).join(mask(spark, d).select("cell_id", "reason", "depth_bin", "elevation_bin"), "cell_id", "left")
    hit = F.col("p") >= THRESHOLD
    return joins.one_to_one(met, context, ["cell_id", "year"], required=F.lit(False)).withColumns(
        {
            "split": F.coalesce(classify.split_of_year(F.col("year"), SPLITS), F.lit("later")),
            "y": F.col("area") >= 90,
            "h": hit,
            "gated": F.when(hit, F.col("amount")).otherwise(0.0),
            "area_bin": classify.area_bins(F.col("area")),
            "p_bin": classify.probability_bins(F.col("p")),
        }
    )


#: Means of values with few decimals often end in a half of the sixth: this much more, and all go up, whatever the order
#: in which they were summed.
_NUDGE = 2e-10


def _rounded(found):
    return found.withColumns({c: F.round(F.col(c) + _NUDGE, 6) for c, kind in found.dtypes if kind == "double"})


def _table(spark, d, measures):
    return _rounded(families.families(rows(spark, d), BASE, {c: F.col(c) for c in CONTEXTS}, measures))


def _r(x: str, name: str) -> str:
    return f"round({x} + {_NUDGE}::DOUBLE, 6) AS {name}"


_SUPPORT = ", ".join([
    "count(*) AS row_count", "count(*) FILTER (y) AS observed_positive_count", _r("count(*) FILTER (y) / count(*)", "observed_positive_rate"),
    "count(*) FILTER (h) AS predicted_positive_count", _r("count(*) FILTER (h) / count(*)", "predicted_positive_rate"),
    _r("count(*) FILTER (y AND h) / nullif(count(*) FILTER (h), 0)", '"precision"'), _r("count(*) FILTER (y AND h) / nullif(count(*) FILTER (y), 0)", "recall"),
    _r("CASE WHEN count(*) FILTER (y AND h) > 0 THEN 2.0::DOUBLE * count(*) FILTER (y AND h) / (count(*) FILTER (y) + count(*) FILTER (h)) END", "f1"),
    "count(*) FILTER (y AND h) AS true_positive_count", "count(*) FILTER (NOT y AND h) AS false_positive_count",
    _r("count(*) FILTER (NOT y AND h) / nullif(count(*) FILTER (NOT y), 0)", "false_positive_rate"), "count(*) FILTER (y AND NOT h) AS false_negative_count",
    _r("count(*) FILTER (y AND NOT h) / nullif(count(*) FILTER (y), 0)", "false_negative_rate"), "count(*) FILTER (NOT y AND NOT h) AS true_negative_count",
    _r("avg(p)", "probability_mean"), _r(f"avg(p - {THRESHOLD}::DOUBLE)", "threshold_margin_mean"),
])


@query("binary_context_families", _sql(_SUPPORT))
def _(spark, d):
    return _table(spark, d, families.support_measures(F.col("y"), F.col("h"), F.col("p"), THRESHOLD))


def _amounts(name: str, column: str) -> list[str]:
    return [
        _r(f"sum({column})", f"{name}_area"), _r(f"sum({column}) - sum(area)", f"{name}_area_bias"),
        _r(f"100 * (sum({column}) - sum(area)) / nullif(sum(area), 0)", f"{name}_percent_bias"), _r(f"avg(area - {column})", f"{name}_mean_residual"),
        _r(f"avg(abs(area - {column}))", f"{name}_mae"), _r(f"sqrt(avg((area - {column}) ** 2))", f"{name}_rmse"),
    ]


_AMOUNTS = {"conditional": "amount", "expected": "expected", "hard_gate": "gated"}


@query("amount_context_families", _sql(", ".join([_r("sum(area)", "observed_area"), *[m for n, c in _AMOUNTS.items() for m in _amounts(n, c)]])))
def _(spark, d):
    return _table(spark, d, families.amount_measures(F.col("area"), {n: F.col(c) for n, c in _AMOUNTS.items()}))


#: A failure's flag and what it is a share of.
_WHOLES = {"positives": "y", "zeros": "area = 0", "detected": "y AND h", "low": "area < 90", "rows": "true"}
_FLAGS = {
    "support_miss_positive": "positives", "support_leakage_zero": "zeros", "amount_underprediction_detected_positive": "detected",
    "amount_overprediction_low_or_zero": "low", "composition_shrinkage": "detected", "high_confidence_wrong": "rows", "near_correct": "rows",
}


@query(
    "component_failure_families",
    _sql(", ".join(x for f, w in _FLAGS.items() for x in (f"count(*) FILTER ({f}) AS {f}_count", _r(f"count(*) FILTER ({f}) / nullif(count(*) FILTER ({_WHOLES[w]}), 0)", f"{f}_rate")))),
)
def _(spark, d):
    wholes = {n: F.count_if(F.expr(c)) for n, c in _WHOLES.items()}
    return _table(spark, d, families.failure_measures({f: (w, F.col(f)) for f, w in _FLAGS.items()}, wholes))


_POINTS = {"p05": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95, "p99": 0.99}


@query("probability_context_quantiles", _sql(", ".join(_r(f"quantile_cont(p, {q})", n) for n, q in _POINTS.items())))
def _(spark, d):
    each = lambda r: joins.contexts(r, {c: F.col(c) for c in CONTEXTS}, [*BASE, "p", "_bucket"])
    found = ordered.percentiles(rows(spark, d).select(*BASE, "p", *CONTEXTS), [*BASE, "context_type", "context_value"], "p", _POINTS, each)
    return _rounded(found)


_GRID = f""", g AS (
  SELECT year, "row", col, avg(observed) * 900 AS area, avg(predicted) AS p, avg(least(900, predicted * 900 + weight * 50)) AS amount FROM o GROUP BY 1, 2, 3),
f AS (
  SELECT *, area >= 450 AS y, p >= {THRESHOLD} AS h, p * amount AS expected, CASE WHEN p >= {THRESHOLD} THEN amount ELSE 0 END AS gated FROM g),
w AS (
  SELECT a.year, a."row", a.col, any_value(a.area) AS area, any_value(a.p) AS p, any_value(a.amount) AS amount, any_value(a.y) AS y, any_value(a.h) AS h,
    any_value(a.expected) AS expected, any_value(a.gated) AS gated,
    count(*) FILTER (b.y AND abs(a."row" - b."row") <= 1 AND abs(a.col - b.col) <= 1) AS o3, count(*) FILTER (b.y) AS o5,
    count(*) FILTER (b.h AND abs(a."row" - b."row") <= 1 AND abs(a.col - b.col) <= 1) AS p3
  FROM f a JOIN f b ON a.year = b.year AND abs(a."row" - b."row") <= 2 AND abs(a.col - b.col) <= 2 GROUP BY 1, 2, 3),
k AS (
  SELECT *, (p >= 0.55 AND NOT y) OR (p < 0.3 AND y) AS wrong, y AND h AND amount - expected >= 45 AS shrunk, NOT y AND h AS fp, y AND NOT h AS fn,
    NOT y AND o3 > 0 AS adjacent, NOT y AND o3 = 0 AND o5 > 0 AS near, y AND o3 <= 1 AS alone, y AND o3 > 1 AND o3 < 9 AS rim, y AND o3 >= 9 AS inside FROM w)"""
_EDGE_SHARES = {
    "fp_isolated_predicted_positive": ("fp", "p3 <= 1"), "fp_predicted_edge": ("fp", "p3 > 1 AND p3 < 9"), "fp_predicted_interior": ("fp", "p3 >= 9"),
    "fp_adjacent_observed": ("fp", "adjacent"), "fp_near_observed": ("fp", "near"), "fp_far_from_observed": ("fp", "NOT (adjacent OR near)"),
    "fp_adjacent_or_near_positive": ("fp", "(adjacent OR near)"), "fn_isolated_positive": ("fn", "alone"), "fn_positive_edge": ("fn", "rim"),
    "fn_positive_edge_or_isolated": ("fn", "(alone OR rim)"), "fn_positive_interior": ("fn", "inside"), "composition_shrinkage_edge": ("(alone OR rim)", "shrunk"),
}


@query(
    "edge_effect_rows",
    _GRID + "\nSELECT year, count(*) AS row_count, count(*) FILTER (y) AS observed_positive_count, count(*) FILTER (fp) AS false_positive_count, count(*) FILTER (fn) AS false_negative_count, "
    + ", ".join(x for n, (a, b) in _EDGE_SHARES.items() for x in (f"count(*) FILTER ({a} AND {b}) AS {n}_count", _r(f"count(*) FILTER ({a} AND {b}) / nullif(count(*) FILTER ({a}), 0)", f"{n}_rate")))
    + """, count(*) FILTER (fp AND (adjacent OR near) AND wrong) AS high_confidence_fp_adjacent_or_near_count,
  count(*) FILTER (fn AND (alone OR rim) AND wrong) AS high_confidence_fn_edge_or_isolated_count, """
    + ", ".join(_r(f"avg(area - {c}) FILTER ({cond})", f"{n}_positive_{name}_mean_residual") for n, c in (("expected_value", "expected"), ("hard_gate", "gated")) for name, cond in (("edge", "alone OR rim"), ("interior", "inside")))
    + " FROM k GROUP BY 1",
)
def _(spark, d):
    amount = F.least(F.lit(900.0), F.col("predicted") * 900 + F.col("weight") * 50)
    cells = observations(spark, d).groupBy("year", "row", "col").agg((F.avg("observed") * 900).alias("area"), F.avg("predicted").alias("p"), F.avg(amount).alias("amount"))
    flagged = cells.withColumns({"observed": F.col("area") >= 450, "predicted": F.col("p") >= THRESHOLD})
    around = families.windows(flagged, ["year"], ["observed", "predicted"])
    y, h, p = F.col("observed"), F.col("predicted"), F.col("p")
    expected = p * F.col("amount")
    residuals = {"expected_value": F.col("area") - expected, "hard_gate": F.col("area") - F.when(h, F.col("amount")).otherwise(0.0)}
    wrong = ((p >= 0.55) & ~y) | ((p < 0.3) & y)
    measures = families.edge_measures(y, h, wrong, y & h & (F.col("amount") - expected >= 45), residuals)
    found = around.groupBy("year").agg(*[m.alias(n) for n, m in measures.items()])
    return _rounded(found)
