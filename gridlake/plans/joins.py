"""Checked joins, routing, context tables and comparisons."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridlake.functions import classify
from gridlake.operators import joins, labels
from gridlake.plans.base import P, Y, query
from gridlake.plans.binary import ROWS, rows
from gridlake.plans.labels import _TEMPORAL, annual
from gridlake.plans.masks import MASK, mask
from gridlake.sources.tables import observations, scan

_PLACES = ", pl AS (SELECT p_partkey AS id, -123 + (p_partkey % 100) * 0.02::DOUBLE AS lon, 36 + (p_partkey // 100) * 0.1::DOUBLE AS lat FROM part)"


def places(spark, d):
    key = F.col("p_partkey")
    return scan(spark, d, "part", "p_partkey").select(key.alias("id"), (-123 + (key % 100) * 0.02).alias("lon"), (36 + F.floor(key / 100) * 0.1).alias("lat"))


@query(
    "product_routing",
    _PLACES + """, gr AS (SELECT c_custkey // 40 AS r, c_custkey % 40 AS c, c_acctbal AS value FROM customer), rt AS (SELECT *, CASE WHEN lat < 37 THEN 'south' ELSE 'north' END AS product, CASE WHEN lat < 37 THEN lon BETWEEN -122.5 AND -121.2 AND lat BETWEEN 36.05 AND 37 ELSE lon BETWEEN -122.8 AND -121.4 AND lat BETWEEN 37 AND 37.65 END AS in_bounds,
 CAST(round_even((lon + 123) / 0.05, 0) AS BIGINT) AS gc FROM pl)
 SELECT product, CASE WHEN NOT in_bounds THEN 'outside_source_bounds' WHEN value IS NULL OR value < 0 THEN 'no_data' ELSE 'valid' END AS status, count(*) AS n, round(sum(CASE WHEN in_bounds AND value >= 0 THEN value END), 4) AS total FROM rt LEFT JOIN gr ON gr.r = CAST(round_even((lat - 36) / 0.05, 0) AS BIGINT) AND gr.c = rt.gc GROUP BY 1, 2""",
)
def _(spark, d):
    grid = scan(spark, d, "customer", "c_custkey", "c_acctbal").select(F.floor(F.col("c_custkey") / 40).alias("row"), (F.col("c_custkey") % 40).alias("col"), F.col("c_acctbal").alias("value"))
    met = joins.sampled_grid(joins.routed(places(spark, d), "lon", "lat", 37.0, ("south", -122.5, 36.05, -121.2, 37.0), ("north", -122.8, 37.0, -121.4, 37.65)), "lon", "lat", grid, -123.0, 36.0, 0.05)
    status = classify.chain([(~F.col("in_bounds"), "outside_source_bounds"), (F.col("value").isNull() | (F.col("value") < 0), "no_data")], "valid")
    return met.groupBy("product", status.alias("status")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.when(F.col("in_bounds") & (F.col("value") >= 0), F.col("value"))), 4).alias("total"))


_RING = [(-122.7, 36.1), (-121.9, 36.3), (-121.3, 36.9), (-121.8, 37.6), (-122.2, 37.0), (-122.6, 37.5)]
_CROSS = " + ".join(f"CASE WHEN ({y1} > lat) <> ({y2} > lat) AND lon < ({x2 - x1!r}) * (lat - {y1}) / ({y2 - y1!r}) + ({x1}) THEN 1 ELSE 0 END" for (x1, y1), (x2, y2) in zip(_RING, [*_RING[1:], _RING[0]], strict=True))


@query("footprint_points", _PLACES + f" SELECT id, lon, lat FROM (SELECT id, round(lon, 6) AS lon, round(lat, 6) AS lat, ({_CROSS}) % 2 = 1 AND lon BETWEEN -122.7 AND -121.3 AND lat BETWEEN 36.1 AND 37.6 AS inside FROM pl) WHERE inside")
def _(spark, d):
    given = places(spark, d)
    return given.where(joins.in_polygon(F.col("lon"), F.col("lat"), _RING)).select("id", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"))


_LOOKUP = ", lk AS (SELECT year, cell_id, avg(predicted) AS calibrated, max(observed) AS best FROM o GROUP BY 1, 2)"


@query("probability_lookup", _LOOKUP + " SELECT o.year, count(*) AS n, round(avg(calibrated), 6) AS mean_calibrated, count(*) FILTER (calibrated >= 0.4) AS likely_positive, round(avg(best - observed), 6) AS mean_gap FROM o JOIN lk ON lk.year = o.year AND lk.cell_id = o.cell_id GROUP BY 1")
def _(spark, d):
    rows_ = observations(spark, d)
    found = rows_.groupBy("year", "cell_id").agg(F.avg("predicted").alias("calibrated"), F.max("observed").alias("best"))
    joined = joins.one_to_one(rows_.select("year", "cell_id", "observed"), found, ["year", "cell_id"])
    return joined.groupBy("year").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("calibrated"), 6).alias("mean_calibrated"), F.count_if(F.col("calibrated") >= 0.4).alias("likely_positive"), F.round(F.avg(F.col("best") - F.col("observed")), 6).alias("mean_gap"))


@query("support_comparison", ", a AS (SELECT DISTINCT year, cell_id FROM o WHERE observed >= 0.5), b AS (SELECT DISTINCT year, cell_id FROM o WHERE predicted >= 0.4) SELECT *, missing = 0 AND extra = 0 AS sets_match FROM (SELECT (SELECT count(*) FROM a) AS base_count, (SELECT count(*) FROM b) AS other_count, (SELECT count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)) AS missing, (SELECT count(*) FROM (SELECT * FROM b EXCEPT SELECT * FROM a)) AS extra)")
def _(spark, d):
    given = observations(spark, d)
    return joins.support_difference(given.where(Y() >= 0.5), given.where(P() >= 0.4), ["year", "cell_id"])


@query(
    "context_tables",
    MASK + ROWS + """, cx AS (SELECT b.*, reason, depth_bin FROM b LEFT JOIN mk USING (cell_id)), ct AS (SELECT 'mask_reason' AS context_type, coalesce(reason, 'missing') AS context_value, * FROM cx UNION ALL SELECT 'depth_bin', coalesce(depth_bin, 'missing'), * FROM cx UNION ALL SELECT 'split', split, * FROM cx UNION ALL SELECT 'quarter', quarter::VARCHAR, * FROM cx)
 SELECT context_type, context_value, source, count(*) AS n, count(*) FILTER (y) AS positives, count(*) FILTER (y AND p >= 0.4) AS tp, round(avg(abs(p - observed)), 6) AS mae, round((sum(p) - sum(observed)) / nullif(sum(observed), 0), 6) AS area_bias FROM ct GROUP BY 1, 2, 3""",
)
def _(spark, d):
    given = rows(spark, d).join(mask(spark, d).select("cell_id", "reason", "depth_bin"), "cell_id", "left")
    each = joins.contexts(given, {"mask_reason": F.col("reason"), "depth_bin": F.col("depth_bin"), "split": F.col("split"), "quarter": F.col("quarter")}, ["source", "y", "p", "observed"])
    return each.groupBy("context_type", "context_value", "source").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("y").alias("positives"), F.count_if(F.col("y") & (F.col("p") >= 0.4)).alias("tp"),
        F.round(F.avg(F.abs(F.col("p") - F.col("observed"))), 6).alias("mae"), F.round(F.try_divide(F.sum("p") - F.sum("observed"), F.sum("observed")), 6).alias("area_bias"),
    )


@query("residual_by_persistence", _TEMPORAL + " SELECT persistence, seasonality, count(*) AS n, round(avg(predicted * 900 - observed * 900), 6) AS mean_residual, round(avg(abs(predicted * 900 - observed * 900)), 6) AS mae FROM o JOIN tc ON tc.station = o.cell_id AND tc.year = o.year GROUP BY 1, 2")
def _(spark, d):
    context = labels.temporal_context(annual(spark, d)).select(F.col("station").alias("cell_id"), "year", "persistence", "seasonality")
    joined = joins.one_to_one(observations(spark, d), context, ["year", "cell_id"])
    error = P() * 900 - Y() * 900
    return joined.groupBy("persistence", "seasonality").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(error), 6).alias("mean_residual"), F.round(F.avg(F.abs(error)), 6).alias("mae"))


@query("inspection_layers", ' SELECT cell_id, max(predicted) FILTER (source = \'A\') AS "A", max(predicted) FILTER (source = \'N\') AS "N", max(predicted) FILTER (source = \'R\') AS "R", max(predicted) AS max_score FROM o GROUP BY 1')
def _(spark, d):
    return joins.layers(observations(spark, d), "cell_id", "source", ["A", "N", "R"], "predicted")


@query(
    "threshold_recommendation",
    """, t AS (SELECT unnest([0.05::DOUBLE, 0.1::DOUBLE, 0.5::DOUBLE, 0.9::DOUBLE, 0.99::DOUBLE]) AS threshold), c AS (SELECT threshold, count(*) AS n, count(*) FILTER (observed >= threshold) AS positives, count(*) FILTER (observed >= threshold AND predicted >= threshold) AS tp, count(*) FILTER (observed < threshold AND predicted >= threshold) AS fp,
 count(*) FILTER (source = 'N') AS bg, count(*) FILTER (source = 'N' AND observed < threshold AND predicted >= threshold) AS bgfp FROM t, o WHERE year = 1997 GROUP BY 1), s AS (SELECT threshold, n, positives, CASE WHEN tp > 0 THEN 2.0::DOUBLE * tp / (tp + fp + positives) END AS f1, bgfp / nullif(bg, 0) AS background_rate, positives >= 100 AND positives / n >= 0.05 AS support_ok FROM c),
 k AS (SELECT *, row_number() OVER (ORDER BY support_ok DESC, positives > 0 DESC, threshold DESC) AS rank FROM s) SELECT threshold, n, positives, round(f1, 6) AS f1, round(background_rate, 6) AS background_rate, support_ok, rank, rank = 1 AND positives > 0 AS selected FROM k""",
)
def _(spark, d):
    t = F.col("threshold")
    each = observations(spark, d).where("year = 1997").withColumn("threshold", F.explode(F.array(*[F.lit(x) for x in (0.05, 0.1, 0.5, 0.9, 0.99)])))
    seen, hit, background = Y() >= t, P() >= t, F.col("source") == "N"
    counts = each.groupBy("threshold").agg(F.count(F.lit(1)).alias("n"), F.count_if(seen).alias("positives"), F.count_if(seen & hit).alias("tp"), F.count_if(~seen & hit).alias("fp"), F.count_if(background).alias("bg"), F.count_if(background & ~seen & hit).alias("bgfp"))
    f1 = F.when(F.col("tp") > 0, 2 * F.col("tp") / (F.col("tp") + F.col("fp") + F.col("positives")))
    found = joins.recommended(counts.select("threshold", "n", "positives", f1.alias("f1"), F.try_divide("bgfp", "bg").alias("background_rate")), 100, 0.05)
    return found.withColumns({c: F.round(c, 6) for c in ("f1", "background_rate")})


@query("source_differences", MASK + ", df AS (SELECT reason, elevation AS a, CASE WHEN p_size % 13 <> 0 THEN p_retailprice / 10 - 130 END AS b FROM mk JOIN part ON p_partkey = cell_id) SELECT reason, count(a - b) AS overlap, round(avg(a - b), 6) AS mean_difference, round(min(a - b), 6) AS min_difference, round(max(a - b), 6) AS max_difference, count(*) FILTER (a IS NOT NULL AND b IS NOT NULL AND (a < 0) <> (b < 0)) AS sign_disagreement FROM df GROUP BY 1")
def _(spark, d):
    other = scan(spark, d, "part", "p_partkey", "p_size", "p_retailprice").select(F.col("p_partkey").alias("cell_id"), F.when(F.col("p_size") % 13 != 0, F.col("p_retailprice") / 10 - 130).alias("other"))
    found = joins.source_difference(mask(spark, d).join(other, "cell_id"), ["reason"], "elevation", "other")
    return found.withColumns({c: F.round(c, 6) for c in ("mean_difference", "min_difference", "max_difference")})


@query("robust_scales", " SELECT source, quarter, round(greatest(0.1::DOUBLE, least(0.6::DOUBLE, quantile_cont(predicted, 0.98))), 6) AS cap FROM o GROUP BY 1, 2")
def _(spark, d):
    return joins.robust_scale(observations(spark, d), ["source", "quarter"], "predicted", 0.98, 0.1, 0.6).withColumn("cap", F.round("cap", 6))


@query("likely_positive_summary", ROWS + " SELECT split, year, source, count(*) AS n, count(*) FILTER (p >= 0.4) AS likely, round(count(*) FILTER (p >= 0.4) / count(*), 6) AS likely_rate, count(*) FILTER (p >= 0.4) * 900.0::DOUBLE AS likely_area, count(*) FILTER (y) AS observed_positive FROM b GROUP BY 1, 2, 3")
def _(spark, d):
    n, likely = F.count(F.lit(1)), F.count_if(F.col("p") >= 0.4)
    return rows(spark, d).groupBy("split", "year", "source").agg(n.alias("n"), likely.alias("likely"), F.round(likely / n, 6).alias("likely_rate"), (likely * 900.0).alias("likely_area"), F.count_if("y").alias("observed_positive"))


_MODELS = ["train_mean", "raw", "damped"]


@query(
    "model_comparison",
    ROWS + """, tm AS (SELECT avg(observed) AS m FROM b WHERE split = 'train'), al AS (SELECT 'train_mean' AS model, split, observed, m AS f FROM b, tm UNION ALL SELECT 'raw', split, observed, p FROM b UNION ALL SELECT 'damped', split, observed, 0.5 * p + 0.25 FROM b)
 SELECT model, CASE model WHEN 'train_mean' THEN 1 WHEN 'raw' THEN 2 ELSE 3 END AS model_order, split, count(*) AS n, round(avg(abs(f - observed)), 6) AS mae, round(sqrt(avg((f - observed) ** 2)), 6) AS rmse, count(*) FILTER (f >= 0.4 AND observed >= 0.5) AS tp, count(*) FILTER (f >= 0.4 AND observed < 0.5) AS fp FROM al GROUP BY 1, 2, 3""",
)
def _(spark, d):
    given = rows(spark, d)
    mean = F.broadcast(given.where("split = 'train'").agg(F.avg("observed").alias("m")))  # one row
    frames = [given.join(mean).select(F.lit("train_mean").alias("model"), "split", "observed", F.col("m").alias("f")), given.select(F.lit("raw").alias("model"), "split", "observed", F.col("p").alias("f")), given.select(F.lit("damped").alias("model"), "split", "observed", (0.5 * F.col("p") + 0.25).alias("f"))]
    every = frames[0].unionByName(frames[1]).unionByName(frames[2])
    error = F.col("f") - F.col("observed")
    return every.groupBy("model", joins.rank_in("model", _MODELS).alias("model_order"), "split").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(F.abs(error)), 6).alias("mae"), F.round(F.sqrt(F.avg(error * error)), 6).alias("rmse"),
        F.count_if((F.col("f") >= 0.4) & (F.col("observed") >= 0.5)).alias("tp"), F.count_if((F.col("f") >= 0.4) & (F.col("observed") < 0.5)).alias("fp"),
    )


@query("projection_sample", " SELECT vec_id, label FROM embeddings ORDER BY (vec_id * 2654435761 + 12345) % 4294967296, vec_id LIMIT 300")
def _(spark, d):
    return joins.hashed_sample(scan(spark, d, "embeddings", "vec_id", "label"), "vec_id", 300)
