"""Comparisons of surfaces, regions and regimes, coverage of sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridlake.functions import classify
from gridlake.operators import binary, metrics
from gridlake.plans.base import P, Y, query
from gridlake.plans.binary import ROWS, rows
from gridlake.plans.diagnostics import FRAME, frame
from gridlake.plans.masks import MASK, mask
from gridlake.sources.tables import observations, scan


@query("feature_label_groups", FRAME + " SELECT source, CASE WHEN area = 0 THEN 'zero' WHEN area >= 900 THEN 'saturated_900' WHEN area >= 450 THEN 'high_canopy' ELSE 'positive_low_mid' END AS label_group, count(*) AS n, round(avg(p), 6) AS mean_p, round(avg(residual), 6) AS mean_residual FROM e GROUP BY 1, 2")
def _(spark, d):
    group = classify.feature_label_group(F.col("area")).alias("label_group")
    return frame(spark, d).groupBy("source", group).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("p"), 6).alias("mean_p"), F.round(F.avg("residual"), 6).alias("mean_residual"))


@query(
    "layer_contexts",
    MASK + """ SELECT 'pooled' AS training_regime, 'north' AS evaluation_region, coalesce(reason, 'unknown') AS reason, coalesce(depth_bin, 'unknown') AS depth_bin, 'unknown' AS label_source, false AS is_observed, 'unknown' AS mask_status, 'unknown' AS evaluation_scope,
 CASE WHEN observed >= 0.1 AND predicted >= 0.4 THEN 'TP' WHEN predicted >= 0.4 THEN 'FP' WHEN observed >= 0.1 THEN 'FN' ELSE 'TN' END AS outcome, count(*) AS n FROM o LEFT JOIN mk USING (cell_id) GROUP BY ALL""",
)
def _(spark, d):
    layer = observations(spark, d).join(mask(spark, d).select("cell_id", "reason", "depth_bin"), "cell_id", "left").fillna("unknown", ["reason", "depth_bin"])
    layer = layer.withColumns(classify.context_columns(layer.columns, {"training_regime": "pooled", "evaluation_region": "north"}))
    keys = ["training_regime", "evaluation_region", *classify.CONTEXT_DEFAULTS]
    return layer.groupBy(*keys, classify.outcome(Y() >= 0.1, P() >= 0.4).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "transfer_metrics",
    """, fz AS (SELECT regr_slope(observed, predicted) AS b, regr_intercept(observed, predicted) AS a FROM o WHERE source = 'A' AND year <= 1996), f AS (SELECT source, observed, greatest(0, least(1, a + b * predicted)) AS f FROM o, fz WHERE year > 1996)
 SELECT 'frozen_A' AS training_regime, 'A' AS model_origin, source AS evaluation_region, source <> 'A' AS transfer, count(*) AS n, round(avg(abs(f - observed)), 6) AS mae, round(sqrt(avg((f - observed) ** 2)), 6) AS rmse, round(100 * (sum(f) - sum(observed)) / sum(observed), 6) AS percent_bias, count(*) FILTER (f >= 0.5 AND observed >= 0.5) AS tp, count(*) FILTER (f >= 0.5 AND observed < 0.5) AS fp FROM f GROUP BY source""",
)
def _(spark, d):
    given = observations(spark, d)
    frozen = F.broadcast(given.where("source = 'A' AND year <= 1996").agg(F.regr_slope("observed", "predicted").alias("b"), F.regr_intercept("observed", "predicted").alias("a")))  # one row
    scored = given.where("year > 1996").join(frozen).withColumn("f", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("a") + F.col("b") * P())))
    f, error = F.col("f"), F.col("f") - Y()
    found = scored.groupBy(F.col("source").alias("evaluation_region")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(F.abs(error)), 6).alias("mae"), F.round(F.sqrt(F.avg(error * error)), 6).alias("rmse"), F.round(100 * (F.sum(f) - F.sum(Y())) / F.sum(Y()), 6).alias("percent_bias"),
        F.count_if((f >= 0.5) & (Y() >= 0.5)).alias("tp"), F.count_if((f >= 0.5) & (Y() < 0.5)).alias("fp"),
    )
    return found.select("*", F.lit("frozen_A").alias("training_regime"), F.lit("A").alias("model_origin"), (F.col("evaluation_region") != "A").alias("transfer"))


@query(
    "conditional_comparison",
    FRAME + """, c AS (SELECT year, area, amount, expected FROM e WHERE area >= 90) SELECT year, count(*) AS n, round(avg(abs(area - amount)), 6) AS conditional_mae, round(avg(abs(area - expected)), 6) AS expected_mae, round(sqrt(avg((area - amount) ** 2)), 6) AS conditional_rmse, round(sqrt(avg((area - expected) ** 2)), 6) AS expected_rmse,
 round((sum(amount) - sum(area)) / sum(area), 6) AS conditional_bias, round((sum(expected) - sum(area)) / sum(area), 6) AS expected_bias, count(*) FILTER (abs(area - amount) < abs(area - expected)) AS conditional_nearer FROM c GROUP BY 1""",
)
def _(spark, d):
    area = F.col("area")
    mae = lambda c: F.round(F.avg(F.abs(area - F.col(c))), 6)
    rmse = lambda c: F.round(F.sqrt(F.avg((area - F.col(c)) * (area - F.col(c)))), 6)
    bias = lambda c: F.round((F.sum(c) - F.sum("area")) / F.sum("area"), 6)
    return frame(spark, d).where(area >= 90).groupBy("year").agg(
        F.count(F.lit(1)).alias("n"), mae("amount").alias("conditional_mae"), mae("expected").alias("expected_mae"), rmse("amount").alias("conditional_rmse"), rmse("expected").alias("expected_rmse"),
        bias("amount").alias("conditional_bias"), bias("expected").alias("expected_bias"), F.count_if(F.abs(area - F.col("amount")) < F.abs(area - F.col("expected"))).alias("conditional_nearer"),
    )


@query(
    "combined_support",
    ROWS + """, s AS (SELECT source, split, count(*) AS n, count(*) FILTER (y AND p >= 0.4) AS tp, count(*) FILTER (NOT y AND p >= 0.4) AS fp, count(*) FILTER (y AND p < 0.4) AS fn, avg(p) AS mean_p, sqrt(avg((p - observed) ** 2)) AS rmse FROM b GROUP BY 1, 2),
 a AS (SELECT source, split, n, tp, fp, fn, mean_p, rmse FROM s UNION ALL SELECT 'combined', split, CAST(sum(n) AS BIGINT), CAST(sum(tp) AS BIGINT), CAST(sum(fp) AS BIGINT), CAST(sum(fn) AS BIGINT), sum(n * mean_p) / sum(n), sqrt(sum(n * rmse ** 2) / sum(n)) FROM s GROUP BY split)
 SELECT source, split, n, tp, fp, fn, round(mean_p, 6) AS mean_p, round(rmse, 6) AS rmse, round(tp / nullif(tp + fp, 0), 6) AS "precision", round(tp / nullif(tp + fn, 0), 6) AS recall, round(CASE WHEN tp > 0 THEN 2.0 * tp / (2 * tp + fp + fn) END, 6) AS f1 FROM a""",
)
def _(spark, d):
    hit, error = F.col("p") >= 0.4, F.col("p") - Y()
    parts = rows(spark, d).groupBy("source", "split").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("y") & hit).alias("tp"), F.count_if(~F.col("y") & hit).alias("fp"), F.count_if(F.col("y") & ~hit).alias("fn"), F.avg("p").alias("mean_p"), F.sqrt(F.avg(error * error)).alias("rmse")
    )
    # The combined rows come from the parts' counts and means, not from the rows again.
    counts = parts.groupBy("split").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    pooled = metrics.combined(parts, ["split"], "n", ["mean_p"], ["rmse"]).join(counts, "split").withColumn("source", F.lit("combined"))
    every = parts.unionByName(pooled)
    precision, recall = F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), F.try_divide(F.col("tp"), F.col("tp") + F.col("fn"))
    every = every.select("*", precision.alias("precision"), recall.alias("recall"), binary.f1_of(precision, recall).alias("f1"))
    return every.withColumns({c: F.round(c, 6) for c in ("mean_p", "rmse", "precision", "recall", "f1")})


@query(
    "source_coverage",
    """, ex AS (SELECT s.source, y.year FROM (VALUES ('A'), ('N'), ('R')) s(source), range(1994, 2003) y(year)), pr AS (SELECT source, year, count(*) AS n, count(DISTINCT cell_id) AS cells FROM o GROUP BY 1, 2)
 SELECT ex.source, count(*) AS expected_years, count(n) AS years, CAST(coalesce(sum(n), 0) AS BIGINT) AS n, coalesce(max(cells), 0) AS most_cells, coalesce(string_agg(CASE WHEN n IS NULL THEN ex.year::VARCHAR END, ',' ORDER BY ex.year), '') AS missing_years FROM ex LEFT JOIN pr ON pr.source = ex.source AND pr.year = ex.year GROUP BY 1""",
)
def _(spark, d):
    years = F.explode(F.sequence(F.lit(1994), F.lit(2002))).alias("year")
    expected = spark.range(1).select(F.explode(F.array(*map(F.lit, "ANR"))).alias("source")).select("source", years)
    present = observations(spark, d).groupBy("source", "year").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("cell_id").alias("cells"))
    missing = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("n").isNull(), F.col("year")))), lambda y: y.cast("string")), ",")
    return expected.join(present, ["source", "year"], "left").groupBy("source").agg(
        F.count(F.lit(1)).alias("expected_years"), F.count("n").alias("years"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.max("cells"), F.lit(0)).alias("most_cells"), missing.alias("missing_years")
    )


@query(
    "best_overlap",
    """, t AS (SELECT p_partkey AS item, 1995 + p_size % 5 AS year, p_retailprice % 10 AS west, p_size % 7 + 0.5::DOUBLE AS south, p_retailprice % 10 + 2 + p_size % 3 AS east, p_size % 7 + 3.5::DOUBLE AS north FROM part),
 v AS (SELECT item, year, greatest(0, least(east, 8) - greatest(west, 3)) * greatest(0, least(north, 7) - greatest(south, 2)) AS overlap FROM t) SELECT year, item, round(overlap, 6) AS overlap, round(overlap / 25, 6) AS share FROM v WHERE overlap / 25 >= 0.2 QUALIFY row_number() OVER (PARTITION BY year ORDER BY overlap DESC, item) = 1""",
)
def _(spark, d):
    """Of catalogue boxes that cover enough of a footprint, the one that covers most of it in each year."""
    size, price = F.col("p_size"), F.col("p_retailprice")
    boxes = scan(spark, d, "part", "p_partkey", "p_size", "p_retailprice").select(F.col("p_partkey").alias("item"), (1995 + size % 5).alias("year"), (price % 10).alias("west"), (size % 7 + 0.5).alias("south"), (price % 10 + 2 + size % 3).alias("east"), (size % 7 + 3.5).alias("north"))
    width = F.greatest(F.lit(0.0), F.least(F.col("east"), F.lit(8.0)) - F.greatest(F.col("west"), F.lit(3.0)))
    height = F.greatest(F.lit(0.0), F.least(F.col("north"), F.lit(7.0)) - F.greatest(F.col("south"), F.lit(2.0)))
    met = boxes.select("item", "year", (width * height).alias("overlap")).where(F.col("overlap") / 25 >= 0.2)
    best = met.groupBy("year").agg(F.max_by(F.struct("item", "overlap"), F.struct("overlap", -F.col("item"))).alias("r"))
    return best.select("year", F.col("r.item").alias("item"), F.round("r.overlap", 6).alias("overlap"), F.round(F.col("r.overlap") / 25, 6).alias("share"))


@query("latest_product", " SELECT p_brand AS tile, p_partkey AS product, p_size AS published FROM part WHERE p_retailprice >= 950 QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_retailprice DESC, p_partkey DESC) = 1")
def _(spark, d):
    """Of the products of a tile that a query box meets, the latest: by publication, then update, then key."""
    rows_ = scan(spark, d, "part", "p_brand", "p_partkey", "p_size", "p_retailprice").where("p_retailprice >= 950")
    best = rows_.groupBy(F.col("p_brand").alias("tile")).agg(F.max(F.struct("p_size", "p_retailprice", "p_partkey")).alias("r"))
    return best.select("tile", F.col("r.p_partkey").alias("product"), F.col("r.p_size").alias("published"))
