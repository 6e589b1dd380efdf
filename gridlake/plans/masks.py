"""The domain mask and what it is applied to; cells are parts, their elevations follow from part sizes."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridlake.functions import classify
from gridlake.operators import masks, sampling
from gridlake.plans.base import SPLITS, P, Y, query
from gridlake.sources.tables import observations, scan

#: Elevations from -146 to 54 m; every seventeenth size has no valid value.
MASK = """, m0 AS (SELECT p_partkey AS cell_id, CASE WHEN p_size % 17 <> 0 THEN p_size * 4.0::DOUBLE - 150 END AS elevation, CASE WHEN p_size % 17 <> 0 THEN greatest(150 - p_size * 4.0::DOUBLE, 0) END AS depth, CASE WHEN p_size % 17 = 0 THEN 'no_data' ELSE 'valid' END AS status FROM part),
 mk AS (SELECT *, CASE WHEN status <> 'valid' THEN 'qa_missing_crm' WHEN elevation BETWEEN -5 AND 5 THEN 'retained_ambiguous_coast' WHEN elevation > 5 THEN 'dropped_definite_land' WHEN depth > 60 THEN 'dropped_deep_water' ELSE 'retained_depth_0_60m' END AS reason,
 NOT (status = 'valid' AND (elevation > 5 OR (elevation < -5 AND depth > 60))) AS plausible,
 CASE WHEN status <> 'valid' THEN 'qa_missing_crm' WHEN elevation BETWEEN -5 AND 5 THEN 'ambiguous_coast' WHEN elevation > 5 THEN 'land_positive' WHEN depth <= 40 THEN '0_40m' WHEN depth > 60 THEN '60m_plus' ELSE '40_60m' END AS depth_bin,
 CASE WHEN status <> 'valid' THEN 'qa_missing_crm' WHEN elevation BETWEEN -5 AND 5 THEN 'ambiguous_coast' WHEN elevation > 5 THEN 'definite_land' ELSE 'subtidal_ocean' END AS elevation_bin FROM m0)"""


def mask(spark, d):
    size = F.col("p_size")
    rows = scan(spark, d, "part", "p_partkey", "p_size").select(F.col("p_partkey").alias("cell_id"), F.when(size % 17 != 0, size * 4.0 - 150).alias("elevation"), F.when(size % 17 != 0, F.greatest(150 - size * 4.0, F.lit(0.0))).alias("depth"), F.when(size % 17 == 0, "no_data").otherwise("valid").alias("status"))
    return rows.withColumns(masks.domain_mask(F.col("elevation"), F.col("depth"), F.col("status"), max_depth=60.0))


@query("domain_mask", MASK + " SELECT * FROM mk")
def _(spark, d):
    return mask(spark, d)


@query("mask_coverage", MASK + " SELECT reason, plausible, count(*) AS cells, round(count(*) / (SELECT count(*) FROM mk), 6) AS share FROM mk GROUP BY 1, 2")
def _(spark, d):
    return masks.coverage(mask(spark, d))


@query(
    "mask_retention",
    MASK + """ SELECT year, source, count(*) AS positives, count(*) FILTER (plausible) AS retained, count(*) FILTER (NOT plausible) AS dropped, count(*) FILTER (plausible IS NULL) AS mask_missing,
 round(count(*) FILTER (plausible) / count(*), 6) AS retained_share FROM o LEFT JOIN mk USING (cell_id) WHERE observed >= 0.1 GROUP BY 1, 2""",
)
def _(spark, d):
    return masks.retention(observations(spark, d).where(Y() >= 0.1), mask(spark, d), "cell_id")


@query("depth_bin_summary", MASK + ", h AS (SELECT cell_id, count(*) AS hits FROM o WHERE observed >= 0.9 GROUP BY 1) SELECT depth_bin, count(*) AS cells, CAST(coalesce(sum(hits), 0) AS BIGINT) AS positives, count(hits) AS cells_with_positives FROM mk LEFT JOIN h USING (cell_id) GROUP BY 1")
def _(spark, d):
    return masks.depth_summary(mask(spark, d), observations(spark, d).where(Y() >= 0.9), "cell_id")


@query("reporting_domain", MASK + " SELECT year, reason, depth_bin, count(*) AS n, round(sum(predicted), 4) AS predicted_area FROM o JOIN mk USING (cell_id) WHERE plausible GROUP BY 1, 2, 3")
def _(spark, d):
    inside = masks.apply_mask(observations(spark, d), mask(spark, d).select("cell_id", "plausible", "reason", "depth_bin"), "cell_id")
    return inside.groupBy("year", "reason", "depth_bin").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(P()), 4).alias("predicted_area"))


@query("off_domain_audit", MASK + " SELECT year, reason, count(*) AS n, round(sum(predicted), 4) AS predicted_area, round(sum(observed), 4) AS observed_area, count(*) FILTER (predicted >= 0.4) AS predicted_positive FROM o JOIN mk USING (cell_id) WHERE NOT plausible GROUP BY 1, 2")
def _(spark, d):
    rows = observations(spark, d).join(mask(spark, d).where("NOT plausible").select("cell_id", "reason"), "cell_id")
    return rows.groupBy("year", "reason").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(P()), 4).alias("predicted_area"), F.round(F.sum(Y()), 4).alias("observed_area"), F.count_if(P() >= 0.4).alias("predicted_positive"))


_SAMPLE = MASK + """, sc AS (SELECT DISTINCT year, cell_id, reason, depth_bin, source = 'R' AS seen FROM o JOIN mk USING (cell_id) WHERE plausible),
 sr AS (SELECT *, ((((cell_id % 4294967296) * 1103515245) % 4294967296 + 7 + year * 2654435761) % 4294967296) / 4294967296.0::DOUBLE AS score FROM sc WHERE NOT seen),
 sk AS (SELECT *, row_number() OVER (PARTITION BY year, reason, depth_bin ORDER BY score, cell_id) AS k, count(*) OVER (PARTITION BY year, reason, depth_bin) AS population FROM sr),
 sq AS (SELECT *, least(population, CASE WHEN reason = 'retained_ambiguous_coast' THEN greatest(ceil(population * 0.5::DOUBLE), 1) WHEN depth_bin = '40_60m' THEN least(greatest(ceil(population * 0.1::DOUBLE), 1), 500) ELSE greatest(ceil(population * 0.2::DOUBLE), 5) END) AS quota FROM sk),
 sm AS (SELECT year, cell_id, reason, depth_bin, seen, round(population::DOUBLE / quota, 6) AS weight FROM sq WHERE k <= quota UNION ALL SELECT year, cell_id, reason, depth_bin, seen, 1.0::DOUBLE FROM sc WHERE seen)"""


def _population(spark, d):
    cells = masks.apply_mask(observations(spark, d), mask(spark, d).select("cell_id", "plausible", "reason", "depth_bin"), "cell_id")
    return cells.select("year", "cell_id", "reason", "depth_bin", (F.col("source") == "R").alias("seen")).distinct()


def _sample(population):
    quotas = [(F.col("reason") == masks.COAST, 0.5, 1, None), (F.col("depth_bin") == "40_60m", 0.1, 1, 500)]
    score = classify.year_score(F.col("cell_id"), F.col("year"), 7)
    return sampling.quota_sample(population, F.col("seen"), ["year", "reason", "depth_bin"], "cell_id", score, quotas, (0.2, 5, None)).withColumn("weight", F.round("weight", 6))


@query("masked_sample", _SAMPLE + " SELECT * FROM sm")
def _(spark, d):
    return _sample(_population(spark, d))


@query(
    "masked_sample_summary",
    _SAMPLE + """, sp AS (SELECT year, reason, depth_bin, count(*) AS population FROM sc GROUP BY 1, 2, 3), st AS (SELECT year, reason, depth_bin, count(*) AS sampled, min(weight) AS min_weight, max(weight) AS max_weight FROM sm GROUP BY 1, 2, 3)
 SELECT year, reason, depth_bin, population, coalesce(sampled, 0) AS sampled, min_weight, max_weight, population - coalesce(sampled, 0) AS dropped FROM sp LEFT JOIN st USING (year, reason, depth_bin)""",
)
def _(spark, d):
    population = _population(spark, d)
    return sampling.stratum_summary(population, _sample(population), ["year", "reason", "depth_bin"])


@query(
    "sample_features",
    _SAMPLE + " SELECT sm.year, sm.cell_id, sm.weight, count(*) AS n, round(avg(o.observed), 12) AS mean_observed, round(avg(o.predicted), 12) AS mean_predicted FROM sm JOIN o ON o.year = sm.year AND o.cell_id = sm.cell_id WHERE sm.depth_bin = '40_60m' GROUP BY 1, 2, 3",
)
def _(spark, d):
    chosen = _sample(_population(spark, d)).where("depth_bin = '40_60m'").select("year", "cell_id", "weight")
    joined = observations(spark, d).drop("weight").join(chosen, ["year", "cell_id"])
    return joined.groupBy("year", "cell_id", "weight").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(Y()), 12).alias("mean_observed"), F.round(F.avg(P()), 12).alias("mean_predicted"))


@query(
    "split_manifest",
    """, mf AS (SELECT DISTINCT year, cell_id, CASE WHEN cell_id % 5 = 0 THEN 'test' ELSE 'train' END AS split, cell_id % 7 <> 0 AS used FROM o WHERE cell_id % 2 = 0)
 SELECT coalesce(mf.split, CASE WHEN year BETWEEN 1992 AND 1996 THEN 'train' WHEN year = 1997 THEN 'validation' WHEN year = 1998 THEN 'test' END) AS split, coalesce(used, true) AS used, count(*) AS n FROM o LEFT JOIN mf USING (year, cell_id) GROUP BY 1, 2""",
)
def _(spark, d):
    rows, cell = observations(spark, d), F.col("cell_id")
    manifest = rows.where(cell % 2 == 0).select("year", "cell_id", F.when(cell % 5 == 0, "test").otherwise("train").alias("split"), (cell % 7 != 0).alias("used")).distinct()
    return masks.attach_split(rows, manifest, ["year", "cell_id"], SPLITS).groupBy("split", "used").agg(F.count(F.lit(1)).alias("n"))


@query("grid_counts", MASK + " SELECT year, source, count(*) AS n, count(elevation) AS complete, count(*) - count(elevation) AS missing, count(DISTINCT cell_id) AS cells, round(sum(observed), 4) AS area FROM o LEFT JOIN mk USING (cell_id) GROUP BY 1, 2")
def _(spark, d):
    rows = observations(spark, d).join(mask(spark, d).select("cell_id", "elevation"), "cell_id", "left")
    n, full = F.count(F.lit(1)), F.count_if(classify.complete("elevation"))
    return rows.groupBy("year", "source").agg(n.alias("n"), full.alias("complete"), (n - full).alias("missing"), F.countDistinct("cell_id").alias("cells"), F.round(F.sum(Y()), 4).alias("area"))


@query(
    "coast_depth_contexts",
    MASK + """ SELECT CASE WHEN reason LIKE '%ambiguous%' THEN 'ambiguous_coast' WHEN depth > 0 THEN 'subtidal_ocean' WHEN elevation > 0 THEN 'landward_or_intertidal' ELSE 'missing_depth_context' END AS context,
 CASE WHEN depth IS NULL THEN 'missing_depth' WHEN depth <= 0 THEN 'not_subtidal_or_zero' WHEN depth <= 10 THEN '(0, 10m]' WHEN depth <= 20 THEN '(10, 20m]' WHEN depth <= 40 THEN '(20, 40m]' WHEN depth <= 60 THEN '(40, 60m]' ELSE '>60m' END AS depth_value_bin,
 count(*) AS cells, min(elevation) AS min_elevation, max(elevation) AS max_elevation FROM mk GROUP BY 1, 2""",
)
def _(spark, d):
    named = classify.coast_depth(F.col("reason"), F.col("depth"), F.col("elevation")).alias("context")
    return mask(spark, d).groupBy(named, classify.depth_bins(F.col("depth")).alias("depth_value_bin")).agg(F.count(F.lit(1)).alias("cells"), F.min("elevation").alias("min_elevation"), F.max("elevation").alias("max_elevation"))
