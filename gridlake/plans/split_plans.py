"""Splits from a manifest, the target region's policy, climatology by training years."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridlake.operators import splits
from gridlake.plans.base import query
from gridlake.sources.tables import observations

YEARS = {"train": list(range(1992, 1997)), "validation": [1997], "test": list(range(1998, 2003))}
_BY_YEAR = "CASE WHEN year BETWEEN 1992 AND 1996 THEN 'train' WHEN year = 1997 THEN 'validation' ELSE 'test' END"
#: Parts of an even number are in the manifest, with exact copies.
_MANIFEST = """, mf AS (
  SELECT DISTINCT year, cell_id, CASE WHEN cell_id % 5 = 0 THEN 'test' WHEN year < 1996 THEN 'train' ELSE 'validation' END AS split, cell_id % 7 <> 0 AS used,
    CASE WHEN cell_id % 7 = 0 THEN 'missing_features' ELSE '' END AS drop_reason
  FROM o WHERE cell_id % 2 = 0)"""
_KEYS = [["source", "year", "cell_id"], ["year", "cell_id"]]


def _members(spark, d):
    rows, cell = observations(spark, d), F.col("cell_id")
    split = F.when(cell % 5 == 0, "test").when(F.col("year") < 1996, "train").otherwise("validation")
    reason = F.when(cell % 7 == 0, "missing_features").otherwise("")
    manifest = rows.where(cell % 2 == 0).select("year", "cell_id", split.alias("split"), (cell % 7 != 0).alias("used"), reason.alias("drop_reason"))
    return splits.attach(rows, manifest, _KEYS, YEARS, allow_missing=True)


@query(
    "split_membership",
    _MANIFEST + f"""
SELECT coalesce(mf.split, {_BY_YEAR}) AS split, coalesce(used, true) AS used, coalesce(drop_reason, 'year_split_fallback') AS drop_reason, count(*) AS n
FROM o LEFT JOIN mf USING (year, cell_id) GROUP BY 1, 2, 3""",
)
def _(spark, d):
    return _members(spark, d).groupBy("split", "used", "drop_reason").agg(F.count(F.lit(1)).alias("n"))


@query(
    "target_region_policy",
    _MANIFEST + f"""
, j AS (
  SELECT o.source, coalesce(mf.split, {_BY_YEAR}) AS split, coalesce(used, true) AS used, coalesce(drop_reason, 'year_split_fallback') AS reason
  FROM o LEFT JOIN mf USING (year, cell_id)),
k AS (SELECT *, split <> 'train' AND source <> 'R' AS other FROM j)
SELECT source, split, used AND NOT other AS used, concat_ws(';', nullif(reason, ''), CASE WHEN other THEN 'non_target_region_eval' END) AS drop_reason, count(*) AS n
FROM k GROUP BY ALL""",
)
def _(spark, d):
    kept = splits.only_target_region(_members(spark, d), "source", "R")
    return kept.groupBy("source", "split", "used", "drop_reason").agg(F.count(F.lit(1)).alias("n"))


@query(
    "climatology_fallbacks",
    """, c AS (SELECT cell_id, year, min(source) AS source, avg(observed) AS v FROM o GROUP BY 1, 2),
tr AS (SELECT *, row_number() OVER () AS r FROM c WHERE year BETWEEN 1992 AND 1994),
s AS (SELECT cell_id, sum(v) AS s, count(*) AS n FROM tr GROUP BY 1),
q AS (SELECT source, avg(v) AS m FROM tr GROUP BY 1),
p AS (
  SELECT c.year, c.v, q.m, c.year BETWEEN 1992 AND 1994 AS train, (SELECT avg(v) FROM tr) AS g,
    CASE WHEN c.year BETWEEN 1992 AND 1994 THEN (s.s - c.v) / nullif(s.n - 1, 0) ELSE s.s / s.n END AS cell
  FROM c LEFT JOIN s USING (cell_id) LEFT JOIN q USING (source))
SELECT year, CASE WHEN cell IS NOT NULL AND train THEN 'cell_training_mean_leave_one_year_out' WHEN cell IS NOT NULL THEN 'cell_training_mean'
  WHEN m IS NOT NULL THEN 'label_source_training_mean' ELSE 'global_training_mean' END AS reason, count(*) AS n, round(avg(abs(v - coalesce(cell, m, g))), 6) AS mae
FROM p GROUP BY 1, 2""",
)
def _(spark, d):
    yearly = observations(spark, d).groupBy("cell_id", "year").agg(F.min("source").alias("source"), F.avg("observed").alias("v"))
    rows = splits.climatology(yearly, ["cell_id"], "source", "v", F.col("year").between(1992, 1994))
    return rows.groupBy("year", "reason").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.abs(F.col("v") - F.col("prediction"))), 6).alias("mae"))
