"""What goes through storage: mergeable metric states, partitioned tables, CSV and JSON, each written and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridlake.functions import classify
from gridlake.operators import metric_state
from gridlake.plans.base import query
from gridlake.sources.tables import (
    LINEITEM,
    conform,
    new_folder,
    observations,
    observed_rows,
    read_csv,
    read_manifest,
    read_parts,
    replace_parts,
    saved,
    stream_of,
    write_csv,
    write_manifest,
    write_parts,
)

KEYS = ["year", "label_source"]
_STATE = """
, s AS (
  SELECT year, CASE WHEN source = 'N' THEN 'assumed_background' ELSE 'observed' END AS label_source, observed AS y, predicted AS p, observed * 900 AS a, predicted * 900 AS g
  FROM o),
m AS (
  SELECT year, label_source, count(*) AS n, count(*) FILTER (y >= 0.1) AS pos, count(*) FILTER (p >= 0.1) AS said, count(*) FILTER (y >= 0.1 AND p >= 0.1) AS tp,
    count(*) FILTER (label_source = 'assumed_background') AS bg, sum(y) AS sy, sum(y * y) AS syy, sum((y - p) ** 2) AS see, avg(y) AS my, avg(p) AS mp,
    sum(a) AS sa, sum(g) AS sg, avg(abs(y - p)) AS mae, sqrt(avg((y - p) ** 2)) AS rmse, avg(abs(a - g)) AS amae, sqrt(avg((a - g) ** 2)) AS armse,
    count(*) FILTER (label_source = 'assumed_background' AND p >= 0.1) AS bgp, sum(CASE WHEN label_source = 'assumed_background' THEN g ELSE 0 END) AS bga,
    max(CASE WHEN label_source = 'assumed_background' THEN g ELSE 0 END) AS bgm, count(*) FILTER (y >= 0.5) AS hi, avg(a - g) FILTER (y >= 0.5) AS hires
  FROM s GROUP BY 1, 2)
SELECT year, label_source, n AS row_count, round(my, 6) AS observed_mean, round(mp, 6) AS predicted_mean, round(sa, 6) AS observed_area, round(sg, 6) AS predicted_area,
  round(sg - sa, 6) AS area_bias, round(100 * (sg - sa) / nullif(sa, 0), 6) AS area_percent_bias, round(mae, 6) AS mae, round(rmse, 6) AS rmse, round(amae, 6) AS area_mae,
  round(armse, 6) AS area_rmse, round(CASE WHEN syy - sy * sy / n > 0 THEN 1 - see / (syy - sy * sy / n) END, 6) AS r2, pos AS positives, said AS predicted_positives,
  round(tp / nullif(said, 0), 6) AS "precision", round(tp / nullif(pos, 0), 6) AS recall, round(CASE WHEN tp > 0 THEN 2.0::DOUBLE * tp / (pos + said) END, 6) AS f1,
  bg AS background_rows, round(bgp / nullif(bg, 0), 6) AS background_positive_rate, round(bga, 6) AS background_predicted_area,
  round(bgm, 6) AS background_predicted_area_max, hi AS high_rows, round(hires, 6) AS high_mean_residual
FROM m"""


def _labelled(rows):
    named = rows.withColumn("is_observed", F.col("source") != "N")
    areas = {f"{c}_area": classify.clipped_area(F.col(c)) for c in ("observed", "predicted")}
    return named.withColumns({"label_source": classify.label_source(["is_observed"]), **areas})


def _finished(state):
    found = metric_state.finished(state, KEYS)
    return found.withColumns({c: F.round(c, 6) for c, kind in found.dtypes if kind == "double"})


@query("metric_state_batches", _STATE)
def _(spark, d):
    rows = _labelled(observations(spark, d)).withColumn("batch", F.col("order_id") % 7)
    states = saved(metric_state.partial(rows, ["batch", *KEYS]), "states")
    return _finished(metric_state.merged(states, KEYS))


@query("metric_state_stream", _STATE)
def _(spark, d):
    arriving = stream_of(spark, d, "lineitem").select(*LINEITEM)
    folder = new_folder(spark, "stream-states")
    metric_state.stream(_labelled(observed_rows(arriving)), f"{folder}/states", f"{folder}/progress", KEYS).awaitTermination()
    return _finished(metric_state.state_at(spark, f"{folder}/states", KEYS))


_STORED = "order_id long, line int, cell_id long, observed double, predicted double, year int, source string"


@query(
    "partitioned_round_trip",
    """, t AS (SELECT * FROM o WHERE year <> 1995 OR observed >= 0.5)
SELECT year, source, count(*) AS n, round(sum(observed), 4) AS observed, min(cell_id) AS first_cell FROM t
WHERE source <> 'N' AND year IN (1995, 1996) GROUP BY 1, 2""",
)
def _(spark, d):
    path = new_folder(spark, "cells")
    rows = conform(observations(spark, d), _STORED)
    write_parts(rows, path, "year", "source")
    replace_parts(rows.where("year = 1995 AND observed >= 0.5"), path, "year", "source")
    # The years are known only from a table, so their folders are chosen when that has been read.
    years = saved(spark.range(1995, 2000).select(F.col("id").cast("int").alias("year"), (F.col("id") < 1997).cast("int").alias("wanted")), "years")
    found = read_parts(spark, path, _STORED).where("source <> 'N'").join(F.broadcast(years.where("wanted = 1")), "year")  # five rows
    return found.groupBy("year", "source").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("observed"), 4).alias("observed"), F.min("cell_id").alias("first_cell"))


@query("csv_round_trip", " SELECT year, count(*) AS n, count(*) FILTER (observed > 0.9) AS high, round(sum(predicted), 4) AS predicted FROM o GROUP BY 1")
def _(spark, d):
    path = new_folder(spark, "csv")
    write_csv(observations(spark, d), path, ["year", "observed", "predicted"])
    rows = read_csv(spark, path, "year int, observed double, predicted double")
    return rows.groupBy("year").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("observed") > 0.9).alias("high"), F.round(F.sum("predicted"), 4).alias("predicted"))


@query("manifest_round_trip", " SELECT source, count(*) AS n, min(year) AS first_year, max(year) AS last_year FROM o GROUP BY 1")
def _(spark, d):
    path = new_folder(spark, "manifest")
    sources = observations(spark, d).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.min("year").alias("first_year"), F.max("year").alias("last_year"))
    write_manifest(spark, path, {"sources": {r["source"]: r.asDict() for r in sources.collect()}})  # a row for each source
    rows = [tuple(r[c] for c in sources.columns) for r in read_manifest(spark, path)["sources"].values()]
    return spark.createDataFrame(rows, sources.schema)
