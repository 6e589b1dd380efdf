"""Sources and sinks: pruned Parquet scans, CSV with a fixed header, partitioned Parquet, JSON manifests, shared tables."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def scan(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def stream_of(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table as a stream of its files, whether it is one file or a folder of them (streams are read from folders)."""
    stored = scan(spark, sf_dir, name)
    file = f"{name}.parquet"
    reader = spark.readStream.schema(stored.schema)
    if any(f.endswith(f"/{file}") for f in stored.inputFiles()):
        return reader.option("pathGlobFilter", file).parquet(sf_dir)
    return reader.parquet(f"{sf_dir}/{file}")


#: The columns of lineitem that observations are made of.
LINEITEM = ("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate", "l_quantity", "l_extendedprice", "l_returnflag")


def observed_rows(lineitem: DataFrame) -> DataFrame:
    """Cell-by-year rows made of lineitem: a cell on a grid of 100 columns, observed and predicted shares, a weight."""
    return lineitem.select(
        F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("cell_id"),
        F.floor(F.col("l_partkey") / 100).alias("row"), F.pmod("l_partkey", F.lit(100)).alias("col"),
        F.year("l_shipdate").alias("year"), F.quarter("l_shipdate").alias("quarter"), F.col("l_returnflag").alias("source"),
        (F.col("l_quantity") / 50).alias("observed"), F.least(F.lit(1.0), F.col("l_extendedprice") / 100000).alias("predicted"),
        (1.0 + F.col("l_linenumber")).alias("weight"),
    )


def observations(spark: SparkSession, sf_dir: str, stored: Column | None = None) -> DataFrame:
    """observed_rows of the table lineitem. stored: a condition on lineitem's own columns."""
    rows = scan(spark, sf_dir, "lineitem", *LINEITEM)
    return observed_rows(rows if stored is None else rows.where(stored))


#: The same rows in SQL.
OBSERVATIONS = """o AS (SELECT l_orderkey AS order_id, l_linenumber AS line, l_partkey AS cell_id, CAST(floor(l_partkey / 100.0) AS BIGINT) AS "row", l_partkey % 100 AS col,
 year(l_shipdate) AS year, quarter(l_shipdate) AS quarter, l_returnflag AS source, l_quantity / 50 AS observed, least(1.0::DOUBLE, l_extendedprice / 100000) AS predicted, 1.0::DOUBLE + l_linenumber AS weight FROM lineitem)"""


def write_csv(df: DataFrame, path: str, fields: list[str]) -> None:
    df.select(*fields).write.mode("overwrite").csv(path, header=True)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).csv(path, header=True, enforceSchema=False)


def write_parts(df: DataFrame, path: str, *partitions: str) -> None:
    df.write.mode("overwrite").partitionBy(*partitions).parquet(path)


def replace_parts(df: DataFrame, path: str, *partitions: str) -> None:
    """Write df by partitions at path: partitions that df has rows of are replaced, the others stay as they are."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partitions).parquet(path)


def read_parts(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """What is at path. Conditions on the partition columns choose folders before any file is opened, and so do joins
    with filtered small tables on them."""
    return (spark.read.schema(schema) if schema is not None else spark.read).parquet(path)


def new_folder(spark: SparkSession, name: str) -> str:
    """A path for a new folder in the one of spark.checkpoint.dir, which all executors share."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def conform(df: DataFrame, schema: T.StructType | str) -> DataFrame:
    """df with exactly the columns and types of schema; a missing column is an error, further ones are dropped."""
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    absent = [f.name for f in schema if f.name not in df.columns]
    if absent:
        raise ValueError(f"columns are missing: {absent}")
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])


def write_manifest(spark: SparkSession, path: str, manifest: dict) -> None:
    """A nested JSON document as one file in the folder path, on any store that Spark writes."""
    spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_manifest(spark: SparkSession, path: str) -> dict:
    found = spark.read.text(path, wholetext=True).first()
    document = json.loads(found[0]) if found else None
    if not isinstance(document, dict):
        raise ValueError(f"no JSON object at {path}")
    return document


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share; where unset, a new local one if Spark is local."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def saved(df: DataFrame, name: str) -> DataFrame:
    """df written to the folder in spark.checkpoint.dir, which all executors share, and read back: cuts lineage."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def latest(df: DataFrame, key: str, *order: str) -> DataFrame:
    """The latest row of each key by the order columns."""
    return df.groupBy(key).agg(F.max_by(F.struct(*df.columns), F.struct(*order)).alias("r")).select("r.*")
