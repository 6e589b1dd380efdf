"""What several operators share: shared-folder tables, size-checked joins, distinct texts, components."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only while its rows sum up to no more than this; beyond it the join shuffles.
BROADCAST_BYTES = 48 << 20
#: Rows and bytes of an Arrow batch at most (one row is never cut).
BATCH_ROWS, BATCH_BYTES = 2000, 16 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share; where unset, a new local one if Spark is local."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def prepare(spark: SparkSession) -> None:
    """Whole texts are long rows: smaller Arrow batches keep Python workers small. A user's own settings hold."""
    limits = {"maxRecordsPerBatch": ("10000", str(BATCH_ROWS)), "maxBytesPerBatch": ("67108864b", f"{BATCH_BYTES}b")}
    for name, (default, ours) in limits.items():
        key = f"spark.sql.execution.arrow.{name}"
        if spark.conf.get(key, default) == default:
            spark.conf.set(key, ours)


def give_back() -> None:
    """Return freed memory to the system: a Python worker lives on and serves later stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """run, for mapInArrow, after whose last batch freed memory is given back."""

    @functools.wraps(run)
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return task


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fits(side: DataFrame, row_bytes: int | Column) -> bool:
    """Whether side, of so many bytes a row in memory, may be broadcast. It should be saved, so that reading it is cheap."""
    size = side.agg(F.sum(row_bytes if isinstance(row_bytes, Column) else F.lit(row_bytes))).first()[0] or 0
    return size <= BROADCAST_BYTES


def sized_join(big: DataFrame, small: DataFrame, on, how: str, row_bytes: int | Column) -> DataFrame:
    """big join small: small is measured and broadcast under BROADCAST_BYTES, else both are shuffled by the key.

    row_bytes: of a row in memory; a column where rows differ. small should be a saved table.
    """
    return big.join(F.broadcast(small) if fits(small, row_bytes) else small.hint("shuffle_hash"), on, how)


def text_id(text: Column) -> Column:
    """128-bit id of a text (its MD5 digest); null counts as the empty text."""
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def with_text_ids(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text (null: empty), rid, which equal texts share, and the columns in carry."""
    return docs.select("doc_id", *carry, F.coalesce("text", F.lit("")).alias("text"), text_id(F.col("text")).alias("rid"))


def copy_groups(rows: DataFrame) -> DataFrame:
    """One row for each text that occurs twice or more: rid, copies, keeper (smallest doc_id, null first)."""
    return (
        rows.groupBy("rid")
        .agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("doc_id")).alias("s"))
        .where("copies > 1")
        .select("rid", "copies", F.col("s.doc_id").alias("keeper"))
    )


def one_of_each(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """rows without those whose text another doc_id keeps. Rows repeated with one doc_id all stay."""
    joined = sized_join(rows, groups.select("rid", "keeper", F.lit(True).alias("grouped")), "rid", "left", 80)
    return joined.where(F.col("grouped").isNull() | F.col("doc_id").eqNullSafe(F.col("keeper"))).select(*rows.columns)


def components(links: DataFrame) -> DataFrame:
    """Connected components of links (a, b): one row per linked node, node and comp (a node of its component).

    Every round hooks each node to its smallest neighbour, shortens the paths, and contracts the links; each
    round at least halves the nodes of a component. Hot nodes meet only partial aggregates and skew joins.
    """
    edges = saved(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    labels = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = saved(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("comp")), "hook")
        up = lambda x: hook.select(F.col("node").alias("comp"), F.col("comp").alias(x))
        for _ in range(2):
            hook = hook.join(up("top"), "comp").select("node", F.col("top").alias("comp"))
        hook = saved(hook, "hook")
        if labels is None:
            labels = hook
        else:
            labels = saved(labels.join(up("top"), "comp", "left").select("node", F.coalesce("top", "comp").alias("comp")), "labels")
        left = hook.select(F.col("node").alias("a"), F.col("comp").alias("ca"))
        right = hook.select(F.col("node").alias("b"), F.col("comp").alias("cb"))
        moved = edges.join(left, "a").join(right, "b").where("ca <> cb")
        edges = saved(moved.select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).distinct(), "links")
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("comp"))
    return labels
