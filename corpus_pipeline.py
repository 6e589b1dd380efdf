"""From raw documents to packed token sequences, in five stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlake.llm import common, ngram_join, packing, quality_rules, substring_dedup, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labels of these documents, does not reject. Null and empty texts score
    0 and stay; null and repeated doc_ids are rows like others, judged by their texts alone; without labels all stay."""
    return toxicity.reject(docs, toxicity.train(docs, common.table(spark, sf_dir, "labels")))


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules, each row judged by its text alone; null and empty texts fail them."""
    return quality_rules.keep(docs)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of each group of documents linked by near-duplicate text: that of the smallest doc_id (null last), then of the
    smallest text id; of rows repeated with both, any one. Null and blank texts link with nothing and stay."""
    return ngram_join.keep_one(docs)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of passages that stand elsewhere too; n_chars follows the text. All rows stay: null and
    empty texts become empty ones, equal texts of 35 words or more lose them all; other columns are as they were."""
    rows = docs.select("doc_id", "text", F.struct(*[c for c in docs.columns if c != "text"]).alias("_row"))
    cut = substring_dedup.remove_repeats(rows, carry=("_row",))
    new = {"text": F.col("kept_text"), "n_chars": F.char_length("kept_text").cast("long")}
    return cut.select(*[new.get(c, F.col(f"_row.{c}")).alias(c) for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences of at most 4096 tokens; each row is a document, null and empty texts are an end mark."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json")).withColumn("ids_crc32", F.crc32("ids")).drop("ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("quality_rules", drop_low_quality),
    ("ngram_join", keep_one_of_each_group),
    ("substring_dedup", cut_repeated_passages),
    ("packing", pack),
]

#: The first stage is a trained classifier, which SQL cannot express; tests hold run() against a plain
#: version of its other stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
