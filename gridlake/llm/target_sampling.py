"""Operator 13: resampling of documents towards a target distribution (built-in functions only).

Texts are turned into arrays of n-grams and these into arrays of bucket numbers (crc32 modulo); exploded, they are
counted by bucket for the documents and for the target. The gains of the buckets, a table of at most `buckets` rows, are
broadcast to the exploded documents and summed a document. Documents are drawn by their mean gain with Gumbel noise: a
distributed sort, whose ranks are places in a partition behind the rows of the partitions before it.

Texts are read once. No step holds more than one document or one row a bucket in one place: counts and sums are
aggregated within tasks before they are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Separators once A-Z are words' letters too: a text is cut before its words are lower-cased.
CUTS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BUCKETS, LONGEST, SEED = 10_000, 2, 7
LEAST_WORDS, PERCENT = 20, 25
#: monotonically_increasing_id() is the partition's number above this many bits, and the row's place in it.
PLACE_BITS = 33


def _lower(word: Column) -> Column:
    """A-Z lower-cased, no other letter; the faster function where a word has no others."""
    return F.when(F.octet_length(word) == F.char_length(word), F.lower(word)).otherwise(F.translate(word, UPPER, LOWER))


def bucket_arrays(rows: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST) -> DataFrame:
    """rows with n_words and buckets: the bucket of each run of 1 to longest consecutive words, repeats kept.

    rows: text and any other columns but those; a null text has no words.
    """
    rest = [c for c in rows.columns if c != "text"]
    cut = rows.select(*rest, F.array_remove(F.split(F.coalesce("text", F.lit("")), CUTS), "").alias("cut"))
    out = cut.select(*rest, F.transform("cut", _lower).alias("g1"))
    for n in range(2, longest + 1):
        more = F.greatest(F.size("g1") - (n - 1), F.lit(0))
        joined = F.zip_with(F.slice(f"g{n - 1}", F.lit(1), more), F.slice("g1", F.lit(n), more), lambda a, b: F.concat(a, F.lit(" "), b))
        out = out.withColumn(f"g{n}", joined)
    grams = F.concat(*[F.col(f"g{n}") for n in range(1, longest + 1)])
    return out.select(*rest, F.size("g1").cast("long").alias("n_words"), F.transform(grams, lambda g: (F.crc32(g) % buckets).cast("int")).alias("buckets"))


def bucket_counts(features: DataFrame, name: str) -> DataFrame:
    """bucket and its features' number, of rows with an array of buckets."""
    return features.select(F.explode("buckets").alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias(name))


def gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """bucket and gain of each bucket that source has features in: log of the smoothed target's share to the source's, in
    thousandths, floored. source and target: rows with buckets."""
    counts = common.saved(bucket_counts(source, "s").join(F.broadcast(bucket_counts(target, "t")), "bucket", "left").select("bucket", "s", F.coalesce("t", F.lit(0)).alias("t")), "counts")
    total = counts.agg(F.coalesce(F.sum("s"), F.lit(0)).alias("s")).first()["s"]
    of_target = target.agg(F.coalesce(F.sum(F.size("buckets").cast("long")), F.lit(0)).alias("t")).first()["t"]
    s, t = F.col("s").cast("double"), F.col("t").cast("double")
    ratio = ((t + 1.0) * float(total + buckets)) / ((s + 1.0) * float(of_target + buckets))
    return counts.select("bucket", F.floor(F.lit(1000.0) * F.ln(ratio)).cast("long").alias("gain"))


def _ranked(rows: DataFrame, order: list[Column]) -> DataFrame:
    """rows, saved, with rank: 1, 2, 3... in the given total order; sorted by ranges, and no range is gathered."""
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    placed = common.saved(placed, "ordered")
    part, place = F.shiftright("_at", PLACE_BITS), F.col("_at").bitwiseAND((1 << PLACE_BITS) - 1)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))  # a row for each partition
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    joined = placed.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    return joined.withColumn("rank", F.col("_offset") + place + 1).drop("_at", "_part", "_offset")


def resample(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """Draw percent of the documents with enough words, those of likelier n-grams under the target more often.

    docs: doc_id, text; target: text; other columns are ignored. Returns one row per row of docs: doc_id, n_features,
    weight (floored mean of gains; 0 without features), score (weight and noise, which depends on seed and doc_id alone)
    and rank (1, 2, 3... of the drawn: highest scores first, ties to the smaller doc_id; else null). A null text has no
    words and, like any text with too few, is never drawn. A null doc_id gets the noise of the empty id and loses ties.
    Rows repeated with one doc_id and score are ranked in any order among themselves. An empty target gives every bucket
    its smoothed gain; an empty table gives an empty one.
    """
    common.prepare(docs.sparkSession)
    features = common.saved(bucket_arrays(docs.select("doc_id", "text"), buckets, longest), "features").withColumn("row", F.monotonically_increasing_id())
    aimed = common.saved(bucket_arrays(target.select("text"), buckets, longest), "target")
    gain = F.broadcast(gains(features, aimed, buckets))  # at most a row for each bucket
    of_doc = features.select("row", "doc_id", "n_words", F.size("buckets").cast("long").alias("n_features"), F.explode_outer("buckets").alias("bucket"))
    summed = of_doc.join(gain, "bucket", "left").groupBy("row", "doc_id", "n_words", "n_features").agg(F.sum("gain").alias("total"))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(F.lit(-1000.0) * F.ln(-F.ln((h.cast("double") + 0.5) / 4294967296.0))).cast("long")
    # Integers throughout: the remainder is never negative, so the quotient is floored.
    mean = F.when(F.col("n_features") > 0, F.expr("(total - pmod(total, n_features)) div n_features")).otherwise(F.lit(0)).cast("long")
    scored = summed.select("row", "doc_id", "n_words", "n_features", mean.alias("weight")).withColumn("score", F.col("weight") + noise)
    scored = common.saved(scored, "scored")
    may = F.col("n_words") >= least_words
    drawn = scored.where(may).count() * percent // 100
    ranked = _ranked(scored.where(may), [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("row")])
    out = ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank"))).unionByName(scored.where(~may).withColumn("rank", F.lit(None).cast("long")))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


#: crc32 in SQL: the table of its bytes, and a fold over a text's bytes.
CRC_TABLE = "SELECT list(list_reduce(list_prepend(i, range(8)), lambda a, x: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) ORDER BY i) AS crc FROM range(256) AS u(i)"


def crc_sql(text: str) -> str:
    """Unsigned crc32 of the UTF-8 bytes of a text, beside a row of CRC_TABLE."""
    data = f"list_transform(range(0, octet_length(encode({text}))), lambda i: CAST('0x' || hex(encode({text}))[2 * i + 1:2 * i + 2] AS BIGINT))"
    return f"xor(list_reduce(list_prepend(4294967295, {data}), lambda c, b: xor(c >> 8, crc[CAST(xor(c, b) & 255 AS BIGINT) + 1])), 4294967295)"


def _features_sql(table: str) -> str:
    words = f"list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{SEPARATORS}'), lambda x: x <> '')"
    return f"""SELECT r, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f
  FROM (SELECT row_number() OVER () AS r, {words} AS w FROM {table})"""


ORACLE = rf"""
WITH tab AS ({CRC_TABLE}),
d AS (
  SELECT row_number() OVER () AS r, doc_id,
    len(list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{SEPARATORS}'), lambda x: x <> '')) AS n_words
  FROM documents),
df AS ({_features_sql("documents")}),
bf AS ({_features_sql("benchmark")}),
names AS (SELECT f FROM df UNION SELECT f FROM bf),
b AS (SELECT f, CAST({crc_sql("f")} AS BIGINT) % {BUCKETS} AS bucket FROM names, tab),
s AS (SELECT bucket, count(*) AS s FROM df JOIN b USING (f) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM bf JOIN b USING (f) GROUP BY bucket),
g AS (
  SELECT bucket, CAST(floor(1000.0::DOUBLE * ln(((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM df) + {BUCKETS})::DOUBLE)
    / ((s + 1)::DOUBLE * ((SELECT count(*) FROM bf) + {BUCKETS})::DOUBLE))) AS BIGINT) AS gain
  FROM s LEFT JOIN t USING (bucket)),
m AS (SELECT r, count(*) AS n, CAST(sum(gain) AS BIGINT) AS total FROM df JOIN b USING (f) JOIN g USING (bucket) GROUP BY r),
w AS (
  SELECT doc_id, n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_features, CAST(coalesce(floor(total / n), 0) AS BIGINT) AS weight,
    CAST('0x' || sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), ''))[1:8] AS BIGINT) AS h
  FROM d LEFT JOIN m USING (r)),
x AS (SELECT *, weight + CAST(floor(-1000.0::DOUBLE * ln(-ln((h + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score FROM w),
k AS (SELECT *, row_number() OVER (PARTITION BY n_words >= {LEAST_WORDS} ORDER BY score DESC, doc_id) AS place FROM x)
SELECT doc_id, n_features, weight, score,
  CASE WHEN n_words >= {LEAST_WORDS} AND place <= (SELECT count(*) FROM d WHERE n_words >= {LEAST_WORDS}) * {PERCENT} // 100 THEN CAST(place AS BIGINT) END AS rank
FROM k
"""


def query(spark, sf_dir: str) -> DataFrame:
    return resample(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
