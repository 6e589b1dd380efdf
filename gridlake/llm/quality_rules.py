"""Operator 7: quality rules, a threshold table compiled into one Spark projection (built-in functions only)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

SPACE = r"[\x20\x09-\x0D]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Frequent function words of the four languages of the texts.
STOP_WORDS = (
    "a an and are as at be by for from has he in is it its of on or that the this to was were which with "
    "au aux ce de des du en est et il la le les ne ou par pas pour qu que qui sur un une "
    "con del el es las los no por se su una y "
    "als auch auf bei das dem den der des die ein eine im ist mit nicht sich sie und von zu"
).split()


@dataclass(frozen=True)
class Rule:
    """times * numerator must lie between low and high times the denominator; a None side is open."""

    name: str
    numerator: str
    denominator: str
    times: int
    low: int | None = None
    high: int | None = None

    def passes(self) -> str:
        sides = []
        if self.low is not None:
            sides.append(f"{self.times} * {self.numerator} >= {self.low} * {self.denominator}")
        if self.high is not None:
            sides.append(f"{self.times} * {self.numerator} <= {self.high} * {self.denominator}")
        return "(" + " AND ".join(sides) + ")"


RULES = (
    Rule("length", "n_words", "1", 1, 50, 1_000_000),
    Rule("word_length", "word_chars", "n_words", 10, 20, 150),
    Rule("symbols", "n_symbols", "n_words", 100, None, 15),
    Rule("stop_words", "n_stop_words", "n_words", 100, 1, None),
    Rule("repeated_lines", "n_dup_lines", "n_lines", 100, None, 50),
)


def let(value: Column, use) -> Column:
    """use(value) with value evaluated once a row."""
    return F.transform(F.array(value), use)[0]


def _repeated_words(words: Column) -> Column:
    """Words in 3-word windows whose words occur as such a window twice or more in the text."""
    n = F.size(words)
    windows = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))

    def places(w: Column) -> Column:
        ranked = F.sort_array(F.transform(w, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
        same = lambda s, a, b: F.coalesce(F.get(s, a)["x"] == F.get(s, b)["x"], F.lit(False))
        twice = let(ranked, lambda s: F.filter(s, lambda _, j: same(s, j, j - 1) | same(s, j, j + 1)))
        covered = F.flatten(F.transform(twice, lambda t: F.array(t["i"], t["i"] + 1, t["i"] + 2)))
        return F.size(F.array_distinct(covered))

    counted = let(windows, lambda w: F.when(F.size(F.array_distinct(w)) < F.size(w), places(w)).otherwise(0))
    return F.when(n >= 4, counted).otherwise(0).cast("long")


def measure(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """The counts that the rules use, for each row of docs, besides doc_id and the columns named in carry."""
    text = F.coalesce(F.col("text"), F.lit(""))
    removed = lambda x, chars: F.char_length(x) - F.char_length(F.translate(x, chars, ""))
    words = docs.select("doc_id", text.alias("text"), *carry).select("doc_id", "text", *carry, F.array_remove(F.split("text", SPACE + "+"), "").alias("words"))
    plain = lambda w: F.translate(w, UPPER, LOWER)
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return words.select(
        "doc_id",
        *carry,
        F.size("words").cast("long").alias("n_words"),
        F.char_length(F.translate("text", " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        removed(F.col("text"), "#*$%&|<>").cast("long").alias("n_symbols"),
        let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))).alias("lines"),
        _repeated_words(F.col("words")).alias("n_repeat_words"),
        F.size(F.filter("words", lambda w: plain(w).isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
    ).select("*", "lines.n_lines", "lines.n_dup_lines").drop("lines")


def apply_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, carry: tuple[str, ...] = ()) -> DataFrame:
    """Judge every whole text by the threshold table.

    docs: doc_id, text; other columns are ignored but for those in carry. Returns one row per input row: doc_id, n_words, word_chars,
    n_symbols, n_dup_lines, n_repeat_words, n_lines, n_stop_words, base_failed, failed (names of the failed rules) and
    kept. Null and empty texts have no words and fail; null and repeated doc_ids are rows like others; an empty
    table gives an empty one.
    """
    failed = F.array_compact(F.array(*[F.when(~F.expr(r.passes()), F.lit(r.name)) for r in rules]))
    base = F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words")
    return measure(docs, carry).withColumns({"base_failed": base, "failed": failed}).withColumn("kept", ~F.col("base_failed") & (F.size("failed") == 0))


def keep(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of docs, all columns, that the rules keep."""
    rows = docs.select("doc_id", "text", F.struct(*docs.columns).alias("_row"))
    # A filter right above would be pushed below and evaluate the counts once for every rule that uses them.
    judged = apply_rules(rows, rules, ("_row",)).withColumn("_place", F.monotonically_increasing_id())
    return judged.where("kept AND _place >= 0").select("_row.*")


ORACLE = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l, row_number() OVER () AS r FROM documents),
g AS (SELECT r, i, array_to_string(w[i:i + 2], ' ') AS x FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
p AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, x) AS c FROM g) WHERE c > 1),
q AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS j FROM p) GROUP BY r),
m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(len(l) AS BIGINT) AS n_lines,
  CAST(coalesce(q.n, 0) AS BIGINT) AS n_repeat_words,
  CAST(len(list_filter(w, lambda x: translate(x, '{UPPER}', '{LOWER}') IN ({", ".join(f"'{w}'" for w in STOP_WORDS)}))) AS BIGINT) AS n_stop_words FROM d LEFT JOIN q USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND {" AND ".join(r.passes() for r in RULES)} AS kept FROM m
"""


def query(spark, sf_dir: str) -> DataFrame:
    judged = apply_rules(common.table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
