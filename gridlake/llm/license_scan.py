"""Operator 10: license scans by a positional rare-token index (built-in functions only).

The templates' licence words with their places are the postings. For each file and each template that it may hold, the
file's words of highest inverse document frequency among that template's are looked up; postings that lie at the same
relative position vote together. A relative position counts if enough of the template's words align there, and if the
file holds each of its mandatory key phrases within the span that the template covers from there. A template that gets
too few votes from the looked-up words is verified with all its words, so no template hides another. Plain phrases are
found in every file besides.

A text is normalised once: one pass keeps the few places of licence words and which key phrases stand in the text; what
follows moves no text.
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .license_texts import LICENSES, PHRASES, PLAIN
from .license_texts import words as words_of

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: (label, words, mandatory key phrases)
TEMPLATES = tuple((label, words_of(text), phrases) for label, text, phrases in LICENSES)
#: Words looked up for a file and template, and the votes at one relative position that a template needs.
LOOKUPS, VOTES = 8, 3
#: Words that must align besides those of the key phrases, so that a phrase alone is no licence.
BESIDES = 2
#: Words that a key phrase may lie beyond the aligned span, as words may have been put in or taken out.
SLACK = 16


def postings(templates=TEMPLATES) -> list[tuple[int, int, str]]:
    """(template, place in it, word) of the templates' licence words; a fixed, small table."""
    return [(t, i, w) for t, (_, passage, _) in enumerate(templates) for i, w in enumerate(passage) if w not in PLAIN]


def _places(phrase: str) -> Column:
    """Starts of a phrase in the words w; null where single does not hold it."""
    parts = phrase.split()
    here = lambda i: functools.reduce(operator.and_, [F.get("w", i + j) == x for j, x in enumerate(parts)])
    return F.when(F.col("single").contains(f" {phrase} "), F.filter(F.sequence(F.lit(0), F.size("w") - 1), here))


def _needed(template: int) -> int:
    """Licence words of a template that must align: as many as its key phrases have, and some more."""
    of_phrases = sum(w not in PLAIN for phrase in TEMPLATES[template][2] for w in phrase.split())
    return max(VOTES, of_phrases + BESIDES)


def read_files(docs: DataFrame, votes: int = VOTES) -> DataFrame:
    """A row per text, without the text: doc_id, n_words, n_base, first_word, last_word, base (labels), hits (place and
    word of licence words) and sure (templates all of whose key phrases stand there, with the phrases' starts, where hits
    are as many as votes)."""
    lower = F.lower(F.coalesce("text", F.lit("")))
    rows = docs.select("doc_id", F.concat(F.lit(" "), F.trim(F.regexp_replace(lower, SEPARATORS, " ")), F.lit(" ")).alias("single"))
    rows = rows.withColumn("w", F.when(F.col("single") == "  ", F.array().cast("array<string>")).otherwise(F.split(F.trim("single"), " ")))
    vocabulary = sorted({w for _, _, w in postings()})
    placed = F.transform("w", lambda x, i: F.struct(i.alias("pos"), x.alias("word")))
    rows = rows.withColumn("hits", F.filter(placed, lambda h: h["word"].isin(vocabulary)))
    mandatory = sorted({p for _, _, phrases in TEMPLATES for p in phrases} - set(PHRASES))
    columns = {phrase: f"p{k}" for k, phrase in enumerate([*PHRASES, *mandatory])}
    for phrase, name in columns.items():
        rows = rows.withColumn(name, _places(phrase))
    found = [F.col(columns[phrase]) for phrase in PHRASES]

    def sure_of(template: int, phrases: tuple[str, ...]) -> Column:
        starts = F.array(*[F.col(columns[p]) for p in phrases])
        all_ = functools.reduce(operator.and_, [F.col(columns[p]).isNotNull() for p in phrases])
        return F.when(all_, F.struct(F.lit(template).alias("template"), starts.alias("starts")))

    sure = F.array_compact(F.array(*[sure_of(t, phrases) for t, (_, _, phrases) in enumerate(TEMPLATES)]))
    return rows.select(
        "doc_id", F.size("w").cast("long").alias("n_words"), "hits",
        sum((F.coalesce(F.size(p), F.lit(0)) for p in found), F.lit(0)).cast("long").alias("n_base"),
        F.least(*map(F.array_min, found)).cast("long").alias("first_word"), F.greatest(*map(F.array_max, found)).cast("long").alias("last_word"),
        F.array_compact(F.array(*[F.when(p.isNotNull(), F.lit(label)) for p, label in zip(found, PHRASES.values(), strict=True)])).alias("base"),
        F.when(F.size("hits") >= votes, sure).alias("sure"),
    )


def scan(docs: DataFrame, lookups: int = LOOKUPS, votes: int = VOTES) -> DataFrame:
    """Licences of every whole text.

    docs: doc_id, text; other columns are ignored. Returns one row per input row: doc_id, n_words, n_base, first_word,
    last_word (null without a place), base_labels, labels (sorted, comma-joined) and score (of the best template the
    share of its looked-up words that align or, where those are too few, of all its words; at least 0.5 where a base
    phrase stands, 0 without any label). A BSD-3 file holds the two clauses as well and has both labels. Null and empty
    texts have no words; null and repeated doc_ids are rows like others; an empty table gives an empty one. Letters beyond
    A-Z are lower-cased too: that changes no word's bounds and no phrase (only the Kelvin sign becomes a k).
    """
    spark = docs.sparkSession
    table = F.broadcast(spark.sql(f"SELECT * FROM VALUES {_sql_values(postings())} AS t(template, place, word)"))
    files = common.saved(read_files(docs, votes).withColumn("id", F.monotonically_increasing_id()), "files")
    distinct = F.array_distinct(F.transform("hits", lambda h: h["word"]))
    frequency = F.broadcast(files.select(F.explode(distinct).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("df")))  # at most the templates' words
    sure = files.where(F.size("sure") > 0).select("id", F.explode("sure").alias("s"), "hits").select("id", "s.template", "s.starts", "hits")
    may = sure.drop("starts")
    held = may.select("id", "template", F.explode(distinct).alias("word")).join(table.select("template", "word").distinct(), ["template", "word"]).join(frequency, "word")
    rare = held.groupBy("id", "template").agg(F.transform(F.slice(F.sort_array(F.collect_list(F.struct("df", "word"))), 1, lookups), lambda x: x["word"]).alias("rare"))
    met = may.join(rare, ["id", "template"]).select("id", "template", "rare", F.explode("hits").alias("h")).select("id", "template", "rare", "h.pos", "h.word")
    # At one relative position each place of the file meets one place of the template: rows are votes.
    aligned = met.join(table, ["template", "word"]).groupBy("id", "template", (F.col("pos") - F.col("place")).alias("at")).agg(
        F.count_if(F.array_contains("rare", F.col("word"))).alias("votes"), F.count(F.lit(1)).alias("exact"), F.max(F.size("rare")).alias("n")
    )
    of = lambda values: F.get(F.array(*[F.lit(v) for v in values]), F.col("template"))
    total, length = of([sum(w not in PLAIN for w in t[1]) for t in TEMPLATES]), of([len(t[1]) for t in TEMPLATES])
    enough = aligned.where(F.col("exact") >= of([_needed(t) for t in range(len(TEMPLATES))])).join(sure.drop("hits"), ["id", "template"])
    sizes = F.get(F.array(*[F.array(*[F.lit(len(p.split())) for p in t[2]]) for t in TEMPLATES]), F.col("template"))
    within = lambda s, size: (s >= F.col("at") - SLACK) & (s + size <= F.col("at") + length + SLACK)
    held = F.forall(F.zip_with("starts", sizes, lambda p, size: F.exists(p, lambda s: within(s, size))), lambda x: x)
    aligned = enough.where(held)
    best = aligned.groupBy("id", "template").agg(
        F.max(F.when(F.col("votes") >= votes, F.least(F.lit(1.0), F.col("votes") / F.col("n")))).alias("looked_up"),
        F.max(F.when(F.col("exact") >= votes, F.col("exact") / total)).alias("exact"),
    )
    best = best.select("id", "template", F.coalesce("looked_up", "exact").alias("share")).where("share IS NOT NULL")
    found = common.saved(best.groupBy("id").agg(F.collect_list(F.struct("template", "share")).alias("found")), "found")

    names = F.array(*[F.lit(t[0]) for t in TEMPLATES])
    out = common.sized_join(files.drop("hits", "sure"), found, "id", "left", 64 + 24 * F.size("found"))
    more = F.coalesce(F.transform("found", lambda x: F.get(names, x["template"])), F.array().cast("array<string>"))
    top = F.coalesce(F.array_max(F.transform("found", lambda x: x["share"])), F.lit(0.0))
    return out.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join(F.array_sort(F.array_distinct("base")), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat("base", more))), ",").alias("labels"),
        F.greatest(top, F.when(F.col("n_base") > 0, 0.5).otherwise(0.0)).alias("score"),
    )


def _sql_values(rows) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)


ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
e AS (SELECT r, unnest(w) AS x, unnest(range(0, len(w))) AS i FROM d),
p(phrase, label) AS (VALUES {_sql_values(PHRASES.items())}),
b AS (SELECT d.r, label, i FROM d, p, unnest(range(0, len(w))) AS u(i) WHERE array_to_string(w[i + 1:i + len(string_split(phrase, ' '))], ' ') = phrase),
bb AS (SELECT r, count(*) AS n, min(i) AS f, max(i) AS l, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, list(DISTINCT label) AS ls FROM b GROUP BY r),
t(template, place, word) AS (VALUES {_sql_values(postings())}),
q AS (SELECT template, count(*) AS total FROM t GROUP BY template),
k(template, label, phrase, size, length, needed) AS (VALUES {_sql_values((i, t[0], p, len(p.split()), len(t[1]), _needed(i)) for i, t in enumerate(TEMPLATES) for p in t[2])}),
kp AS (
  SELECT r, w, phrase, size FROM d, (SELECT DISTINCT phrase, size FROM k)
  WHERE contains(' ' || array_to_string(w, ' ') || ' ', ' ' || phrase || ' ')),
ks AS (SELECT r, phrase, i FROM kp, unnest(range(0, len(w))) AS u(i) WHERE array_to_string(w[i + 1:i + size], ' ') = phrase),
h AS (SELECT r, x AS word, i FROM e WHERE x IN (SELECT word FROM t)),
f AS (SELECT word, count(DISTINCT r) AS df FROM h GROUP BY word),
kc AS (SELECT template, any_value(label) AS label, any_value(needed) AS needed, count(*) AS phrases FROM k GROUP BY template),
y AS (
  SELECT r, template, any_value(label) AS label FROM (SELECT DISTINCT r, phrase FROM ks) JOIN k USING (phrase) JOIN kc USING (template, label)
  GROUP BY r, template HAVING count(*) = any_value(phrases)),
o AS (SELECT r, template, word, row_number() OVER (PARTITION BY r, template ORDER BY df, word) AS rank FROM (SELECT DISTINCT r, template, word FROM h JOIN t USING (word)) JOIN f USING (word)),
c AS (SELECT r, template, word, count(*) OVER (PARTITION BY r, template) AS n FROM o WHERE rank <= {LOOKUPS}),
a AS (SELECT h.r, t.template, i - place AS z, count(c.word) AS votes, count(*) AS exact, max(c.n) AS n FROM h JOIN t USING (word) LEFT JOIN c ON c.r = h.r AND c.template = t.template AND c.word = h.word GROUP BY 1, 2, 3),
v AS (
  SELECT a.r, a.template, z FROM a JOIN kc USING (template) JOIN k ON k.template = a.template JOIN ks ON ks.r = a.r AND ks.phrase = k.phrase
  WHERE exact >= kc.needed AND i >= z - {SLACK} AND i + size <= z + length + {SLACK}
  GROUP BY a.r, a.template, z HAVING count(DISTINCT k.phrase) = any_value(phrases)),
m AS (SELECT r, template, coalesce(max(CASE WHEN votes >= {VOTES} THEN least(1.0::DOUBLE, votes / n) END), max(CASE WHEN exact >= {VOTES} THEN exact / total END)) AS share FROM a JOIN v USING (r, template, z) JOIN q USING (template) GROUP BY 1, 2),
z AS (SELECT r, max(share) AS share, list(DISTINCT label) AS ls FROM m JOIN y USING (r, template) WHERE share IS NOT NULL GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(bb.n, 0) AS BIGINT) AS n_base, CAST(bb.f AS BIGINT) AS first_word, CAST(bb.l AS BIGINT) AS last_word, coalesce(bb.labels, '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(bb.ls, []), coalesce(z.ls, [])))), ','), '') AS labels,
  greatest(coalesce(z.share, 0.0), CASE WHEN bb.n > 0 THEN 0.5 ELSE 0.0 END)::DOUBLE AS score
FROM d LEFT JOIN bb USING (r) LEFT JOIN z USING (r)
"""


def query(spark, sf_dir: str) -> DataFrame:
    return scan(common.table(spark, sf_dir, "documents"))
