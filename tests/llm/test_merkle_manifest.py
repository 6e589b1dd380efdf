"""Operator 11 against a plain version, over many partitions and on odd rows."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from gridlake.llm import merkle_manifest

SCHEMA = "doc_id long, source string, lang string, n_chars int, text string, idx int, part string, digest string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(*values):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def tree(nodes, fanout):
    """Levels of a plain tree."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        at = levels[-1]
        levels.append([h(*at[i : i + fanout]) for i in range(0, len(at), fanout)])
    return levels


def path(levels, i, fanout):
    out = []
    for at in levels[:-1]:
        first = i - i % fanout
        out.append((at[first:i], at[i + 1 : first + fanout]))
        i //= fanout
    return out


def plain(rows, tampered, fanout):
    groups = {}
    for row in rows:
        groups.setdefault(row[1], []).append((row[0] is not None, row[0] or 0, leaf(*row[:5]), leaf(*row[:4], tampered(row)), row[0]))
    sources = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([x[2] for x in sorted(groups[s])], fanout) for s in sources}
    upper = tree([trees[s][-1][0] for s in sources], fanout)
    out = []
    for k, s in enumerate(sources):
        for i, x in enumerate(sorted(groups[s])):
            steps = path(trees[s], i, fanout) + path(upper, k, fanout)
            folded = x[3]
            for before, after in steps:
                folded = h(*before, folded, *after)
            proof = h(*[d for two in steps for side in two for d in side])
            out.append((x[4], x[2], trees[s][-1][0], upper[-1][0], proof, folded, folded == upper[-1][0]))
    return out, trees, upper


def cut(row):
    return row[4].replace("\n", "") if row[0] is not None and row[4] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0 else row[4]


def cut_column():
    return F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))


def table(spark, rows):
    return spark.createDataFrame([(*r, 9, "p", "d") for r in rows], SCHEMA)


def same(got, want):
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


@pytest.mark.parametrize(("fanout", "most", "span"), [(3, 7, 4), (2, 50, 2), (5, 1000, 64)])
def test_proofs_and_records_equal_plain_version(spark, fanout, most, span):
    rng = random.Random(fanout)
    text = lambda: rng.choice([None, "", "a\nb", "é\n\n日本", "x" * rng.randrange(50)])
    rows = [(i, rng.choice(["hot", "hot", "hot", None, "", "é", "z", f"s{i % 30}"]), rng.choice(["en", None]), rng.choice([None, i]), text()) for i in range(600)]
    rows += [(None, "hot", None, None, None)] * 3 + [(7, "hot", "en", 1, "same\n")] * 5 + [(None, None, None, None, None), (-4, "z", "en", 2, "y" * 300_000)]
    rng.shuffle(rows)
    want, trees, upper = plain(rows, cut, fanout)
    same(merkle_manifest.proofs(table(spark, rows), cut_column(), fanout, most, span).collect(), want)
    records = [(s, "source", level, i, d) for s, levels in trees.items() for level, at in enumerate(levels) for i, d in enumerate(at)]
    records += [(None, "dataset", level, i, d) for level, at in enumerate(upper) for i, d in enumerate(at)]
    same(merkle_manifest.manifest(table(spark, rows), fanout, most, span).select("source", "scope", "level", "idx", "digest").collect(), records)


def test_one_row_one_source_and_an_empty_table(spark):
    one = [(1, "a", "en", 3, "a\nb")]
    for rows in (one, one * 4, [(i, None, None, None, None) for i in range(10)]):
        same(merkle_manifest.proofs(table(spark, rows), cut_column()).collect(), plain(rows, cut, 3)[0])
    assert merkle_manifest.proofs(table(spark, [])).count() == 0 and merkle_manifest.manifest(table(spark, [])).count() == 0
    with pytest.raises(ValueError):
        merkle_manifest.proofs(table(spark, one), fanout=1)
