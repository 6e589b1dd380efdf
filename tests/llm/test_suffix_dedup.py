"""Operator 12 against brute force: windows and seeds, hot strings, long texts, both ways to join, odd rows."""

import collections
import hashlib
import random

import pytest

from gridlake.llm import common, suffix_dedup

SCHEMA = "doc_id long, text string, rid string, pos int, spans string"


def plain(docs, window):
    texts = [(t or "").encode() for _, t in docs]
    counts = collections.Counter(t[i : i + window] for t in texts for i in range(len(t) - window + 1))
    rows = []
    for (doc_id, _), t in zip(docs, texts, strict=True):
        gone = bytearray(len(t) + 1)
        for i in range(len(t) - window + 1):
            if counts[t[i : i + window]] > 1:
                gone[i : i + window] = b"\1" * window
        kept = bytes(x for x, g in zip(t, gone, strict=False) if not g)
        rows.append((doc_id, len(t), sum(gone), gone.count(b"\0\1") + (gone[0] == 1), hashlib.sha256(kept).hexdigest(), kept))
    return rows


def table(spark, rows):
    return spark.createDataFrame([(d, t, "x", 1, "y") for d, t in rows], SCHEMA)


def check(spark, docs, window, seed):
    got = suffix_dedup.remove_repeats(table(spark, docs).repartition(5), window, seed).collect()
    assert sorted(repr((*r[:5], bytes(r[5]))) for r in got) == sorted(map(repr, plain(docs, window)))


def texts(rng):
    alphabet = ["a", "b", "é", "日", " "]
    text = lambda n: "".join(rng.choice(alphabet) for _ in range(n))
    common_line, passages = text(12), [text(60) for _ in range(6)]
    docs = []
    for i in range(120):
        parts = [text(rng.randrange(40))]
        for _ in range(rng.randrange(4)):
            p = rng.choice(passages)
            a = rng.randrange(20)
            parts += [p[a : rng.randrange(a, 61)], text(rng.randrange(30)), common_line * (i % 2)]
        docs.append((i, "".join(parts)))
    docs += [(200, docs[3][1]), (201, docs[3][1]), (202, docs[4][1] + "x"), (203, "a" * 500), (204, "ab" * 200), (None, docs[5][1][:50])]
    docs += [(300, None), (301, ""), (302, "a"), (302, "a"), (303, passages[0] + passages[1]), (304, passages[0] + "é" + passages[1])]
    return docs


@pytest.mark.parametrize(("window", "seed"), [(40, 5), (40, 40), (24, 7), (13, 1), (50, 25)])
def test_removed_bytes_equal_brute_force(spark, window, seed):
    check(spark, texts(random.Random(window + seed)), window, seed)


def test_the_shuffled_way_and_hashes_over_batches(spark, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(common, "BATCH_ROWS", 3)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        check(spark, texts(random.Random(9))[::2], 40, 5)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_production_settings_on_long_texts_and_shared_passages(spark):
    rng = random.Random(1)
    text = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    passage, line = text(1500), text(120)
    docs = [(i, text(300) + (passage[i : 1500 - 2 * i] if i % 3 else line) + text(200)) for i in range(40)]
    docs += [(50, text(700_000) + passage + text(100_000)), (51, passage[:199]), (52, passage[:200]), (53, text(5000))]
    check(spark, docs, 200, 25)


def test_empty_table_and_carried_columns(spark):
    assert suffix_dedup.remove_repeats(table(spark, [])).count() == 0
    rows = suffix_dedup.remove_repeats(table(spark, [(1, "a" * 300), (2, "b")]), carry=("rid", "pos")).collect()
    assert sorted((r["doc_id"], r["n_removed"], r["n_spans"], r["rid"], r["pos"]) for r in rows) == [(1, 300, 1, "x", 1), (2, 0, 0, "x", 1)]
