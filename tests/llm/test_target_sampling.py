"""Operator 13 against a plain version, on odd rows and settings, and its shares of a drawn target."""

import collections
import hashlib
import math
import random
import re
import zlib

import pytest

from gridlake.llm import target_sampling

SCHEMA = "doc_id long, text string, gain long, rank string, row int"


def plain(docs, target, buckets, longest, percent, least_words, seed):
    def features(text):
        words = [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
        grams = [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]
        return len(words), [zlib.crc32(g.encode()) % buckets for g in grams]

    found = [(doc_id, *features(text)) for doc_id, text in docs]
    s, t = collections.Counter(b for *_, x in found for b in x), collections.Counter(b for text in target for b in features(text)[1])
    total_s, total_t = s.total() + buckets, t.total() + buckets
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * total_s / ((s[b] + 1) * total_t))) for b in s}
    rows = []
    for doc_id, n_words, x in found:
        weight = sum(gain[b] for b in x) // len(x) if x else 0
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append([doc_id, len(x), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n_words >= least_words])
    may = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    ranks = {id(r): i + 1 for i, r in enumerate(may[: len(may) * percent // 100])}
    return [(*r[:4], ranks.get(id(r))) for r in rows]


def table(spark, rows):
    return spark.createDataFrame([(d, t, 0, "x", 1) for d, t in rows], SCHEMA)


@pytest.mark.parametrize("settings", [(10_000, 2, 25, 20, 7), (50, 3, 60, 1, 1), (7, 1, 100, 0, 2)])
def test_resample_equals_plain_version(spark, settings):
    rng = random.Random(3)
    words = ["Été", "ARC", "ſtone", "naïve", "x9", "日本", "K", *(f"w{i}" for i in range(40))]
    text = lambda n: "".join(rng.choice(words) + rng.choice([" ", ", ", "\n", " -- ", "_"]) for _ in range(n))
    docs = [(i, text(rng.randrange(60))) for i in range(300)] + [(400, None), (401, ""), (402, " \t;"), (403, "one"), (404, text(30_000)), (None, text(25))]
    target = [None, "", text(200), "x9 x9 K ARC"]
    buckets, longest, percent, least, seed = settings
    got = target_sampling.resample(table(spark, docs), table(spark, [(1, t) for t in target]), buckets, longest, percent, least, seed)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, plain(docs, target, *settings)))


def test_repeated_rows_empty_tables_and_an_empty_target(spark):
    docs = [(5, "a b c " * 10)] * 4 + [(None, "a b c " * 10)] * 2 + [(6, None)]
    rows = target_sampling.resample(table(spark, docs), table(spark, []), percent=50).collect()
    assert len(rows) == 7 and sorted(r["rank"] for r in rows if r["rank"]) == [1, 2, 3]
    assert {tuple(r)[:4] for r in rows} == {r[:4] for r in plain(docs, [], 10_000, 2, 50, 20, 7)}
    assert target_sampling.resample(table(spark, []), table(spark, [(1, "a")])).count() == 0


def test_documents_like_the_target_are_drawn_more_often(spark):
    rng = random.Random(5)
    of = lambda vocabulary: " ".join(rng.choice(vocabulary) for _ in range(40))
    near, far = [f"n{i}" for i in range(30)], [f"f{i}" for i in range(30)]
    docs = [(i, of(near if i % 4 == 0 else far)) for i in range(400)]
    drawn = target_sampling.resample(table(spark, docs), table(spark, [(1, of(near)) for _ in range(20)])).where("rank IS NOT NULL").collect()
    assert len(drawn) == 100 and sum(r["doc_id"] % 4 == 0 for r in drawn) >= 60  # 25 by chance
