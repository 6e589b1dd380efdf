"""Operator 9: toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's score is logistic in its hashed words; the document's is their noisy-or,
1 - prod(1 - p). Training sees document labels alone; the sentence scores it needs for that then locate the sentences
that make a document toxic.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .text_hash import U, mix, slices, word_bounds, word_hashes

BITS = 18
#: The classifier is fitted on at most about so many labelled documents of each class, taken by a hash of doc_id.
TRAIN_PER_CLASS = 3000
THRESHOLD = 0.3
STEPS, DECAY = 80, 2e-4
#: Remainders of crc32(doc_id as text) modulo 4 whose labels may be learned; settings were chosen with the last one left
#: out of the fit and scored.
LEARNED = (0, 1, 3)
#: Lengths in bytes of the word beginnings that are features too.
PREFIXES = (4, 5)

WORD_SEPARATORS = np.ones(256, bool)
for _lo, _hi in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B), (0x80, 0x100)):
    WORD_SEPARATORS[_lo:_hi] = False
ENDS = np.zeros(256, bool)
ENDS[[*b".!?\n"]] = True


def sentence_words(data: np.ndarray, offsets: np.ndarray):
    """(feature, sentence) of each feature in text order, byte start and end of each sentence, row of each sentence.

    A word's features are its hash and those of its first bytes (inflected forms share them). Sentences are numbered
    over all rows; those without words are not counted.
    """
    starts, ends, first = word_bounds(data, offsets, WORD_SEPARATORS)
    features = [(word_hashes(data, starts, ends, lower=True) >> U(64 - BITS)).astype(np.int64)]
    for size in PREFIXES:
        begun = word_hashes(data, starts, np.minimum(ends, starts + size), lower=True)
        features.append((mix(begun + U(size)) >> U(64 - BITS)).astype(np.int64))
    stops = np.cumsum(ENDS[data])[starts] if len(starts) else np.zeros(0, np.int64)
    row = np.searchsorted(first, np.arange(len(starts)), "right") - 1
    new = np.ones(len(starts), bool)
    new[1:] = (stops[1:] != stops[:-1]) | (row[1:] != row[:-1])
    begin = np.flatnonzero(new)
    last = np.r_[begin[1:], len(starts)] - 1
    return np.stack(features, axis=1).ravel(), np.repeat(np.cumsum(new) - 1, len(features)), starts[begin], ends[last] if len(starts) else ends, row[begin]


def _distinct(values: np.ndarray) -> np.ndarray:
    """The distinct values, sorted; values are overwritten."""
    values.sort()
    return values[np.r_[True, values[1:] != values[:-1]]] if len(values) else values


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float

    def sentences(self, feature: np.ndarray, sentence: np.ndarray, n: int) -> np.ndarray:
        return self.bias + np.bincount(sentence, self.weights[feature], n)


def gradient(w, b, feature, sentence, doc_of_sentence, labels, weights, decay) -> tuple[np.ndarray, float]:
    """Of the mean weighted negative log-likelihood of noisy-or documents, with the penalty on w, by w and b."""
    z = b + np.bincount(sentence, w[feature], len(doc_of_sentence))
    s = np.maximum(np.bincount(doc_of_sentence, np.logaddexp(0, z), len(labels)), 1e-12)
    total = weights.sum()
    slope = weights * np.where(labels == 1, -1 / np.expm1(np.minimum(s, 500)), 1.0) / total
    dz = slope[doc_of_sentence] * _sigmoid(z)
    return np.bincount(feature, dz[sentence], len(w)) + decay * len(labels) / total * w, dz.sum()


def fit(feature, sentence, doc_of_sentence, labels, weights, steps: int = STEPS, least_docs: int = 5, decay: float = DECAY) -> Model:
    """Noisy-or maximum likelihood by Adam on the whole sample; words of fewer than least_docs documents are left out."""
    size = 1 << BITS
    pairs = doc_of_sentence[sentence].astype(np.int64)
    pairs <<= BITS
    pairs |= feature
    usable = np.bincount(_distinct(pairs) & (size - 1), minlength=size) >= least_docs
    keep = usable[feature]
    pairs = sentence[keep].astype(np.int64)
    pairs <<= BITS
    pairs |= feature[keep]
    del keep
    pairs = _distinct(pairs)
    feature, sentence = pairs & (size - 1), pairs >> BITS
    del pairs
    ids = np.flatnonzero(np.bincount(feature, minlength=size))
    number = np.zeros(size, np.int64)
    number[ids] = np.arange(len(ids))
    feature = number[feature]
    w, b = np.zeros(len(ids)), -5.0
    m, v, mb, vb = np.zeros(len(ids)), np.zeros(len(ids)), 0.0, 0.0
    for step in range(1, steps + 1):
        g, gb = gradient(w, b, feature, sentence, doc_of_sentence, labels, weights, decay)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        rate, c1, c2 = 0.1, 1 - 0.9**step, 1 - 0.999**step
        w -= rate * (m / c1) / (np.sqrt(v / c2) + 1e-7)
        b -= rate * (mb / c1) / (np.sqrt(vb / c2) + 1e-7)
    full = np.zeros(size, np.float32)
    full[ids] = w
    return Model(full, float(b))


@common.lean
def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, data, offsets in slices(batch.column("text")):
            feature, sentence, _, _, doc = sentence_words(data, offsets)
            word_doc = doc[sentence] if len(sentence) else sentence
            cut = np.searchsorted(word_doc, np.arange(hi - lo + 1))
            words = [feature[a:b].astype(np.uint32).tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
            places = [(sentence[a:b] - sentence[a] if b > a else sentence[:0]).astype(np.uint32).tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("label").slice(lo, hi - lo), batch.column("weight").slice(lo, hi - lo), pa.array(words, pa.binary()), pa.array(places, pa.binary())],
                ["label", "weight", "words", "places"],
            )


def _train(decay: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _fitted(batches, decay)

    return common.lean(run)


def _fitted(batches: Iterator[pa.RecordBatch], decay: float) -> Iterator[pa.RecordBatch]:
    words, places, docs, labels, weights, base = [], [], [], [], [], 0
    for batch in batches:
        for label, weight, w, p in zip(*(batch.column(c).to_pylist() for c in ("label", "weight", "words", "places")), strict=True):
            p = np.frombuffer(p, np.uint32)
            if not len(p):
                continue
            n = int(p[-1]) + 1
            words.append(np.frombuffer(w, np.uint32))
            places.append(p + np.uint32(base))
            docs.append(np.full(n, len(labels), np.int32))
            labels.append(label)
            weights.append(weight)
            base += n
    if labels:
        joined = []
        for held in (words, places, docs):
            joined.append(np.concatenate(held))
            held.clear()
        model = fit(*joined, np.array(labels), np.array(weights), decay=decay)
        yield pa.RecordBatch.from_arrays([pa.array([model.weights.tobytes()]), pa.array([model.bias])], ["weights", "bias"])


def remainder(doc_id: Column) -> Column:
    """What decides whether a document's label may be learned; null for a null doc_id."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4))


def train(docs: DataFrame, labels: DataFrame, per_class: int = TRAIN_PER_CLASS, learned: tuple[int, ...] = LEARNED, decay: float = DECAY) -> Model:
    """Fit on documents whose label may be learned: remainder(doc_id) is one of learned.

    The sample is bounded (per_class); rows of a thinned class weigh more. labels rows with nulls are left out; of
    several labels of one doc_id the largest holds, of several texts the smallest. Without any row the model scores
    every text alike.
    """
    usable = labels.where("doc_id is not null and toxic is not null").where(remainder(F.col("doc_id")).isin(*learned))
    usable = usable.groupBy("doc_id").agg(F.max("toxic").alias("label"))
    counts = {r["label"]: r["count"] for r in usable.groupBy("label").count().collect()}
    share = {label: min(1.0, per_class / n) for label, n in counts.items()}
    if not share:
        return Model(np.zeros(1 << BITS, np.float32), -5.0)
    of = F.create_map(*[F.lit(x) for pair in share.items() for x in pair])[F.col("label")]
    sample = usable.where(F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1 << 20)) < of * (1 << 20))
    sample = F.broadcast(sample.select("doc_id", F.col("label").cast("int").alias("label"), (1 / of).alias("weight")))  # at most 2 * per_class rows or so
    found = docs.select("doc_id", "text").join(sample, "doc_id").groupBy("doc_id", "label", "weight").agg(F.min("text").alias("text"))
    model = found.mapInArrow(_features, "label int, weight double, words binary, places binary").repartition(1).mapInArrow(_train(decay), "weights binary, bias double")
    row = model.first()
    return Model(np.frombuffer(row["weights"], np.float32), row["bias"]) if row else Model(np.zeros(1 << BITS, np.float32), -5.0)


def _scored(model: Model, threshold: float, locate: bool = True):
    @common.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in slices(batch.column("text")):
                feature, sentence, starts, ends, doc = sentence_words(data, offsets)
                z = model.sentences(feature, sentence, len(doc))
                score = -np.expm1(-np.bincount(doc, np.logaddexp(0, z), hi - lo))
                worst = np.full(hi - lo, -np.inf)
                np.maximum.at(worst, doc, z)
                bad = np.flatnonzero((score[doc] >= threshold) & ((_sigmoid(z) >= threshold / 2) | (z == worst[doc]))) if locate and len(doc) else []
                found: list[list[str]] = [[] for _ in range(hi - lo)]
                for i in bad:
                    found[doc[i]].append(data[starts[i] : ends[i]].tobytes().decode())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(lo, hi - lo), pa.array(score, pa.float64()), pa.array((score >= threshold).astype(np.int32)), pa.array(found, pa.list_(pa.string()))],
                    ["doc_id", "score", "predicted", "offending"],
                )

    return run


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score (0 to 1), predicted (1 from threshold) and offending of every text: of a predicted one the sentences
    that alone reach half the threshold, and the highest scored one in any case.

    docs: doc_id, text; other columns are ignored. Null and empty texts have no sentence and score 0; null and
    repeated doc_ids are rows like others; texts of any length are scored whole; an empty table gives an empty one.
    The model has a fixed size (2 ** 18 weights).
    """
    return docs.select("doc_id", "text").mapInArrow(_scored(model, threshold), "doc_id long, score double, predicted int, offending array<string>")


def reject(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """docs, all columns, without the rows that score at least threshold."""

    scored_rows = _scored(model, threshold, locate=False)

    @common.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = pa.array(range(batch.num_rows), pa.int64())
            asked = pa.RecordBatch.from_arrays([at, batch.column("text")], ["doc_id", "text"])
            for scored in scored_rows(iter([asked])):
                yield batch.take(scored.column("doc_id").filter(pc.equal(scored.column("predicted"), 0)))

    return docs.mapInArrow(run, docs.schema)


def query(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    scored = score(docs, train(docs, common.table(spark, sf_dir, "labels")))
    held = F.coalesce(remainder(F.col("doc_id")) == 2, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", "predicted", "offending")
