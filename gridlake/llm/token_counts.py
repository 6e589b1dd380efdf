"""Operator 3: token counts by a count-only Viterbi over a unigram vocabulary.

An Aho-Corasick automaton enumerates the vocabulary's matches; for each place the dynamic programme carries the best
score and the number of pieces on that path, and nothing to trace back. Ties go to the earlier start of the last piece,
as in public unigram tokenizers, which keep the first of equal candidates and meet starts in ascending order. A character
that no single piece covers may be unknown, at ten below the lowest score; it counts as its bytes in UTF-8 (byte fallback).
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from . import common
from .word_ids import parts

MARK = "▁"
UNKNOWN_PENALTY = 10.0
CACHE_BYTES = 160 << 20
CHUNK = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
_LOADED: dict[str, tuple] = {}


def vocabulary(path: str) -> list[tuple[str, float]]:
    """(piece, score) of the ordinary pieces of a sentencepiece file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    odd = lambda i: model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size()) if not odd(i)]


class Counter:
    """Counts pieces of chunks; no piece has a word mark after another character, so none crosses chunks."""

    def __init__(self, pieces: list[tuple[str, float]]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.single = {piece for piece, _ in pieces if len(piece) == 1}
        self.unknown = min((score for _, score in pieces), default=0.0) - UNKNOWN_PENALTY
        self.crossing = any(MARK in piece.lstrip(MARK) for piece, _ in pieces)
        self.known: dict[str, tuple[float, int]] = {}
        self.held = 0

    def best(self, chunk: str) -> tuple[float, int]:
        n = len(chunk)
        ends: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
        for end, found in self.automaton.iter(chunk):
            ends[end + 1].append(found)
        score, count = [0.0] * (n + 1), [0] * (n + 1)
        for end in range(1, n + 1):
            top, pieces = None, 0
            for length, value in sorted(ends[end], reverse=True):  # ascending start
                total = score[end - length] + value
                if top is None or total > top:
                    top, pieces = total, count[end - length] + 1
            if chunk[end - 1] not in self.single:
                total = score[end - 1] + self.unknown
                if top is None or total > top:
                    top, pieces = total, count[end - 1] + len(chunk[end - 1].encode())
            score[end], count[end] = top, pieces
        return score[n], count[n]

    def learn(self, chunks: list[str]) -> None:
        """In sorted order neighbours begin alike, and the entries of shared prefixes stay."""
        before, score, count, single, worst = "", [0.0], [0], self.single, -math.inf
        for chunk in sorted(chunks):
            same, most = 0, min(len(before), len(chunk))
            while same < most and before[same] == chunk[same]:
                same += 1
            before, fresh = chunk, len(chunk) - same
            score[same + 1 :] = [worst] * fresh
            count[same + 1 :] = [0] * fresh
            odd = [] if single.issuperset(chunk) else [i for i in range(len(chunk) - 1, same - 1, -1) if chunk[i] not in single]

            def unknown(at: int) -> None:
                total = score[at] + self.unknown
                if total > score[at + 1]:
                    score[at + 1], count[at + 1] = total, count[at] + len(chunk[at].encode())

            for last, (length, value) in self.automaton.iter(chunk):  # at each place the longest match comes first
                if last >= same:
                    while odd and odd[-1] < last:
                        unknown(odd.pop())
                    start = last + 1 - length
                    total = score[start] + value
                    if total > score[last + 1]:
                        score[last + 1], count[last + 1] = total, count[start] + 1
            while odd:
                unknown(odd.pop())
            self.known[chunk] = score[-1], count[-1]

    def chunks(self, text: str) -> list[str]:
        if not text:
            return []
        marked = MARK + text.replace(" ", MARK)
        return [marked] if self.crossing else CHUNK.findall(marked)

    def texts(self, texts: list[str]) -> list[tuple[float, int]]:
        cut = [self.chunks(text) for text in texts]
        every = set().union(*cut)
        new = [chunk for chunk in every if chunk not in self.known]
        if self.held + _memory(new) > CACHE_BYTES:
            self.known, self.held, new = {}, 0, list(every)
        self.learn(new)
        self.held += _memory(new)
        out = []
        for chunks in cut:
            score = pieces = 0
            for s, c in map(self.known.__getitem__, chunks):
                score += s
                pieces += c
            out.append((float(score), pieces))
        return out

    def text(self, text: str) -> tuple[float, int]:
        return self.texts([text])[0]


def _memory(chunks: list[str]) -> int:
    """Bytes that remembered chunks take, about: the text, and an entry with its numbers."""
    return 4 * sum(map(len, chunks)) + 300 * len(chunks)


def count(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_tokens and score (of the best segmentation) of every whole text.

    docs: doc_id, text; other columns are ignored. model: path of a sentencepiece file, on every worker. Spaces
    become word marks and one is put first; nothing else is normalised. Null and empty texts have 0 tokens; null and
    repeated doc_ids are rows like others; an empty table gives an empty one.
    """

    @common.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if model not in _LOADED:
            _LOADED[model] = Counter(vocabulary(model))
        for batch in batches:
            found = [x for _, texts in parts(batch.column("text")) for x in _LOADED[model].texts(texts.to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([c for _, c in found], pa.int64()), pa.array([s for s, _ in found], pa.float64())],
                ["doc_id", "n_tokens", "score"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, score double")


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count(common.table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
