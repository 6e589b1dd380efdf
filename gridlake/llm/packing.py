"""Operator 5: harmonic packing of token sequences.

Lengths fall into classes: class k holds pieces of more than capacity / (k + 1) and at most capacity / k tokens, and
its bins close at k pieces, so a worker needs to know nothing but how many pieces its open bin has. As pieces may be
cut, a length that would waste more than `waste` of a bin gives up a piece of exactly capacity // (k + 1) tokens
first and its rest falls into a higher class. Pieces of capacity / classes tokens or fewer share next-fit bins.
At the end of a partition the pieces of its open bins are strung together and cut at the capacity; what remains is
laid out in sequences of powers of two. Every partition packs alone: no shuffle, a fixed amount of memory.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .word_ids import gather, parts

PIECES = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
#: Bytes, about, that a task spends on remembered words before it starts afresh, where nothing else is said and where
#: packing has an application to itself, and what an entry needs besides its text.
CACHE_BYTES, ALONE_BYTES, ENTRY_BYTES = 48 << 20, 144 << 20, 230
#: Text bytes encoded together, or a 64th of what may be remembered if that is more; one text is never cut.
TOGETHER_BYTES = 1 << 20
#: Words of letters that are encoded as one text.
TOGETHER = 2000
#: Marks after a Latin letter or digit, which stays one when normalised: the tokenizer splits them there.
CLOSING = r"([0-9A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{12F}\x{131}-\x{24F}])([.,!?;:])"


class WordEncoder:
    """Ids of words and texts as the tokenizer's file at path gives them; strings of special tokens are ordinary text there.

    The tokenizer drops white space and never merges across it, lower-cases, and splits marks from words, so words
    and marks are encoded once each and remembered. Many words of letters are encoded as one text, whose ids are cut
    after each token that ends a word; where there are not as many ends as words, one by one.
    """

    def __init__(self, path: str, most: int = CACHE_BYTES):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs a worker a core already
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values(), default=-1) + 1, bool)
        if suffix:
            self.ends[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
        self.known: dict[str, bytes] = {}
        self.held, self.most = 0, most

    def _ids(self, words: list[str]) -> list[bytes]:
        return [np.array(found.ids, "<u4").tobytes() for found in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _letter_ids(self, words: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for at in range(0, len(words), TOGETHER):
            part = words[at : at + TOGETHER]
            (found,) = self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)
            ids = np.array(found.ids, "<u4")
            ends = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            if len(ends) != len(part) or ends[-1] != 4 * len(ids):
                out += self._ids(part)
                continue
            raw = ids.tobytes()
            out += [raw[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
        return out

    def of_words(self, words: list[str]) -> list[bytes]:
        new = [word for word in words if word not in self.known]
        size = sum(map(len, new)) + ENTRY_BYTES * len(new)
        if self.held + size > self.most and self.known:
            self.known, new, self.held = {}, words, 0
            size = sum(map(len, new)) + ENTRY_BYTES * len(new)
        self.held += size
        letters = [word for word in new if word.isalpha()]
        others = [word for word in new if not word.isalpha()]
        self.known.update(zip(letters, self._letter_ids(letters), strict=True))
        for at in range(0, len(others), TOGETHER):
            part = others[at : at + TOGETHER]
            self.known.update(zip(part, self._ids(part), strict=True))
        return list(map(self.known.__getitem__, words))

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of texts."""
        plain = pc.if_else(pc.string_is_ascii(texts), pc.ascii_lower(texts), texts)
        spaced = pc.replace_substring_regex(pc.replace_substring(plain, "\n", " "), CLOSING, r"\1 \2")
        return gather(spaced, self.of_words)


def plan(length: int, capacity: int, classes: int, waste: float) -> list[tuple[int, int]]:
    """(piece length, class) of a rest of length tokens, at most capacity; class 0 is next-fit."""
    out = []
    while length:
        k = capacity // length
        if k >= classes:
            out.append((length, 0))
            break
        if capacity - k * length <= waste * capacity:
            out.append((length, k))
            break
        k += 1
        out.append((capacity // k, k if k < classes else 0))
        length -= capacity // k
    return out


class Packer:
    """Fills the bins of one partition; rows of finished sequences gather in .rows."""

    def __init__(self, capacity: int, classes: int, waste: float, first_id: int):
        self.capacity, self.classes, self.waste, self.next_id = capacity, classes, waste, first_id
        self.open: dict[int, list[tuple]] = {}
        self.small = 0
        self.plans: dict[int, list[tuple[int, int]]] = {}
        self.rows: list[tuple] = []

    def close(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc, start, total, ids in pieces:
            self.rows.append((doc, start, len(ids) // 4, total, self.next_id, offset, ids))
            offset += len(ids) // 4
        self.next_id += 1

    def add(self, doc, ids: bytes) -> None:
        total, at = len(ids) // 4, 0
        while total - at >= self.capacity:
            self.close([(doc, at, total, ids[4 * at : 4 * (at + self.capacity)])])
            at += self.capacity
        rest = total - at
        if rest not in self.plans:
            self.plans[rest] = plan(rest, self.capacity, self.classes, self.waste)
        for length, k in self.plans[rest]:
            piece = (doc, at, total, ids[4 * at : 4 * (at + length)])
            at += length
            if k == 0 and self.small + length > self.capacity:
                self.close(self.open.pop(0))
                self.small = 0
            held = self.open.setdefault(k, [])
            held.append(piece)
            if k == 0:
                self.small += length
            elif len(held) == k:
                self.close(self.open.pop(k))

    def finish(self) -> None:
        rest = [piece for k in sorted(self.open) for piece in self.open[k]]
        self.open = {}
        left = sum(len(p[3]) for p in rest) // 4
        while left:
            size = min(self.capacity, 1 << (left.bit_length() - 1))
            left -= size
            taken = []
            while size:
                doc, start, total, ids = rest.pop(0)
                here = min(size, len(ids) // 4)
                taken.append((doc, start, total, ids[: 4 * here]))
                if 4 * here < len(ids):
                    rest.insert(0, (doc, start + here, total, ids[4 * here :]))
                size -= here
            self.close(taken)


def _packed(path: str, capacity: int, end_id: int, classes: int, waste: float, remembered: int):
    kinds = (pa.int64(),) * 6 + (pa.binary(),)
    names = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]

    def rows(packer: Packer) -> Iterator[pa.RecordBatch]:
        done, packer.rows = packer.rows, []
        for at in range(0, len(done), 4000):
            yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*done[at : at + 4000], strict=True), kinds, strict=True)], names)

    @common.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Made for each task: what it remembers goes with it, so idle workers stay small.
        encode, end = WordEncoder(path, remembered), end_id.to_bytes(4, "little")
        packer = Packer(capacity, classes, waste, TaskContext.get().partitionId() << 40)
        for batch in batches:
            for at, texts in parts(batch.column("text"), max(TOGETHER_BYTES, remembered // 64)):
                ids, offsets = encode(texts)
                docs = batch.column("doc_id").slice(at, len(texts)).to_pylist()
                for doc, a, b in zip(docs, offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                    packer.add(doc, ids[a:b].tobytes() + end)
                yield from rows(packer)
        packer.finish()
        yield from rows(packer)

    return run


def pack(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 2, classes: int = 32, waste: float = 1 / 32, remembered: int = CACHE_BYTES) -> DataFrame:
    """Tokenise docs and pack the ids, end_id after each document, into sequences of at most capacity tokens.

    docs: doc_id, text; other columns are ignored. tokenizer: path of the tokenizer's file, on every worker. remembered:
    bytes that a task may spend on the ids of words; it changes the work, not the pieces.
    Returns one row per piece: doc_id, start (ids of its document before it), length, doc_tokens, sequence_id,
    offset in the sequence, ids (little-endian unsigned 32-bit). Null and empty texts are the single id end_id; null
    and repeated doc_ids are documents like others; strings of special tokens are encoded as ordinary text, as the
    tokenizers' notes prescribe (encode_special_tokens); a document longer than capacity fills sequences of its own and
    its rest is packed; an empty table gives an empty one.
    """
    return docs.select("doc_id", "text").mapInArrow(_packed(tokenizer, capacity, end_id, classes, waste, remembered), PIECES)


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    pieces = pack(common.table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), remembered=ALONE_BYTES)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
