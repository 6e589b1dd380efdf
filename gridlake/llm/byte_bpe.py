"""Operator 6: byte-level BPE by prefix dynamic programming, and decoding.

For every prefix of a piece's bytes there is exactly one token that can end its encoding. The table of these last
tokens is filled from left to right: a token that ends at a place is right if the encoding of what precedes it may
be followed by it, which depends on the last token before it alone. The encoding is read off from the end.
Appending bytes only adds entries; after an edit, entries are redone until they agree with the old ones for as many
places as the longest token has bytes.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common
from .word_ids import gather, parts

#: Bytes, about, that a worker spends on remembered chunks before it starts afresh, what an entry needs besides its
#: text, and pairs of tokens of which it remembers whether they may follow each other.
CACHE_BYTES, ENTRY_BYTES, PAIRS = 96 << 20, 230, 500_000
#: Where a space is not single before a visible character, the text is split by the pattern as a whole.
ODD_SPACE = re.compile(r" (?=\s|$)")
_LOADED: dict[tuple[str, str], tuple] = {}


class Remembered(dict):
    """Ids by chunk, and about how many bytes they take."""

    size = 0

    def grow(self, chunks: list[str]) -> None:
        self.size += sum(map(len, chunks)) + ENTRY_BYTES * len(chunks)


class BytePairs:
    """Ranks of byte tokens and which tokens may follow each other."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.longest = max(map(len, ranks), default=0)
        self.parts: dict[int, tuple[int, int]] = {}
        self.merges: dict[tuple[int, int], int] = {}
        self.follows: dict[int, bool] = {}
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut], rank), ranks.get(token[cut:], rank)
                if left < rank and right < rank and self._may_follow(left, right):
                    self.parts[rank] = left, right
                    self.merges[left, right] = rank
                    break
        self.follows.clear()

    def _may_follow(self, left: int, right: int) -> bool:
        """No merge across the border of left and right comes before the merges that made them.

        The two are taken apart towards the border, latest merge first; a pair at the border whose merge is
        earlier than the last one undone would have been merged instead.
        """
        before = 1 << 62
        while True:
            if self.merges.get((left, right), before) < before:
                return False
            can_left, can_right = left in self.parts, right in self.parts
            if can_left and (left > right or not can_right):
                before, left = left, self.parts[left][1]
            elif can_right:
                # Of equal ranks the leftmost pair merges first, so a border pair of this very rank comes first too.
                before, right = right + 1, self.parts[right][0]
            else:
                return True

    def may_follow(self, left: int, right: int) -> bool:
        key = left << 32 | right
        known = self.follows.get(key)
        if known is None:
            if len(self.follows) > PAIRS:
                self.follows.clear()
            known = self.follows[key] = self._may_follow(left, right)
        return known


class PrefixTable:
    """The last token of each prefix of some bytes."""

    def __init__(self, pairs: BytePairs, data: bytes = b""):
        self.pairs, self.data, self.last = pairs, b"", [-1]
        self.append(data)

    def append(self, more: bytes) -> None:
        have = len(self.data)
        self.data = data = self.data + more
        last, longest, pairs = self.last, self.pairs.longest, self.pairs
        token_of, known = pairs.ranks.get, pairs.follows.get
        for end in range(have + 1, len(data) + 1):
            for start in range(end - 1, max(-1, end - longest - 1), -1):
                token = token_of(data[start:end])
                if token is None:
                    continue
                if start == 0:
                    break
                fits = known(last[start] << 32 | token)
                if pairs.may_follow(last[start], token) if fits is None else fits:
                    break
            else:
                raise ValueError("bytes outside the vocabulary")
            last.append(token)

    def restart(self, data: bytes) -> None:
        """Go on with other bytes; the entries of what they begin with alike stay."""
        old, same = self.data, 0
        most = min(len(old), len(data))
        while same < most and old[same] == data[same]:
            same += 1
        self.data = old[:same]
        del self.last[same + 1 :]
        self.append(data[same:])

    def replace(self, at: int, length: int, new: bytes) -> int:
        """Put new in place of length bytes; returns how many entries were made anew."""
        old = self.last[at + length + 1 :]
        self.data = self.data[:at] + new + self.data[at + length :]
        self.last = self.last[: at + 1]
        after, same, whole = at + len(new), 0, self.data
        self.data = whole[:at]
        for end in range(at + 1, len(whole) + 1):
            self.append(whole[end - 1 : end])
            if end > after:
                same = same + 1 if self.last[end] == old[end - after - 1] else 0
                if same >= self.pairs.longest:
                    self.data = whole
                    self.last += old[end - after :]
                    return end - at
        return len(self.data) - at

    def ids(self) -> list[int]:
        out, end = [], len(self.data)
        while end:
            out.append(self.last[end])
            end -= len(self.pairs.bytes_of[self.last[end]])
        return out[::-1]


def load(path: str, pattern: str) -> tuple:
    """(byte pairs, compiled pattern, remembered chunks) of a rank file; made once in a worker."""
    if (path, pattern) not in _LOADED:
        import regex

        _LOADED[path, pattern] = BytePairs(read_ranks(path)), regex.compile(pattern), Remembered()
    return _LOADED[path, pattern]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def _learn(matches: set[str], pairs: BytePairs) -> dict[str, bytes]:
    """The ids of matches. In sorted order neighbours begin alike, and the entries of shared prefixes stay."""
    table, out = PrefixTable(pairs), {}
    for match in sorted(matches):
        data = match.encode()
        whole = pairs.ranks.get(data)
        if whole is None:
            table.restart(data)
        out[match] = np.array(table.ids() if whole is None else [whole], "<u4").tobytes()
    return out


def encode_chunks(chunks: list[str], loaded: tuple) -> list[bytes]:
    """The ids of each chunk, little-endian unsigned 32-bit; remembered, as chunks recur."""
    pairs, pattern, known = loaded
    new = [chunk for chunk in chunks if chunk not in known]
    if known.size > CACHE_BYTES:
        known.clear()
        known.size, new = 0, chunks
    known.grow(new)
    if new:
        matched = [pattern.findall(chunk) for chunk in new]
        learned = _learn({match for matches in matched for match in matches if match not in known}, pairs)
        known.grow(list(learned))
        known.update(learned)
        known.update(zip(new, [b"".join(map(known.__getitem__, matches)) for matches in matched], strict=True))
    return list(map(known.__getitem__, chunks))


def encode_text(text: str, loaded: tuple) -> bytes:
    """The ids of one text."""
    return b"".join(encode_chunks(list(loaded[1].findall(text)), loaded))


def encode_texts(texts: pa.Array, loaded: tuple) -> list[bytes]:
    """The ids of each of texts (without nulls).

    A single space before a visible character always begins a match of the pattern, so texts are cut there; texts
    with other spaces are split by the pattern as a whole.
    """
    odd = [i for i, text in enumerate(texts.to_pylist()) if ODD_SPACE.search(text)]
    plain = np.ones(len(texts), bool)
    plain[odd] = False
    ids, offsets = gather(
        texts.filter(pa.array(plain)),
        lambda words: encode_chunks([" " + word for word in words], loaded),
        lambda words: encode_chunks(words, loaded),
    )
    out = [b""] * len(texts)
    for i, a, b in zip(np.flatnonzero(plain).tolist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        out[i] = ids[a:b].tobytes()
    for i in odd:
        out[i] = encode_text(texts[i].as_py(), loaded)
    return out


def encode(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """doc_id and ids (little-endian unsigned 32-bit) of every text; null texts are empty and have no ids.

    docs: doc_id, text; other columns are ignored. ranks: path of the rank file, on every worker. Texts of any
    length are encoded whole; null and repeated doc_ids are rows like others; an empty table gives an empty one.
    """

    @common.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loaded = load(ranks, pattern)
        for batch in batches:
            for at, texts in parts(batch.column("text")):
                docs = batch.column("doc_id").slice(at, len(texts))
                yield pa.RecordBatch.from_arrays([docs, pa.array(encode_texts(texts, loaded), pa.binary())], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids binary")


def decode(encoded: DataFrame, ranks: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of decimal ids joined by a space) and decoded (bytes) of doc_id, ids."""

    @common.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bytes_of = {rank: token for token, rank in read_ranks(ranks).items()}
        size = max(bytes_of, default=-1) + 1
        decimal = [str(i) for i in range(size)]
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                n, digests, decoded = [], [], []
                for blob in part.column("ids"):
                    ids = np.frombuffer(blob.as_buffer(), "<u4").tolist()
                    n.append(len(ids))
                    digests.append(hashlib.sha256(" ".join(map(decimal.__getitem__, ids)).encode()).hexdigest())
                    decoded.append(b"".join(map(bytes_of.__getitem__, ids)))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.binary())],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded"],
                )

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded binary")


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers
    from pyspark.sql import functions as F

    how = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    decoded = decode(encode(common.table(spark, sf_dir, "documents"), *how), how[0])
    return decoded.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))
