"""Operator 1: exact removal of repeated passages by level-wise doubling.

A window is `window` consecutive words of one text. Levels are window lengths, each twice the one before (5, 10, 20;
the last is cut to `window`). At each level only places whose sequence occurs somewhere else survive, and only survivors
are extended to the next level; the loop ends when none is left or the window's length is reached.

Below the full length a level need not look at every place: each window is represented by the sub-window with
the smallest hash in it (equal windows choose equal sub-windows), so about a fifteenth of the places is shuffled.

Identity: texts by 128-bit digests, windows of the full length by 96 hash bits (a collision is expected in none of a
thousand runs over 10 ** 13 windows). Shorter levels only choose candidates, so their 64-bit hashes can add work but
no result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.storagelevel import StorageLevel

from . import common
from .text_hash import U, mix, slices, sliding, window_hashes, word_bounds, word_hashes

MOST = U(0xFFFFFFFFFFFFFFFF)
KEPT = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string"
PLACES = "k long, more int, rid binary, pos int, state int"
#: state of a place: seen once in its slice, seen there twice or more (known to repeat), already known and passed on.
ONCE, REPEATED, PASSED = 0, 1, 2


def level_lengths(window: int, seed: int) -> list[int]:
    """seed, twice seed, ... and at last window itself."""
    lengths = [min(seed, window)]
    while lengths[-1] < window:
        lengths.append(min(2 * lengths[-1], window))
    return lengths


def _chosen(words: np.ndarray, first: np.ndarray, length: int, window: int, prior: tuple[int, np.ndarray] | None):
    """Places (and their hashes) that stand for the candidate windows at this length."""
    n_windows = len(words) - window + 1
    if n_windows <= 0:
        return np.zeros(0, np.int64), np.zeros(0, U)
    inside = np.zeros(n_windows + 1, np.int32)
    counts = np.diff(first)
    full = counts >= window
    np.add.at(inside, first[:-1][full], 1)
    np.add.at(inside, (first[:-1] + counts - window + 1)[full], -1)
    candidate = np.cumsum(inside[:-1]) > 0
    if prior is not None:
        old, marks = prior
        hashes = window_hashes(words, old)
        alive = np.where(marks[: len(hashes)], hashes, MOST)
        candidate &= sliding(np.minimum, alive, window - old + 1) == sliding(np.minimum, hashes, window - old + 1)
    hashes = window_hashes(words, length)
    span = window - length + 1
    if span == 1:
        at = np.flatnonzero(candidate)
        return at, hashes[at]
    least = np.where(candidate, sliding(np.minimum, hashes, span), U(0))
    padded = np.concatenate([np.zeros(span - 1, U), least, np.zeros(span - 1, U)])
    covering = sliding(np.maximum, padded, span)
    at = np.flatnonzero((covering == hashes) & (covering > 0))
    return at, hashes[at]


def _places(length: int, window: int, prior_length: int | None):
    """A row for each chosen place: hash (k, and more bits of another one at the full length), rid, pos, state."""

    @common.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prior = batch.column("places") if prior_length else None
            for lo, hi, data, offsets in slices(batch.column("text")):
                starts, ends, first = word_bounds(data, offsets)
                words = word_hashes(data, starts, ends)
                marks = None
                if prior_length:
                    marks = np.zeros(len(words) + 1, bool)
                    row, pos = _marked(prior.slice(lo, hi - lo))
                    marks[first[row] + pos] = True
                at, hashes = _chosen(words, first, length, window, (prior_length, marks) if prior_length else None)
                if not len(at):
                    continue
                row = np.searchsorted(first, at, "right") - 1
                more = (window_hashes(mix(words), length)[at] & U(0x7FFFFFFF)).astype(np.int32) if length == window else np.zeros(len(at), np.int32)
                _, one, count = np.unique(hashes, return_index=True, return_counts=True)
                state = np.full(len(at), PASSED, np.int32)
                state[one] = np.where(count > 1, REPEATED, ONCE)
                key = np.where(state == PASSED, mix(hashes + at.astype(U)), hashes).view(np.int64)
                rids = batch.column("rid").slice(lo, hi - lo).take(pa.array(row))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key), pa.array(more), rids, pa.array((at - first[row]).astype(np.int32)), pa.array(state)], ["k", "more", "rid", "pos", "state"]
                )

    return run


@common.lean
def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """rid and pos of rows, sorted by k and more, that are passed on, or whose hash occurs twice or is known to repeat.

    A run of one hash over many batches is never held: its rows leave as soon as it is known to repeat.
    """
    held = known = None
    for batch in batches:
        if not batch.num_rows:
            continue
        if held is not None:
            batch = pa.concat_batches([held, batch])
        k, more, state = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("k", "more", "state"))
        own = state != PASSED
        new = np.r_[True, (k[1:] != k[:-1]) | (more[1:] != more[:-1])]
        run, start = np.cumsum(new) - 1, np.flatnonzero(new)
        again = (np.bincount(run, own) > 1) | np.logical_or.reduceat(state == REPEATED, start)
        again[0] |= known == (k[0], more[0])
        keep = ~own | again[run]
        known = (k[-1], more[-1]) if again[-1] else None
        alone = np.flatnonzero(own[start[-1] :])
        held = None if again[-1] or not len(alone) else batch.slice(int(start[-1] + alone[0]), 1)
        yield batch.select(["rid", "pos"]).filter(pa.array(keep))


@common.lean
def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """rid and places of rows rid, at (array of places): a bit for each word up to the last place."""
    for batch in batches:
        lists, out = batch.column("at"), []
        offsets, values = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            bits = np.zeros(int(values[a:b].max(initial=-1)) + 1, np.uint8)
            bits[values[a:b]] = 1
            out.append(np.packbits(bits).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("rid"), pa.array(out, pa.binary())], ["rid", "places"])


def _marked(places: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, place) of each bit set in bitmaps."""
    blobs = pc.fill_null(places, b"").cast(pa.large_binary())
    ends = np.frombuffer(blobs.buffers()[1], np.int64)[blobs.offset : blobs.offset + len(blobs) + 1] * 8
    bits = np.unpackbits(np.frombuffer(blobs.buffers()[2], np.uint8)[ends[0] // 8 : ends[-1] // 8]) if ends[-1] > ends[0] else np.zeros(0, np.uint8)
    at = np.flatnonzero(bits) + ends[0]
    row = np.searchsorted(ends, at, "right") - 1
    return row, at - ends[row]


def _bytes() -> Column:
    """Of a row with a bitmap of places in memory."""
    return 112 + F.coalesce(F.octet_length("places"), F.lit(0))


def repeated_places(texts: DataFrame, window: int = 35, seed: int = 5) -> DataFrame:
    """rid and places (a bitmap of starts) of the windows of texts (rid, text) that occur twice or more among them.

    While the survivors of a level are small they are broadcast. Beyond that the texts are dealt out by rid once and kept
    so on disk, and each further level moves its survivors alone; what a lost executor held is made again.
    """
    survivors, before, dealt = None, None, False
    for length in level_lengths(window, seed):
        rows = texts
        if survivors is not None:
            if survivors.isEmpty():
                break
            if common.fits(survivors, _bytes()):
                rows = texts.join(F.broadcast(survivors), "rid")
            else:
                if not dealt:
                    texts, dealt = texts.repartition("rid").persist(StorageLevel.DISK_ONLY), True
                rows = texts.join(survivors.hint("shuffle_hash"), "rid")
        columns = ["rid", "text"] + ["places"] * (survivors is not None)
        places = rows.select(*columns).mapInArrow(_places(length, window, before), PLACES)
        alive = places.repartition("k").sortWithinPartitions("k", "more").mapInArrow(_repeated, "rid binary, pos int")
        survivors = common.saved(alive.groupBy("rid").agg(F.collect_set("pos").alias("at")).mapInArrow(_bitmaps, "rid binary, places binary"), f"level{length}")
        before = length
    if dealt:
        texts.unpersist()
    return survivors


def _cut(window: int, carry: tuple[str, ...]):
    @common.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, removed, digests, texts = [], [], [], []
            row, pos = _marked(batch.column("places"))
            begin = np.searchsorted(row, np.arange(batch.num_rows + 1))
            for i, (text, copied) in enumerate(zip(batch.column("text"), batch.column("copied"), strict=True)):
                words = text.as_py().encode().split()
                total = len(words)
                if copied.as_py() and total >= window:
                    words = []
                elif begin[i] < begin[i + 1]:
                    at = pos[begin[i] : begin[i + 1]]
                    cover = np.zeros(total + 1, np.int32)
                    cover[at] += 1
                    cover[at + window] -= 1
                    words = [words[x] for x in np.flatnonzero(np.cumsum(cover[:-1]) == 0)]
                kept = b" ".join(words)
                n.append(total)
                removed.append(total - len(words))
                digests.append(hashlib.sha256(kept).hexdigest())
                texts.append(kept.decode())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string()), pa.array(texts, pa.string()), *map(batch.column, carry)],
                ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text", *carry],
            )

    return run


def remove_repeats(docs: DataFrame, window: int = 35, seed: int = 5, carry: tuple[str, ...] = ()) -> DataFrame:
    """Remove each word covered by a window whose word sequence also starts anywhere else.

    docs: doc_id, text; other columns are ignored but for those in carry. Returns one row per input row: doc_id,
    n_words, n_removed, kept_sha256, kept_text (kept words joined by one space) and carry. Null and empty texts have no words and keep the
    empty text; null and repeated doc_ids are rows like others; texts shorter than the window keep all words;
    equal texts are all removed if they hold a window (no copy is kept); an empty table gives an empty one.

    Equal texts are found first, and one of each goes through the levels: their windows repeat by themselves.
    """
    rows = common.with_text_ids(docs)
    groups = common.saved(common.copy_groups(rows), "copies")
    places = repeated_places(common.one_of_each(rows, groups).select("rid", "text"), window, seed)
    facts = places.join(groups.select("rid", F.lit(True).alias("copied")), "rid", "full")
    facts = common.saved(facts.select("rid", F.coalesce("copied", F.lit(False)).alias("copied"), "places"), "facts")
    joined = common.sized_join(common.with_text_ids(docs, carry), facts, "rid", "left", _bytes())
    given = joined.select("doc_id", "text", F.coalesce("copied", F.lit(False)).alias("copied"), "places", *carry)
    schema = T.StructType([*T.StructType.fromDDL(KEPT).fields, *[given.schema[c] for c in carry]])
    return given.mapInArrow(_cut(window, carry), schema)


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT r, i, array_to_string(w[i:i + 34], ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM d)),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY g) AS c FROM s) WHERE c > 1),
gone AS (SELECT r, list_distinct(list(j)) AS js FROM (SELECT r, unnest(range(i, i + 35)) AS j FROM rep) GROUP BY r),
k AS (SELECT d.doc_id, len(w) AS n, CASE WHEN js IS NULL THEN 0 ELSE len(js) END AS m,
  CASE WHEN js IS NULL THEN w ELSE list_transform(list_filter(range(1, len(w) + 1), lambda i: NOT list_contains(js, i)), lambda i: w[i]) END AS kept FROM d LEFT JOIN gone USING (r))
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(m AS BIGINT) AS n_removed, sha256(coalesce(array_to_string(kept, ' '), '')) AS kept_sha256 FROM k
"""


def query(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(common.table(spark, sf_dir, "documents")).drop("kept_text")
