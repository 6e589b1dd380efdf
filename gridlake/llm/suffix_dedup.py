"""Operator 12: exact removal of repeated byte strings by bucket-pointer refinement of suffix buckets.

A suffix's bucket is identified by a hash of its first q bytes. Buckets are refined by sorting on the identifiers of
later offsets: the pair of the identifiers at i and i + length identifies the bucket of twice the length at i, and these
refined identifiers are used for the next doubling (25, 50, 100, 200 bytes). Only suffixes whose buckets hold another one
go on.

Most suffixes need no refinement of their own. Of the q-grams in each window of full length, the one with the least
identifier stands for the window (equal windows choose equal places; ties go to the leftmost), so about one suffix in 88
is sorted. Neighbouring windows with one such place form a block, identified by the refined buckets at its first and last
window and its shape. A block that stands elsewhere too is settled as a whole. Only blocks that do not, and one block of
each other kind in their bucket, which may share some windows with them, are refined window by window.

Identity: texts by 128-bit digests, windows and blocks of full length by 96 hash bits; shorter levels only choose
candidates.
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
from .substring_dedup import ONCE, PASSED, PLACES, REPEATED, _repeated, level_lengths
from .text_hash import U, mix, slices, sliding, window_hashes

WINDOW, SEED = 200, 25
KEPT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
BLOCKS = "k long, more int, gram long, rid binary, pos int, n int, state int"
#: Kinds of blocks: another stands for the same content, this one stands for others, no other has the content.
SETTLED, FIRST, ALONE = 0, 1, 2
#: A window's place is chosen by the high bits of its identifier, then by position.
HIGH, LOW = U(0xFFFFFFFF80000000), U(0x7FFFFFFF)
#: Multipliers of the two families of refined identifiers.
FAMILIES = U(0x9FB21C651E98DF25), U(0xC2B2AE3D27D4EB4F)


def refined(ids: np.ndarray, step: int) -> np.ndarray:
    """Identifiers of the strings that two others make: that at a place and that at step behind it."""
    return mix(ids[:-step] * FAMILIES[0] + ids[step:]) if len(ids) > step else np.zeros(0, U)


def refined_at(ids: np.ndarray, lengths: list[int], at: np.ndarray, family: int) -> np.ndarray:
    """Identifiers of the last of lengths at some places, from those of the first at all."""
    if len(lengths) == 1:
        return ids[at] if family == 0 else mix(ids[at] ^ FAMILIES[1])
    step = lengths[-1] - lengths[-2]
    return mix(refined_at(ids, lengths[:-1], at, family) * FAMILIES[family] + refined_at(ids, lengths[:-1], at + step, family))


def grams(data: np.ndarray, q: int) -> np.ndarray:
    """Identifiers of the q-grams at all places (over row ends too; callers leave those out)."""
    return window_hashes(mix(np.arange(1, 257, dtype=U))[data], q)


def _inside(offsets: np.ndarray, window: int, n: int) -> np.ndarray:
    """Which of n places start a window within their row."""
    steps = np.zeros(n + 1, np.int32)
    full = np.diff(offsets) >= window
    np.add.at(steps, offsets[:-1][full], 1)
    np.add.at(steps, (offsets[1:] - window + 1)[full], -1)
    return np.cumsum(steps[:-1]) > 0


def _chosen(ids: np.ndarray, length: int, window: int) -> np.ndarray:
    """The place that stands for each window, of those with identifiers of the given length."""
    return (sliding(np.minimum, (ids & HIGH) | np.arange(len(ids), dtype=U), window - length + 1) & LOW).astype(np.int64)


def _integers(packed: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, value) of rows of packed 32-bit numbers; null is none."""
    blobs = pc.fill_null(packed, b"").cast(pa.large_binary())
    ends = np.frombuffer(blobs.buffers()[1], np.int64)[blobs.offset : blobs.offset + len(blobs) + 1] // 4
    values = np.frombuffer(blobs.buffers()[2], np.int32)[ends[0] : ends[-1]] if ends[-1] > ends[0] else np.zeros(0, np.int32)
    return np.repeat(np.arange(len(blobs)), np.diff(ends)), values.astype(np.int64)


def _marked(packed: pa.Array, offsets: np.ndarray, n: int) -> np.ndarray:
    """Which of n places are in the rows' packed places."""
    row, pos = _integers(packed)
    marks = np.zeros(n, bool)
    marks[offsets[row] + pos] = True
    return marks


def _covered(packed: pa.Array, offsets: np.ndarray, n: int) -> np.ndarray:
    """Which of n places are in the rows' packed ranges (first, number)."""
    row, values = _integers(packed)
    first, size = offsets[row[::2]] + values[::2], values[1::2]
    steps = np.zeros(n + 1, np.int32)
    np.add.at(steps, first, 1)
    np.add.at(steps, first + size, -1)
    return np.cumsum(steps[:-1]) > 0


def _keyed(hashes: np.ndarray, more: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, state) of rows of a slice: only one row of those alike has their hash as its key."""
    order = np.lexsort((more, hashes))
    h, m = hashes[order], more[order]
    start = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (m[1:] != m[:-1])]) if len(h) else np.zeros(0, np.int64)
    state = np.full(len(hashes), PASSED, np.int32)
    state[order[start]] = np.where(np.diff(np.r_[start, len(h)]) > 1, REPEATED, ONCE)
    return np.where(state == PASSED, mix(hashes + at.astype(U)), hashes).view(np.int64), state


def _small(hashes: np.ndarray) -> np.ndarray:
    return (hashes & LOW).astype(np.int32)


def _places(lengths: list[int], level: int, refining: bool):
    """A row for each place that stands for candidate windows at a level: as operator 1's.

    refining: rows have ranges of candidate windows and, beyond the first refinement, the places of the level before that
    are alive (at).
    """
    window, length = lengths[-1], lengths[level]

    @common.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in slices(batch.column("text")):
                n = len(data) - window + 1
                candidate = _inside(offsets, window, n) if n > 0 else np.zeros(0, bool)
                if not candidate.any():
                    continue
                ids = first = grams(data, lengths[0])
                if refining:
                    candidate &= _covered(batch.column("ranges").slice(lo, hi - lo), offsets, n)
                    for k in range(1, level + 1):
                        if k == level and level > 1:
                            alive = _marked(batch.column("at").slice(lo, hi - lo), offsets, len(data))
                            candidate &= alive[_chosen(ids, lengths[k - 1], window)]
                        ids = refined(ids, lengths[k] - lengths[k - 1])
                places = np.unique(_chosen(ids, length, window)[candidate]) if length < window else np.flatnonzero(candidate)
                if not len(places):
                    continue
                more = _small(refined_at(first, lengths, places, 1)) if length == window else np.zeros(len(places), np.int32)
                key, state = _keyed(ids[places], more, places)
                row = np.searchsorted(offsets, places, "right") - 1
                rids = batch.column("rid").slice(lo, hi - lo).take(pa.array(row))
                columns = [pa.array(key), pa.array(more), rids, pa.array((places - offsets[row]).astype(np.int32)), pa.array(state)]
                yield pa.RecordBatch.from_arrays(columns, ["k", "more", "rid", "pos", "state"])

    return run


def _blocks(lengths: list[int]):
    """A row for each block whose place is alive: identifiers of its content, its q-gram, rid, first window, their number."""
    q, window = lengths[0], lengths[-1]

    @common.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in slices(batch.column("text")):
                n = len(data) - window + 1
                inside = _inside(offsets, window, n) if n > 0 else np.zeros(0, bool)
                if not inside.any():
                    continue
                ids = grams(data, q)
                place = np.where(inside, _chosen(ids, q, window), -1)
                start = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
                size = np.diff(np.r_[start, n])
                alive = _marked(batch.column("at").slice(lo, hi - lo), offsets, len(data))
                keep = (place[start] >= 0) & alive[place[start]]
                start, size = start[keep], size[keep]
                if not len(start):
                    continue
                place = place[start]
                shape = mix(((place - start) * (2 * window) + size).astype(U))
                k, more = (
                    mix((refined_at(ids, lengths, start, f) * FAMILIES[f] + refined_at(ids, lengths, start + size - 1, f)) ^ shape) for f in (0, 1)
                )
                key, state = _keyed(k, _small(more), start)
                row = np.searchsorted(offsets, start, "right") - 1
                rids = batch.column("rid").slice(lo, hi - lo).take(pa.array(row))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(key), pa.array(_small(more)), pa.array(ids[place].view(np.int64)), rids,
                        pa.array((start - offsets[row]).astype(np.int32)), pa.array(size.astype(np.int32)), pa.array(state),
                    ],
                    ["k", "more", "gram", "rid", "pos", "n", "state"],
                )

    return run


@common.lean
def _kinds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """gram, rid, pos, n and kind of blocks, sorted by k and more. A run of one content over many batches is never held."""
    held = known = None

    def told(batch: pa.RecordBatch, kind: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*map(batch.column, ("gram", "rid", "pos", "n")), pa.array(kind)], ["gram", "rid", "pos", "n", "kind"])

    for batch in batches:
        if not batch.num_rows:
            continue
        if held is not None:
            batch = pa.concat_batches([held, batch])
        k, more, state = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("k", "more", "state"))
        own = state != PASSED
        new = np.r_[True, (k[1:] != k[:-1]) | (more[1:] != more[:-1])]
        run, start = np.cumsum(new) - 1, np.flatnonzero(new)
        goes_on = known == (k[0], more[0])
        many = (np.bincount(run, own) > 1) | np.logical_or.reduceat(state == REPEATED, start)
        many[0] |= goes_on
        kind = np.where(own & ~many[run], ALONE, SETTLED).astype(np.int32)
        owned = np.flatnonzero(own)
        first = owned[np.r_[True, run[owned][1:] != run[owned][:-1]]] if len(owned) else owned
        first = first[many[run[first]] & ((run[first] > 0) | (not goes_on))]
        kind[first] = FIRST
        known = (k[-1], more[-1]) if many[-1] else None
        last = np.flatnonzero(own[start[-1] :])
        held, keep = None, np.ones(len(k), bool)
        if not many[-1] and len(last):
            at = int(start[-1] + last[0])
            held, keep[at] = batch.slice(at, 1), False
        out = told(batch, kind)
        yield out.filter(pa.array(keep))
    if held is not None:
        yield told(held, np.full(1, ALONE, np.int32))


def _packed(name: str, pairs: bool):
    """rid and the rows' numbers (found: places, or structs of a first place and a number), sorted, as 32-bit numbers."""

    @common.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, out = batch.column("found"), []
            offsets, values = lists.offsets.to_numpy(), lists.values
            columns = [c.to_numpy(zero_copy_only=False) for c in (values.flatten() if pairs else [values])]
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                order = np.argsort(columns[0][a:b], kind="stable")
                out.append(np.stack([c[a:b][order] for c in columns], axis=1).astype(np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("rid"), pa.array(out, pa.binary())], ["rid", name])

    return run


def _spans(window: int):
    """rid and the removed bytes (packed starts and ends) of rows rid, found (structs of a first window and their number)."""

    @common.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, out = batch.column("found"), []
            offsets = lists.offsets.to_numpy()
            pos, size = (c.to_numpy(zero_copy_only=False).astype(np.int64) for c in lists.values.flatten())
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                order = np.argsort(pos[a:b], kind="stable")
                start = pos[a:b][order]
                end = np.maximum.accumulate(start + size[a:b][order] - 1 + window)
                new = np.flatnonzero(np.r_[True, start[1:] > end[:-1]])
                out.append(np.stack([start[new], end[np.r_[new[1:] - 1, b - a - 1]]], axis=1).astype(np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("rid"), pa.array(out, pa.binary())], ["rid", "spans"])

    return run


def _bytes(*columns: str) -> Column:
    """Of a row with packed numbers in memory."""
    return sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in columns), F.lit(112))


class _Texts:
    """Texts (rid, text) to be joined with small tables by rid. A table beyond the measure of a broadcast is shuffled; for
    that the texts are dealt out by rid once and kept so on disk. What a lost executor held is made again."""

    def __init__(self, texts: DataFrame):
        self.texts, self.dealt = texts, False

    def with_(self, table: DataFrame, *columns: str) -> DataFrame:
        if common.fits(table, _bytes(*columns)):
            return self.texts.join(F.broadcast(table), "rid")
        if not self.dealt:
            self.texts, self.dealt = self.texts.repartition("rid").persist(StorageLevel.DISK_ONLY), True
        return self.texts.join(table.hint("shuffle_hash"), "rid")

    def done(self) -> None:
        if self.dealt:
            self.texts.unpersist()


def _alive(places: DataFrame) -> DataFrame:
    """rid and pos of the places whose bucket holds another."""
    return places.repartition("k").sortWithinPartitions("k", "more").mapInArrow(_repeated, "rid binary, pos int")


def repeated_windows(texts: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """rid, pos and n: ranges of starts of windows of texts (rid, text) that occur twice or more among them."""
    lengths = level_lengths(window, seed)
    held = _Texts(texts)
    pair = F.collect_list(F.struct("pos", "n")).alias("found")

    first = _alive(texts.mapInArrow(_places(lengths, 0, False), PLACES))
    if len(lengths) == 1:
        return first.withColumn("n", F.lit(1))
    kept = first.groupBy("rid").agg(F.collect_list("pos").alias("found")).mapInArrow(_packed("at", False), "rid binary, at binary")
    rows = held.with_(common.saved(kept, "grams"), "at").select("rid", "text", "at")
    blocks = rows.mapInArrow(_blocks(lengths), BLOCKS).repartition("k").sortWithinPartitions("k", "more")
    blocks = common.saved(blocks.mapInArrow(_kinds, "gram long, rid binary, pos int, n int, kind int"), "blocks")
    settled = blocks.where(F.col("kind") != ALONE).select("rid", "pos", "n")

    # A block alone may share windows with another of its bucket: one of each kind that occurs in such buckets goes on too.
    alone = blocks.where(F.col("kind") == ALONE)
    open_ = common.saved(alone.select("gram").distinct(), "buckets")
    others = common.sized_join(blocks.where(F.col("kind") == FIRST), open_, "gram", "inner", 48)
    ranges = alone.unionByName(others).groupBy("rid").agg(pair).mapInArrow(_packed("ranges", True), "rid binary, ranges binary")
    ranges = common.saved(ranges, "ranges")
    waiting = ranges.withColumn("at", F.lit(None).cast("binary"))
    for level in range(1, len(lengths)):
        rows = held.with_(waiting, "ranges", "at").select("rid", "text", "ranges", "at")
        alive = _alive(rows.mapInArrow(_places(lengths, level, True), PLACES))
        if level == len(lengths) - 1:
            alive = common.saved(alive, "windows")
            break
        kept = alive.groupBy("rid").agg(F.collect_list("pos").alias("found")).mapInArrow(_packed("at", False), "rid binary, at binary")
        waiting = common.saved(ranges.join(kept, "rid"), f"level{lengths[level]}")
        if waiting.isEmpty():
            alive = None
            break
    held.done()
    return settled if alive is None else settled.unionByName(alive.select("rid", "pos", F.lit(1).alias("n")))


def _cut(window: int, carry: tuple[str, ...]):
    @common.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(5)]
            spans = batch.column("spans").to_pylist()
            for text, copied, packed in zip(batch.column("text"), batch.column("copied"), spans, strict=True):
                data = text.as_buffer().to_pybytes() if text.is_valid else b""
                cut = np.frombuffer(packed or b"", np.int32).reshape(-1, 2).tolist()
                if copied.as_py() and len(data) >= window:
                    cut = [[0, len(data)]]
                ends = [0, *[e for _, e in cut]]
                kept = b"".join(data[a:b] for a, b in zip(ends, [*[s for s, _ in cut], len(data)], strict=True))
                for values, x in zip(out, (len(data), len(data) - len(kept), len(cut), hashlib.sha256(kept).hexdigest(), kept), strict=True):
                    values.append(x)
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            columns = [pa.array(x, t) for x, t in zip(out, types, strict=True)]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", *carry]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns, *map(batch.column, carry)], names)

    return run


def remove_repeats(docs: DataFrame, window: int = WINDOW, seed: int = SEED, carry: tuple[str, ...] = ()) -> DataFrame:
    """Remove each byte covered by a string of `window` bytes that also starts anywhere else.

    docs: doc_id, text (taken as UTF-8); other columns are ignored but for those in carry. Returns one row per input row:
    doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256, kept (the remaining bytes, which may end
    within a character) and carry. Null and empty texts have no bytes; null and repeated doc_ids are rows like others;
    texts shorter than the window keep all bytes; equal texts are all removed if they hold a window; an empty table gives
    an empty one. A text may be of any length that a row can have.
    """
    common.prepare(docs.sparkSession)
    rows = common.with_text_ids(docs)
    groups = common.saved(common.copy_groups(rows), "copies")
    windows = repeated_windows(common.one_of_each(rows, groups).select("rid", "text"), window, seed)
    spans = windows.groupBy("rid").agg(F.collect_list(F.struct("pos", "n")).alias("found")).mapInArrow(_spans(window), "rid binary, spans binary")
    facts = spans.join(groups.select("rid", F.lit(True).alias("copied")), "rid", "full")
    facts = common.saved(facts.select("rid", F.coalesce("copied", F.lit(False)).alias("copied"), "spans"), "facts")
    more = ("_carried",) if carry else ()
    held = docs.select("doc_id", "text", *[F.struct(*carry).alias(c) for c in more])  # so that no name clashes
    joined = common.sized_join(common.with_text_ids(held, more), facts, "rid", "left", _bytes("spans"))
    given = joined.select("doc_id", "text", F.coalesce("copied", F.lit(False)).alias("copied"), "spans", *more)
    schema = T.StructType([*T.StructType.fromDDL(KEPT).fields, *[given.schema[c] for c in more]])
    out = given.mapInArrow(_cut(window, more), schema)
    return out.select(*[f for f in out.columns if f not in more], *[f"{c}.*" for c in more])


#: Texts are cut into parts with an overlap first, so that taking strings of them is quick.
PART = 2000
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
parts AS (
  SELECT r, p, substring(x, 2 * p + 1, 2 * ({PART} + {WINDOW - 1})) AS y
  FROM (SELECT r, x, unnest(range(0, length(x) // 2, {PART})) AS p FROM d)),
s AS (
  SELECT r, p + i AS i, md5_number(substring(y, 2 * i + 1, {2 * WINDOW})) AS h
  FROM (SELECT r, p, y, unnest(range(0, least({PART}, length(y) // 2 - {WINDOW - 1}))) AS i FROM parts)),
rep AS (SELECT r, i FROM s JOIN (SELECT h FROM s GROUP BY h HAVING count(*) > 1) USING (h)),
gaps AS (SELECT r, i, i - lag(i) OVER (PARTITION BY r ORDER BY i) > {WINDOW} AS new FROM rep),
runs AS (SELECT r, i, sum(CASE WHEN new THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY i) AS run FROM gaps),
spans AS (SELECT r, min(i) AS a, max(i) + {WINDOW} AS b FROM runs GROUP BY r, run),
ends AS (
  SELECT r, count(*) AS n, sum(b - a) AS removed, list([a, b] ORDER BY a) AS ab FROM spans GROUP BY r),
kept AS (
  SELECT doc_id, length(x) // 2 AS n_bytes, coalesce(removed, 0) AS removed, coalesce(n, 0) AS n,
    CASE WHEN n IS NULL THEN x ELSE array_to_string(list_transform(range(0, CAST(n AS BIGINT) + 1), lambda k:
      substring(x, 2 * (CASE WHEN k = 0 THEN 0 ELSE ab[k][2] END) + 1,
        2 * ((CASE WHEN k = n THEN length(x) // 2 ELSE ab[k + 1][1] END) - (CASE WHEN k = 0 THEN 0 ELSE ab[k][2] END)))), '') END AS y
  FROM d LEFT JOIN ends USING (r))
SELECT doc_id, CAST(n_bytes AS BIGINT) AS n_bytes, CAST(removed AS BIGINT) AS n_removed, CAST(n AS BIGINT) AS n_spans, sha256(unhex(y)) AS kept_sha256
FROM kept
"""


def query(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(common.table(spark, sf_dir, "documents")).drop("kept")
