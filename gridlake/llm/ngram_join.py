"""Operator 8: n-gram Jaccard join in size-banded tiles with hashed bitmap signatures.

Texts with equal shingle sets are one class. Classes meet in tiles: a tile holds the classes that share one key,
in a band of sizes whose ratio the threshold allows. Candidate pairs are then verified: the bit counts of two
hashed bitmaps bound the overlap from above, and pairs that pass get an exact intersection of sorted arrays.

Round A finds most links cheaply: keys are the few smallest shingle hashes, and each class is verified against
one class of its tiles (the one it meets most often), so a group of thousands of near copies costs one pair for
each. Round B makes the result complete: two sets with Jaccard >= t share an element among the first
n - ceil(t n) + 1 of each in any common order, so all these are keys, common shingles last; there only classes that
round A has not connected are paired. Tiles of many classes are cut into blocks of near sizes, and each pair of blocks is
a cell with rows of its own, so that a hot tile spreads over tasks and none holds more than two blocks.

Texts and classes are told apart by 128 bits. Shingles are 64-bit hashes, which matter only within a pair of sets.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .text_hash import U, mix, slices, window_hashes, word_bounds, word_hashes

BITS = 2048
#: Members of one verification tile; larger ones are split, each part with its own copy of the pivot.
TILE = 256
#: A shingle is common if so many classes, and such a share of them, hold it. At most 1 / SHARE times the mean
#: set size of shingles can be common, whatever the number of texts, so their list has a bounded size.
COMMON, SHARE = 64, 1 / 500
#: Shingles that occur so often in one slice of texts, of about so many shingles, are counted over all.
SLICE_SHINGLES = 1_000_000
SLICE_COMMON, SLICE_SHARE = 4, 1 / 200
KEYS = 8
#: Pairs that a task holds before it sums them up.
PAIRS_HELD = 500_000
#: Runs of more classes are compared by bitmaps, SIDE x SIDE at once; only pairs that pass leave the task.
RUN, SIDE = 12, 256
#: Classes of a block of a tile, and rows of one shingle that a task holds before it passes them on.
BLOCK, HELD = 4096, 100_000
#: Common shingles that are told to all tasks at most (the most frequent ones; any list gives the same links).
OFTEN = 1_000_000
#: A pair of sets of n elements must share one more prefix element for every STEP elements; prefixes grow by as many.
STEP = 32


def shingle_sets(texts: pa.Array, n: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first row, sorted distinct shingle hashes of each row) by slices of rows."""
    for lo, _hi, data, offsets in slices(texts):
        starts, ends, first = word_bounds(data, offsets)
        words = word_hashes(data, starts, ends, lower=True)
        hashes = window_hashes(words, n)
        out = []
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if b - a >= n:
                out.append(np.unique(hashes[a : b - n + 1]))
            else:
                out.append(window_hashes(words[a:b], b - a) if b > a else words[:0])
        yield lo, out


def _bands(n: int, threshold: float) -> tuple[int, int]:
    """Two bands of sizes, set off by half a band: sizes within half the allowed ratio share one of them."""
    at = math.log(max(n, 1)) / -math.log(threshold)
    return 2 * math.floor(at), 2 * math.floor(at + 0.5) + 1


def _set_id(s: np.ndarray) -> bytes | None:
    """128-bit digest of a set's sorted hashes; none of the empty set."""
    return hashlib.blake2b(s, digest_size=16).digest() if len(s) else None


def _profiles(n: int, threshold: float):
    """A row for each text (rid, n, set_id, keys, bits) and for each shingle that many texts of one slice hold (shingle, seen)."""
    kinds = {"rid": pa.binary(), "n": pa.int64(), "set_id": pa.binary(), "keys": pa.list_(pa.int64()), "bits": pa.binary(), "shingle": pa.int64(), "seen": pa.int64()}

    def rows(**columns) -> pa.RecordBatch:
        size = len(next(iter(columns.values())))
        return pa.RecordBatch.from_arrays([(columns[c] if isinstance(columns[c], pa.Array) else pa.array(columns[c], kind)) if c in columns else pa.nulls(size, kind) for c, kind in kinds.items()], list(kinds))

    def often(held: list[np.ndarray]) -> pa.RecordBatch:
        value, count = np.unique(np.concatenate(held), return_counts=True)
        many = count >= max(SLICE_COMMON, SLICE_SHARE * len(held))
        return rows(shingle=value[many].view(np.int64), seen=count[many])

    @common.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for lo, sets in shingle_sets(batch.column("text"), n):
                yield rows(
                    rid=batch.column("rid").slice(lo, len(sets)),
                    n=[len(s) for s in sets],
                    set_id=[_set_id(s) for s in sets],
                    keys=[[int(x) for band in _bands(len(s), threshold) for x in mix(s[:KEYS] + U(band)).view(np.int64)] for s in sets],
                    bits=[bitmap(s, width(len(s))).tobytes() for s in sets],
                )
                held += sets
                size += sum(map(len, sets))
                if size >= SLICE_SHINGLES:
                    yield often(held)
                    held, size = [], 0
        if held:
            yield often(held)

    return run


def _members(n: int):
    """A row for each tile that a text stands in, with its set."""

    @common.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tiles = batch.column("tiles").to_pylist()
            nodes = batch.column("node").to_numpy(zero_copy_only=False)
            for lo, sets in shingle_sets(batch.column("text"), n):
                rows = [(t["tile"], t["part"], t["member"], nodes[lo + i], s.tobytes()) for i, s in enumerate(sets) for t in tiles[lo + i]]
                for at in range(0, len(rows), 2000):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(list(x), kind) for x, kind in zip(zip(*rows[at : at + 2000], strict=True), (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary()), strict=True)],
                        ["tile", "part", "member", "node", "set"],
                    )

    return run


def width(n: int) -> int:
    """Bits of the signature of n elements; few, and each wider one folds into the narrower ones."""
    return BITS if n < BITS // 2 else 4 * BITS if n < 2 * BITS else 16 * BITS


def bitmap(s: np.ndarray, bits: int) -> np.ndarray:
    """Each element flips one bit."""
    at = (s >> U(64 - bits.bit_length() + 1)).astype(np.int64)
    return np.packbits(np.bincount(at, minlength=bits).astype(np.uint8) & 1).view(U)


def folded(signature: bytes, bits: int) -> np.ndarray:
    """The signature of the same set at fewer bits: neighbouring bits are added up without carry."""
    if len(signature) * 8 == bits:
        return np.frombuffer(signature, U)
    own = np.unpackbits(np.frombuffer(signature, np.uint8)).reshape(bits, -1)
    return np.packbits(np.bitwise_xor.reduce(own, axis=1)).view(U)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * |a & b| >= percent * |a | b|, the exact count only where size and bit counts allow it."""
    total, least = len(a) + len(b), min(len(a), len(b))
    if 100 * least < percent * max(len(a), len(b)):
        return False
    bits = width(least)
    bound = (total - int(np.bitwise_count(bitmap(a, bits) ^ bitmap(b, bits)).sum())) // 2  # each differing bit is an unshared element
    if (100 + percent) * bound < percent * total:
        return False
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return (100 + percent) * shared >= percent * total


def _bounded(percent: int):
    """Pairs whose bit counts allow the overlap they need."""

    @common.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            n, m = (batch.column(c).to_numpy() for c in ("n_a", "n_b"))
            total, differ = n + m, np.zeros(len(n), np.int64)
            for i, (x, y, least) in enumerate(zip(batch.column("bits_a").to_pylist(), batch.column("bits_b").to_pylist(), np.minimum(n, m).tolist(), strict=True)):
                differ[i] = np.bitwise_count(folded(x, width(least)) ^ folded(y, width(least))).sum()
            bound = (total - differ) // 2
            good = pa.array((100 + percent) * bound >= percent * total)
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(good) for c in ("a", "b")], ["a", "b"])

    return run


def _verify(percent: int):
    @common.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile = pivot = None
        for batch in batches:
            a, b = [], []
            sets = batch.column("set")
            for i, (t, part, member, node) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("tile", "part", "member", "node")), strict=True)):
                s = np.frombuffer(sets[i].as_buffer(), U)
                if not member:
                    tile, pivot = (t, part), s.copy()
                elif tile == (t, part) and linked(pivot, s, percent):
                    a.append(t)
                    b.append(node)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def verified(pairs: DataFrame, classes: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (a, b) of classes that link. Each class's set is made anew from its text and shuffled once a tile."""
    pairs = common.saved(pairs.withColumn("part", F.lit(0)), "pairs")
    parts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("parts"))
    inside = pairs.join(parts, "a").select("a", "b", F.pmod(F.xxhash64("a", "b"), F.col("parts")).cast("int").alias("part"))
    inside = common.saved(inside, "tiles")
    stands = inside.select(F.col("b").alias("node"), F.struct(F.col("a").alias("tile"), "part", F.lit(1).alias("member")).alias("t")).unionByName(
        inside.select(F.col("a").alias("node"), F.struct(F.col("a").alias("tile"), "part", F.lit(0).alias("member")).alias("t")).distinct()
    )
    needed = stands.groupBy("node").agg(F.collect_list("t").alias("tiles")).join(classes.select("node", "rid"), "node")
    needed = common.saved(needed, "needed")
    return (
        common.sized_join(texts, needed, "rid", "inner", 96 + 48 * F.size("tiles"))
        .select("text", "node", "tiles")
        .mapInArrow(_members(n), "tile long, part int, member int, node long, set binary")
        .repartition("tile", "part")
        .sortWithinPartitions("tile", "part", "member")
        .mapInArrow(_verify(percent), "a long, b long")
    )


def least_shared(n):
    """Elements that the prefixes of two sets that link share at least, n: size of the smaller."""
    return 1 + n // STEP


def prefix_size(n, percent: int):
    """n - ceil(t n) + least_shared(n), at most n."""
    return np.minimum(n, n - -(-percent * n // 100) + least_shared(n))


def needed(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """Prefix elements that sets of n and m elements (n <= m) share if they link.

    Elements they share are in both prefixes or behind the prefix that ends first, so no more than the longer rest adds
    to those that the prefixes share.
    """
    overlap = -(-percent * (n + m) // (100 + percent))
    rest = np.maximum(n - prefix_size(n, percent), m - prefix_size(m, percent))
    return np.maximum(least_shared(n), overlap - rest)


def _prefixes(n: int, percent: int, often: np.ndarray):
    """Each class with its prefix: hashes in ascending order, common shingles after all others."""

    @common.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes = batch.column("node")
            for lo, sets in shingle_sets(batch.column("text"), n):
                out = []
                for s in sets:
                    k = int(prefix_size(len(s), percent))
                    if len(often):
                        spot = np.minimum(np.searchsorted(often, s), len(often) - 1)
                        last = often[spot] == s
                        s = np.concatenate([s[~last][:k], s[last][:k]])
                    out.append(s[:k])
                ends = np.cumsum([0, *map(len, out)]).astype(np.int32)
                prefix = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*out, np.zeros(0, U)]).view(np.int64)))
                yield pa.RecordBatch.from_arrays([nodes.slice(lo, len(sets)), pa.array([len(s) for s in sets], pa.int32()), prefix], ["node", "n", "prefix"])

    return run


PAIRS = "a long, b long, need long, met long, k long, n int, node long, comp long"


def _runs(batches: Iterator[pa.RecordBatch], columns: int, most: int | None = None) -> Iterator[tuple[list[np.ndarray], bool]]:
    """The first columns of rows sorted by the first one, in pieces that do not cut its runs; and False.

    Where most is given, a run that grows beyond it comes in pieces of its own, as they arrive; and True.
    """
    held, open_ = None, None
    for batch in batches:
        cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(columns)]
        if open_ is not None and len(cols[0]):
            more = int(np.searchsorted(cols[0], open_, "right"))
            if more:
                yield [x[:more] for x in cols], True
                cols = [x[more:] for x in cols]
        if not len(cols[0]):
            continue
        open_ = None
        if held is not None:
            cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
        last = int(np.searchsorted(cols[0], cols[0][-1], "left"))
        if last:
            yield [x[:last] for x in cols], False
        held = [x[last:].copy() for x in cols]
        if most is not None and len(held[0]) > most:
            open_ = held[0][0]
            yield held, True
            held = None
    if held is not None:
        yield held, False


def cells(members: DataFrame, percent: int) -> DataFrame:
    """members (k, n, comp, node) of tiles dealt to cells: cell, side, n, comp, node.

    A tile of at most BLOCK classes is one cell. A larger one is cut into bands of sizes, so wide that classes that link
    are in the same or in neighbouring bands, and a band into blocks by a hash; a cell is a pair of blocks (side 1 and 2)
    or a block with itself (side 3). Tiles of a single component have no pair to find and are left out.
    """
    members = members.withColumn("band", F.floor(F.log("n") / (math.log(100 / percent) * 1.0001)).cast("int"))
    bands = members.groupBy("k", "band").agg(F.count(F.lit(1)).alias("m"), F.min("comp").alias("least"), F.max("comp").alias("most"))
    tiles = bands.groupBy("k").agg(F.sum("m").alias("all"), F.min("least").alias("least"), F.max("most").alias("most"), F.map_from_entries(F.collect_list(F.struct("band", F.ceil(F.col("m") / BLOCK).cast("int")))).alias("parts"))
    tiles = common.saved(tiles.where("least < most").select("k", F.when(F.col("all") > BLOCK, F.col("parts")).alias("parts")), "tiles")
    placed = common.sized_join(members, tiles, "k", "inner", 64 + 16 * F.coalesce(F.size("parts"), F.lit(0)))
    placed = placed.withColumn("x", F.pmod(F.xxhash64("node"), F.try_element_at("parts", F.col("band"))).cast("int"))
    blocks = lambda band: F.when(F.try_element_at("parts", band).isNotNull(), F.sequence(F.lit(0), F.try_element_at("parts", band) - 1)).otherwise(F.array())
    cell = lambda a, x, b, y, side: F.struct(F.xxhash64("k", a, x, b, y).alias("cell"), side.alias("side"))
    b, x = F.col("band"), F.col("x")
    own = F.transform(blocks(b), lambda y: cell(b, F.least(x, y), b, F.greatest(x, y), F.when(x == y, 3).when(x < y, 1).otherwise(2)))
    above = F.transform(blocks(b + 1), lambda y: cell(b, x, b + 1, y, F.lit(1)))
    below = F.transform(blocks(b - 1), lambda y: cell(b - 1, y, b, x, F.lit(2)))
    whole = F.array(F.struct(F.xxhash64("k").alias("cell"), F.lit(3).alias("side")))
    dealt = placed.select("n", "comp", "node", F.explode(F.when(F.col("parts").isNull(), whole).otherwise(F.concat(own, above, below))).alias("c"))
    return dealt.select("c.cell", "c.side", "n", "comp", "node")


def _cells(percent: int):
    """Pairs of unconnected classes in cells (cell, n, side, comp, node, bits) whose bit counts allow the overlap they need.

    SIDE classes by SIDE others are compared at once.
    """

    def pieces(n: np.ndarray, lo: int, hi: int) -> Iterator[tuple[int, int, int]]:
        """(start, end, width) of pieces of lo .. hi of at most SIDE classes whose signatures are equally wide."""
        while lo < hi:
            size, end = width(int(n[lo])), lo + 1
            while end < min(lo + SIDE, hi) and width(int(n[end])) == size:
                end += 1
            yield lo, end, size
            lo = end

    def compare(a, b, same: bool) -> Iterator[pa.RecordBatch]:
        """a, b: (n, comp, node, bits), each sorted by n; same: a is b, and each pair is met once."""
        n, m = a[0], b[0]
        low, high = np.searchsorted(m, -(-n * percent // 100), "left"), np.searchsorted(m, n * 100 // percent, "right")
        for lo, hi, wide in pieces(n, 0, len(n)):
            left: dict[int, np.ndarray] = {}
            for at, to, other in pieces(m, lo if same else int(low[lo]), int(high[hi - 1])):
                size = min(wide, other)
                if size not in left:
                    left[size] = np.stack([folded(x, size) for x in a[3][lo:hi]])
                right = np.stack([folded(x, size) for x in b[3][at:to]])
                total = n[lo:hi][:, None] + m[at:to]
                differ = np.zeros(total.shape, np.int64)
                for word in range(size // 64):
                    differ += np.bitwise_count(left[size][:, word][:, None] ^ right[:, word])
                good = ((100 + percent) * ((total - differ) // 2) >= percent * total) & (a[1][lo:hi][:, None] != b[1][at:to])
                if same:
                    good &= np.arange(at, to) > np.arange(lo, hi)[:, None]
                i, j = np.nonzero(good)
                if len(i):
                    x, y = a[2][lo + i], b[2][at + j]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["a", "b"])

    @common.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (key, n, side, *rest), _ in _runs(batches, 6):
            start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            for lo, hi in zip(start.tolist(), [*start[1:].tolist(), len(key)], strict=True):
                cols = [x[lo:hi] for x in (n.astype(np.int64), *rest)]
                of = side[lo:hi]
                if (of == 3).all():
                    yield from compare(cols, cols, True)
                else:
                    yield from compare(*([x[of == half] for x in cols] for half in (1, 2)), False)

    return run


def _pairs(percent: int):
    """Pairs of unconnected classes in the runs of one key (k, n, node, comp); members of large runs are passed on.

    A large run becomes part of the tile of its smallest class (k), so that classes that meet in many runs meet in few tiles;
    one too large to be held becomes a tile of its own.
    """
    kinds = {c: pa.int32() if c == "n" else pa.int64() for c in ("a", "b", "need", "met", "k", "n", "node", "comp")}

    def in_run(n, node, comp) -> tuple[list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
        a, b, need = [], [], []
        n = n.astype(np.int64)
        reach = np.searchsorted(n, n * 100 // percent, "right")
        for i in range(len(n) - 1):
            j = slice(i + 1, reach[i])
            apart = comp[j] != comp[i]
            if apart.any():
                other, m = node[j][apart], n[j][apart]
                a.append(np.minimum(other, node[i]))
                b.append(np.maximum(other, node[i]))
                need.append(needed(np.full(len(m), n[i]), m, percent))
        return a, b, need

    def flush(cols, found) -> Iterator[pa.RecordBatch]:
        key, n, node, comp = cols
        start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        end = np.r_[start[1:], len(key)]
        mixed = np.minimum.reduceat(comp, start) != np.maximum.reduceat(comp, start)
        large = mixed & (end - start > RUN)
        if large.any():
            here = np.repeat(large, end - start)
            tile = np.repeat(np.minimum.reduceat(node, start), end - start)
            yield rows(k=tile[here], n=n[here], node=node[here], comp=comp[here])
        mixed &= ~large
        for lo, hi in zip(start[mixed].tolist(), end[mixed].tolist(), strict=True):
            for gathered, more in zip(found[:3], in_run(n[lo:hi], node[lo:hi], comp[lo:hi]), strict=True):
                gathered += more
                found[3] += sum(map(len, more))
            if found[3] > PAIRS_HELD:
                yield out(found)

    def rows(**columns) -> pa.RecordBatch:
        size = len(next(iter(columns.values())))
        return pa.RecordBatch.from_arrays([pa.array(columns[c], kind) if c in columns else pa.nulls(size, kind) for c, kind in kinds.items()], list(kinds))

    def out(found) -> pa.RecordBatch:
        """What has gathered, one row a pair with the number of keys that it met in."""
        a, b, need = map(np.concatenate, found[:3])
        found[:] = [], [], [], 0
        order = np.lexsort((b, a))
        a, b, need = a[order], b[order], need[order]
        new = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
        return rows(a=a[new], b=b[new], need=need[new], met=np.diff(np.r_[new, len(a)]))

    @common.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [[], [], [], 0]
        for cols, part in _runs(batches, 4, HELD):
            if part:
                yield rows(**dict(zip(("k", "n", "node", "comp"), cols, strict=True)))
            else:
                yield from flush(cols, found)
        if found[3]:
            yield out(found)

    return run


def placed(docs: DataFrame, n: int = 5, percent: int = 75) -> DataFrame:
    """A row per row of docs: doc_id, rid (its text's id), n_shingles and comp, which linked documents share (null where
    the set is empty)."""
    rows = common.with_text_ids(docs)
    groups = common.saved(common.copy_groups(rows), "copies")
    texts = common.one_of_each(rows, groups).select("rid", "text")
    found = common.saved(texts.mapInArrow(_profiles(n, percent / 100), "rid binary, n long, set_id binary, keys array<long>, bits binary, shingle long, seen long"), "profiles")
    profiles = found.where("rid is not null")
    classes = profiles.where("n > 0").groupBy("set_id").agg(F.min("rid").alias("rid"), *[F.first(c).alias(c) for c in ("n", "keys", "bits")])
    classes = common.saved(classes.withColumn("node", F.monotonically_increasing_id()), "classes")

    keyed = classes.select("node", "n", F.explode("keys").alias("k"))
    # What is found by key is saved before it is joined: a join of its own can be broadcast or split where a key is hot.
    sizes = common.saved(keyed.groupBy("k").agg(F.count(F.lit(1)).alias("m")).where("m > 1"), "sizes")
    keyed = common.saved(common.sized_join(keyed, sizes, "k", "inner", 32), "keyed")
    central = keyed.groupBy("node").agg(F.sum("m").alias("weight"))
    pivots = common.saved(keyed.join(central, "node").groupBy("k").agg(F.max(F.struct("weight", "node")).alias("p")).select("k", F.col("p.node").alias("a")), "pivots")
    votes = common.sized_join(keyed, pivots, "k", "inner", 32).where("a <> node").groupBy("node", "a").count()
    best = votes.groupBy("node").agg(F.max(F.struct("count", "a")).alias("v"))
    links = common.saved(verified(best.select(F.col("v.a").alias("a"), F.col("node").alias("b")), classes, texts, n, percent), "links")
    comps = common.components(links)

    total = classes.count()
    often = found.where("rid is null").groupBy("shingle").agg(F.sum("seen").alias("c")).where(F.col("c") >= max(COMMON, SHARE * total))
    often = np.sort(np.array([r[0] for r in often.orderBy(F.desc("c"), "shingle").limit(OFTEN).select("shingle").collect()], np.int64).view(U))
    prefixes = common.sized_join(texts, classes.select("rid", "node"), "rid", "inner", 56).select("node", "text").mapInArrow(_prefixes(n, percent, often), "node long, n int, prefix array<long>")
    prefixes = prefixes.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    postings = prefixes.select(F.explode("prefix").alias("k"), "n", "node", "comp")
    met = common.saved(postings.repartition("k").sortWithinPartitions("k", "n").mapInArrow(_pairs(percent), PAIRS), "met")
    few = met.where("k is null").groupBy("a", "b").agg(F.sum("met").alias("shared"), F.max("need").alias("need")).where("shared >= need").select("a", "b")
    side = lambda x: classes.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("bits").alias(f"bits_{x}"))
    few = few.join(side("a"), "a").join(side("b"), "b").mapInArrow(_bounded(percent), "a long, b long")
    many = cells(common.saved(met.where("k is not null").select("k", "n", "comp", "node").distinct(), "members"), percent)
    many = many.join(classes.select("node", "bits"), "node").select("cell", "n", "side", "comp", "node", "bits")
    many = many.repartition("cell").sortWithinPartitions("cell", "n").mapInArrow(_cells(percent), "a long, b long")
    rest = few.unionByName(many).distinct()
    links = links.unionByName(verified(rest, classes, texts, n, percent))
    comps = common.components(links)

    member = profiles.groupBy("rid").agg(F.first("n").alias("n_shingles"), F.first("set_id").alias("set_id"))
    member = common.sized_join(member, classes.select("set_id", "node"), "set_id", "left", 56)
    member = common.saved(member.join(comps, "node", "left").select("rid", "n_shingles", F.coalesce("comp", "node").alias("comp")), "member")
    return common.saved(common.sized_join(rows.select("doc_id", "rid"), member, "rid", "inner", 64).select("doc_id", "rid", "n_shingles", "comp"), "placed")


def jaccard_classes(docs: DataFrame, n: int = 5, percent: int = 75) -> DataFrame:
    """Documents with their near-duplicate component.

    docs: doc_id, text; other columns are ignored. Words are runs of bytes other than white space, A-Z lower-cased;
    a document's set is its distinct n-word shingles (with fewer words: the whole sequence). Two documents link when
    100 * intersection >= percent * union. Returns one row per input row: doc_id, n_shingles, component_id (the
    smallest doc_id reachable by links; its own where the set is empty: null and blank texts link with nothing).
    Null doc_ids never are a component_id unless a whole component has no other. An empty table gives an empty one.
    """
    found = placed(docs, n, percent)
    least = found.where("comp is not null").groupBy("comp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("m"))
    least = common.saved(least.where("m > 1").select("comp", "least"), "least")
    return common.sized_join(found, least, "comp", "left", 32).select("doc_id", "n_shingles", F.coalesce("least", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, n: int = 5, percent: int = 75) -> DataFrame:
    """docs, all columns, with one row of each group of linked documents: that of the smallest doc_id (null last), then of
    the smallest text id; of rows that repeat both, any one.

    Documents with empty sets (null and blank texts) link with nothing and stay, as often as they stand there.
    """
    found = placed(docs, n, percent)
    order = F.struct(F.col("doc_id").isNull().alias("x"), "doc_id", "rid")
    groups = found.where("comp is not null").groupBy("comp").agg(F.count(F.lit(1)).alias("m"), F.min(order).alias("s"))
    groups = common.saved(groups.where("m > 1").select("comp", F.col("s.doc_id").alias("keep_id"), F.col("s.rid").alias("keep_rid")), "groups")
    inside = common.sized_join(found, groups, "comp", "inner", 80)
    stays = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("rid") == F.col("keep_rid"))
    key = F.unhex(F.md5(F.concat_ws(" ", F.col("doc_id").cast("string"), F.hex("rid"))))  # of rows with one doc_id and text
    rows = inside.groupBy("doc_id", "rid", stays.alias("stays")).agg(F.count(F.lit(1)).alias("m"))
    verdicts = common.saved(rows.select(key.alias("_key"), F.when(~F.col("stays"), "goes").when(F.col("m") > 1, "repeats").alias("_verdict")).where("_verdict is not null"), "verdicts")
    name = "_key"
    while name in docs.columns:
        name += "_"
    mark = name + "verdict"
    whole = docs.withColumn(name, F.unhex(F.md5(F.concat_ws(" ", F.col("doc_id").cast("string"), F.hex(common.text_id(F.col("text")))))))
    judged = common.sized_join(whole, verdicts.toDF(name, mark), name, "left", 64)
    out = judged.where(F.col(mark).isNull())
    if not verdicts.where("_verdict = 'repeats'").isEmpty():
        out = out.unionByName(judged.where(F.col(mark) == "repeats").dropDuplicates([name]))
    return out.select(*docs.columns)


ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END)) AS g FROM d),
c AS (SELECT g, min(doc_id) AS r, len(g) AS n FROM s WHERE len(g) > 0 GROUP BY g),
e AS (SELECT r, n, unnest(g) AS x FROM c),
o AS (SELECT a.r AS p, b.r AS q, count(*) AS k, any_value(a.n) + any_value(b.n) AS t FROM e a JOIN e b ON a.x = b.x AND a.r < b.r GROUP BY 1, 2),
l AS (SELECT p, q FROM o WHERE 100 * k >= 75 * (t - k)),
u AS (SELECT p, q FROM l UNION ALL SELECT q, p FROM l),
v AS (SELECT r, r AS m FROM c UNION SELECT u.q, v.m FROM v JOIN u ON u.p = v.r),
m AS (SELECT r, min(m) AS m FROM v GROUP BY r)
SELECT s.doc_id, CAST(len(s.g) AS BIGINT) AS n_shingles, coalesce(m.m, s.doc_id) AS component_id FROM s LEFT JOIN c ON s.g = c.g LEFT JOIN m USING (r)
"""


def query(spark, sf_dir: str) -> DataFrame:
    return jaccard_classes(common.table(spark, sf_dir, "documents"))
