"""Operator 11: a Merkle manifest of a dataset, with a proof for every row.

Each group's leaves are dealt to partitions by ranges and indexed: place in the partition behind the rows of the group
in the partitions before it. A partition goes through its leaves with a mountain-range stack: as in counting in base
`fanout`, each completed run of nodes carries into their parent, and what is completed leaves as a node record. A
partition rarely starts or ends where a node does, so some peaks of its range wait for neighbours. Those alone, some for
each level and partition, are merged by the same stack over ever longer spans of partitions. The last run of a level may
be short and is hashed as it is, without padding.

A proof needs, besides the nodes over the partition's own leaves, only those that touch the edges of its span: these are
looked up among the records, some for each level.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

FANOUT = 3
#: Leaves of a partition on average, at most; a partition's leaves are held together while it proves them.
LEAVES = 1 << 16
#: Partitions whose peaks are merged together.
SPAN = 1024
#: monotonically_increasing_id() is the partition's number above this many bits, and the row's place in it.
PLACE_BITS = 33
NODES = "grp string, n long, level int, idx long, digest binary, part long, peak boolean"
PROOFS = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


class Tree(NamedTuple):
    """indexed: grp, part, idx (in the group), n (leaves of the group) and the given columns; runs: grp, part, start, stop, n;
    nodes: records of all nodes above the leaves; roots: grp, digest."""

    indexed: DataFrame
    runs: DataFrame
    nodes: DataFrame
    roots: DataFrame


def digest(parts: list[Column]) -> Column:
    """Digest of the parts, each `-` if null, else its UTF-8 byte count, a colon and itself."""
    texts = [p.cast("string") for p in parts]
    written = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.unhex(F.sha2(F.concat(*written), 256))


def group_key(source: Column) -> Column:
    """A text that is never null and is ordered as source is, null first."""
    return F.coalesce(F.concat(F.lit("s"), source), F.lit(""))


def leaves(docs: DataFrame, tampered_text: Column) -> DataFrame:
    """grp, doc_id, digest and tampered (the digest with the tampered text, null where that is the text) of each row."""
    columns = lambda text: digest([F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text])
    rows = docs.select("doc_id", "source", "lang", "n_chars", "text", tampered_text.alias("other"))
    changed = F.when(F.col("other") != F.col("text"), columns(F.col("other")))
    return rows.select(group_key(F.col("source")).alias("grp"), "doc_id", columns(F.col("text")).alias("digest"), changed.alias("tampered"))


def _indexed(rows: DataFrame, order: list[str], most: int) -> tuple[DataFrame, DataFrame]:
    """rows with part, idx and n, and the runs: what each partition has of each group."""
    spark = rows.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows.count() / most))
    keys = ["grp", *order, "_row"]  # rows that are equal up to here are alike; the last key keeps many of them apart
    placed = rows.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    placed = common.saved(placed.drop("_row").withColumn("_at", F.monotonically_increasing_id()), "placed")
    placed = placed.withColumns({"part": F.shiftright("_at", PLACE_BITS), "_at": F.col("_at").bitwiseAND((1 << PLACE_BITS) - 1)})
    counts = placed.groupBy("grp", "part").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    group = Window.partitionBy("grp")
    before = F.coalesce(F.sum("_n").over(group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = common.saved(counts.select("grp", "part", "_n", "_first", before.alias("start"), F.sum("_n").over(group).alias("n")), "runs")
    size = 96 + F.octet_length("grp")
    joined = common.sized_join(placed, runs.drop("_n"), ["grp", "part"], "inner", size)
    indexed = joined.withColumn("idx", F.col("start") + F.col("_at") - F.col("_first")).drop("_at", "_first", "start")
    return indexed, runs.select("grp", "part", "start", (F.col("start") + F.col("_n")).alias("stop"), "n")


def _sha(children: list[bytes]) -> bytes:
    """Digest of digests, as hex text."""
    return hashlib.sha256("".join(d.hex() for d in children).encode()).digest()


class Range:
    """The mountain range over consecutive nodes of one group with n leaves."""

    def __init__(self, group: str, n: int, fanout: int):
        self.group, self.n, self.fanout = group, n, fanout
        self.stack: list[tuple[int, int, bytes]] = []
        self.ends: int | None = None

    def follows(self, group: str, level: int, idx: int) -> bool:
        return group == self.group and self.ends in (None, idx * self.fanout**level)

    def push(self, level: int, idx: int, node: bytes) -> list[tuple[int, int, bytes]]:
        """Add the next node and carry. Returns the nodes whose parents that completes."""
        done = []
        self.ends = min((idx + 1) * self.fanout**level, self.n)
        while True:
            self.stack.append((level, idx, node))
            width = -(-self.n // self.fanout**level)
            have = idx % self.fanout + 1
            if width == 1 or (have < self.fanout and idx < width - 1):
                return done
            run = self.stack[-have:]
            if len(run) < have or run[0][:2] != (level, idx - have + 1):
                return done  # the run began in an earlier span
            del self.stack[-have:]
            done += run
            level, idx, node = level + 1, idx // self.fanout, _sha([d for _, _, d in run])


def _climb(fanout: int):
    """Nodes above those given (grp, n, level, idx, digest, part; sorted by grp and first leaf), and the peaks that are left."""

    @common.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        range_, part = None, 0

        def left() -> None:
            out.extend((range_.group, range_.n, level, idx, d, part, True) for level, idx, d in range_.stack)

        def batch_of() -> pa.RecordBatch:
            columns = zip(*out, strict=True) if out else [[]] * 7
            types = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.bool_()]
            made = pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], ["grp", "n", "level", "idx", "digest", "part", "peak"])
            out.clear()
            return made

        for batch in batches:
            for group, n, level, idx, node, at in zip(*(batch.column(c).to_pylist() for c in ("grp", "n", "level", "idx", "digest", "part")), strict=True):
                if range_ is None or not range_.follows(group, level, idx):
                    if range_ is not None:
                        left()
                    range_ = Range(group, n, fanout)
                part = at
                out.extend((group, n, done, i, d, at, False) for done, i, d in range_.push(level, idx, node) if done)
            yield batch_of()
        if range_ is not None:
            left()
            yield batch_of()

    return run


def _first_leaf(fanout: int) -> Column:
    return F.col("idx") * F.pow(F.lit(float(fanout)), F.col("level")).cast("long")


def build(rows: DataFrame, order: list[str], fanout: int = FANOUT, most: int = LEAVES, span: int = SPAN) -> Tree:
    """The trees over rows (grp, digest and others), one for each grp, its leaves in the given order."""
    if fanout < 2 or span < 2:
        raise ValueError("fanout and span are at least 2")
    indexed, runs = _indexed(rows, order, most)
    given = indexed.select("grp", "n", F.lit(0).alias("level"), "idx", "digest", "part")
    made = common.saved(given.sortWithinPartitions("grp", "idx").mapInArrow(_climb(fanout), NODES), "nodes")
    top = F.pow(F.lit(float(fanout)), F.col("level")) >= F.col("n")
    nodes = made.where(~F.col("peak") | top)
    waiting = made.where(F.col("peak") & ~top)
    while not waiting.isEmpty():
        waiting = waiting.withColumn("part", F.floor(F.col("part") / span)).repartition("grp", "part")
        merged = waiting.withColumn("_first", _first_leaf(fanout)).sortWithinPartitions("grp", "_first").drop("_first", "peak")
        merged = common.saved(merged.mapInArrow(_climb(fanout), NODES), "nodes")
        nodes = nodes.unionByName(merged.where(~F.col("peak") | top))
        waiting = merged.where(F.col("peak") & ~top)
    nodes = nodes.select("grp", "n", "level", "idx", "digest", top.alias("root"))
    return Tree(indexed, runs, nodes, nodes.where("root").select("grp", "n", "digest"))


def _wanted(spans: DataFrame, fanout: int) -> DataFrame:
    """spans (start, stop, n and others) with level and idx of all children of the parents over a span's two ends."""
    powers = F.array(*[F.lit(fanout**k) for k in range(int(62 / math.log2(fanout)) + 1)])
    depth = F.size(F.filter(powers, lambda p: p < F.col("n")))
    at = spans.withColumn("level", F.explode(F.filter(F.sequence(F.lit(0), F.lit(62)), lambda k: k < depth))).withColumn("_p", F.get(powers, F.col("level")))
    last = F.expr(f"(n + _p - 1) div _p - 1")

    def children(leaf: str) -> Column:
        first = F.expr(f"{leaf} div (_p * {fanout}) * {fanout}")
        return F.sequence(first, F.least(last, first + (fanout - 1)))

    return at.withColumn("idx", F.explode(F.array_union(children("start"), children("(stop - 1)")))).drop("_p", "start", "stop", "n")


def _edges(tree: Tree, spans: DataFrame, fanout: int) -> DataFrame:
    """spans with level, idx and digest of the nodes at their edges."""
    wanted = common.saved(_wanted(spans, fanout), "wanted")
    size = 96 + F.octet_length("grp")
    above = common.sized_join(tree.nodes.select("grp", "level", "idx", "digest"), wanted, ["grp", "level", "idx"], "inner", size)
    lowest = tree.indexed.select("grp", "idx", "digest")
    below = common.sized_join(lowest, wanted.where("level = 0"), ["grp", "idx"], "inner", size)
    return above.where("level > 0").unionByName(below)


#: Rows that a partition of leaves is given: nodes of its groups' trees, of the tree over the groups, and the groups' roots.
OWN, UPPER, GROUP = 0, 1, 2


def _prove(fanout: int, root: bytes):
    def siblings(at: int, n: int, node) -> list[tuple[list[bytes], list[bytes]]]:
        """The run's others before and after, level by level."""
        found, level = [], 0
        while n > 1:
            first = at - at % fanout
            found.append(([node(level, i) for i in range(first, at)], [node(level, i) for i in range(at + 1, min(first + fanout, n))]))
            at, n, level = at // fanout, -(-n // fanout), level + 1
        return found

    def levels(start: int, found: list[bytes], n: int) -> list[tuple[int, list[bytes]]]:
        """(first index, digests) at each level of the nodes that stand over these leaves alone."""
        out = [(start, found)]
        while n > 1:
            start, found = out[-1]
            first, end = -(-start // fanout), start + len(found)
            last = end // fanout if end < n else -(-end // fanout)
            out.append((first, [_sha(found[i * fanout - start : (i + 1) * fanout - start]) for i in range(first, last)]))
            n = -(-n // fanout)
        return out

    def run(rows: pa.Table, edges: pa.Table) -> pa.Table:
        rows = rows.sort_by([("grp", "ascending"), ("idx", "ascending")])
        groups, idx, sizes = (rows.column(c).to_pylist() for c in ("grp", "idx", "n"))
        leaf, tampered = rows.column("digest").to_pylist(), rows.column("tampered").to_pylist()
        own, upper, whole = {}, {}, {}
        for kind, group, level, i, d, at, n in zip(*(edges.column(c).to_pylist() for c in ("kind", "grp", "level", "idx", "digest", "at", "up_n")), strict=True):
            if kind == GROUP:
                whole[group] = (d, at, n)
            else:
                (own if kind == OWN else upper)[group, level, i] = d
        subroots, proofs, folds = [], [], []
        begin = 0
        while begin < len(groups):
            group, n = groups[begin], sizes[begin]
            end = begin
            while end < len(groups) and groups[end] == group:
                end += 1
            known = levels(idx[begin], leaf[begin:end], n)

            def node(level: int, i: int, known=known, group=group) -> bytes:
                first, digests = known[level]
                return digests[i - first] if first <= i < first + len(digests) else own[group, level, i]

            subroot, at, n_groups = whole[group]
            above = siblings(at, n_groups, lambda level, i, group=group: upper[group, level, i])
            for k in range(begin, end):
                path = siblings(idx[k], n, node) + above
                proofs.append(hashlib.sha256("".join(d.hex() for two in path for side in two for d in side).encode()).hexdigest())
                folded = leaf[k] if tampered[k] is None else tampered[k]
                for before, after in path:
                    folded = _sha([*before, folded, *after])
                folds.append(folded)
                subroots.append(subroot.hex())
            begin = end
        columns = [
            rows.column("doc_id").cast(pa.int64()),
            pa.array([d.hex() for d in leaf], pa.string()), pa.array(subroots, pa.string()), pa.array([root.hex()] * len(leaf), pa.string()),
            pa.array(proofs, pa.string()), pa.array([d.hex() for d in folds], pa.string()), pa.array([d == root for d in folds], pa.bool_()),
        ]
        return pa.table(columns, [c.split()[0] for c in PROOFS.split(", ")])

    return run


def _trees(docs: DataFrame, tampered_text: Column, fanout: int, most: int, span: int) -> tuple[Tree, Tree]:
    """The trees of the sources, and the tree over their roots."""
    lower = build(common.saved(leaves(docs, tampered_text), "leaves"), ["doc_id", "digest"], fanout, most, span)
    roots = common.saved(lower.roots.select(F.lit("").alias("grp"), F.col("grp").alias("source"), "digest"), "roots")
    return lower, build(roots, ["source"], fanout, most, span)


def manifest(docs: DataFrame, fanout: int = FANOUT, most: int = LEAVES, span: int = SPAN) -> DataFrame:
    """The node records of a dataset: source, level (0: leaves), idx, digest, and scope (`source` or `dataset`).

    docs: doc_id, source, lang, n_chars, text; other columns are ignored. The nodes of scope `dataset` stand over the
    sources' roots (its level 0), null first, then bytewise; the highest is the dataset's root. Null values have a mark
    of their own in a leaf; null and repeated doc_ids are leaves like others (null first, then by digest); an empty table
    gives an empty one.
    """
    lower, upper = _trees(docs, F.col("text"), fanout, most, span)
    source = F.when(F.col("grp") != "", F.substring("grp", 2, 1 << 30))
    hexed = F.lower(F.hex("digest")).alias("digest")
    parts = []
    for tree, scope, name in ((lower, "source", source), (upper, "dataset", F.lit(None).cast("string"))):
        above = tree.nodes.where("level > 0").select("grp", "level", "idx", "digest")
        rows = tree.indexed.select("grp", F.lit(0).alias("level"), "idx", "digest").unionByName(above)
        parts.append(rows.select(name.alias("source"), F.lit(scope).alias("scope"), "level", "idx", hexed))
    return parts[0].unionByName(parts[1])


def proofs(
    docs: DataFrame, tampered_text: Column | None = None, fanout: int = FANOUT, most: int = LEAVES, span: int = SPAN
) -> DataFrame:
    """The proof of each row, and what the row with its text tampered with folds to.

    docs: doc_id, source, lang, n_chars, text; other columns are ignored. Returns one row per input row: doc_id, leaf,
    subroot (of the source), root, proof_sha256 (of the siblings up to the root), folded_root and verified (whether that
    is the root). Null sources are one source, before the others. Null and repeated doc_ids are rows like others: null
    first, then by digest. A lone row's leaf is the root, and its proof is empty. An empty table gives an empty one.
    """
    common.prepare(docs.sparkSession)
    lower, upper = _trees(docs, F.col("text") if tampered_text is None else tampered_text, fanout, most, span)
    root = upper.roots.first()
    if root is None:
        return docs.sparkSession.createDataFrame([], PROOFS)
    places = common.saved(upper.indexed.select("grp", "source", F.col("idx").alias("start"), (F.col("idx") + 1).alias("stop"), "n", "digest"), "places")
    above = _edges(upper, places.drop("digest"), fanout)
    above = above.select(F.col("source").alias("grp"), F.lit(UPPER).alias("kind"), "level", "idx", "digest")
    whole = places.select(
        F.col("source").alias("grp"), F.lit(GROUP).alias("kind"), F.lit(0).alias("level"), F.lit(0).cast("long").alias("idx"),
        "digest", F.col("start").alias("at"), F.col("n").alias("up_n"),
    )
    none = {"at": F.lit(None).cast("long"), "up_n": F.lit(None).cast("long")}
    of_group = above.withColumns(none).unionByName(whole).join(lower.runs.select("grp", "part"), "grp")
    of_part = _edges(lower, lower.runs, fanout).withColumn("kind", F.lit(OWN)).withColumns(none)
    edges = of_part.unionByName(of_group).select("part", "kind", "grp", "level", "idx", "digest", "at", "up_n")
    rows = lower.indexed.select("part", "grp", "idx", "n", "doc_id", "digest", "tampered")
    return rows.groupBy("part").cogroup(edges.groupBy("part")).applyInArrow(_prove(fanout, bytes(root["digest"])), PROOFS)


def _crc_sql() -> tuple[str, str]:
    from .target_sampling import CRC_TABLE, crc_sql

    return CRC_TABLE, crc_sql("CAST(doc_id AS VARCHAR)")


def _leaf_sql(text: str) -> str:
    written = lambda x: f"coalesce(CAST(octet_length(encode({x})) AS VARCHAR) || ':' || {x}, '-')"
    return "sha256(" + " || ".join(map(written, ("CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text))) + ")"


def _oracle() -> str:
    table, crc = _crc_sql()
    tree = lambda name, leaf: f"""{name} AS (
  SELECT g, 0 AS level, i, d, count(*) OVER (PARTITION BY g) AS n FROM {leaf}
  UNION ALL
  SELECT g, level + 1, i // {FANOUT}, sha256(string_agg(d, '' ORDER BY i)), (n + {FANOUT - 1}) // {FANOUT}
  FROM {name} WHERE n > 1 GROUP BY g, level, i // {FANOUT}, n)"""  # noqa: E731
    return f"""
WITH RECURSIVE tab AS ({table}),
x AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce('s' || source, '') AS g, {_leaf_sql("text")} AS d,
    CASE WHEN {crc} % 2 = 0 THEN {_leaf_sql("replace(text, chr(10), '')")} END AS other
  FROM documents, tab),
leaf AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, d) - 1 AS i FROM x),
{tree("low", "leaf")},
sub AS (SELECT g AS source, d, '' AS g, row_number() OVER (ORDER BY encode(g)) - 1 AS i FROM low WHERE n = 1),
{tree("up", "sub")},
top AS (SELECT d AS root FROM up WHERE n = 1),
path AS (
  SELECT r, s.level, s.i, s.d, s.i < leaf.i // CAST(pow({FANOUT}, s.level) AS BIGINT) AS before
  FROM leaf JOIN low s ON s.g = leaf.g AND s.n > 1 AND s.i // {FANOUT} = leaf.i // CAST(pow({FANOUT}, s.level + 1) AS BIGINT)
    AND s.i <> leaf.i // CAST(pow({FANOUT}, s.level) AS BIGINT)
  UNION ALL
  SELECT r, 100 + s.level, s.i, s.d, s.i < sub.i // CAST(pow({FANOUT}, s.level) AS BIGINT)
  FROM leaf JOIN sub ON sub.source = leaf.g JOIN up s ON s.n > 1 AND s.i // {FANOUT} = sub.i // CAST(pow({FANOUT}, s.level + 1) AS BIGINT)
    AND s.i <> sub.i // CAST(pow({FANOUT}, s.level) AS BIGINT)),
lengths AS (
  SELECT r, (SELECT max(level) FROM low WHERE low.g = leaf.g) AS m, (SELECT max(level) FROM up) AS u FROM leaf),
proof AS (SELECT r, sha256(string_agg(d, '' ORDER BY level, i)) AS p FROM path GROUP BY r),
sides AS (
  SELECT r, level, coalesce(string_agg(d, '' ORDER BY i) FILTER (before), '') AS a, coalesce(string_agg(d, '' ORDER BY i) FILTER (NOT before), '') AS b
  FROM path GROUP BY r, level),
steps AS (
  SELECT r, k, CASE WHEN k < m THEN k ELSE 100 + k - m END AS level, m + u AS total FROM lengths, unnest(range(0, m + u)) AS w(k)),
filled AS (SELECT steps.r, k, coalesce(a, '') AS a, coalesce(b, '') AS b FROM steps LEFT JOIN sides ON sides.r = steps.r AND sides.level = steps.level),
fold AS (
  SELECT r, 0 AS k, coalesce(other, d) AS d FROM leaf
  UNION ALL
  SELECT fold.r, fold.k + 1, sha256(a || fold.d || b) FROM fold JOIN filled ON filled.r = fold.r AND filled.k = fold.k),
folded AS (SELECT fold.r, fold.d AS f FROM fold JOIN lengths ON lengths.r = fold.r AND fold.k = m + u)
SELECT doc_id, leaf.d AS leaf, sub.d AS subroot, root, coalesce(p, sha256('')) AS proof_sha256, f AS folded_root, f = root AS verified
FROM leaf JOIN sub ON sub.source = leaf.g JOIN folded USING (r) LEFT JOIN proof USING (r), top
"""


ORACLE = _oracle()


def query(spark, sf_dir: str) -> DataFrame:
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    return proofs(common.table(spark, sf_dir, "documents"), tampered)
