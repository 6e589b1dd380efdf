"""Operator 2: approximate nearest neighbours on robust-pruned directed graphs.

Equal vectors are one class. Classes are dealt to shards by hash; each shard's graph is built by greedy searches that
propose neighbours and a relaxed distance pruning that keeps diverse edges. Every query searches every shard with a
beam, and the shards' best are merged. Largest inner product is nearest distance after one more component makes all
norms of a shard equal.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Classes of a shard on average, whatever the machine: the beams below suit this size.
SHARD_ROWS = 8192
#: Queries that search a shard together. A shard's graph moves once for each block, so a block's vectors are about as
#: many bytes as the graph: what moves is in proportion to the queries that each shard has to see.
QUERY_BLOCK = 65536
DEGREE, BUILD_BEAM, SEARCH_BEAM, ALPHA, BATCH = 32, 56, 192, 1.2, 256


def beam_search(x: np.ndarray, graph: np.ndarray, queries: np.ndarray, entry: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, inner products) of the best width places of each query, unordered; -1 where there are fewer.

    All queries step together: each expands its nearest place that is not yet expanded.
    """
    n_queries, rows = len(queries), np.arange(len(queries))
    ids = np.full((n_queries, width), -1, np.int32)
    near = np.full((n_queries, width), -np.inf, np.float32)
    open_ = np.zeros((n_queries, width), bool)
    seen = np.zeros((n_queries, len(x)), bool)
    ids[:, 0], near[:, 0], open_[:, 0], seen[:, entry] = entry, queries @ x[entry], True, True
    active = rows
    while len(active):
        at = np.where(open_[active], near[active], -np.inf).argmax(axis=1)
        open_[active, at] = False
        next_ = graph[ids[active, at]]
        fresh = (next_ >= 0) & ~seen[active[:, None], next_]
        r, c = np.nonzero(fresh)
        seen[active[r], next_[r, c]] = True
        gain = np.full(next_.shape, -np.inf, np.float32)
        gain[r, c] = np.einsum("ij,ij->i", x[next_[r, c]], queries[active[r]])
        all_near = np.concatenate([near[active], gain], axis=1)
        best = np.argpartition(-all_near, width - 1, axis=1)[:, :width]
        near[active] = np.take_along_axis(all_near, best, 1)
        ids[active] = np.take_along_axis(np.concatenate([ids[active], np.where(fresh, next_, -1)], axis=1), best, 1)
        open_[active] = np.take_along_axis(np.concatenate([open_[active], fresh], axis=1), best, 1)
        active = active[open_[active].any(axis=1)]
    return ids, near


def robust_prune(x: np.ndarray, centres: np.ndarray, candidates: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Of candidates (-1: none) keep up to degree for each centre: the nearest, then the nearest of those that no kept
    one is alpha times nearer to than the centre is. Norms are equal, so distances follow from inner products."""
    candidates = np.where(candidates == centres[:, None], -1, candidates)
    order = np.sort(candidates, axis=1)
    double = np.zeros_like(order, bool)
    double[:, 1:] = order[:, 1:] == order[:, :-1]
    candidates = np.where(double, -1, order)
    points = x[candidates]
    norm = float(x[0] @ x[0])
    far = 2 * norm - 2 * np.einsum("bkd,bd->bk", points, x[centres])
    far = np.where(candidates < 0, np.inf, far)
    between = 2 * norm - 2 * points @ points.transpose(0, 2, 1)
    rows, out = np.arange(len(centres)), np.full((len(centres), degree), -1, np.int32)
    for k in range(degree):
        pick = far.argmin(axis=1)
        alive = np.isfinite(far[rows, pick])
        if not alive.any():
            break
        out[:, k] = np.where(alive, candidates[rows, pick], -1)
        gone = alpha * alpha * between[rows, pick] <= far
        gone[rows, pick] = True
        far = np.where(gone & alive[:, None], np.inf, far)
    return out


def build_graph(x: np.ndarray, degree: int = DEGREE, width: int = BUILD_BEAM, alpha: float = ALPHA, seed: int = 7) -> tuple[np.ndarray, int]:
    """(neighbours of each row, entry) for rows of equal norm."""
    n, rng = len(x), np.random.default_rng(seed)
    entry = int((x @ x.mean(axis=0)).argmax())
    graph = np.full((n, degree), -1, np.int32)
    if n > 1:
        start = min(degree // 2, n - 1)
        graph[:, :start] = (np.arange(n)[:, None] + rng.integers(1, n, (n, start))) % n
    for batch in np.array_split(rng.permutation(n), max(1, math.ceil(n / BATCH))):
        found, _ = beam_search(x, graph, x[batch], entry, width)
        graph[batch] = robust_prune(x, batch, np.concatenate([found, graph[batch]], axis=1), degree, alpha)
        source, target = np.repeat(batch, degree), graph[batch].ravel()
        source, target = source[target >= 0], target[target >= 0]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        to, begin, count = np.unique(target, return_index=True, return_counts=True)
        place = np.arange(len(target)) - np.repeat(begin, count)
        fits = place < degree
        back = np.full((len(to), degree), -1, np.int32)
        back[np.repeat(np.arange(len(to)), count)[fits], place[fits]] = source[fits]
        graph[to] = robust_prune(x, to, np.concatenate([graph[to], back], axis=1), degree, alpha)
    return graph, entry


def equal_norms(vectors: np.ndarray) -> np.ndarray:
    squares = np.einsum("ij,ij->i", vectors, vectors)
    return np.concatenate([vectors, np.sqrt(np.maximum(squares.max() - squares, 0))[:, None]], axis=1).astype(np.float32)


def _build(shard: pd.DataFrame) -> pd.DataFrame:
    shard = shard.sort_values("class_id")
    vectors = np.stack(shard["vector"].to_numpy()).astype(np.float32)
    graph, entry = build_graph(equal_norms(vectors.astype(np.float64)))
    ids = shard["class_id"].to_numpy(np.int64)
    return pd.DataFrame({"shard": [int(shard["shard"].iloc[0])], "ids": [ids.tobytes()], "vectors": [vectors.tobytes()], "graph": [graph.tobytes()], "entry": [entry]})


def _search(k: int, width: int):
    names = ["query_class", "class_id", "score"]

    def run(queries: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(index):
            return pd.DataFrame({"query_class": pd.Series(dtype="int64"), "class_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        row = index.iloc[0]
        ids = np.frombuffer(row["ids"], np.int64)
        vectors = np.frombuffer(row["vectors"], np.float32).reshape(len(ids), -1)
        graph = np.frombuffer(row["graph"], np.int32).reshape(len(ids), -1)
        x, out = equal_norms(vectors.astype(np.float64)), []
        for part in np.array_split(np.arange(len(queries)), math.ceil(len(queries) / BATCH)):
            asked = np.stack(queries["vector"].iloc[part].to_numpy()).astype(np.float64)
            flat = np.concatenate([asked, np.zeros((len(asked), 1))], axis=1).astype(np.float32)
            found, _ = beam_search(x, graph, flat, int(row["entry"]), min(width, max(len(ids), 1)))
            score = np.where(found < 0, -np.inf, np.einsum("bkd,bd->bk", vectors[found].astype(np.float64), asked))
            order = np.lexsort((ids[found], -score), axis=1)[:, :k]
            score = np.take_along_axis(score, order, 1)
            found = np.take_along_axis(found, order, 1)
            r, c = np.nonzero(np.isfinite(score))
            out.append(pd.DataFrame(dict(zip(names, (queries["query_class"].to_numpy()[part][r], ids[found[r, c]], score[r, c]), strict=True))))
        return pd.concat(out, ignore_index=True)

    return run


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and vector (floats) of rows that can be compared: no null or non-finite component, not zero, and of the
    length that most rows have."""
    rows = vectors.where("vec_id is not null and embedding is not null").select("vec_id", F.col("embedding").cast("array<float>").alias("vector"))
    bad = F.exists("vector", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rows = rows.where(~bad & F.exists("vector", lambda v: v != 0))
    length = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("vector") == (length["n"] if length else -1))


def nearest(vectors: DataFrame, is_query, k: int = 20, shard_rows: int = SHARD_ROWS, width: int = SEARCH_BEAM) -> DataFrame:
    """The k nearest found of each query row, by largest inner product.

    vectors: vec_id, embedding; other columns are ignored. is_query: condition on vec_id. shard_rows: classes of a
    shard on average; larger shards want wider beams. Returns query_id, rank, vec_id and score (double precision, on the given vectors), ties to the smaller vec_id; a query is not its own neighbour, its
    copies are. Rows with a null vec_id, vectors null, zero, holding null or non-finite components, or of another
    length than most take no part; of rows with one vec_id and one vector one counts; empty tables give empty ones.
    """
    rows = common.saved(usable(vectors).distinct(), "vectors")
    # Only the k + 1 smallest ids of a class can be answers; the limit is applied before the shuffle as well.
    ranked = rows.withColumn("r", F.row_number().over(Window.partitionBy("vector").orderBy("vec_id"))).where(F.col("r") <= k + 1)
    classes = ranked.groupBy("vector").agg(F.sort_array(F.collect_list("vec_id")).alias("members"))
    classes = common.saved(classes.select(F.col("members")[0].alias("class_id"), "vector", "members"), "classes")
    n_shards = max(1, math.ceil(classes.count() / shard_rows))
    shards = classes.select(F.pmod(F.xxhash64("class_id"), F.lit(n_shards)).cast("int").alias("shard"), "class_id", "vector")
    index = common.saved(shards.groupBy("shard").applyInPandas(_build, "shard int, ids binary, vectors binary, graph binary, entry int"), "graphs")

    asked = rows.where(is_query).join(classes.select("vector", F.col("class_id").alias("query_class")), "vector").select("vec_id", "query_class")
    asked = common.saved(asked, "asked")
    distinct = asked.select(F.col("query_class").alias("class_id")).distinct().join(classes.select("class_id", "vector"), "class_id")
    n_blocks = max(1, math.ceil(asked.count() / QUERY_BLOCK))
    blocks = distinct.select(F.col("class_id").alias("query_class"), "vector", F.pmod(F.xxhash64("class_id"), F.lit(n_blocks)).cast("int").alias("block"))
    blocks = blocks.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1))))
    graphs = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    found = blocks.groupBy("shard", "block").cogroup(graphs.groupBy("shard", "block")).applyInPandas(_search(k + 1, width), "query_class long, class_id long, score double")

    best = Window.partitionBy("query_class").orderBy(F.desc("score"), "class_id")
    found = found.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1)
    members = found.join(classes.select("class_id", "members"), "class_id").select("query_class", "score", F.explode("members").alias("vec_id"))
    best = Window.partitionBy("query_class").orderBy(F.desc("score"), "vec_id")
    members = members.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1)
    lists = members.groupBy("query_class").agg(F.sort_array(F.collect_list(F.struct("r", "vec_id", "score"))).alias("found"))
    answers = asked.join(lists, "query_class").select(F.col("vec_id").alias("query_id"), F.filter("found", lambda x: x["vec_id"] != F.col("vec_id")).alias("found"))
    return answers.select("query_id", F.posexplode(F.slice("found", 1, k)).alias("at", "x")).select(
        "query_id", (F.col("at") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score")
    )


def query(spark, sf_dir: str) -> DataFrame:
    return nearest(common.table(spark, sf_dir, "embeddings"), "vec_id % 20 = 0")
