"""What needs an order over all rows of a group, without sorting a group in one task: running totals by value, exact
percentiles, average ranks, areas under curves.

Rows are first counted by distinct value (combined before the shuffle), so that a hot value is one row. Up to RANGE such
rows in all are ordered as they are. More are dealt to ranges by splitters that Spark samples from them, whatever their
distribution: within a range they are ordered together, and the ranges' totals, few for each group, are what came before.
Percentiles need few ranks, so that only the values near these are counted at all.
"""

from __future__ import annotations

import functools
import math
import operator
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridlake.sources.tables import saved

#: Distinct (keys, value) of a range at most.
RANGE = 1 << 17
#: Percentiles count values in the square of so many buckets first.
BUCKETS = 16


def _same(keys: list[str]) -> Column:
    return functools.reduce(operator.and_, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys], F.lit(True))


def ranges(rows: DataFrame, order: list[str], most: int = RANGE) -> DataFrame:
    """rows, saved, with _range: ascending numbers of ranges of the order, none of more than most rows.

    Rows should be distinct in the order's columns: rows that are equal there stay together.
    """
    n, spread = rows.count(), 2  # splitters are sampled, so ranges are planned half as large
    while True:
        parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(spread * n / most))
        placed = saved(rows.repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id()), "ranges")
        largest = placed.groupBy("_range").count().agg(F.max("count")).first()[0] or 0
        if largest <= most:
            return placed
        spread *= 2


def running(df: DataFrame, keys: list[str], value: str, sums: dict[str, Column]) -> DataFrame:
    """A row for each distinct (keys, value): the sums over its rows, before_<name> over the rows of smaller values of its
    keys, and total_<name> over all of them.

    Rows whose value is null or NaN are left out; null keys are keys like others, and infinite values are values.
    """
    names = list(sums)
    some = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    per = saved(some.groupBy(*keys, value).agg(*[x.alias(n) for n, x in sums.items()]), "values")
    smaller = Window.rowsBetween(Window.unboundedPreceding, -1)
    before = lambda n, order: F.coalesce(F.sum(n).over(order), F.lit(0))
    if per.count() <= RANGE:
        inside, whole = smaller.partitionBy(*keys).orderBy(value), Window.partitionBy(*keys)
        return per.select("*", *[before(n, inside).alias(f"before_{n}") for n in names], *[F.sum(n).over(whole).alias(f"total_{n}") for n in names])
    placed = ranges(per, [*keys, value])
    totals = placed.groupBy(*keys, "_range").agg(*[F.sum(n).alias(n) for n in names])
    order = smaller.partitionBy(*keys).orderBy("_range")
    whole = Window.partitionBy(*keys)
    earlier = totals.select(*keys, "_range", *[before(n, order).alias(f"_{n}") for n in names], *[F.sum(n).over(whole).alias(f"total_{n}") for n in names])
    inside = smaller.partitionBy("_range", *keys).orderBy(value)
    placed = placed.select("*", *[before(n, inside).alias(f"_in_{n}") for n in names])
    joined = placed.alias("a").join(earlier.alias("b"), _same([*keys, "_range"]))
    return joined.select(
        *[F.col(f"a.{c}").alias(c) for c in [*keys, value, *names]],
        *[(F.col(f"a._in_{n}") + F.col(f"b._{n}")).alias(f"before_{n}") for n in names],
        *[F.col(f"b.total_{n}").alias(f"total_{n}") for n in names],
    )


def cuts(rows: DataFrame, value: str) -> list[float]:
    """Ascending values that deal rows to BUCKETS ** 2 buckets, about even ones if the values are distinct."""
    n = BUCKETS * BUCKETS
    return rows.agg(F.percentile_approx(F.col(value).cast("double"), [k / n for k in range(1, n)], 8 * n)).first()[0] or []


def bucket(value: str, at: list[float]) -> Column:
    """How many of the ascending values at are not above value: counted among every BUCKETS-th, then among those between."""
    v = F.col(value).cast("double")
    passed = lambda among: F.size(F.filter(among, lambda c: c <= v))
    parts = F.array(*[F.array(*[F.lit(float(c)) for c in at[k : k + BUCKETS - 1]]).cast("array<double>") for k in range(0, len(at) + 1, BUCKETS)])
    part = passed(F.array(*[F.lit(float(c)) for c in at[BUCKETS - 1 :: BUCKETS]]).cast("array<double>"))
    return part * BUCKETS + passed(F.get(parts, part))


def percentiles(df: DataFrame, keys: list[str], value: str, points: dict[str, float], spread: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Exact percentiles (linear between the neighbouring ranks) of each group, one column for each of points.

    Rows are first counted by group and bucket of values. Only those of the buckets with a wanted rank are then counted by
    distinct value, so that what is shuffled and ordered is a small part of df. df is saved and read twice. spread: makes
    rows (keys, value, _bucket) of the saved ones, such as one for each context, so that these are never stored.
    """
    known = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    rows = saved(known if spread else known.select(*dict.fromkeys([*keys, value])), "known")
    each = (spread or (lambda r: r))(rows.withColumn("_bucket", bucket(value, cuts(rows, value) if rows.count() > RANGE else [])))
    counted = saved(each.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_m")), "buckets")
    whole = Window.partitionBy(*keys)
    smaller = whole.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    placed = counted.select("*", F.coalesce(F.sum("_m").over(smaller), F.lit(0)).alias("_base"), F.sum("_m").over(whole).alias("_total"))
    spots = {name: F.lit(float(q)) * (F.col("_total") - 1) for name, q in points.items()}
    ranks = [end(spot) for spot in spots.values() for end in (F.floor, F.ceil)]
    hit = functools.reduce(operator.or_, [(F.col("_base") <= r) & (r < F.col("_base") + F.col("_m")) for r in ranks], F.lit(False))
    wanted = saved(placed.where(hit).drop("_m"), "wanted")  # a few rows a group
    small = F.broadcast(wanted) if wanted.count() <= RANGE else wanted
    met = each.alias("a").join(small.alias("b"), _same([*keys, "_bucket"]))
    met = met.select(*[F.col(f"a.{c}").alias(c) for c in [*keys, value, "_bucket"]], "_base", "_total")
    per = running(met, [*keys, "_bucket", "_base", "_total"], value, {"n": F.count(F.lit(1))})
    before, out = F.col("_base") + F.col("before_n"), []
    for name, spot in spots.items():
        holds = lambda rank: (before <= rank) & (rank < before + F.col("n"))
        low, high = (F.max(F.when(holds(r), F.col(value))) for r in (F.floor(spot), F.ceil(spot)))
        out.append((low + (high - low) * F.max(spot - F.floor(spot))).alias(name))
    return per.groupBy(*keys).agg(*out)


def average_ranks(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Each distinct (keys, value) with its rank from 1; equal values share the mean of their ranks."""
    per = running(df, keys, value, {"n": F.count(F.lit(1))})
    return per.select(*keys, value, (F.col("before_n") + (F.col("n") + 1) / 2).alias("rank"))


def spearman(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Rank correlation of each group over its rows with both values (null where a side is constant)."""
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*keys, x, y).agg(F.count(F.lit(1)).alias("_m"))
    ranks = []
    for c in (x, y):
        per = running(rows, keys, c, {"_c": F.sum("_m")})
        ranks.append(per.select(*keys, c, (F.col("before__c") + (F.col("_c") + 1) / 2).alias(f"_r{c}")))
    for c, rank in zip((x, y), ranks, strict=True):
        left = rows
        rows = left.alias("a").join(rank.alias("b"), _same([*keys, c])).select(*[F.col(f"a.{k}").alias(k) for k in left.columns], F.col(f"b._r{c}").alias(f"_r{c}"))
    m, a, b = F.col("_m"), F.col(f"_r{x}"), F.col(f"_r{y}")
    n = F.sum(m)
    cov, va, vb = n * F.sum(m * a * b) - F.sum(m * a) * F.sum(m * b), n * F.sum(m * a * a) - F.sum(m * a) * F.sum(m * a), n * F.sum(m * b * b) - F.sum(m * b) * F.sum(m * b)
    return rows.groupBy(*keys).agg(F.try_divide(cov, F.sqrt(va) * F.sqrt(vb)).alias("spearman"))


def areas(df: DataFrame, keys: list[str], observed: Column, score: str) -> DataFrame:
    """AUROC (ties count half) and average precision (one step for each distinct score) of each group.

    Rows without a score are left out. AUROC is null without both classes, average precision without positives.
    """
    y = F.coalesce(observed, F.lit(False)).cast("long")
    rows = running(df, keys, score, {"pos": F.sum(y), "neg": F.sum(1 - y)})
    pos, neg = F.col("total_pos") - F.col("before_pos"), F.col("total_neg") - F.col("before_neg")  # at least this score
    won = F.sum(F.col("pos") * (F.col("before_neg") + F.col("neg") / 2))
    step = F.sum(F.col("pos") * F.try_divide(pos, pos + neg))
    return rows.groupBy(*keys).agg(F.try_divide(won, F.max("total_pos") * F.max("total_neg")).alias("auroc"), F.try_divide(step, F.max("total_pos")).alias("average_precision"))
