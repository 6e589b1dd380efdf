"""Stratified samples with quotas by population; rows chosen by rank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Shares of the score by which a stratum is dealt out, so that no task ranks a whole one.
SLICES = 1024


def quota_sample(rows: DataFrame, observed: Column, strata: list[str], key: str, score: Column, quotas: list[tuple], default: tuple) -> DataFrame:
    """All observed rows (weight 1) and, of each stratum's other rows, the first by (score, key) up to its quota.

    quotas: (condition on strata, fraction, least, most or None), the first that holds counts; default: the last three.
    The quota is min(population, min(max(ceil(population * fraction), least), most)); weight is population / quota.
    score: in [0, 1). Null strata are strata like others; rows whose observed is null are not observed.
    """
    seen = F.coalesce(observed, F.lit(False))
    others = rows.where(~seen).withColumn("_score", score).withColumn("_slice", F.floor(F.col("_score") * SLICES))
    whole = Window.partitionBy(*strata)
    slices = others.groupBy(*strata, "_slice").agg(F.count(F.lit(1)).alias("_m"))
    slices = slices.withColumn("_population", F.sum("_m").over(whole))
    slices = slices.withColumn("_before", F.coalesce(F.sum("_m").over(whole.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))

    def rows_of(fraction, least, most):
        wanted = F.greatest(F.ceil(F.col("_population") * F.lit(float(fraction))), F.lit(least))
        return F.least(wanted, F.lit(most)) if most is not None else wanted

    wanted = rows_of(*default)
    for condition, *quota in reversed(quotas):
        wanted = F.when(condition, rows_of(*quota)).otherwise(wanted)
    slices = slices.withColumn("_quota", F.least("_population", wanted)).where("_before < _quota")
    names = [*strata, "_slice"]
    slices = slices.select(*[F.col(c).alias(f"_at_{c}") for c in names], "_population", "_before", "_quota")
    same = F.lit(True)
    for c in names:
        same &= F.col(c).eqNullSafe(F.col(f"_at_{c}"))
    place = F.col("_before") + F.row_number().over(Window.partitionBy(*names).orderBy("_score", key))
    taken = others.join(slices, same).withColumn("_place", place).where("_place <= _quota")
    taken = taken.select(*rows.columns, (F.col("_population") / F.col("_quota")).alias("weight"))
    return rows.where(seen).withColumn("weight", F.lit(1.0)).unionByName(taken)


def stratum_summary(rows: DataFrame, sample: DataFrame, strata: list[str]) -> DataFrame:
    """Population, sampled and dropped rows of each stratum, and the least and largest weight in the sample."""
    size = rows.groupBy(*strata).agg(F.count(F.lit(1)).alias("population"))
    taken = sample.groupBy(*strata).agg(F.count(F.lit(1)).alias("_taken"), F.min("weight").alias("min_weight"), F.max("weight").alias("max_weight"))
    same = F.lit(True)
    for c in strata:
        same &= F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    joined = size.alias("a").join(taken.alias("b"), same, "left").select(*[F.col(f"a.{c}").alias(c) for c in strata], "population", F.coalesce("_taken", F.lit(0)).alias("sampled"), "min_weight", "max_weight")
    return joined.withColumn("dropped", F.col("population") - F.col("sampled"))


def top_of_each_sign(rows: DataFrame, value: str, key: str, n: int) -> DataFrame:
    """The n rows of largest value above 0 (side high) and the n of smallest below 0 (side low), ranked; ties to the smaller key.

    Each side is an ordered limit, of which every task sends n rows at most; only those are ranked.
    """
    out = []
    for side, where, order in (("high", F.col(value) > 0, F.desc(value)), ("low", F.col(value) < 0, F.asc(value))):
        some = rows.where(where).orderBy(order, key).limit(n).withColumn("side", F.lit(side))
        out.append(some.withColumn("rank", F.row_number().over(Window.partitionBy("side").orderBy(order, key))))
    return out[0].unionByName(out[1])


def nearest_to_median(points: DataFrame, x: str, y: str, key: str, n: int) -> DataFrame:
    """The n points nearest to the medians of x and y; ties to the smaller key."""
    from gridlake.operators import ordered

    middle = F.broadcast(ordered.percentiles(points, [], x, {"_mx": 0.5}).join(ordered.percentiles(points, [], y, {"_my": 0.5})))  # one row
    far = points.join(middle).withColumn("distance", F.hypot(F.col(x) - F.col("_mx"), F.col(y) - F.col("_my")))
    return far.drop("_mx", "_my").orderBy("distance", key).limit(n)


def by_priority(rows: DataFrame, buckets: list[tuple[str, Column]], score: str, key: str, cap: int) -> DataFrame:
    """At most cap rows: by the first bucket that a row is in, then the larger score, then key. reasons: all its buckets."""
    number = F.coalesce(*[F.when(condition, F.lit(i)) for i, (_, condition) in enumerate(buckets)])
    reasons = F.concat_ws(";", *[F.when(condition, F.lit(name)) for name, condition in buckets])
    named = F.get(F.array(*[F.lit(name) for name, _ in buckets]), F.col("_number"))
    rows = rows.withColumn("_number", number).withColumn("reasons", reasons).where("_number IS NOT NULL")
    return rows.withColumn("bucket", named).orderBy("_number", F.desc(score), key).limit(cap).drop("_number")
