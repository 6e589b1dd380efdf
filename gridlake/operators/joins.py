"""Joins with checks, routing by place, and small tables made of several."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlake.functions import classify
from gridlake.operators import ordered


def one_to_one(left: DataFrame, right: DataFrame, keys: list[str], required: Column | None = None) -> DataFrame:
    """left with right's columns. Two right rows of one key stop the job, and so does a required row of left without one."""
    others = [c for c in right.columns if c not in keys]
    told = F.concat_ws(", ", *[F.coalesce(F.col(k).cast("string"), F.lit("null")) for k in keys])
    once = right.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *[F.first(c).alias(c) for c in others])
    once = once.withColumn("_known", F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("two rows of one key: "), told)).cast("boolean")).otherwise(True)).drop("_n")
    wanted = F.lit(True) if required is None else F.coalesce(required, F.lit(False))
    absent = F.raise_error(F.concat(F.lit("no row for key: "), told)).cast("boolean")
    joined = left.join(once, keys, "left").withColumn("_ok", F.when(F.col("_known").isNull() & wanted, absent).otherwise(F.coalesce("_known", F.lit(True))))
    return joined.where("_ok").drop("_ok", "_known")


def routed(points: DataFrame, x: str, y: str, boundary: float, south: tuple, north: tuple) -> DataFrame:
    """points with the product that serves them and whether they are within its bounds.

    south serves what lies below the boundary; a product is (name, west, south, east, north), its edges belong to it.
    """
    below = F.col(y) < boundary
    inside = lambda p: F.col(x).between(p[1], p[3]) & F.col(y).between(p[2], p[4])
    return points.withColumn("product", F.when(below, south[0]).otherwise(north[0])).withColumn("in_bounds", F.when(below, inside(south)).otherwise(inside(north)))


def sampled_grid(points: DataFrame, x: str, y: str, grid: DataFrame, x0: float, y0: float, step: float) -> DataFrame:
    """points with the value of the nearest grid centre (grid: row, col, value; centres at x0 + col * step, y0 + row * step);
    null outside the grid. The place follows by arithmetic, so this is a join on equal keys."""
    place = points.withColumn("col", F.rint((F.col(x) - x0) / step).cast("long")).withColumn("row", F.rint((F.col(y) - y0) / step).cast("long"))
    return place.join(grid.select("row", "col", "value"), ["row", "col"], "left")


def in_polygon(x: Column, y: Column, ring: list[tuple[float, float]]) -> Column:
    """Whether a point is inside a ring (even-odd rule); its bounding box is tested first, on plain comparisons."""
    xs, ys = zip(*ring, strict=True)
    crossings = F.lit(0)
    for (x1, y1), (x2, y2) in zip(ring, [*ring[1:], ring[0]], strict=True):
        if y1 != y2:
            spans = (F.lit(y1) > y) != (F.lit(y2) > y)
            crossings = crossings + F.when(spans & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1), 1).otherwise(0)
    return x.between(min(xs), max(xs)) & y.between(min(ys), max(ys)) & (crossings % 2 == 1)


def support_difference(base: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """One row: keys of base and other, and how many stand in one of them alone."""
    both = base.select(*keys, F.lit(1).alias("_b"), F.lit(0).alias("_o")).unionByName(other.select(*keys, F.lit(0).alias("_b"), F.lit(1).alias("_o")))
    each = both.groupBy(*keys).agg(F.max("_b").alias("_b"), F.max("_o").alias("_o"))
    count = lambda c: F.count_if(c)
    b, o = F.col("_b") == 1, F.col("_o") == 1
    found = each.agg(count(b).alias("base_count"), count(o).alias("other_count"), count(b & ~o).alias("missing"), count(~b & o).alias("extra"))
    return found.withColumn("sets_match", (F.col("missing") == 0) & (F.col("extra") == 0))


def contexts(rows: DataFrame, named: dict[str, Column], keep: list[str]) -> DataFrame:
    """rows once for each context: context_type, context_value and the columns in keep; one pass serves all tables."""
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("t"), F.coalesce(c.cast("string"), F.lit("missing")).alias("v")) for n, c in named.items()]))
    return rows.select(each.alias("_c"), *keep).select(F.col("_c.t").alias("context_type"), F.col("_c.v").alias("context_value"), *keep)


def layers(rows: DataFrame, key: str, layer: str, names: list[str], value: str) -> DataFrame:
    """One row per key with a column for each named layer (its largest value there), and the largest of all."""
    wide = rows.groupBy(key).agg(*[F.max(F.when(F.col(layer) == n, F.col(value))).alias(n) for n in names])
    return wide.withColumn("max_score", F.greatest(*names))


def source_difference(rows: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """Rows with a valid value on both sides: their number, difference a - b, and how often the signs differ."""
    ok = classify.known(F.col(a)) & classify.known(F.col(b))
    d = F.when(ok, F.col(a) - F.col(b))
    signs = ok & ((F.col(a) < 0) != (F.col(b) < 0))
    return rows.groupBy(*keys).agg(F.count(d).alias("overlap"), F.avg(d).alias("mean_difference"), F.min(d).alias("min_difference"), F.max(d).alias("max_difference"), F.count_if(signs).alias("sign_disagreement"))


def robust_scale(rows: DataFrame, keys: list[str], value: str, q: float, least: float, most: float) -> DataFrame:
    """A cap for each group: a percentile of its values held within least and most; least without values."""
    groups = rows.select(*keys).distinct()
    found = ordered.percentiles(rows, keys, value, {"_q": q})
    capped = F.coalesce(F.greatest(F.lit(least), F.least(F.lit(most), F.col("_q"))), F.lit(least))
    return groups.join(found, keys, "left").select(*keys, capped.alias("cap"))


def recommended(rows: DataFrame, min_positives: int, min_rate: float) -> DataFrame:
    """Candidate thresholds (threshold, n, positives, f1, background_rate) ranked: enough positives, any positives, the
    larger threshold, F1, the lower rate of false positives on background. The first is selected if it has positives."""
    from pyspark.sql import Window

    enough = (F.col("positives") >= min_positives) & (F.try_divide(F.col("positives"), F.col("n")) >= min_rate)
    order = [F.desc("support_ok"), F.desc(F.col("positives") > 0), F.desc("threshold"), F.desc(F.coalesce("f1", F.lit(-1.0))), F.asc(F.coalesce("background_rate", F.lit(2.0)))]
    ranked = rows.withColumn("support_ok", F.coalesce(enough, F.lit(False))).withColumn("rank", F.row_number().over(Window.orderBy(*order)))  # a few candidates
    return ranked.withColumn("selected", (F.col("rank") == 1) & (F.col("positives") > 0))


def hashed_sample(rows: DataFrame, key: str, n: int) -> DataFrame:
    """n rows in the order of a hash of their key: the same ones each time, whatever the partitions."""
    return rows.orderBy(F.pmod(F.col(key) * 2654435761 + 12345, F.lit(4294967296)), key).limit(n)


def rank_in(column: str, order: list[str]) -> Column:
    """Place of a label in an explicit order; labels that are not in it come last."""
    return F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(x) for x in order]), F.col(column)), F.lit(0)), F.lit(len(order) + 1)).cast("int")
