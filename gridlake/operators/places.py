"""Joins of tables by place: boxes that overlap, points in polygons, nearest centres on irregular axes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridlake.operators import ordered
from gridlake.sources.tables import saved

BOX = ("x0", "y0", "x1", "y1")
#: Buckets of level k are 2 ** k wide; boxes of no more than 2 ** LOWEST are at that level.
LOWEST, HIGHEST = -20, 62
#: Ids of equal points or equal polygons that are held in one row, about.
TOGETHER = 1024


def _levelled(boxes: DataFrame) -> DataFrame:
    """boxes with the least level at which they are no wider or higher than a bucket, so that they touch at most four."""
    side = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    level = F.when(side > 0, F.ceil(F.log2(side))).otherwise(LOWEST)
    return boxes.where("x0 <= x1 AND y0 <= y1").withColumn("_level", F.greatest(F.lit(LOWEST), F.least(F.lit(HIGHEST), level)).cast("int"))


def _bucketed(boxes: DataFrame, levels: list[int]) -> DataFrame:
    """boxes in the buckets they touch, at their own level and at those higher ones of levels."""
    at = F.array_distinct(F.concat(F.array("_level"), F.filter(F.array(*[F.lit(k) for k in levels]), lambda k: k > F.col("_level"))))
    rows = boxes.withColumn("_at", F.explode(at)).withColumn("_size", F.pow(F.lit(2.0), F.col("_at")))
    for axis, low, high in (("_i", "x0", "x1"), ("_j", "y0", "y1")):
        bucket = lambda c: F.floor(F.col(c) / F.col("_size"))
        rows = rows.withColumn(axis, F.explode(F.sequence(bucket(low), bucket(high))))  # noqa: B023
    return rows


def overlapping(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs of left (id, x0, y0, x1, y1) and right (key and the same), whose boxes overlap; edges belong to a box.

    A point is a box without extent. Each box lies in at most four buckets of each level: those of its own size, and of
    the sizes of the other table's larger boxes. A pair meets at the level of the larger box and is reported in one bucket
    only, that of the lower left corner of what the two share, so nothing is removed afterwards. A box with a null or its
    ends in the wrong order overlaps nothing.
    """
    sides = [saved(_levelled(t.select(name, *[F.col(c).cast("double").alias(c) for c in BOX])), "boxes") for t, name in ((left, "id"), (right, "key"))]
    levels = [[r[0] for r in s.select("_level").distinct().collect()] for s in sides]  # at most some eighty numbers
    a = _bucketed(sides[0], levels[1])
    b = _bucketed(sides[1], levels[0]).select("key", "_at", "_i", "_j", F.col("_level").alias("_other"), *[F.col(c).alias(f"_{c}") for c in BOX])
    met = a.join(b, ["_at", "_i", "_j"]).where(F.greatest("_level", "_other") == F.col("_at"))
    c = {n: F.col(n) for n in [*BOX, *(f"_{n}" for n in BOX)]}
    share = (c["x0"] <= c["_x1"]) & (c["_x0"] <= c["x1"]) & (c["y0"] <= c["_y1"]) & (c["_y0"] <= c["y1"])
    corner = (F.floor(F.greatest("x0", "_x0") / F.col("_size")) == F.col("_i")) & (F.floor(F.greatest("y0", "_y0") / F.col("_size")) == F.col("_j"))
    return met.where(share & corner).select("id", "key")


def first_valid(pairs: DataFrame, sources: DataFrame, priority: str, valid: Column, *fields: str) -> DataFrame:
    """Of each id's sources (joined by key) that are valid the first by priority, ties to the smaller key: id, key, fields."""
    met = pairs.join(sources, "key").where(valid)
    first = F.min_by(F.struct("key", *fields), F.struct(priority, "key"))
    return met.groupBy("id").agg(first.alias("_f")).select("id", "_f.*")


def edges_of(vertices: DataFrame) -> DataFrame:
    """polygon and its sides (x1, y1)-(x2, y2), of vertices (polygon, ring, seq, x, y). A ring closes by itself."""
    ring = Window.partitionBy("polygon", "ring").orderBy("seq")
    whole = ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    back = lambda c: F.coalesce(F.lead(c).over(ring), F.first(c).over(whole))
    return vertices.select("polygon", F.col("x").alias("x1"), F.col("y").alias("y1"), back("x").alias("x2"), back("y").alias("y2"))


def cover(edges: DataFrame, size: float) -> DataFrame:
    """polygon, i, j and inside of the square cells of a size that polygons touch: those with a side through them are not
    inside (their points have to be tried), those without lie inside as a whole. Other cells are outside."""
    tiny = size * 1e-9  # cells that a side passes this near count as touched
    cell = lambda x: F.floor(x / size)
    strips = edges.withColumn("i", F.explode(F.sequence(cell(F.least("x1", "x2") - tiny), cell(F.greatest("x1", "x2") + tiny))))
    slope = F.try_divide(F.col("y2") - F.col("y1"), F.col("x2") - F.col("x1"))
    at = lambda x: F.when(F.col("x1") == F.col("x2"), F.lit(None)).otherwise(F.col("y1") + (x - F.col("x1")) * slope)
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    left, right = at(F.col("i") * size - tiny), at((F.col("i") + 1) * size + tiny)
    bottom = F.greatest(low, F.least(F.coalesce(left, low), F.coalesce(right, low)))
    top = F.least(high, F.greatest(F.coalesce(left, high), F.coalesce(right, high)))
    touched = strips.select("polygon", "i", F.explode(F.sequence(cell(bottom - tiny), cell(top + tiny))).alias("j")).distinct()
    # Along the middle line of a row of cells, what lies between an odd crossing and the next is inside.
    half = lambda y: F.floor(y / size - 0.5)
    lines = edges.where("y1 <> y2").withColumn("j", F.explode(F.sequence(half(low), half(high) + 1)))
    middle = (F.col("j") + 0.5) * size
    lines = lines.where((F.col("y1") > middle) != (F.col("y2") > middle))
    crossing = (F.col("x2") - F.col("x1")) * (middle - F.col("y1")) / (F.col("y2") - F.col("y1")) + F.col("x1")
    crossings = lines.groupBy("polygon", "j").agg(F.sort_array(F.collect_list(crossing)).alias("x"))
    spans = crossings.select("polygon", "j", "x", F.explode(F.sequence(F.lit(0), F.size("x") - 2, F.lit(2))).alias("k"))
    first, last = F.floor(F.get("x", F.col("k")) / size - 0.5) + 1, F.floor(F.get("x", F.col("k") + 1) / size - 0.5)
    within = spans.withColumns({"_a": first, "_b": last}).where("_a <= _b").select("polygon", F.explode(F.sequence("_a", "_b")).alias("i"), "j")
    marked = touched.withColumn("inside", F.lit(False)).unionByName(within.withColumn("inside", F.lit(True)))
    return marked.groupBy("polygon", "i", "j").agg(F.bool_and("inside").alias("inside"))


def _together(rows: DataFrame, keys: list[str], member: str) -> DataFrame:
    """rows that are equal in keys as one: keys and their members in an array, several rows of about TOGETHER members
    each where there are more."""
    many = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > TOGETHER)
    part = F.pmod(F.xxhash64(member), F.ceil(F.coalesce("_n", F.lit(1)) / TOGETHER))
    return rows.join(many, keys, "left").groupBy(*keys, part.alias("_part")).agg(F.collect_list(member).alias("members")).drop("_part")


def in_polygons(points: DataFrame, vertices: DataFrame, size: float) -> DataFrame:
    """Pairs of points (id, x, y) and the polygons that hold them, by the even-odd rule over all rings of a polygon, so that
    a ring within another is a hole.

    vertices: polygon, ring, seq, x, y. size: of the cells that polygons are covered with; it changes the work, not the
    pairs. Points in cells within a polygon are not tried at all, those in cells with a side against the polygon's sides
    near that row of cells alone. Points at one place are tried once, and so are polygons with the same sides: their pairs
    are made from arrays of ids after the test. A point without coordinates is in no polygon.
    """
    edges = edges_of(vertices.where("x IS NOT NULL AND y IS NOT NULL"))
    sides = edges.groupBy("polygon").agg(F.sort_array(F.collect_list(F.struct("x1", "y1", "x2", "y2"))).alias("sides"))
    shapes = _together(saved(sides, "sides"), ["sides"], "polygon").withColumnRenamed("members", "polygons")
    shapes = saved(shapes.withColumn("shape", F.monotonically_increasing_id()), "shapes")
    cells = cover(shapes.select(F.col("shape").alias("polygon"), F.explode("sides").alias("s")).select("polygon", "s.*"), size)
    cells = saved(cells.withColumnRenamed("polygon", "shape"), "cover")
    slack = size / 100  # sides this near a row of cells are kept with it; those further off cross none of its points
    low, high = F.col("j") * size - slack, (F.col("j") + 1) * size + slack
    near = F.filter("sides", lambda s: (F.least(s["y1"], s["y2"]) <= high) & (F.greatest(s["y1"], s["y2"]) >= low))
    held = cells.join(shapes, "shape").select("i", "j", "inside", F.when(~F.col("inside"), near).alias("sides"), "polygons")
    known = points.select("id", "x", "y").where("x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x) AND NOT isnan(y)")
    spots = _together(known, ["x", "y"], "id").withColumnRenamed("members", "ids")
    placed = spots.withColumns({"i": F.floor(F.col("x") / size), "j": F.floor(F.col("y") / size)})
    # The pairs may be many more than what they are made from: the number of tasks is fixed, not cut down to small input.
    spark = points.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    met = placed.repartition(tasks, "i", "j").join(held.repartition(tasks, "i", "j"), ["i", "j"])

    def crossed(s: Column) -> Column:
        spans = (s["y1"] > F.col("y")) != (s["y2"] > F.col("y"))
        return spans & (F.col("x") < (s["x2"] - s["x1"]) * (F.col("y") - s["y1"]) / (s["y2"] - s["y1"]) + s["x1"])

    crossings = F.aggregate("sides", F.lit(0), lambda n, s: n + F.when(F.try_divide(F.lit(1.0), s["y2"] - s["y1"]).isNotNull() & crossed(s), 1).otherwise(0))
    found = met.where(F.col("inside") | (crossings % 2 == 1))
    return found.select("polygons", F.explode("ids").alias("id")).select("id", F.explode("polygons").alias("polygon"))


def nearest_centre(points: DataFrame, value: str, centres: DataFrame, centre: str) -> DataFrame:
    """points with the nearest value of centres (in a column of that name), ties to the smaller; null without any.

    An as-of join in both directions: the distinct values of both are dealt to ranges together; each is told the last
    centre up to it and the first from it on, within its range or carried from the nearest range that has one.
    Null and NaN values have no nearest centre and are none.
    """
    known = lambda df, c: df.select(F.col(c).cast("double").alias("v")).where("v IS NOT NULL AND NOT isnan(v)")
    marked = known(points, value).withColumn("_c", F.lit(False)).unionByName(known(centres, centre).withColumn("_c", F.lit(True)))
    each = saved(marked.groupBy("v").agg(F.bool_or("_c").alias("_c")), "values")
    placed = ordered.ranges(each, ["v"])
    own = F.when(F.col("_c"), F.col("v"))
    ends = placed.groupBy("_range").agg(F.min(own).alias("_first"), F.max(own).alias("_last"))
    line = Window.orderBy("_range")  # a row for each range
    carried = ends.select(
        "_range",
        F.last("_last", ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"),
        F.first("_first", ignorenulls=True).over(line.rowsBetween(1, Window.unboundedFollowing)).alias("_after"),
    )
    inside = Window.partitionBy("_range").orderBy("v")
    low = F.last(own, ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, 0))
    high = F.first(own, ignorenulls=True).over(inside.rowsBetween(0, Window.unboundedFollowing))
    told = placed.select("v", "_range", low.alias("_low"), high.alias("_high")).join(F.broadcast(carried), "_range")
    low, high = F.coalesce("_low", "_before"), F.coalesce("_high", "_after")
    nearest = F.when(high.isNull() | (F.col("v") - low <= high - F.col("v")), low).otherwise(high)
    found = told.select(F.col("v").alias("_v"), nearest.alias(centre))
    at = F.when(~F.isnan(F.col(value).cast("double")), F.col(value).cast("double"))
    return points.withColumn("_v", at).join(found, "_v", "left").drop("_v")


def sampled_irregular(points: DataFrame, x: str, y: str, grid: DataFrame) -> DataFrame:
    """points with the value of the grid (x, y, value) at the nearest column and row: both axes are the grid's own
    coordinates, in any spacing. A grid may lack some pairs of its axes; the value is null there."""
    columns = nearest_centre(points, x, grid.select(F.col("x").alias("_x")).distinct(), "_x")
    both = nearest_centre(columns, y, grid.select(F.col("y").alias("_y")).distinct(), "_y")
    cells = grid.select(F.col("x").cast("double").alias("_x"), F.col("y").cast("double").alias("_y"), "value")
    return both.join(cells, ["_x", "_y"], "left").withColumnsRenamed({"_x": "grid_x", "_y": "grid_y"})
