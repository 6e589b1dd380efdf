"""Grid operators: windows, hexagons, projection, nearest positives, connected components, blocks, lattices."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridlake.functions import classify
from gridlake.sources.tables import saved


def neighbours(cells: DataFrame, value: str, reach: int = 1) -> DataFrame:
    """Each cell (row, col) with the sum of value over its square window. Every cell is sent to its window's cells and
    summed there, so the work grows with the cells and no join is needed."""
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(-reach, reach + 1) for j in range(-reach, reach + 1)])
    sent = cells.select("row", "col", value, F.explode(steps).alias("s"))
    at = sent.select((F.col("row") + F.col("s.i")).alias("row"), (F.col("col") + F.col("s.j")).alias("col"), value, ((F.col("s.i") == 0) & (F.col("s.j") == 0)).alias("own"))
    return at.groupBy("row", "col").agg(F.sum(value).alias("window_sum"), F.bool_or("own").alias("is_cell"), F.max(F.when(F.col("own"), F.col(value))).alias(value)).where("is_cell").drop("is_cell")


def hexagon(x: Column, y: Column, side: float) -> tuple[Column, Column]:
    """Axial coordinates of the flat hexagon around a point, by cube rounding (halves to even)."""
    q, r = x * (2.0 / 3) / side, (x * (-1.0 / 3) + y * (math.sqrt(3) / 3)) / side
    s = -q - r
    rq, rr, rs = F.rint(q), F.rint(r), F.rint(s)
    dq, dr, ds = F.abs(rq - q), F.abs(rr - r), F.abs(rs - s)
    whole_q = F.when((dq > dr) & (dq > ds), -rr - rs).otherwise(rq)
    whole_r = F.when(~((dq > dr) & (dq > ds)) & (dr > ds), -rq - rs).otherwise(rr)
    return whole_q.cast("long"), whole_r.cast("long")


def hexagon_centre(q: Column, r: Column, side: float) -> tuple[Column, Column]:
    return q * (1.5 * side), (r + q / 2) * (math.sqrt(3) * side)


def hexagon_wkt(x: Column, y: Column, side: float) -> Column:
    """The closed ring of a flat hexagon around its centre, to the millimetre."""
    corners = [(side * math.cos(math.pi / 3 * k), side * math.sin(math.pi / 3 * k)) for k in (0, 1, 2, 3, 4, 5, 0)]
    points = [F.format_string("%.3f %.3f", x + dx, y + dy) for dx, dy in corners]
    return F.concat(F.lit("POLYGON (("), F.concat_ws(", ", *points), F.lit("))"))


def utm(longitude: Column, latitude: Column, zone: int = 10) -> tuple[Column, Column]:
    """Easting and northing in metres on the northern half of a UTM zone (WGS 84), by the third-order series in the
    third flattening; good to a millimetre within some degrees of the central meridian."""
    a, f, scale = 6378137.0, 1 / 298.257223563, 0.9996
    n = f / (2 - f)
    radius = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    e = 2 * math.sqrt(n) / (1 + n)
    sine, east = F.sin(F.radians(latitude)), F.radians(longitude - F.lit(6.0 * zone - 183))
    t = F.sinh(F.atanh(sine) - e * F.atanh(e * sine))
    xi, eta = F.atan2(t, F.cos(east)), F.atanh(F.sin(east) / F.sqrt(1 + t * t))
    x, y = eta, xi
    for j, c in enumerate(alpha, 1):
        x = x + c * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        y = y + c * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return 500000 + scale * radius * x, scale * radius * y


def utm_inverse(easting: Column, northing: Column, zone: int = 10) -> tuple[Column, Column]:
    """Longitude and latitude in degrees of metres on the northern half of a UTM zone: the way back from utm(), by the
    inverse series (to the fourth order for the latitude); forward and back differ by less than a millimetre."""
    a, f, scale = 6378137.0, 1 / 298.257223563, 0.9996
    n = f / (2 - f)
    radius = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    beta = (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480)
    delta = (
        2 * n - 2 * n**2 / 3 - 2 * n**3 + 116 * n**4 / 45, 7 * n**2 / 3 - 8 * n**3 / 5 - 227 * n**4 / 45,
        56 * n**3 / 15 - 136 * n**4 / 35, 4279 * n**4 / 630,
    )
    xi, eta = northing / (scale * radius), (easting - 500000) / (scale * radius)
    x, y = eta, xi
    for j, c in enumerate(beta, 1):
        x = x - c * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        y = y - c * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    conformal = F.asin(F.sin(y) / F.cosh(x))
    latitude = conformal
    for j, c in enumerate(delta, 1):
        latitude = latitude + c * F.sin(2 * j * conformal)
    return F.lit(6.0 * zone - 183) + F.degrees(F.atan2(F.sinh(x), F.cos(y))), F.degrees(latitude)


def context(cells: DataFrame, positive: str) -> DataFrame:
    """Each cell (row, col, positive) with the positives in its 3 x 3 and 5 x 5 windows, their share of the cells there
    that exist, and its edge and ring classes. Cells are sent to their windows' cells and summed there."""
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(-2, 3) for j in range(-2, 3)])
    sent = cells.select("row", "col", F.col(positive).cast("int").alias("_p"), F.explode(steps).alias("s"))
    i, j = F.col("s.i"), F.col("s.j")
    near, own = (F.abs(i) <= 1) & (F.abs(j) <= 1), (i == 0) & (j == 0)
    at = sent.select((F.col("row") + i).alias("row"), (F.col("col") + j).alias("col"), "_p", near.alias("near"), own.alias("own"))
    summed = at.groupBy("row", "col").agg(
        F.max(F.when(F.col("own"), F.col("_p"))).alias("_p"), F.sum(F.when(F.col("near"), F.col("_p")).otherwise(0)).alias("count_3x3"),
        F.count_if("near").alias("_kept3"), F.sum("_p").alias("count_5x5"), F.count(F.lit(1)).alias("_kept5"),
    ).where("_p IS NOT NULL")
    edge = classify.edge_class(F.col("_p") == 1, F.col("count_3x3"), F.col("count_5x5"))
    return summed.select(
        "row", "col", (F.col("_p") == 1).alias(positive), "count_3x3", (F.col("count_3x3") / F.col("_kept3")).alias("share_3x3"),
        "count_5x5", (F.col("count_5x5") / F.col("_kept5")).alias("share_5x5"), edge.alias("edge_class"), classify.exterior_ring(edge).alias("ring_class"),
    )


#: Cells of a strip of rows at most (a single row is never cut), and its rows at most.
STRIP_CELLS, STRIP_ROWS = 1 << 20, 256


def _nearest_squares(at: np.ndarray, columns: np.ndarray, squares: np.ndarray) -> np.ndarray:
    """For each column of at (sorted), the least (at - c) ** 2 + square over columns c (sorted) with their squares.

    The lower envelope of parabolas: the best column never moves left as at grows, so the middle one of each open range
    splits its columns in two; all ranges of a level are searched together.
    """
    best = np.full(len(at), -1)
    low, high = np.zeros(1, np.int64), np.full(1, len(at) - 1)  # ranges of at
    first, last = np.zeros(1, np.int64), np.full(1, len(columns) - 1)  # and of columns that may be best there
    while len(low):
        middle, size = (low + high) // 2, last - first + 1
        begin = np.cumsum(size) - size
        tried = np.arange(size.sum()) - np.repeat(begin, size) + np.repeat(first, size)
        away = np.repeat(at[middle], size) - columns[tried]
        cost = away * away + squares[tried]
        least = np.minimum.reduceat(cost, begin)
        here = np.flatnonzero(cost == np.repeat(least, size))
        place = tried[here[np.searchsorted(here, begin)]]
        best[middle] = least
        left, right = low < middle, middle < high
        low, high, first, last = (
            np.r_[low[left], middle[right] + 1], np.r_[middle[left] - 1, high[right]],
            np.r_[first[left], place[right]], np.r_[place[left], last[right]],
        )
    return best


def _distances(asked: pa.Table, known: pa.Table) -> pa.Table:
    """Distances of one strip's cells: known has its positives and the nearest ones above and below it in each column."""
    names = ["row", "col"]
    rows, cols = (asked.column(c).to_numpy() for c in names)
    order = np.lexsort((cols, rows))
    rows, cols = rows[order], cols[order]
    distance = np.full(len(rows), np.nan)
    if known.num_rows and len(rows):
        prow, pcol = (known.column(c).to_numpy() for c in names)
        top, height = rows[0], rows[-1] - rows[0] + 1
        columns, at = np.unique(pcol, return_inverse=True)
        far = np.int64(1) << 31
        above, below = np.full((height, len(columns)), -far), np.full((height, len(columns)), far)
        np.maximum.at(above, (np.clip(prow - top, 0, height - 1)[prow - top < height], at[prow - top < height]), (prow - top)[prow - top < height])
        np.minimum.at(below, (np.clip(prow - top, 0, height - 1)[prow >= top], at[prow >= top]), (prow - top)[prow >= top])
        above = np.maximum.accumulate(above, axis=0)
        below = np.minimum.accumulate(below[::-1], axis=0)[::-1]
        start = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
        for a, b in zip(start.tolist(), [*start[1:].tolist(), len(rows)], strict=True):
            line = rows[a] - top
            vertical = np.minimum(line - above[line], below[line] - line)
            seen = vertical < far // 2
            distance[a:b] = np.sqrt(_nearest_squares(cols[a:b], columns[seen], (vertical * vertical)[seen]).astype(np.float64))
    return pa.table([pa.array(rows), pa.array(cols), pa.array(distance, mask=np.isnan(distance))], ["row", "col", "distance"])


def nearest_positive(cells: DataFrame, positives: DataFrame) -> DataFrame:
    """cells (row, col) with the Euclidean distance to the nearest of positives (row, col); null if there are none.

    An exact distance transform of a raster in two passes. Down the columns, in SQL: each strip of rows that holds cells
    is told, for each column with positives, the last one above it and the first one below. Along the rows, within a strip: the lower
    envelope of the columns' parabolas. What moves is the cells, the positives and two numbers for each strip and
    column; a task holds one strip. Rows and columns span less than 2 ** 30. Repeated cells count once.
    """
    asked = saved(cells.select(F.col("row").cast("long"), F.col("col").cast("long")).distinct(), "cells")
    there = saved(positives.select(F.col("row").cast("long"), F.col("col").cast("long")).distinct(), "positives")
    ends = asked.select("col").unionByName(there.select("col")).agg(F.min("col"), F.max("col")).first()
    width = 1 if ends[0] is None else ends[1] - ends[0] + 1
    height = max(1, min(STRIP_ROWS, STRIP_CELLS // width))
    strip = F.floor(F.col("row") / height).alias("strip")
    every = asked.select(strip).unionByName(there.select(strip)).distinct()
    numbered = saved(every.select("strip", F.row_number().over(Window.orderBy("strip")).alias("n")), "strips")  # a row a strip
    spans = there.groupBy(strip, "col").agg(F.min("row").alias("first"), F.max("row").alias("last")).join(numbered, "strip")
    column = Window.partitionBy("col").orderBy("n")
    spans = spans.select("col", "n", "first", "last", F.lead("n").over(column).alias("next"), F.lag("n").over(column).alias("before"))

    def told(row: str, low: Column, high: Column) -> DataFrame:
        """The columns' nearest positives (row) for the strips numbered low to high."""
        each = spans.where(low <= high).select("col", F.col(row).alias("row"), F.explode(F.sequence(low, high)).alias("n"))
        return each.join(numbered, "n").select("strip", "row", "col")

    above = told("last", F.col("n") + 1, F.coalesce("next", F.lit(numbered.count())).cast("int"))
    below = told("first", F.coalesce("before", F.lit(1)), F.col("n") - 1)
    known = there.select(strip, "row", "col").unionByName(above).unionByName(below)
    both = asked.withColumn("strip", strip).groupBy("strip").cogroup(known.groupBy("strip"))
    return both.applyInArrow(_distances, "row long, col long, distance double")


def connected(cells: DataFrame, columns: int, cell_size: float = 30.0) -> DataFrame:
    """8-connected components of cells (row, col) on a grid of so many columns: component (its first cell, row by row),
    cells and area. Each round hooks components to their least neighbour and contracts the links between them."""
    numbered = saved(cells.select((F.col("row") * columns + F.col("col")).alias("node"), "row", "col").distinct(), "cells")
    ahead = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in ((0, 1), (1, -1), (1, 0), (1, 1))]))
    links = numbered.select(F.col("node").alias("a"), "row", "col", ahead.alias("s")).select("a", (F.col("row") + F.col("s.i")).alias("row"), (F.col("col") + F.col("s.j")).alias("col"))
    edges = saved(links.join(numbered.select("row", "col", F.col("node").alias("b")), ["row", "col"]).select("a", "b"), "links")
    labels = numbered.select("node", F.col("node").alias("component"))
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("top"))
        hook = saved(hook, "hook")
        parent = hook.select(F.col("node").alias("top"), F.col("top").alias("above"))
        hook = saved(hook.join(parent, "top").select("node", F.col("above").alias("top")), "hook")
        labels = saved(labels.join(hook.select(F.col("node").alias("component"), "top"), "component", "left").select("node", F.coalesce("top", "component").alias("component")), "labels")
        ends = hook.select(F.col("node").alias("a"), F.col("top").alias("x")), hook.select(F.col("node").alias("b"), F.col("top").alias("y"))
        edges = saved(edges.join(ends[0], "a").join(ends[1], "b").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "links")
    sizes = labels.groupBy("component").agg(F.count(F.lit(1)).alias("cells"), F.min("node").alias("first_cell"))
    sizes = sizes.withColumn("area", F.col("cells") * (cell_size * cell_size))
    return numbered.join(labels, "node").join(sizes, "component").select("row", "col", F.col("first_cell").alias("component"), "cells", "area")


def block_average(pixels: DataFrame, features: list[str], size: int = 3, complete: bool = False) -> DataFrame:
    """Means of features over blocks of size x size pixels (row, col), and the pixels they rest on.

    complete: a block counts only if all its pixels are there with all features; else known values are averaged.
    """
    full = classify.complete(*features)
    blocks = pixels.groupBy(F.floor(F.col("row") / size).alias("row"), F.floor(F.col("col") / size).alias("col"))
    out = blocks.agg(F.count_if(full).alias("valid_pixels"), *[F.avg(F.when(classify.known(F.col(f)), F.col(f))).alias(f) for f in features])
    return out.where(F.col("valid_pixels") == size * size) if complete else out


def in_window(row: Column, col: Column, window: tuple[int, int, int, int]) -> Column:
    """Whether a cell is in the window (row, col, rows, columns); its ends are open. Plain comparisons reach the scan."""
    return (row >= window[0]) & (row < window[0] + window[2]) & (col >= window[1]) & (col < window[1] + window[3])


def snapped(points: DataFrame, x: str, y: str, resolution: float, tolerance: float) -> DataFrame:
    """points with their lattice place (row, col), its rows and columns, and the distance to it.

    The lattice starts at the smallest x and the largest y; its size follows from the span. A point further from its
    place than tolerance stops the job.
    """
    ends = F.broadcast(points.agg(F.min(x).alias("_x0"), F.max(x).alias("_x1"), F.min(y).alias("_y0"), F.max(y).alias("_y1")))  # one row
    place = points.join(ends).withColumn("col", F.rint((F.col(x) - F.col("_x0")) / resolution).cast("long")).withColumn("row", F.rint((F.col("_y1") - F.col(y)) / resolution).cast("long"))
    off = F.hypot(F.col(x) - F.col("_x0") - F.col("col") * resolution, F.col("_y1") - F.col(y) - F.col("row") * resolution)
    size = lambda low, high: (F.rint((F.col(high) - F.col(low)) / resolution) + 1).cast("long")
    refused = F.raise_error(F.concat(F.lit("a point is off the lattice by "), off.cast("string"))).cast("double")
    return place.select(*points.columns, "row", "col", size("_y0", "_y1").alias("lattice_rows"), size("_x0", "_x1").alias("lattice_columns"), F.when(off > tolerance, refused).otherwise(off).alias("snap_distance"))
