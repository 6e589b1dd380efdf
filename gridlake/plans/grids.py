"""Grid operators; cells are lineitem's parts on 100 columns, points come from customers and cells."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from gridlake.operators import spatial
from gridlake.plans.base import query
from gridlake.sources.tables import observations, scan

CELLS = ', cl AS (SELECT "row", col, avg(observed) AS a, avg(observed) >= 0.62 AS positive FROM o GROUP BY 1, 2)'
_EDGE = "CASE WHEN positive AND c3 <= 1 THEN 'isolated_positive' WHEN positive AND c3 >= 9 THEN 'positive_interior' WHEN positive THEN 'positive_edge' WHEN c3 > 0 THEN 'zero_adjacent_to_positive' WHEN c5 > 0 THEN 'near_positive_exterior' ELSE 'far_zero_exterior' END"


def cells(spark, d):
    """Cells with their mean to 12 digits: shares are whole 50ths, and a mean that is just a threshold counts as reaching
    it, in whatever order the rows were summed."""
    found = observations(spark, d).groupBy("row", "col").agg(F.round(F.avg("observed"), 12).alias("a"))
    return found.withColumn("positive", F.col("a") >= 0.62)


@query(
    "grid_context",
    CELLS + f""", wn AS (SELECT a."row", a.col, any_value(a.positive) AS positive, count(*) FILTER (b.positive AND abs(a."row" - b."row") <= 1 AND abs(a.col - b.col) <= 1) AS c3, count(*) FILTER (abs(a."row" - b."row") <= 1 AND abs(a.col - b.col) <= 1) AS k3, count(*) FILTER (b.positive) AS c5, count(*) AS k5
 FROM cl a JOIN cl b ON abs(a."row" - b."row") <= 2 AND abs(a.col - b.col) <= 2 GROUP BY 1, 2), eg AS (SELECT *, {_EDGE} AS edge_class FROM wn)
 SELECT "row", col, positive, c3 AS count_3x3, round(c3 / k3, 6) AS share_3x3, c5 AS count_5x5, round(c5 / k5, 6) AS share_5x5, edge_class,
 CASE WHEN edge_class IN ('positive_interior', 'positive_edge', 'isolated_positive') THEN 'observed_positive' WHEN edge_class = 'zero_adjacent_to_positive' THEN 'adjacent_8_neighbor_ring' WHEN edge_class = 'near_positive_exterior' THEN 'near_5x5_ring' ELSE 'far_exterior' END AS ring_class FROM eg""",
)
def _(spark, d):
    found = spatial.context(cells(spark, d), "positive")
    return found.withColumns({"share_3x3": F.round("share_3x3", 6), "share_5x5": F.round("share_5x5", 6)})


@query("edge_effects", CELLS + f""", wn AS (SELECT a."row", a.col, any_value(a.positive) AS positive, any_value(a.a) AS v, count(*) FILTER (b.positive AND abs(a."row" - b."row") <= 1 AND abs(a.col - b.col) <= 1) AS c3, count(*) FILTER (b.positive) AS c5
 FROM cl a JOIN cl b ON abs(a."row" - b."row") <= 2 AND abs(a.col - b.col) <= 2 GROUP BY 1, 2) SELECT {_EDGE} AS edge_class, count(*) AS cells, count(*) FILTER (positive AND v < 0.7) AS missed, count(*) FILTER (NOT positive AND v >= 0.55) AS leaked, round(count(*) FILTER (NOT positive AND v >= 0.55) / count(*), 6) AS leak_rate FROM wn GROUP BY 1""")
def _(spark, d):
    given = cells(spark, d)
    rows = spatial.context(given, "positive").join(given.select("row", "col", "a"), ["row", "col"])
    n, leaked = F.count(F.lit(1)), F.count_if(~F.col("positive") & (F.col("a") >= 0.55))
    return rows.groupBy("edge_class").agg(n.alias("cells"), F.count_if(F.col("positive") & (F.col("a") < 0.7)).alias("missed"), leaked.alias("leaked"), F.round(leaked / n, 6).alias("leak_rate"))


@query("nearest_positive", CELLS + ' SELECT a."row", a.col, round(min(sqrt((a."row" - b."row") ** 2 + (a.col - b.col) ** 2)), 9) AS distance FROM cl a LEFT JOIN (SELECT * FROM cl WHERE a >= 0.66) b ON true GROUP BY 1, 2')
def _(spark, d):
    given = cells(spark, d)
    return spatial.nearest_positive(given, given.where("a >= 0.66")).withColumn("distance", F.round("distance", 9))


@query(
    "connected_components",
    CELLS + """, nd AS (SELECT "row" * 100 + col AS id, "row", col FROM cl WHERE positive), ed AS (SELECT a.id AS a, b.id AS b FROM nd a JOIN nd b ON abs(a."row" - b."row") <= 1 AND abs(a.col - b.col) <= 1 AND a.id <> b.id),
 wk AS (WITH RECURSIVE w AS (SELECT id, id AS m FROM nd UNION SELECT ed.b, w.m FROM w JOIN ed ON ed.a = w.id WHERE w.m < ed.b) SELECT id, min(m) AS component FROM w GROUP BY 1)
 SELECT nd."row", nd.col, component, count(*) OVER (PARTITION BY component) AS cells, count(*) OVER (PARTITION BY component) * 900.0::DOUBLE AS area FROM nd JOIN wk USING (id)""",
)
def _(spark, d):
    return spatial.connected(cells(spark, d).where("positive"), 100)


@query("block_averages", CELLS + ' SELECT CAST(floor("row" / 3) AS BIGINT) AS "row", CAST(floor(col / 3) AS BIGINT) AS col, count(*) AS valid_pixels, round(avg(a), 9) AS a FROM cl WHERE "row" >= 2 AND "row" < 14 AND col >= 10 AND col < 70 GROUP BY 1, 2 HAVING count(*) = 9')
def _(spark, d):
    window = spatial.in_window(F.col("row"), F.col("col"), (2, 10, 12, 60))
    return spatial.block_average(cells(spark, d).where(window), ["a"], 3, complete=True).withColumn("a", F.round("a", 9))


_SIDE = 3.0 / math.sqrt(3)
_HEX = f""", pt AS (SELECT c_custkey AS id, (c_acctbal % 97) AS x, (c_nationkey * 3.7::DOUBLE) AS y, c_acctbal FROM customer), h0 AS (SELECT *, x * (2.0::DOUBLE / 3) / {_SIDE!r}::DOUBLE AS q, (x * (-1.0::DOUBLE / 3) + y * {math.sqrt(3) / 3!r}::DOUBLE) / {_SIDE!r}::DOUBLE AS r FROM pt),
 h1 AS (SELECT *, -q - r AS s, round_even(q, 0) AS rq, round_even(r, 0) AS rr, round_even(-q - r, 0) AS rs FROM h0), h2 AS (SELECT *, abs(rq - q) AS dq, abs(rr - r) AS dr, abs(rs - s) AS ds FROM h1),
 hx AS (SELECT *, CAST(CASE WHEN dq > dr AND dq > ds THEN -rr - rs ELSE rq END AS BIGINT) AS hq, CAST(CASE WHEN NOT (dq > dr AND dq > ds) AND dr > ds THEN -rq - rs ELSE rr END AS BIGINT) AS hr FROM h2)"""


@query(
    "hexagon_bins",
    _HEX + f" SELECT hq, hr, round(hq * {1.5 * _SIDE!r}::DOUBLE, 6) AS x, round((hr + hq / 2) * {math.sqrt(3) * _SIDE!r}::DOUBLE, 6) AS y, count(*) AS n, count(*) FILTER (c_acctbal > 5000) AS positives, round(count(*) FILTER (c_acctbal > 5000) / count(*), 6) AS rate, round(avg(c_acctbal), 4) AS mean FROM hx GROUP BY 1, 2",
)
def _(spark, d):
    points = scan(spark, d, "customer", "c_acctbal", "c_nationkey").select((F.col("c_acctbal") % 97).alias("x"), (F.col("c_nationkey") * 3.7).alias("y"), "c_acctbal")
    q, r = spatial.hexagon(F.col("x"), F.col("y"), _SIDE)
    hits = F.count_if(F.col("c_acctbal") > 5000)
    bins = points.groupBy(q.alias("hq"), r.alias("hr")).agg(F.count(F.lit(1)).alias("n"), hits.alias("positives"), F.round(hits / F.count(F.lit(1)), 6).alias("rate"), F.round(F.avg("c_acctbal"), 4).alias("mean"))
    x, y = spatial.hexagon_centre(F.col("hq"), F.col("hr"), _SIDE)
    return bins.select("*", F.round(x, 6).alias("x"), F.round(y, 6).alias("y"))


@query(
    "hexagon_outlines",
    _HEX + f" SELECT DISTINCT hq, hr, 'POLYGON ((' || concat_ws(', ', " + ", ".join(f"printf('%.3f %.3f', hq * {1.5 * _SIDE!r}::DOUBLE + {_SIDE * math.cos(math.pi / 3 * k)!r}::DOUBLE, (hr + hq / 2) * {math.sqrt(3) * _SIDE!r}::DOUBLE + {_SIDE * math.sin(math.pi / 3 * k)!r}::DOUBLE)" for k in (0, 1, 2, 3, 4, 5, 0)) + ") || '))' AS wkt FROM hx",
)
def _(spark, d):
    points = scan(spark, d, "customer", "c_acctbal", "c_nationkey").select((F.col("c_acctbal") % 97).alias("x"), (F.col("c_nationkey") * 3.7).alias("y"))
    q, r = spatial.hexagon(F.col("x"), F.col("y"), _SIDE)
    x, y = spatial.hexagon_centre(F.col("hq"), F.col("hr"), _SIDE)
    return points.select(q.alias("hq"), r.alias("hr")).distinct().select("hq", "hr", spatial.hexagon_wkt(x, y, _SIDE).alias("wkt"))


_N = (1 / 298.257223563) / (2 - 1 / 298.257223563)


@query(
    "projected_points",
    f""", ll AS (SELECT p_partkey AS id, -125 + (p_partkey % 100) * 0.05::DOUBLE AS lon, 34 + (p_partkey // 100) * 0.1::DOUBLE AS lat FROM part), t0 AS (SELECT *, sin(radians(lat)) AS sn, radians(lon + 123) AS ea, {2 * math.sqrt(_N) / (1 + _N)!r}::DOUBLE AS e FROM ll),
 t1 AS (SELECT *, sinh(atanh(sn) - e * atanh(e * sn)) AS t FROM t0), t2 AS (SELECT *, atan2(t, cos(ea)) AS xi, atanh(sin(ea) / sqrt(1 + t * t)) AS eta FROM t1)
 SELECT id, round(500000 + {0.9996 * 6378137.0 / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)!r}::DOUBLE * (eta + """ + " + ".join(f"{c!r}::DOUBLE * cos({2 * j} * xi) * sinh({2 * j} * eta)" for j, c in enumerate((_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16, 13 * _N**2 / 48 - 3 * _N**3 / 5, 61 * _N**3 / 240), 1))
    + f"), 4) AS easting, round({0.9996 * 6378137.0 / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)!r}::DOUBLE * (xi + " + " + ".join(f"{c!r}::DOUBLE * sin({2 * j} * xi) * cosh({2 * j} * eta)" for j, c in enumerate((_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16, 13 * _N**2 / 48 - 3 * _N**3 / 5, 61 * _N**3 / 240), 1)) + "), 4) AS northing FROM t2",
)
def _(spark, d):
    key = F.col("p_partkey")
    points = scan(spark, d, "part", "p_partkey").select(key.alias("id"), (-125 + (key % 100) * 0.05).alias("lon"), (34 + F.floor(key / 100) * 0.1).alias("lat"))
    x, y = spatial.utm(F.col("lon"), F.col("lat"))
    return points.select("id", F.round(x, 4).alias("easting"), F.round(y, 4).alias("northing"))


@query(
    "snapped_points",
    """, pt AS (SELECT p_partkey AS id, (p_partkey % 100) * 30.0::DOUBLE + (p_partkey % 7 - 3) * 0.005::DOUBLE AS x, (p_partkey // 100) * 30.0::DOUBLE AS y FROM part), en AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM pt),
 sn AS (SELECT *, round_even((x - x0) / 30, 0) AS c, round_even((y1 - y) / 30, 0) AS r FROM pt, en)
 SELECT CAST(r AS BIGINT) AS "row", count(*) AS n, max(CAST(round_even((y1 - y0) / 30, 0) + 1 AS BIGINT)) AS lattice_rows, max(CAST(round_even((x1 - x0) / 30, 0) + 1 AS BIGINT)) AS lattice_columns, round(avg(sqrt((x - x0 - c * 30) ** 2 + (y1 - y - r * 30) ** 2)), 6) AS mean_distance, round(max(sqrt((x - x0 - c * 30) ** 2 + (y1 - y - r * 30) ** 2)), 6) AS max_distance FROM sn GROUP BY 1""",
)
def _(spark, d):
    key = F.col("p_partkey")
    points = scan(spark, d, "part", "p_partkey").select(key.alias("id"), ((key % 100) * 30.0 + (key % 7 - 3) * 0.005).alias("x"), (F.floor(key / 100) * 30.0).alias("y"))
    found = spatial.snapped(points, "x", "y", 30.0, 0.05)
    return found.groupBy("row").agg(F.count(F.lit(1)).alias("n"), F.max("lattice_rows").alias("lattice_rows"), F.max("lattice_columns").alias("lattice_columns"), F.round(F.avg("snap_distance"), 6).alias("mean_distance"), F.round(F.max("snap_distance"), 6).alias("max_distance"))
