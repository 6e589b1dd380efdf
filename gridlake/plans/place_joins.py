"""Joins of two tables by place: parts lie on a grid of 100 columns, suppliers have boxes and rings, customers are points."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridlake.operators import places, spatial
from gridlake.plans.base import query
from gridlake.sources.tables import scan

_PARTS = """, pa AS (
  SELECT p_partkey AS id, p_partkey % 100 AS x0, p_partkey // 100 AS y0, p_retailprice AS price,
    p_partkey % 100 + (p_size % 7) / 2.0::DOUBLE AS x1, p_partkey // 100 + (p_size % 5) / 4.0::DOUBLE AS y1
  FROM part)"""
_SUPPLIERS = """, su AS (
  SELECT s_suppkey AS key, s_acctbal, s_nationkey, s_suppkey * 7 % 100 AS x0, s_suppkey * 3 % 20 AS y0,
    s_suppkey * 7 % 100 + s_suppkey % 40 / 2.0::DOUBLE AS x1, s_suppkey * 3 % 20 + s_suppkey % 3 AS y1
  FROM supplier)"""
_OVERLAP = """, ov AS (
  SELECT pa.id, su.key FROM pa JOIN su
    ON pa.x0 <= su.x1 AND su.x0 <= pa.x1 AND pa.y0 <= su.y1 AND su.y0 <= pa.y1)"""


def _parts(spark, d):
    key, size = F.col("p_partkey"), F.col("p_size")
    x0, y0 = key % 100, F.floor(key / 100)
    return scan(spark, d, "part", "p_partkey", "p_size", "p_retailprice").select(
        key.alias("id"), x0.alias("x0"), y0.alias("y0"), (x0 + size % 7 / 2.0).alias("x1"), (y0 + size % 5 / 4.0).alias("y1"),
        F.col("p_retailprice").alias("price"),
    )


def _suppliers(spark, d):
    key = F.col("s_suppkey")
    x0, y0 = key * 7 % 100, key * 3 % 20
    return scan(spark, d, "supplier").select(
        key.alias("key"), "s_acctbal", "s_nationkey", x0.alias("x0"), y0.alias("y0"), (x0 + key % 40 / 2.0).alias("x1"), (y0 + key % 3).alias("y1"),
    )


@query(
    "overlapping_boxes",
    _PARTS + _SUPPLIERS + _OVERLAP + """
SELECT key, count(*) AS parts, round(sum(price), 4) AS price FROM ov JOIN pa USING (id) GROUP BY key""",
)
def _(spark, d):
    parts = _parts(spark, d)
    pairs = places.overlapping(parts, _suppliers(spark, d))
    sums = pairs.join(parts.select("id", "price"), "id").groupBy("key")
    return sums.agg(F.count(F.lit(1)).alias("parts"), F.round(F.sum("price"), 4).alias("price"))


@query(
    "latest_intersecting_product",
    _PARTS + _SUPPLIERS + _OVERLAP + """
SELECT id, arg_max(key, (s_acctbal, key)) AS key FROM ov JOIN su USING (key) GROUP BY id""",
)
def _(spark, d):
    products = _suppliers(spark, d)
    met = places.overlapping(_parts(spark, d), products).join(products.select("key", "s_acctbal"), "key")
    return met.groupBy("id").agg(F.max_by("key", F.struct("s_acctbal", "key")).alias("key"))


@query(
    "first_valid_source",
    _PARTS + _SUPPLIERS + """
, hit AS (
  SELECT pa.id, key, s_nationkey FROM pa JOIN su
    ON pa.x0 BETWEEN su.x0 AND su.x1 AND pa.y0 BETWEEN su.y0 AND su.y1 WHERE s_acctbal > 1000),
ch AS (SELECT id, key, row_number() OVER (PARTITION BY id ORDER BY s_nationkey, key) AS place FROM hit)
SELECT pa.id, ch.key, CASE WHEN ch.key IS NULL THEN 'no_valid_source' ELSE 'valid' END AS status
FROM pa LEFT JOIN ch ON ch.id = pa.id AND place = 1""",
)
def _(spark, d):
    points = _parts(spark, d).select("id", "x0", "y0", F.col("x0").alias("x1"), F.col("y0").alias("y1"))
    sources = _suppliers(spark, d)
    chosen = places.first_valid(places.overlapping(points, sources), sources.drop(*places.BOX), "s_nationkey", F.col("s_acctbal") > 1000)
    status = F.when(F.col("key").isNull(), "no_valid_source").otherwise("valid")
    return points.select("id").join(chosen, "id", "left").withColumn("status", status)


#: A star of twelve vertices around each supplier, with a square hole.
_RINGS = """, v AS (
  SELECT s_suppkey AS polygon, 0 AS ring, k AS seq,
    s_suppkey * 7 % 100 + (1 + (s_suppkey * 31 + k * 17) % 23 / 10.0::DOUBLE) * cos(k * 0.5235987755982988::DOUBLE) AS x,
    s_suppkey * 3 % 20 + (1 + (s_suppkey * 31 + k * 17) % 23 / 10.0::DOUBLE) * sin(k * 0.5235987755982988::DOUBLE) AS y
  FROM supplier, range(12) AS u(k)
  UNION ALL
  SELECT s_suppkey, 1, k, s_suppkey * 7 % 100 + CASE WHEN k IN (0, 3) THEN -0.51::DOUBLE ELSE 0.51::DOUBLE END,
    s_suppkey * 3 % 20 + CASE WHEN k < 2 THEN -0.51::DOUBLE ELSE 0.51::DOUBLE END
  FROM supplier, range(4) AS u(k)),
sd AS (
  SELECT polygon, x AS x1, y AS y1, coalesce(lead(x) OVER w, first_value(x) OVER w) AS x2, coalesce(lead(y) OVER w, first_value(y) OVER w) AS y2
  FROM v WINDOW w AS (PARTITION BY polygon, ring ORDER BY seq)),
pt AS (SELECT c_custkey AS id, c_custkey * 37 % 10000 / 100.0::DOUBLE AS x, c_custkey * 911 % 2000 / 100.0::DOUBLE AS y FROM customer)"""


def _rings(spark, d):
    key, k = F.col("s_suppkey"), F.col("seq")
    given = scan(spark, d, "supplier", "s_suppkey")
    reach = 1 + (key * 31 + k * 17) % 23 / 10.0
    stars = given.withColumn("seq", F.explode(F.sequence(F.lit(0), F.lit(11)))).select(
        key.alias("polygon"), F.lit(0).alias("ring"), "seq",
        (key * 7 % 100 + reach * F.cos(k * 0.5235987755982988)).alias("x"), (key * 3 % 20 + reach * F.sin(k * 0.5235987755982988)).alias("y"),
    )
    corner = lambda first: F.when(first, -0.51).otherwise(0.51)
    holes = given.withColumn("seq", F.explode(F.sequence(F.lit(0), F.lit(3)))).select(
        key.alias("polygon"), F.lit(1).alias("ring"), "seq",
        (key * 7 % 100 + corner(k.isin(0, 3))).alias("x"), (key * 3 % 20 + corner(k < 2)).alias("y"),
    )
    return stars.unionByName(holes)


@query(
    "points_in_polygons",
    _RINGS + """
SELECT id, polygon FROM pt JOIN sd ON (y1 > y) <> (y2 > y) AND x < (x2 - x1) * (y - y1) / (y2 - y1) + x1
GROUP BY id, polygon HAVING count(*) % 2 = 1""",
)
def _(spark, d):
    key = F.col("c_custkey")
    points = scan(spark, d, "customer", "c_custkey").select(key.alias("id"), (key * 37 % 10000 / 100.0).alias("x"), (key * 911 % 2000 / 100.0).alias("y"))
    return places.in_polygons(points, _rings(spark, d), 0.5)


@query(
    "nearest_centres",
    """, ax AS (SELECT DISTINCT s_acctbal AS centre FROM supplier)
SELECT c_custkey AS id, arg_min(centre, (abs(c_acctbal - centre), centre)) AS centre FROM customer, ax GROUP BY c_custkey""",
)
def _(spark, d):
    points = scan(spark, d, "customer", "c_custkey", "c_acctbal")
    found = places.nearest_centre(points, "c_acctbal", scan(spark, d, "supplier", "s_acctbal").distinct(), "s_acctbal")
    return found.select(F.col("c_custkey").alias("id"), F.col("s_acctbal").alias("centre"))


_IRREGULAR = """, gr AS (
  SELECT CAST(r * r AS DOUBLE) AS x, CAST(c * c * c AS DOUBLE) / 10 AS y, v AS value
  FROM (SELECT p_partkey % 40 AS r, p_partkey % 37 AS c, max(p_retailprice) AS v FROM part GROUP BY 1, 2)),
ps AS (SELECT c_custkey AS id, c_custkey % 1600 + 0.3::DOUBLE AS px, c_custkey * 7 % 5000 + 0.1::DOUBLE AS py FROM customer),
nx AS (SELECT id, arg_min(x, (abs(px - x), x)) AS gx FROM ps, (SELECT DISTINCT x FROM gr) GROUP BY id),
ny AS (SELECT id, arg_min(y, (abs(py - y), y)) AS gy FROM ps, (SELECT DISTINCT y FROM gr) GROUP BY id)"""


@query("irregular_grid_samples", _IRREGULAR + """
SELECT id, gx AS grid_x, gy AS grid_y, value FROM nx JOIN ny USING (id) LEFT JOIN gr ON gr.x = gx AND gr.y = gy""")
def _(spark, d):
    key = F.col("p_partkey")
    cells = scan(spark, d, "part", "p_partkey", "p_retailprice").groupBy((key % 40).alias("r"), (key % 37).alias("c")).agg(F.max("p_retailprice").alias("value"))
    r, c = F.col("r"), F.col("c")
    grid = cells.select((r * r).cast("double").alias("x"), ((c * c * c).cast("double") / 10).alias("y"), "value")
    at = F.col("c_custkey")
    points = scan(spark, d, "customer", "c_custkey").select(at.alias("id"), (at % 1600 + 0.3).alias("px"), (at * 7 % 5000 + 0.1).alias("py"))
    return places.sampled_irregular(points, "px", "py", grid).select("id", "grid_x", "grid_y", "value")


@query("unprojected_points", """
SELECT c_custkey AS id, round(-125 + c_custkey % 401 * 0.01::DOUBLE, 8) AS longitude, round(31 + c_custkey % 1103 * 0.01::DOUBLE, 8) AS latitude FROM customer""")
def _(spark, d):
    """Points projected and brought back: what remains is below a millimetre, some 1e-8 degrees."""
    key = F.col("c_custkey")
    points = scan(spark, d, "customer", "c_custkey").select(key.alias("id"), (-125 + key % 401 * 0.01).alias("lon"), (31 + key % 1103 * 0.01).alias("lat"))
    east, north = spatial.utm(F.col("lon"), F.col("lat"))
    lon, lat = spatial.utm_inverse(F.col("east"), F.col("north"))
    return points.select("id", east.alias("east"), north.alias("north")).select("id", F.round(lon, 8).alias("longitude"), F.round(lat, 8).alias("latitude"))
