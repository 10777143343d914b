"""Joins with rules kept as tables: sites, needles, bands and outlines derived from the data."""

from pyspark.sql import functions as F

from table_queries.analysis import haversine_sql
from table_queries.registry import query
from table_queries.shops import table
from vitrina.operators.contains import exclude_by_table, guess_type_by_table
from vitrina.operators.nearest import nearest_in_table
from vitrina.operators.outlines import count_in_outlines, points_in_outlines
from vitrina.operators.ranges import first_band

# Every supplier is a site; a tenth of them share a place, and half lie in one town.
_SITES = """sites AS (SELECT s_suppkey AS pos, s_name AS city,
  CASE WHEN s_suppkey % 2 = 0 THEN 40 + (s_suppkey * 37 % 500) / 10000.0 ELSE -60 + (s_suppkey * 7919 % 12000) / 100.0 END::DOUBLE AS slat,
  CASE WHEN s_suppkey % 2 = 0 THEN -3.7 + (s_suppkey * 53 % 900) / 10000.0 ELSE -180 + (s_suppkey * 104729 % 36000) / 100.0 END::DOUBLE AS slon
  FROM supplier)"""
_VISITS = """visits AS (SELECT c_custkey,
  CASE WHEN c_custkey % 2 = 0 THEN 39.9 + (c_custkey * 31 % 2500) / 10000.0 ELSE -85 + (c_custkey * 6101 % 17000) / 100.0 END::DOUBLE AS lat,
  CASE WHEN c_custkey % 2 = 0 THEN -3.8 + (c_custkey * 43 % 3000) / 10000.0 ELSE -180 + (c_custkey * 81647 % 36001) / 100.0 END::DOUBLE AS lon
  FROM customer)"""


def _place(key, near, far):
    k = F.col(key)
    even = k % 2 == 0
    (a, m, n, d), (b, p, q, e) = near, far
    return F.when(even, a + (k * m % n) / d).otherwise(b + (k * p % q) / e)


@query(f"""
WITH {_SITES}, {_VISITS},
d AS (SELECT c_custkey, pos, city, {haversine_sql('lat', 'lon', 'slat', 'slon')} AS km FROM visits, sites)
SELECT c_custkey, round(min(km), 6) AS km FROM d GROUP BY c_custkey""")
def nearest_of_site_table(spark, sf_dir):
    """Every customer's closest supplier, over all suppliers."""
    sites = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("pos"), F.col("s_name").alias("site"),
        _place("s_suppkey", (40, 37, 500, 10000.0), (-60, 7919, 12000, 100.0)).alias("lat"),
        _place("s_suppkey", (-3.7, 53, 900, 10000.0), (-180, 104729, 36000, 100.0)).alias("lon"),
    )
    visits = table(spark, sf_dir, "customer").select(
        "c_custkey", _place("c_custkey", (39.9, 31, 2500, 10000.0), (-85, 6101, 17000, 100.0)).alias("lat"),
        _place("c_custkey", (-3.8, 43, 3000, 10000.0), (-180, 81647, 36001, 100.0)).alias("lon"),
    )
    return nearest_in_table(visits, sites).select("c_custkey", F.round("km", 6).alias("km"))


# Brands are words of the shops' names and their neighbours' first letters.
_NEEDLES = """needles AS (SELECT DISTINCT substring(upper(p_name), 1 + (p_partkey % 5)::INT, 4 + (p_partkey % 9)::INT) AS brand
  FROM part WHERE p_partkey % 3 = 0)"""


def _needles(spark, sf_dir):
    k = F.col("p_partkey")
    part = F.substr(F.upper("p_name"), (1 + k % 5).cast("int"), (4 + k % 9).cast("int"))
    return table(spark, sf_dir, "part").where(k % 3 == 0).select(part.alias("brand")).distinct()


@query(f"""
WITH {_NEEDLES}
SELECT p_partkey FROM part WHERE p_partkey % 3 <> 0 AND NOT EXISTS (
  SELECT 1 FROM needles WHERE trim(brand) <> '' AND contains(lower(p_name || ' ' || p_type), lower(brand)))""")
def excluded_by_brand_table(spark, sf_dir):
    """Parts whose name and type contain none of the brands cut out of other parts' names."""
    parts = table(spark, sf_dir, "part").where("p_partkey % 3 <> 0").select(
        "p_partkey", F.concat_ws(" ", "p_name", "p_type").alias("nombre")
    )
    return exclude_by_table(parts, _needles(spark, sf_dir)).select("p_partkey")


@query("""
WITH stems AS (SELECT min(p_partkey) AS pos, lower(substring(p_type, 1 + (p_partkey % 11)::INT, 5)) AS stem FROM part GROUP BY 2),
category AS (SELECT p_partkey, lower(p_name || ' ' || p_type) AS c FROM part)
SELECT p_partkey, 't' || arg_min(pos, pos)::VARCHAR AS place_type
FROM category LEFT JOIN stems ON contains(c, stem) AND trim(stem) <> '' GROUP BY p_partkey""")
def category_types_by_table(spark, sf_dir):
    """The first of the stems cut out of all parts' types that a part's name and type contain."""
    k = F.col("p_partkey")
    part = table(spark, sf_dir, "part")
    stem = F.lower(F.substr("p_type", (1 + k % 11).cast("int"), F.lit(5)))
    stems = part.groupBy(stem.alias("stem")).agg(F.min("p_partkey").alias("pos"))
    typed = stems.withColumn("type", F.concat(F.lit("t"), F.col("pos").cast("string")))
    named = part.select("p_partkey", F.concat_ws(" ", "p_name", "p_type").alias("categoria"))
    return guess_type_by_table(named, typed, name="place_type").select("p_partkey", "place_type")


# One band for each supplier: many overlap, some touch, some are empty.
_RANGES = """ranges AS (SELECT s_suppkey AS pos, s_nationkey % 3 AS criterion, s_suppkey % 97 AS points,
  round(s_acctbal) * 40 AS lo, round(s_acctbal) * 40 + (s_suppkey % 13 - 1) * 2500 AS hi FROM supplier)"""


@query(f"""
WITH {_RANGES},
met AS (SELECT o_orderkey, arg_min(points, pos) AS puntos, min(pos) AS pos FROM orders
  JOIN ranges ON criterion = o_orderkey % 3 AND o_totalprice BETWEEN lo AND hi GROUP BY o_orderkey)
SELECT orders.o_orderkey, coalesce(puntos, 0) AS puntos, pos FROM orders LEFT JOIN met USING (o_orderkey)""")
def band_scores_by_table(spark, sf_dir):
    """Every order's first band among those of its criterion."""
    k, low = F.col("s_suppkey"), F.round("s_acctbal") * 40
    bands = table(spark, sf_dir, "supplier").select(
        k.alias("pos"), (F.col("s_nationkey") % 3).cast("long").alias("criterion"), (k % 97).alias("points"),
        low.alias("lo"), (low + (k % 13 - 1) * 2500).alias("hi"),
    )
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", (F.col("o_orderkey") % 3).alias("criterion"))
    found = first_band(orders, bands, "o_totalprice", criterion="criterion")
    return found.select(
        "o_orderkey", F.coalesce("band.points", F.lit(0).cast("long")).alias("puntos"), F.col("band.pos").alias("pos")
    )


# One diamond for each supplier, every fourth with a diamond-shaped hole, of very different sizes.
_DIAMONDS = """diamonds AS (SELECT s_suppkey AS outline, 35.5031 + (s_suppkey * 37 % 900) / 100.0 AS y, -8.5017 + (s_suppkey * 53 % 1100) / 100.0 AS x,
  CASE s_suppkey % 3 WHEN 0 THEN 0.017 WHEN 1 THEN 0.37 ELSE 2.9 END AS r FROM supplier)"""
_ORDER_PLACES = """p AS (SELECT o_orderkey, 35.507 + (o_orderkey * 7919 % 10007) / 1000 AS lat, -9.503 + (o_orderkey * 104729 % 13007) / 1000 AS lon FROM orders)"""


def diamonds(spark, sf_dir):
    k = F.col("s_suppkey")
    y, x = 35.5031 + (k * 37 % 900) / 100.0, -8.5017 + (k * 53 % 1100) / 100.0
    size = F.when(k % 3 == 0, 0.017).when(k % 3 == 1, 0.37).otherwise(2.9)

    def corners(r):
        return [(x - r, y), (x, y + r), (x + r, y), (x, y - r)]

    def edges(r):
        ring = corners(r)
        return F.array(*[
            F.struct(a.alias("x1"), b.alias("y1"), c.alias("x2"), d.alias("y2")) for (a, b), (c, d) in zip(ring, ring[1:] + ring[:1])
        ])

    whole = edges(size)
    return table(spark, sf_dir, "supplier").select(
        k.alias("outline"), F.when(k % 4 == 0, F.concat(whole, edges(size / 3))).otherwise(whole).alias("edges")
    )


def order_places(spark, sf_dir):
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", (35.507 + (k * 7919 % 10007) / 1000).alias("lat"), (-9.503 + (k * 104729 % 13007) / 1000).alias("lon")
    )


_INSIDE = f"""WITH {_DIAMONDS}, {_ORDER_PLACES},
met AS (SELECT o_orderkey, outline FROM p JOIN diamonds ON abs(lat - y) + abs(lon - x) < r
  AND NOT (outline % 4 = 0 AND abs(lat - y) + abs(lon - x) < r / 3))"""


@query(f"{_INSIDE} SELECT o_orderkey, outline FROM met")
def points_in_outline_table(spark, sf_dir):
    """Every order's place with all the outlines around it."""
    found = points_in_outlines(order_places(spark, sf_dir), diamonds(spark, sf_dir))
    return found.select("o_orderkey", "outline")


@query(f"{_INSIDE} SELECT s_suppkey AS outline, count(o_orderkey) AS n FROM supplier LEFT JOIN met ON outline = s_suppkey GROUP BY 1")
def points_per_outline(spark, sf_dir):
    return count_in_outlines(order_places(spark, sf_dir), diamonds(spark, sf_dir))
