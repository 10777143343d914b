"""Grids, outlines, towns and search targets."""

from pyspark.sql import functions as F

from table_queries.registry import query
from table_queries.shops import table
from vitrina.functions import geo
from vitrina.operators import grid, towns as T
from vitrina.plans.collect import work_table
from vitrina.sources.config import towns_from_json
from vitrina.sources.responses import outlines, zones


def boxes(spark, sf_dir):
    """A box per supplier, of a size spelled out of its key."""
    k = F.col("s_suppkey")
    lat, lon = 36 + (k * 7 % 800) / 100, -9 + (k * 13 % 1200) / 100
    return table(spark, sf_dir, "supplier").select(
        "s_suppkey",
        lat.alias("min_lat"), (lat + (k % 7) * 0.013).alias("max_lat"),
        lon.alias("min_lon"), (lon + (k % 11) * 0.0171).alias("max_lon"),
    )


@query("""
WITH b AS (SELECT s_suppkey, 36 + (s_suppkey * 7 % 800) / 100 AS lat0, -9 + (s_suppkey * 13 % 1200) / 100 AS lon0,
    (s_suppkey % 7) * 0.013::DOUBLE AS h, (s_suppkey % 11) * 0.0171::DOUBLE AS w FROM supplier),
ys AS (SELECT *, unnest(generate_series(0, floor((h - 0.005) / 0.01 + 1e-9)::BIGINT)) AS i FROM b WHERE h > 0),
xs AS (SELECT *, unnest(generate_series(0, floor((w - 0.005) / 0.01 + 1e-9)::BIGINT)) AS j FROM ys WHERE w > 0)
SELECT s_suppkey, round(lat0 + 0.005 + i * 0.01, 6) AS lat, round(lon0 + 0.005 + j * 0.01, 6) AS lon,
  14 AS zoom, 0.01::DOUBLE AS cell_deg FROM xs""")
def grid_of_boxes(spark, sf_dir):
    cells = grid.grid_cells(boxes(spark, sf_dir))
    return cells.select("s_suppkey", "lat", "lon", "zoom", "cell_deg")


def saved_outlines(spark, sf_dir):
    """A geocoder response per customer: a diamond with a hole, in two parts for some."""
    k = F.col("c_custkey")
    lat, lon = 36 + (k * 7 % 800) / 100, -9 + (k * 13 % 1200) / 100

    def diamond(radius, away=0.0):
        corners = [(0, -radius), (radius, 0), (0, radius), (-radius, 0), (0, -radius)]
        points = [
            F.array(F.round(lon + x + away, 6), F.round(lat + y, 6)) for x, y in corners
        ]
        return F.array(*points)

    one = F.array(diamond(0.0333), diamond(0.0133))
    two = F.array(one, F.array(diamond(0.0033, 0.2)))
    shape = F.when(k % 3 == 0, F.lit("Polygon")).when(k % 3 == 1, F.lit("MultiPolygon"))
    return table(spark, sf_dir, "customer").select(
        k.cast("string").alias("place"),
        F.col("c_name").alias("display_name"),
        F.array(*[
            F.round(v, 6).cast("string")
            for v in (lat - 0.04, lat + 0.04, lon - 0.04, lon + 0.04)
        ]).alias("boundingbox"),
        F.struct(
            shape.alias("type"),
            F.when(k % 3 == 0, F.to_json(one)).otherwise(F.to_json(two)).alias("coordinates"),
        ).alias("geojson"),
    )


_CENTRE = "36 + (c_custkey * 7 % 800) / 100 AS lat0, -9 + (c_custkey * 13 % 1200) / 100 AS lon0"


@query(f"""
WITH c AS (SELECT c_custkey, {_CENTRE} FROM customer),
cells AS (SELECT *, (i - 3.5) * 0.01 AS dy, (j - 3.5) * 0.01 AS dx
  FROM c, generate_series(0, 7) y(i), generate_series(0, 7) x(j))
SELECT c_custkey::VARCHAR AS place, round(lat0 + dy, 6) AS lat, round(lon0 + dx, 6) AS lon FROM cells
WHERE c_custkey % 3 = 2 OR (abs(dx) + abs(dy) < 0.0333 AND abs(dx) + abs(dy) > 0.0133)""")
def grid_in_outlines(spark, sf_dir):
    places = outlines(saved_outlines(spark, sf_dir))
    return grid.grid_cells(places, edges="edges").select("place", "lat", "lon")


_RINGS = [
    [(-9.0, 36.0), (3.1, 36.0), (3.1, 41.03), (-2.51, 43.97), (-9.0, 41.01)],
    [(-4.013, 39.013), (-2.013, 39.013), (-2.013, 40.513), (-4.013, 40.513)],
]


def _crossing_sql(rings) -> str:
    rows = []
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
            rows.append(f"({x1}::DOUBLE, {y1}::DOUBLE, {x2}::DOUBLE, {y2}::DOUBLE)")
    return f"edges(x1, y1, x2, y2) AS (VALUES {', '.join(rows)})"


@query(f"""
WITH {_crossing_sql(_RINGS)},
p AS (SELECT o_orderkey, 35.507 + (o_orderkey * 7919 % 10007) / 1000 AS lat, -9.503 + (o_orderkey * 104729 % 13007) / 1000 AS lon FROM orders)
SELECT o_orderkey, lat, lon FROM p WHERE (SELECT count(*) FROM edges WHERE (y1 > lat) <> (y2 > lat)
  AND lon < x1 + (lat - y1) * (x2 - x1) / (y2 - y1)) % 2 = 1""")
def points_in_outline(spark, sf_dir):
    k = F.col("o_orderkey")
    points = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        (35.507 + (k * 7919 % 10007) / 1000).alias("lat"),
        (-9.503 + (k * 104729 % 13007) / 1000).alias("lon"),
    )
    return grid.within_outline(points, geo.literal_edges(_RINGS))


def _cells(spark, sf_dir):
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        "c_custkey",
        (36 + (k * 7 % 800) / 100).alias("lat"),
        (-9 + (k * 13 % 1200) / 100).alias("lon"),
        (14 + k % 3).cast("int").alias("zoom"),
        F.when(F.col("c_mktsegment") == "BUILDING", 0.00125)
        .otherwise(0.01 / F.pow(F.lit(2), k % 3)).alias("cell_deg"),
        "c_acctbal",
    )


_SAT = "c_acctbal > 1000"


@query(f"""
WITH c AS (SELECT c_custkey, 36 + (c_custkey * 7 % 800) / 100 AS lat0, -9 + (c_custkey * 13 % 1200) / 100 AS lon0,
    14 + c_custkey % 3 AS z, c_acctbal, CASE WHEN c_mktsegment = 'BUILDING' THEN 0.00125 ELSE 0.01 / power(2, c_custkey % 3) END AS d FROM customer)
SELECT c_custkey, part, round(lat0 + ny * d / 4, 9) AS lat, round(lon0 + ex * d / 4, 9) AS lon, least(z + 1, 16) AS zoom, d / 2 AS cell_deg
FROM c, (VALUES (0, 1, -1), (1, 1, 1), (2, -1, -1), (3, -1, 1)) q(part, ny, ex) WHERE {_SAT} AND d > 0.002""")
def divided_cells(spark, sf_dir):
    parts = grid.subdivide(_cells(spark, sf_dir), F.expr(_SAT))
    return parts.drop("c_acctbal").withColumns({"lat": F.round("lat", 9), "lon": F.round("lon", 9)})


@query(f"""
SELECT count(*) AS heuristic_stops FROM customer WHERE {_SAT} AND c_mktsegment = 'BUILDING'""")
def stopped_cells(spark, sf_dir):
    return grid.heuristic_stops(_cells(spark, sf_dir), F.expr(_SAT)).agg(
        F.count(F.lit(1)).alias("heuristic_stops")
    )


def _level_sql(level: int) -> str:
    by = 8 >> level
    source = f"SELECT floor(iy / {by}) AS iy, floor(ix / {by}) AS ix, sum(n) AS n FROM fine GROUP BY 1, 2"
    if level == 0:
        return f"l0 AS ({source})"
    return f"""l{level} AS (SELECT iy, ix, coalesce(n, 0) AS n FROM (
    SELECT iy * 2 + y AS iy, ix * 2 + x AS ix FROM l{level - 1}, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) q(y, x)
    WHERE n >= 120) LEFT JOIN ({source}) USING (iy, ix))"""


@query(f"""
WITH p AS (SELECT 40 + power((o_orderkey * 7919 % 1009) / 1009, 3) / 5 AS lat, -4 + power((o_orderkey * 104729 % 1013) / 1013, 2) / 5 AS lon FROM orders),
fine AS (SELECT floor(lat / 0.00125) AS iy, floor(lon / 0.00125) AS ix, count(*) AS n FROM p GROUP BY 1, 2),
{", ".join(_level_sql(i) for i in range(4))}
{" UNION ALL ".join(f"SELECT iy::BIGINT AS iy, ix::BIGINT AS ix, {i} AS level, {0.01 / 2**i}::DOUBLE AS cell_deg, {min(14 + i, 16)} AS zoom, n::BIGINT AS n FROM l{i}" + (" WHERE n < 120" if i < 3 else "") for i in range(4))}""")
def dense_cells(spark, sf_dir):
    k = F.col("o_orderkey")
    points = table(spark, sf_dir, "orders").select(
        (40 + F.pow((k * 7919 % 1009) / 1009, F.lit(3)) / 5).alias("lat"),
        (-4 + F.pow((k * 104729 % 1013) / 1013, F.lit(2)) / 5).alias("lon"),
    )
    return grid.adaptive_cells(points)


@query("""
SELECT o_orderkey, z AS pos, (36 + o_orderkey % 8 + 0.5)::DOUBLE AS lat, (-9 + o_orderkey % 12 + z)::DOUBLE AS lon,
  CASE WHEN (o_orderkey + z) % 2 = 0 THEN 15 ELSE 14 END AS zoom, 0.01::DOUBLE AS cell_deg
FROM orders, (VALUES (0), (1)) t(z)""")
def zone_cells(spark, sf_dir):
    k = F.col("o_orderkey")
    lat = (36 + k % 8).cast("string")

    def zone(z):
        lon = (-9 + k % 12 + z).cast("string")
        end = F.when((k + z) % 2 == 0, ', "zoom": 15}').otherwise("}")
        return F.concat(F.lit('{"lat": '), lat, F.lit('.5, "lon": '), lon, end)

    text = F.concat(F.lit("["), zone(0), F.lit(", "), zone(1), F.lit("]"))
    listed = zones(table(spark, sf_dir, "orders").select("o_orderkey", text.alias("zones")), "zones")
    pos = F.col("lon") + 9 - F.col("o_orderkey") % 12
    return listed.withColumn("pos", pos.cast("int"))


# Towns ----------------------------------------------------------------------

def town_rows(spark, sf_dir):
    """Every customer as a town of its nation's region."""
    nation = table(spark, sf_dir, "nation")
    region = table(spark, sf_dir, "region")
    customer = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    return (
        customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            F.col("r_name").alias("region"), F.col("n_name").alias("province"),
            F.col("c_name").alias("name"), (k * 37 % 9000).cast("int").alias("population"),
            k.alias("pos"),
        )
    )


_TOWN_ROWS = """t AS (SELECT r_name AS region, n_name AS province, c_name AS name,
    c_custkey * 37 % 9000 AS population, c_custkey AS pos
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


@query("SELECT DISTINCT r_name AS region FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey")
def region_list(spark, sf_dir):
    return T.regions(town_rows(spark, sf_dir))


@query(f"WITH {_TOWN_ROWS} SELECT * FROM t WHERE region = 'ASIA' AND population >= 5000")
def towns_of_region(spark, sf_dir):
    return T.region_towns(town_rows(spark, sf_dir), "ASIA", 5000)


@query(f"""
WITH {_TOWN_ROWS} SELECT name, name || ', ' || province AS location, name || ', ' || province || ', España' AS city,
  'bares en ' || name || ', ' || province AS source_query FROM t""")
def search_targets(spark, sf_dir):
    rows = T.search_targets(town_rows(spark, sf_dir), "bares")
    return rows.select("name", "location", "city", "source_query")


@query(f"""
WITH {_TOWN_ROWS} SELECT name, pos FROM t WHERE pos NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')""")
def towns_left(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'")
    customer = table(spark, sf_dir, "customer")
    done = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(
        F.concat(F.upper("c_name"), F.lit("  ")).alias("municipio_origen")
    )
    return T.skip_processed(town_rows(spark, sf_dir), done).select("name", "pos")


@query(f"""
WITH {_TOWN_ROWS} SELECT region, province, name, population, pos,
  row_number() OVER (PARTITION BY region ORDER BY population DESC, pos) AS place FROM t""")
def towns_ranked_by_region(spark, sf_dir):
    return T.towns_by_region(town_rows(spark, sf_dir))


@query(f"WITH {_TOWN_ROWS} SELECT DISTINCT region, province FROM t")
def provinces_by_region(spark, sf_dir):
    return T.region_provinces(town_rows(spark, sf_dir))


@query(f"""
WITH {_TOWN_ROWS} SELECT region, province, name, population::INT AS population FROM t""")
def towns_of_files(spark, sf_dir):
    """Town files of one town each, as JSON text, read back into flat towns."""
    town = F.struct(
        F.col("name").alias("nombre"), F.col("province").alias("provincia"),
        F.col("population").alias("poblacion"),
    )
    content = F.create_map(
        F.col("region"),
        F.struct(F.array("province").alias("provincias"), F.array(town).alias("municipios")),
    )
    files = town_rows(spark, sf_dir).select(F.to_json(content).alias("value"))
    return towns_from_json(files, "value").drop("pos")


@query(f"""
WITH {_TOWN_ROWS}, c AS (SELECT t.*, {_CENTRE.replace('c_custkey', 'pos')} FROM t WHERE population < 5000),
cells AS (SELECT *, (i - 3.5) * 0.01 AS dy, (j - 3.5) * 0.01 AS dx
  FROM c, generate_series(0, 7) y(i), generate_series(0, 7) x(j))
SELECT name, 'bares en ' || name || ', ' || province AS source_query, round(lat0 + dy, 6) AS lat,
  round(lon0 + dx, 6) AS lon, 14 AS zoom, 0.01::DOUBLE AS cell_deg FROM cells
WHERE pos % 3 = 2 OR (abs(dx) + abs(dy) < 0.0333 AND abs(dx) + abs(dy) > 0.0133)""")
def search_work(spark, sf_dir):
    rows = town_rows(spark, sf_dir)
    done = rows.where("population >= 5000").select(F.col("name").alias("municipio_origen"))
    city = F.concat_ws(", ", "name", "province", F.lit("España"))
    placed = outlines(saved_outlines(spark, sf_dir)).drop("display_name")
    named = placed.join(
        rows.select(F.col("pos").cast("string").alias("place"), city.alias("city")), "place"
    ).drop("place").withColumnRenamed("city", "place")
    return work_table(rows, named, "bares", done).select(
        "name", "source_query", "lat", "lon", "zoom", "cell_deg"
    )


@query("""
SELECT o_orderkey, CASE WHEN o_custkey % 90 - 5 <= 0 THEN 3 ELSE least(3, ceil((o_custkey % 90 - 5) / 20)::BIGINT) END AS pages FROM orders""")
def page_plans(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", T.pages_for(F.col("o_custkey") % 90 - 5).alias("pages")
    )
