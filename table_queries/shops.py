"""Listings derived from the driver's tables, in Spark and in SQL.

Every order is one listing of its customer's shop. Names, addresses, links and
coordinates are spelled out of the keys so that there are chains, duplicates,
missing values and several kinds of links.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

SITES = [
    {"ciudad": "Madrid", "lat": 40.4470, "lon": -3.6906},
    {"ciudad": "Barcelona", "lat": 41.3873, "lon": 2.1700},
    {"ciudad": "Valencia", "lat": 39.4719, "lon": -0.3729},
    {"ciudad": "Vigo", "lat": 42.2333, "lon": -8.7163},
    {"ciudad": "Sevilla", "lat": 37.3905, "lon": -5.9980},
]
BRANDS = ["machinery b", "Household CA", "(P) nation_1", "ure j", " "]
SIGNATURES = [
    ("Shopify", "track(3"),
    ("WooCommerce", 'lang="fr"'),
    ("PrestaShop", "track(1"),
    ("Casa", "track(22"),
    ("Casa", 'lang="es"'),
    ("Magento", "track(7"),
]
CART_WORDS = ["<!-- ad 9", 'LANG="DE"'.lower()]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def letters(c):
    return F.translate(c.cast("string"), "0123456789", "abcdefghij")


def shops(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    pages = table(spark, sf_dir, "pages")
    page_count = pages.agg(F.count(F.lit(1))).scalar()
    links = pages.select("page_id", F.col("url").alias("page_url"))
    k, c = F.col("o_orderkey"), F.col("c_custkey")
    lat = F.concat((36 + c % 8).cast("string"), F.lit("."), (c % 10).cast("string"), F.lit("5"))
    lon = F.concat((-9 + c % 12).cast("string"), F.lit("."), (c % 9).cast("string"))
    bare = F.regexp_replace("page_url", "^https?://", "")
    place = F.concat(F.lit("https://maps.example.com/place/"), c.cast("string"))
    return (
        orders.join(customer, F.col("o_custkey") == c)
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(links, k % page_count == F.col("page_id"), "left")
        .select(
            k.alias("seq"),
            F.concat_ws(
                " ", "c_mktsegment", letters(c),
                F.concat(F.lit("("), F.col("o_orderstatus"), F.lit(")")), "n_name",
            ).alias("nombre"),
            F.concat(F.lit("+34 981 "), (10 + c % 90).cast("string")).alias("telefono"),
            F.concat(F.lit("Calle "), (k % 2).cast("string")).alias("direccion"),
            F.coalesce(
                F.when(k % 5 == 0, "")
                .when(k % 5 == 1, F.concat(F.lit("www.Instagram.com/"), letters(c)))
                .when(k % 5 == 2, bare)
                .otherwise(F.col("page_url")),
                F.lit(""),
            ).alias("web"),
            F.concat((k % 5).cast("string"), F.lit(","), (k % 10).cast("string")).alias("rating"),
            F.col("c_mktsegment").alias("categoria"),
            F.concat(F.lower("c_mktsegment"), F.lit(" en "), F.col("n_name")).alias("source_query"),
            F.lit("2026-01-01T00:00:00Z").alias("retrieved_at_utc"),
            F.when(k % 3 == 0, F.concat(place, F.lit("/data=!3d"), lat, F.lit("!4d"), lon))
            .when(k % 3 == 1, F.concat(place, F.lit("/@"), lat, F.lit(","), lon, F.lit(",17z")))
            .otherwise("")
            .alias("maps_url"),
            F.col("n_name").alias("municipio_origen"),
            F.when(k % 4 == 0, lat).when(k % 4 == 1, "n/a").otherwise("").alias("lat"),
            F.when(k % 4 == 0, lon).when(k % 4 == 1, lon).otherwise("").alias("lon"),
        )
    )


_LAT = "(36 + c_custkey % 8)::VARCHAR || '.' || (c_custkey % 10)::VARCHAR || '5'"
_LON = "(-9 + c_custkey % 12)::VARCHAR || '.' || (c_custkey % 9)::VARCHAR"
_PLACE = "'https://maps.example.com/place/' || c_custkey::VARCHAR"
_LETTERS = "translate(c_custkey::VARCHAR, '0123456789', 'abcdefghij')"

SHOPS_SQL = f"""shops AS (
  SELECT o_orderkey AS seq,
    c_mktsegment || ' ' || {_LETTERS} || ' (' || o_orderstatus || ') ' || n_name AS nombre,
    '+34 981 ' || (10 + c_custkey % 90)::VARCHAR AS telefono,
    'Calle ' || (o_orderkey % 2)::VARCHAR AS direccion,
    coalesce(CASE o_orderkey % 5 WHEN 0 THEN ''
      WHEN 1 THEN 'www.Instagram.com/' || {_LETTERS}
      WHEN 2 THEN regexp_replace(url, '^https?://', '')
      ELSE url END, '') AS web,
    (o_orderkey % 5)::VARCHAR || ',' || (o_orderkey % 10)::VARCHAR AS rating,
    c_mktsegment AS categoria,
    lower(c_mktsegment) || ' en ' || n_name AS source_query,
    '2026-01-01T00:00:00Z' AS retrieved_at_utc,
    CASE o_orderkey % 3 WHEN 0 THEN {_PLACE} || '/data=!3d' || {_LAT} || '!4d' || {_LON}
      WHEN 1 THEN {_PLACE} || '/@' || {_LAT} || ',' || {_LON} || ',17z' ELSE '' END AS maps_url,
    n_name AS municipio_origen,
    CASE o_orderkey % 4 WHEN 0 THEN {_LAT} WHEN 1 THEN 'n/a' ELSE '' END AS lat,
    CASE WHEN o_orderkey % 4 <= 1 THEN {_LON} ELSE '' END AS lon
  FROM orders JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey
  LEFT JOIN pages ON o_orderkey % (SELECT count(*) FROM pages) = page_id)"""


def towns(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    region = table(spark, sf_dir, "region")
    key = F.col("n_nationkey")
    return nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("r_name").alias("region"),
        F.concat(F.lit("Provincia "), (key % 7).cast("string")).alias("province"),
        F.concat(F.lit(" "), F.lower("n_name")).alias("name"),
        (1000 * (1 + key * 37 % 250)).cast("int").alias("population"),
        key.cast("long").alias("pos"),
    )


TOWNS_SQL = """towns AS (
  SELECT r_name AS region, 'Provincia ' || (n_nationkey % 7)::VARCHAR AS province,
    ' ' || lower(n_name) AS name, 1000 * (1 + n_nationkey * 37 % 250) AS population,
    n_nationkey::BIGINT AS pos
  FROM nation JOIN region ON n_regionkey = r_regionkey)"""


def sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def haversine_sql(lat1: str, lon1: str, lat2, lon2) -> str:
    return (
        f"2 * 6371.0 * asin(sqrt(least(1.0, power(sin(radians({lat2} - {lat1}) / 2), 2) + "
        f"cos(radians({lat1})) * cos(radians({lat2})) * "
        f"power(sin(radians({lon2} - {lon1}) / 2), 2))))"
    )


def sites_sql(name: str = "sites") -> str:
    rows = ", ".join(
        f"({i}, {sql_text(s['ciudad'])}, {s['lat']}::DOUBLE, {s['lon']}::DOUBLE)"
        for i, s in enumerate(SITES)
    )
    return f"{name}(pos, city, slat, slon) AS (VALUES {rows})"


def case_sql(value: str, bands: list[dict], low: str, high: str, field: str, other: str) -> str:
    def shown(b):
        return sql_text(b[field]) if isinstance(b[field], str) else str(b[field])

    whens = " ".join(f"WHEN {value} BETWEEN {b[low]} AND {b[high]} THEN {shown(b)}" for b in bands)
    return f"CASE {whens} ELSE {other} END"


def brand_norm_sql(c: str) -> str:
    s = f"lower({c})"
    for pattern, to in ((r"\([^)]*\)", ""), (r"\d+", ""), (r"[\-_,.|/&]", " "), (r"\s+", " ")):
        s = f"regexp_replace({s}, '{pattern}', '{to}', 'g')"
    return f"trim({s})"


def brand_key_sql(name: str, town: str) -> str:
    norm, words = brand_norm_sql(name), f"string_split({brand_norm_sql(town)}, ' ')"
    kept = (
        f"array_to_string(list_filter(string_split({norm}, ' '), "
        f"lambda w: NOT list_contains({words}, w)), ' ')"
    )
    return f"coalesce(nullif({kept}, ''), nullif({norm}, ''))"
