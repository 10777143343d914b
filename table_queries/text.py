"""Cleaning, keys and page contents."""

from pyspark.sql import functions as F

from table_queries.registry import query
from table_queries.shops import (
    CART_WORDS, SHOPS_SQL, SIGNATURES, brand_key_sql, brand_norm_sql, shops, sql_text, table,
)
from vitrina import defaults
from vitrina.functions import geo, page, rules, text
from vitrina.operators.brands import exclude_brands, names_brand, with_brand_key
from vitrina.operators.contact import page_features
from vitrina.operators.dedup import with_keys


@query(r"""SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS cleaned FROM documents""")
def clean_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", text.clean_text(F.col("text")).alias("cleaned"))


@query("""
WITH r AS (SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 'n/a' WHEN 1 THEN '4.5d'
    WHEN 2 THEN (o_orderkey % 11)::VARCHAR || ',0'
    WHEN 3 THEN ' ' || (o_orderkey % 5)::VARCHAR || ',' || (o_orderkey % 10)::VARCHAR
    WHEN 4 THEN '' ELSE (o_orderkey % 100)::VARCHAR END AS raw FROM orders),
n AS (SELECT *, CASE WHEN regexp_full_match(trim(replace(raw, ',', '.')), '[0-9]+(\\.[0-9]+)?')
    THEN trim(replace(raw, ',', '.'))::DOUBLE END AS x FROM r)
SELECT o_orderkey, CASE WHEN x IS NULL THEN ''
    ELSE regexp_replace(printf('%.1f', x), '\\.0$', '') END AS rating FROM n""".replace("\\\\", "\\"))
def clean_ratings(spark, sf_dir):
    k = F.col("o_orderkey")
    raw = (
        F.when(k % 6 == 0, "n/a")
        .when(k % 6 == 1, "4.5d")
        .when(k % 6 == 2, F.concat((k % 11).cast("string"), F.lit(",0")))
        .when(k % 6 == 3, F.concat(F.lit(" "), (k % 5).cast("string"), F.lit(","),
                                   (k % 10).cast("string")))
        .when(k % 6 == 4, "")
        .otherwise((k % 100).cast("string"))
    )
    orders = table(spark, sf_dir, "orders")
    return orders.select("o_orderkey", text.clean_rating(raw).alias("rating"))


@query("""
SELECT o_orderkey, regexp_replace(printf('%.1f',
  ((o_orderkey % 10)::VARCHAR || '.' || lpad((o_orderkey % 100)::VARCHAR, 2, '0'))::DOUBLE), '[.]0$', '') AS rating
FROM orders""")
def two_decimal_ratings(spark, sf_dir):
    k = F.col("o_orderkey")
    raw = F.concat((k % 10).cast("string"), F.lit(","), F.lpad((k % 100).cast("string"), 2, "0"))
    return table(spark, sf_dir, "orders").select("o_orderkey", text.clean_rating(raw).alias("rating"))


@query(f"""
WITH {SHOPS_SQL}
SELECT seq, CASE WHEN web <> '' AND NOT starts_with(web, 'http://') AND NOT starts_with(web, 'https://')
    THEN 'https://' || web ELSE web END AS web FROM shops""")
def web_with_scheme(spark, sf_dir):
    return shops(spark, sf_dir).select("seq", text.with_scheme(F.col("web")).alias("web"))


@query(f"""
WITH {SHOPS_SQL}
SELECT seq, CASE WHEN trim(maps_url) <> '' THEN string_split(trim(maps_url), '?')[1] END AS url_key,
  sha1(trim(lower(nombre)) || '|' || trim(lower(direccion)) || '|' || trim(lower(telefono))) AS fallback_key
FROM shops""")
def listing_keys(spark, sf_dir):
    return with_keys(shops(spark, sf_dir)).select("seq", "url_key", "fallback_key")


def coordinates_sql(field: str) -> str:
    group = {"lat": 1, "lon": 2}[field]
    number = r"(-?\d+\.\d+)"
    return f"""CASE WHEN regexp_full_match(lat, '-?[0-9.]+') AND regexp_full_match(lon, '-?[0-9.]+')
      THEN {field}::DOUBLE
    WHEN regexp_matches(maps_url, '!3d{number}!4d{number}')
      THEN regexp_extract(maps_url, '!3d{number}!4d{number}', {group})::DOUBLE
    WHEN regexp_matches(maps_url, '@{number},{number}')
      THEN regexp_extract(maps_url, '@{number},{number}', {group})::DOUBLE END"""


@query(f"""
WITH {SHOPS_SQL}
SELECT seq, {coordinates_sql('lat')} AS lat, {coordinates_sql('lon')} AS lon FROM shops""")
def listing_coordinates(spark, sf_dir):
    spot = geo.coordinates(F.col("lat"), F.col("lon"), F.col("maps_url"))
    listed = shops(spark, sf_dir).select("seq", spot.alias("spot"))
    return listed.select("seq", "spot.lat", "spot.lon")


@query(f"""
SELECT p_partkey, {brand_norm_sql("p_name || ' (' || p_type || ') - ' || p_brand || '/' || p_size::VARCHAR")} AS norm,
  {brand_key_sql("p_name || ' ' || p_type || ' ' || p_brand", "split_part(p_name, ' ', 1) || '-' || p_size::VARCHAR")} AS brand_key
FROM part""")
def brand_keys(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    size = F.col("p_size").cast("string")
    decorated = F.concat(
        F.col("p_name"), F.lit(" ("), F.col("p_type"), F.lit(") - "), F.col("p_brand"), F.lit("/"), size
    )
    named = part.select(
        "p_partkey",
        text.brand_norm(decorated).alias("norm"),
        F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("nombre"),
        F.concat_ws("-", F.substring_index("p_name", " ", 1), size).alias("municipio_origen"),
    )
    return with_brand_key(named).select("p_partkey", "norm", "brand_key")


_PART_BRANDS = ["WIDGET", "blue b", "t gear", "small ring", "hot", "", "ld bo"]


@query(f"""
SELECT p_partkey, p_name FROM part WHERE NOT EXISTS (
  SELECT 1 FROM (VALUES {", ".join(f"({sql_text(b)})" for b in _PART_BRANDS)}) brands(brand)
  WHERE trim(brand) <> '' AND contains(lower(p_name), lower(brand)))""")
def excluded_brands(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    return exclude_brands(part, _PART_BRANDS, "p_name")


@query(f"""
SELECT contains(lower(p_name), 'ring') OR contains(lower(p_name), 'red') AS excluded,
  count(*) AS n FROM part GROUP BY 1""")
def excluded_brand_count(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    flag = names_brand(F.col("p_name"), ["Ring", "RED"])
    return part.groupBy(flag.alias("excluded")).agg(F.count(F.lit(1)).alias("n"))


_WHENS = " ".join(f"WHEN contains(html, {sql_text(n)}) THEN {sql_text(p)}" for p, n in SIGNATURES)
_CARTS = " ".join(
    f"WHEN contains(lower(html), {sql_text(w)}) THEN 'Desconocida'" for w in CART_WORDS
)
PLATFORM_SQL = f"CASE {_WHENS} {_CARTS} END"

_EMAIL = (
    r"[a-zA-Z0-9](?:[a-zA-Z0-9._+\-]*[a-zA-Z0-9])?@"
    r"[a-zA-Z0-9](?:[a-zA-Z0-9.\-]*[a-zA-Z0-9])?\.[a-zA-Z]{2,}"
)


def _in(values) -> str:
    return ", ".join(sql_text(v) for v in values)


def first_email_sql(column: str) -> str:
    local, domain = "regexp_extract(m, '^(.*)@', 1)", "lower(regexp_extract(m, '@([^@]*)$', 1))"
    return f"""list_filter(regexp_extract_all({column}, '{_EMAIL}'), lambda m:
      regexp_extract({domain}, '([^.]*)$', 1) NOT IN ({_in(defaults.FILE_EXTENSIONS)})
      AND NOT regexp_full_match(regexp_replace({local}, '[._-]', '', 'g'), '[0-9]+')
      AND lower({local}) NOT IN ({_in(defaults.BLOCKED_LOCALS)})
      AND {domain} NOT IN ({_in(defaults.BLOCKED_DOMAINS)}))[1]"""


def first_handle_sql(column: str) -> str:
    pattern = page.PROFILE_URL
    return f"""'https://instagram.com/' || list_filter(regexp_extract_all({column}, '{pattern}', 1), lambda h:
      lower(h) NOT IN ({_in(defaults.RESERVED_HANDLES)})
      AND NOT contains(h, '..') AND NOT ends_with(h, '.'))[1]"""


@query(f"SELECT page_id, {PLATFORM_SQL} AS platform FROM pages")
def page_platform(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").withColumn("low", F.lower("html"))
    found = page.platform(F.col("html"), F.col("low"), SIGNATURES, CART_WORDS)
    return pages.select("page_id", found.alias("platform"))


@query(f"""
SELECT 'd' || doc_id::VARCHAR AS id, {first_email_sql('text')} AS email FROM documents
UNION ALL SELECT 'p' || page_id::VARCHAR, {first_email_sql('html')} FROM pages""")
def first_emails(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), "text"
    )
    pages = table(spark, sf_dir, "pages").select(
        F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("id"),
        F.col("html").alias("text"),
    )
    return docs.union(pages).select("id", page.first_email(F.col("text")).alias("email"))


_CONTACT_HTML = """'<a href="mailto:' || CASE c_custkey % 6
    WHEN 0 THEN 'logo' || c_custkey::VARCHAR || '@2x.png'
    WHEN 1 THEN 'NoReply@shop.es' WHEN 2 THEN '12.34-' || c_custkey::VARCHAR || '@a.com'
    WHEN 3 THEN 'x@sentry.io' ELSE 'info.' || c_custkey::VARCHAR || '@' || lower(c_mktsegment) || '.es' END
    || '"> +_hola' || (c_custkey % 50)::VARCHAR || '@b-c.com_foo@c.com. <a href="//www.Instagram.com/'
    || CASE c_custkey % 4 WHEN 0 THEN 'p/' WHEN 1 THEN 'mi...' ELSE 'tienda_' || c_custkey::VARCHAR END
    || '">https://instagram.com/otra.' || (c_custkey % 9)::VARCHAR || '/'"""


def contact_pages(spark, sf_dir):
    """Small pages spelled out of the customers."""
    k = F.col("c_custkey")
    customer = table(spark, sf_dir, "customer")
    key = k.cast("string")
    mail = (
        F.when(k % 6 == 0, F.concat(F.lit("logo"), key, F.lit("@2x.png")))
        .when(k % 6 == 1, "NoReply@shop.es")
        .when(k % 6 == 2, F.concat(F.lit("12.34-"), key, F.lit("@a.com")))
        .when(k % 6 == 3, "x@sentry.io")
        .otherwise(F.concat(F.lit("info."), key, F.lit("@"), F.lower("c_mktsegment"), F.lit(".es")))
    )
    handle = F.when(k % 4 == 0, "p/").when(k % 4 == 1, "mi...").otherwise(
        F.concat(F.lit("tienda_"), key)
    )
    html = F.concat(
        F.lit('<a href="mailto:'), mail, F.lit('"> +_hola'), (k % 50).cast("string"),
        F.lit('@b-c.com_foo@c.com. <a href="//www.Instagram.com/'), handle,
        F.lit('">https://instagram.com/otra.'), (k % 9).cast("string"), F.lit("/"),
    )
    return customer.select("c_custkey", "c_mktsegment", html.alias("html"))


@query(f"""
WITH h AS (SELECT c_custkey, c_mktsegment, {_CONTACT_HTML} AS html FROM customer),
e AS (SELECT *, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE {first_email_sql('html')} END AS found FROM h)
SELECT c_custkey, coalesce(found, 'vmarketing@' || lower(c_mktsegment) || 'ninosss' || c_custkey::VARCHAR || 'co.com') AS email,
  CASE WHEN found IS NULL THEN 'placeholder' ELSE 'page' END AS email_source,
  {first_handle_sql('html')} AS perfil FROM e""")
def contact_details(spark, sf_dir):
    pages = contact_pages(spark, sf_dir)
    k = F.col("c_custkey")
    name = F.concat(F.col("c_mktsegment"), F.lit(" Niños-ß & "), k.cast("string"), F.lit("% (Co)."))
    mail = F.when(k % 5 != 0, page.first_email(F.col("html")))
    return pages.withColumn("found", mail).select(
        "c_custkey",
        F.coalesce("found", page.placeholder_email(name)).alias("email"),
        F.when(F.col("found").isNull(), "placeholder").otherwise("page").alias("email_source"),
        page.first_handle(F.col("html")).alias("perfil"),
    )


@query(f"""
SELECT url, min(plataforma) AS plataforma, min(email) AS email, min(perfil) AS perfil FROM (
  SELECT url, {PLATFORM_SQL} AS plataforma, {first_email_sql('html')} AS email,
    {first_handle_sql('html')} AS perfil FROM pages WHERE NOT contains(url, '?')) GROUP BY url""")
def saved_page_features(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(
        "url", "html", F.when(F.contains("url", F.lit("?")), 404).otherwise(200).alias("status")
    )
    return page_features(pages, SIGNATURES, CART_WORDS)


@query(r"""
SELECT 'd' || doc_id::VARCHAR AS id,
  trim(regexp_replace(regexp_extract(text, '(\+?\d[\d\s().-]{7,}\d)', 1), '\s+', ' ', 'g')) AS phone FROM documents
UNION ALL SELECT 'p' || page_id::VARCHAR,
  trim(regexp_replace(regexp_extract(html, '(\+?\d[\d\s().-]{7,}\d)', 1), '\s+', ' ', 'g')) FROM pages""")
def phone_numbers(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), "text"
    )
    pages = table(spark, sf_dir, "pages").select(
        F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("id"), "html"
    )
    return docs.union(pages).select("id", text.phone_in(F.col("text")).alias("phone"))


@query(f"""
SELECT conv_id, turn, substring(trim(regexp_replace(lower(regexp_replace(strip_accents(text),
    '[^\\x00-\\x7F]', '', 'g')), '[^a-z0-9]+', '_', 'g'), '_'), 1, 40) AS slug FROM conversations""")
def text_slugs(spark, sf_dir):
    talk = table(spark, sf_dir, "conversations")
    return talk.select("conv_id", "turn", text.slug(F.col("text")).alias("slug"))


@query("""
SELECT p_partkey, CASE WHEN contains(lower(c), 'bar') THEN 'bar' ELSE
  CASE WHEN contains(lower(c), 'ring') THEN 'jewelry_store' WHEN contains(lower(c), 'gear') THEN 'hardware_store'
    WHEN contains(lower(c), 'economy') THEN 'cafe' END END AS place_type
FROM (SELECT p_partkey, p_name || ' ' || p_type AS c FROM part)""")
def category_types(spark, sf_dir):
    stems = [("bar", "bar"), ("ring", "jewelry_store"), ("gear", "hardware_store"), ("economy", "cafe")]
    part = table(spark, sf_dir, "part")
    category = F.concat_ws(" ", "p_name", "p_type")
    return part.select("p_partkey", rules.guess_type(category, stems).alias("place_type"))


@query(f"""
WITH {SHOPS_SQL}
SELECT seq, regexp_matches(lower(web), 'instagram\\.com|facebook\\.com|fb\\.com') AS social,
  CASE WHEN web = '' THEN 'sin_presencia' WHEN ends_with(nombre, '1') THEN 'ecommerce_funcional' ELSE 'solo_redes_sociales' END AS madurez
FROM shops""")
def web_presence(spark, sf_dir):
    sold = F.endswith("nombre", F.lit("1")) & (F.col("web") != "")
    return shops(spark, sf_dir).select(
        "seq",
        page.is_social(F.col("web")).alias("social"),
        rules.maturity(F.when(sold, "Sí").otherwise("No"), F.col("web")).alias("madurez"),
    )
