"""Saved responses and pages to listings; duplicates; caps."""

from pyspark.sql import functions as F

from table_queries.registry import query
from table_queries.shops import SHOPS_SQL, letters, shops, table
from vitrina import model
from vitrina.functions.text import clean_rating
from vitrina.operators.dedup import dedup_two_keys, first_per_key, with_keys
from vitrina.operators.ordering import first_n
from vitrina.operators.runs import collection_report, collection_summary, raw_vs_deduped, require_name
from vitrina.operators.durable import new_path
from vitrina.plans.collect import collect_pages, collect_places, collect_places_run
from vitrina.sources.ledgers import append_usage
from vitrina.sources.listings import read_listings
from vitrina.sources.pages import listings_from_detail_pages, towns_from_html
from vitrina.sources.responses import places_to_listings, search_items


# Two-key duplicates ---------------------------------------------------------

def two_keys_sql(pairs: str) -> str:
    """CTE kept(seq) for a source of (a, b, seq), by rounds as sets."""
    return f"""pairs AS ({pairs}),
rounds AS (
  SELECT a, b, min(seq) AS seq, 0 AS done FROM pairs GROUP BY a, b
  UNION ALL
  SELECT a, b, seq, win::INT FROM (
    SELECT *, bool_or(win) OVER (PARTITION BY a) AS a_won, bool_or(win) OVER (PARTITION BY b) AS b_won FROM (
      SELECT *, seq = min(seq) OVER (PARTITION BY a) AND seq = min(seq) OVER (PARTITION BY b) AS win
      FROM rounds WHERE done = 0))
  WHERE win OR NOT (a_won OR b_won)),
kept AS (SELECT seq FROM rounds WHERE done = 1)"""


EVENT_PAIRS = """SELECT CASE WHEN event_id % 6 = 0 THEN 'f' || event_type || floor(value)::INT::VARCHAR
    ELSE 'u' || (user_id * 31 + event_id % 40)::VARCHAR END AS a,
  event_type || floor(value)::INT::VARCHAR AS b, event_id AS seq FROM events"""


def event_keys(spark, sf_dir):
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        e.alias("seq"),
        F.when(e % 6 > 0, (F.col("user_id") * 31 + e % 40).cast("string")).alias("url_key"),
        F.concat(F.col("event_type"), F.floor("value").cast("string")).alias("fallback_key"),
    )


@query(f"WITH RECURSIVE {two_keys_sql(EVENT_PAIRS)} SELECT seq FROM kept")
def dedup_two_keys_events(spark, sf_dir):
    return dedup_two_keys(event_keys(spark, sf_dir)).select("seq")


@query(f"WITH RECURSIVE {two_keys_sql(EVENT_PAIRS)} SELECT seq FROM kept")
def dedup_two_keys_by_rounds(spark, sf_dir):
    """The same rows from a table in another order and in many small tasks."""
    return dedup_two_keys(event_keys(spark, sf_dir).repartition(23, "fallback_key")).select("seq")


@query("""
SELECT event_id AS seq FROM (
  SELECT event_id, row_number() OVER (PARTITION BY event_id - nth ORDER BY event_id) AS place
  FROM (SELECT event_id, row_number() OVER (ORDER BY event_id) AS nth FROM events))
WHERE place % 2 = 1""")
def dedup_key_chain(spark, sf_dir):
    """Every event shares a key with the one before: one chain, of which every other row stays."""
    e = F.col("event_id")
    chained = table(spark, sf_dir, "events").select(
        e.alias("seq"),
        F.floor((e + 1) / 2).cast("string").alias("url_key"),
        F.floor(e / 2).cast("string").alias("fallback_key"),
    )
    return dedup_two_keys(chained).select("seq")


_SHOP_PAIRS = """SELECT CASE WHEN maps_url <> '' THEN 'u' || maps_url
    ELSE 'f' || lower(nombre || '|' || direccion || '|' || telefono) END AS a,
  lower(nombre || '|' || direccion || '|' || telefono) AS b, seq FROM shops"""


@query(f"""
WITH RECURSIVE {SHOPS_SQL}, {two_keys_sql(_SHOP_PAIRS)}
SELECT seq, nombre, CASE WHEN regexp_matches(rating, ',0$') THEN split_part(rating, ',', 1)
  ELSE replace(rating, ',', '.') END AS rating FROM shops JOIN kept USING (seq)""")
def collected_pages(spark, sf_dir):
    return collect_pages(shops(spark, sf_dir)).select("seq", "nombre", "rating")


@query("""
SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_custkey, o_orderkey LIMIT 12000""")
def first_rows(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return first_n(orders, 12_000, "o_custkey", "o_orderkey")


# Places ---------------------------------------------------------------------

def place_responses(spark, sf_dir):
    """One saved places response per customer, as JSON text."""
    k = F.col("c_custkey")

    def localized(text):
        return F.struct(text.alias("text"))

    number = k.cast("string")
    place = F.struct(
        localized(F.col("c_name")).alias("displayName"),
        F.concat(F.lit("Rúa "), number).alias("formattedAddress"),
        F.when(k % 3 > 0, F.concat(F.lit("981 "), number)).alias("nationalPhoneNumber"),
        F.when(k % 2 == 0, F.concat(F.lit("+34 "), number)).alias("internationalPhoneNumber"),
        F.when(k % 4 > 0, F.concat(F.lit("shop"), number, F.lit(".es"))).alias("websiteUri"),
        F.when(k % 5 > 0, k % 50 / 10).alias("rating"),
        F.when(k % 6 > 0, localized(F.initcap("c_mktsegment"))).alias("primaryTypeDisplayName"),
        F.concat(F.lit("https://maps.google.com/?cid="), (k % 400).cast("string")).alias("googleMapsUri"),
        F.when(k % 7 > 0, F.struct((k % 90 / 2).alias("latitude"), (0 - k % 9 / 4).alias("longitude")))
        .alias("location"),
    )
    document = F.struct(
        F.concat(F.lit("tiendas en "), number).alias("query"),
        F.col("c_mktsegment").alias("municipio_origen"),
        F.lit("2026-01-01T00:00:00Z").alias("retrieved_at_utc"),
        F.array(place).alias("places"),
    )
    # Spread, as a customer's few bytes become a long text.
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return customer.repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))).select(
        k.alias("seq"), F.to_json(document).alias("body")
    )


_PLACES_SQL = """places AS (SELECT c_custkey AS seq, c_name AS nombre,
    CASE WHEN c_custkey % 3 > 0 THEN '981 ' || c_custkey::VARCHAR WHEN c_custkey % 2 = 0
      THEN '+34 ' || c_custkey::VARCHAR ELSE '' END AS telefono,
    'Rúa ' || c_custkey::VARCHAR AS direccion,
    CASE WHEN c_custkey % 4 > 0 THEN 'shop' || c_custkey::VARCHAR || '.es' ELSE '' END AS web,
    CASE WHEN c_custkey % 5 > 0 THEN (c_custkey % 50 / 10)::DOUBLE::VARCHAR ELSE '' END AS rating,
    CASE WHEN c_custkey % 6 > 0 THEN upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) ELSE '' END AS categoria,
    'tiendas en ' || c_custkey::VARCHAR AS source_query, '2026-01-01T00:00:00Z' AS retrieved_at_utc,
    'https://maps.google.com/?cid=' || (c_custkey % 400)::VARCHAR AS maps_url, c_mktsegment AS municipio_origen,
    CASE WHEN c_custkey % 7 > 0 THEN (c_custkey % 90 / 2)::DOUBLE::VARCHAR ELSE '' END AS lat,
    CASE WHEN c_custkey % 7 > 0 THEN (0 - c_custkey % 9 / 4)::DOUBLE::VARCHAR ELSE '' END AS lon
  FROM customer)"""


def parsed_places(spark, sf_dir):
    body = F.from_json("body", model.PLACES_RESPONSE)
    return place_responses(spark, sf_dir).select("seq", body.alias("r")).select("seq", "r.*")


@query(f"WITH {_PLACES_SQL} SELECT {', '.join(model.LISTING_COLUMNS)} FROM places")
def place_listings(spark, sf_dir):
    return places_to_listings(parsed_places(spark, sf_dir))


@query(f"""
WITH {_PLACES_SQL} SELECT nombre, maps_url FROM places
QUALIFY row_number() OVER (PARTITION BY maps_url ORDER BY nombre) = 1""")
def collected_places(spark, sf_dir):
    listed = places_to_listings(parsed_places(spark, sf_dir))
    return collect_places(listed, seq="nombre").select("nombre", "maps_url")


@query(f"""
WITH {_PLACES_SQL} SELECT nombre, maps_url, rating FROM (
  SELECT * FROM places QUALIFY row_number() OVER (PARTITION BY maps_url ORDER BY seq) = 1)
ORDER BY seq LIMIT 150""")
def collect_from_places(spark, sf_dir):
    """Saved responses to the capped table, as the job runs it."""
    body = F.from_json("body", model.PLACES_RESPONSE)
    saved = place_responses(spark, sf_dir).select(F.col("seq").alias("line"), body.alias("r")).select("line", "r.*")
    return collect_places(places_to_listings(saved, ["line"]), 150).select("nombre", "maps_url", "rating")


@query("""
SELECT c_custkey, c_custkey % 4 AS items, CASE WHEN c_custkey % 3 = 0 THEN 0.002 ELSE c_custkey % 5 / 100 END AS cost
FROM customer""")
def search_responses(spark, sf_dir):
    k = F.col("c_custkey")
    hit = F.struct(
        F.lit("organic").alias("type"), F.col("c_name").alias("title"),
        F.lit("https://x.com").alias("url"), F.lit(None).cast("string").alias("breadcrumb"),
    )
    result = F.when(k % 4 > 0, F.array(F.struct(F.array_repeat(hit, (k % 4).cast("int")).alias("items"))))
    task = F.struct(F.when(k % 3 == 0, 0.002).otherwise(0.0).alias("cost"), result.alias("result"))
    document = F.to_json(
        F.struct(
            F.col("c_name").alias("nombre"), k.cast("string").alias("municipio"),
            (k % 5 / 100).alias("cost"), F.array(task).alias("tasks"),
        )
    )
    customer = table(spark, sf_dir, "customer")
    saved = customer.select(F.from_json(document, model.SEARCH_RESPONSE).alias("r")).select("r.*")
    return search_items(saved).select(
        F.col("municipio").cast("long").alias("c_custkey"),
        F.size("items").cast("long").alias("items"), "cost",
    )


# Pages ----------------------------------------------------------------------

def detail_pages(spark, sf_dir):
    """A detail page per customer; a third names no phone, so that the first
    phone-like run of the source counts: the digits of the name."""
    k = F.col("c_custkey")
    n = k.cast("string")
    return table(spark, sf_dir, "customer").select(
        k.alias("seq"),
        F.col("c_mktsegment").alias("town"),
        F.concat(F.lit("https://maps.example.com/p/"), n).alias("url"),
        F.concat(
            F.lit("<html><body><h1> "), F.col("c_name"), F.lit("&amp;<b>Hijos</b>\n</h1>"),
            F.when(k % 3 == 0, F.concat(
                F.lit('<button data-item-id="phone:tel">+34 981 '), n, F.lit(" 00 00</button>")))
            .when(k % 3 == 1, F.concat(
                F.lit('<button aria-label="Teléfono: 986 '), n, F.lit(' 11 22">Llamar</button>')))
            .otherwise(F.concat(F.lit("<p>Tel (988) "), n, F.lit(" 33-44</p>"))),
            F.lit('<button data-item-id="address">Rúa '), n, F.lit("<br>Lugo</button>"),
            F.when(k % 4 == 0, "").otherwise(F.concat(
                F.lit('<a data-item-id="authority" href="https://shop'), n, F.lit('.es">'),
                F.when(k % 4 == 1, "Sitio web").otherwise(F.concat(F.lit("shop"), n, F.lit(".com/"))),
                F.lit("</a>"))),
            F.when(k % 5 == 0, F.lit('<span aria-hidden="true">nuevo</span><span aria-hidden="true"> 3,9</span>'))
            .otherwise(F.concat(F.lit('<div role="img" aria-label="4,'), (k % 10).cast("string"),
                                F.lit(' estrellas"></div>'))),
            F.when(k % 2 == 0, F.lit('<button class="x DkEaL">Tienda de ropa</button>'))
            .otherwise(F.lit('<button jsaction="pane.rating.category">Zapatería</button>')),
            F.lit("</body></html>"),
        ).alias("html"),
    )


@query("""
SELECT c_name || '&Hijos' AS nombre,
  CASE c_custkey % 3 WHEN 0 THEN '+34 981 ' || n || ' 00 00' WHEN 1 THEN '986 ' || n || ' 11 22'
    ELSE c_name[10:] END AS telefono,
  'Rúa ' || n || ' Lugo' AS direccion,
  CASE c_custkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'https://shop' || n || '.es' ELSE 'shop' || n || '.com/' END AS web,
  CASE WHEN c_custkey % 5 = 0 THEN '3.9' WHEN c_custkey % 10 = 0 THEN '4' ELSE '4.' || (c_custkey % 10)::VARCHAR END AS rating,
  CASE WHEN c_custkey % 2 = 0 THEN 'Tienda de ropa' ELSE 'Zapatería' END AS categoria,
  'q' AS source_query, 't' AS retrieved_at_utc, 'https://maps.example.com/p/' || n AS maps_url,
  '' AS municipio_origen, '' AS lat, '' AS lon
FROM (SELECT *, c_custkey::VARCHAR AS n FROM customer)""")
def detail_page_listings(spark, sf_dir):
    return listings_from_detail_pages(detail_pages(spark, sf_dir), F.lit("q"), F.lit("t"))


@query("""
SELECT c_name || '&Hijos' AS nombre, c_mktsegment AS municipio_origen, 'q' || c_custkey::VARCHAR AS source_query,
  'https://maps.example.com/p/' || (c_custkey % 90)::VARCHAR AS maps_url
FROM (SELECT * FROM customer QUALIFY row_number() OVER (PARTITION BY c_custkey % 90 ORDER BY c_custkey) = 1)
ORDER BY c_custkey LIMIT 70""")
def collect_from_pages(spark, sf_dir):
    """Saved detail pages to the capped table: every place is saved several times."""
    saved = detail_pages(spark, sf_dir).withColumn(
        "url", F.concat(F.lit("https://maps.example.com/p/"), (F.col("seq") % 90).cast("string"))
    )
    query_text = F.concat(F.lit("q"), F.col("seq").cast("string"))
    listings = listings_from_detail_pages(saved, query_text, F.lit("t"), F.col("town"), F.col("seq"))
    return collect_pages(listings, 70).select("nombre", "municipio_origen", "source_query", "maps_url")


def _entities_sql(text: str) -> str:
    """Entities decoded, also those that a page's end has cut before the ';'."""
    for entity, sign in (
        ("&quot;?", "'\"'"), ("&#(x27|39);?", "chr(39)"), ("&lt;?", "'<'"), ("&gt;?", "'>'"),
        ("&amp;?", "'&'"),
    ):
        text = f"regexp_replace({text}, '{entity}', {sign}, 'g')"
    return text


_HEADING = r"trim(regexp_replace(regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1), '\s+', ' ', 'g'))"


@query(f"SELECT url, {_entities_sql(_HEADING)} AS nombre FROM pages")
def page_names(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    listed = listings_from_detail_pages(pages, F.lit("q"), F.lit("t"))
    return listed.select(F.col("maps_url").alias("url"), "nombre")


def town_pages(spark, sf_dir):
    """A page with two town tables and a plain one for each customer."""
    k = F.col("c_custkey")
    people = k * 37 % 20000
    name = F.concat(F.lit("Villa "), letters(k))
    shown = F.concat(
        F.floor(people / 1000).cast("string"), F.lit("&nbsp;"),
        F.lpad((people % 1000).cast("string"), 3, "0"),
    )

    def row(rank):
        return F.concat(
            F.lit("<tr bgcolor=x>\n<td>"), rank, F.lit("</td><td><a href='#'>"), name,
            F.lit("</a>&nbsp;"), name, F.lit("</td><td> "), shown, F.lit("</td><td>"),
            F.col("c_mktsegment"), F.col("c_mktsegment"),
            F.lit("</td><th>Castilla &amp; León</th><td>x</td></tr>"),
        )

    head = F.lit("<tr><th>Nº</th><th>a</th><th>b</th><th>c</th><th>d</th></tr>")
    return table(spark, sf_dir, "customer").select(
        "c_custkey",
        F.concat(
            F.lit('<p><table class="plain">'), row(k.cast("string")), F.lit("</table>"),
            F.lit('<table id="t" class="wikitable sortable">'), head, row((k + 1).cast("string")),
            F.lit('<tr><td>9</td><td>short</td></tr></table><table class="big wikitable">'),
            row(F.concat((k + 7).cast("string"), F.lit(".º"))), F.lit("</table>"),
        ).alias("html"),
    )


@query("""
SELECT c_custkey, p AS table_pos, c_custkey + CASE p WHEN 0 THEN 1 ELSE 7 END AS rank,
  'Villa ' || translate(c_custkey::VARCHAR, '0123456789', 'abcdefghij') AS name,
  c_custkey * 37 % 20000 AS population, c_mktsegment AS province, 'Castilla & León' AS region
FROM customer, (VALUES (0), (1)) t(p) WHERE c_custkey * 37 % 20000 >= 5000""")
def page_towns(spark, sf_dir):
    return towns_from_html(town_pages(spark, sf_dir)).drop("row_pos")


# Summaries ------------------------------------------------------------------

def collected(spark, sf_dir):
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        k.alias("seq"),
        F.when(k % 17 == 0, "").otherwise(F.col("c_mktsegment")).alias("nombre"),
        (k % 23).cast("string").alias("direccion"),
        F.lit("").alias("telefono"),
        F.col("c_nationkey").alias("town"),
    )


@query("""
WITH r AS (SELECT *, c_custkey % 17 > 0 AS named FROM customer),
v AS (SELECT c_nationkey, count(DISTINCT (c_mktsegment, c_custkey % 23)) AS valid FROM r WHERE named GROUP BY 1)
SELECT c_nationkey AS town, count(*) AS discovered, count(*) FILTER (WHERE named) AS processed,
  count(*) FILTER (WHERE NOT named) AS errors, coalesce(any_value(valid), 0) AS valid,
  count(*) FILTER (WHERE named) - coalesce(any_value(valid), 0) AS duplicates
FROM r LEFT JOIN v USING (c_nationkey) GROUP BY 1""")
def collection_counts(spark, sf_dir):
    rows = collected(spark, sf_dir)
    kept = first_per_key(require_name(rows), ["town", "nombre", "direccion"], "seq")
    return collection_summary(rows, kept, ["town"])


@query(f"""
WITH {SHOPS_SQL}
SELECT count(*) AS results_raw, count(DISTINCT (lower(nombre), lower(direccion), lower(telefono))) AS results_deduped
FROM shops""")
def raw_and_deduped(spark, sf_dir):
    raw = with_keys(shops(spark, sf_dir))
    return raw_vs_deduped(raw, first_per_key(raw, "fallback_key", "seq"))


_TOWN = "CASE WHEN c_nationkey % 6 > 0 THEN c_nationkey END"


@query(f"""
WITH r AS (SELECT *, c_nationkey % 4 AS run, {_TOWN} AS town, c_custkey % 17 > 0 AS named FROM customer),
marked AS (SELECT run, town, 1 AS d, named::INT AS p, (NOT named)::INT AS e, 0 AS v, 0 AS h FROM r
  UNION ALL SELECT DISTINCT ON (run, town, c_mktsegment, c_custkey % 23) run, town, 0, 0, 0, 1, 0 FROM r WHERE named
  UNION ALL SELECT s_nationkey % 4, CASE WHEN s_nationkey % 6 > 0 THEN s_nationkey END, 0, 0, 0, 0, 1 FROM supplier WHERE s_suppkey % 3 = 0)
SELECT run, town, sum(d)::BIGINT AS discovered, sum(p)::BIGINT AS processed, sum(e)::BIGINT AS errors, sum(v)::BIGINT AS valid,
  sum(h)::BIGINT AS heuristic_stops, (sum(p) - sum(v))::BIGINT AS duplicates, 2 - grouping(run)::INT - grouping(town)::INT AS level
FROM marked GROUP BY ROLLUP (run, town)""")
def collection_totals(spark, sf_dir):
    """Counts per run and town, per run and of all; a sixth of the rows have no town."""
    def town(key):
        return F.when(F.col(key) % 6 > 0, F.col(key))

    rows = collected(spark, sf_dir).withColumn("run", F.col("town") % 4).withColumn("town", town("town"))
    kept = first_per_key(require_name(rows), ["run", "town", "nombre", "direccion"], "seq")
    stops = table(spark, sf_dir, "supplier").where("s_suppkey % 3 = 0").select(
        (F.col("s_nationkey") % 4).alias("run"), town("s_nationkey").alias("town")
    )
    return collection_report(rows, kept, ["run", "town"], stops)


@query(f"""
WITH {SHOPS_SQL},
u AS (SELECT count(DISTINCT CASE WHEN trim(maps_url) <> '' THEN trim(maps_url) ELSE lower(nombre || '|' || direccion || '|' || telefono) END) AS n FROM shops),
q AS (SELECT count(*) AS requests, count(*) FILTER (WHERE event_type <> 'click') AS pages FROM events WHERE user_id % 9 = 0),
m AS (SELECT requests + (SELECT count(*) FROM events WHERE user_id % 9 = 1) AS month_requests FROM q)
SELECT 'bares' AS category, (SELECT count(DISTINCT event_type) FROM events WHERE user_id % 9 = 0) AS n_queries, requests, pages,
  (SELECT count(*) FROM shops) AS results_raw, least(n, 500) AS results_deduped, 500::BIGINT AS written, month_requests,
  greatest(0, 1000 - month_requests) AS remaining, month_requests <= 1000 AS within_free,
  round(greatest(0, month_requests - 1000) / 1000.0::DOUBLE * 35.0::DOUBLE, 4) AS est_cost_usd, '2026-03-05T10:00:00+00:00' AS retrieved_at_utc
FROM u, q, m""")
def run_report(spark, sf_dir):
    """A run of the places search: its output of 500 rows and its metrics, with the month's quota."""
    from datetime import datetime

    events = table(spark, sf_dir, "events")
    output, ledger = new_path(spark, "places-output"), new_path(spark, "usage")
    # Another run of the month, and one of the month before.
    earlier = events.where("user_id % 9 = 1").agg(F.count(F.lit(1)).alias("requests"))
    dates = F.array(*[F.lit(d).cast("timestamp") for d in ("2026-03-01 00:00:00", "2026-02-28 23:59:59")])
    append_usage(earlier.select(F.explode(dates).alias("run_ts"), "requests"), ledger)
    asked = events.where("user_id % 9 = 0").select(
        F.col("event_type").alias("source_query"), (F.col("event_type") != "click").alias("answered")
    )
    run = collect_places_run(
        shops(spark, sf_dir), asked, output, ledger, "bares", max_records=500, now=datetime(2026, 3, 5, 10)
    )
    written = read_listings(spark, output).count()
    return run.select(
        "category", F.size("queries").cast("long").alias("n_queries"), "requests", "pages", "results_raw", "results_deduped",
        F.lit(written).cast("long").alias("written"), "quota.month_requests", "quota.remaining", "quota.within_free",
        "quota.est_cost_usd", "retrieved_at_utc",
    )
