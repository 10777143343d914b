"""Scoring: distances, bands, avatars, brand counts, the whole analysis."""

from pyspark.sql import functions as F

from table_queries.registry import query
from table_queries.shops import (
    BRANDS, CART_WORDS, SHOPS_SQL, SIGNATURES, SITES, TOWNS_SQL, brand_key_sql, case_sql,
    haversine_sql, letters, shops, sites_sql, sql_text, table, towns,
)
from table_queries.text import PLATFORM_SQL, coordinates_sql, first_email_sql, first_handle_sql
from vitrina import defaults
from vitrina.functions import geo, rules
from vitrina.functions.handles import best_profile, matches_business
from vitrina.operators.brands import (
    count_by_brand, distinct_brands, with_brand_key, with_store_count,
)
from vitrina.operators.contact import latest_lookup, page_features, search_key
from vitrina.operators.dedup import first_per_full_url, first_per_key, with_keys
from vitrina.operators.lookups import attach
from vitrina.operators.nearest import with_nearest_site
from vitrina.operators.runs import analysis_summary
from vitrina.operators.score import score_listings
from vitrina.operators.towns import town_population
from vitrina.plans.analyse import (
    analyse, analyse_with_handles, resolve_and_account, summarise_with_handles,
)

RULES = defaults.WEIGHTS["criterios"]


# Brands -------------------------------------------------------------------

_FIRST_SQL = """firsts AS (
  SELECT * FROM shops QUALIFY row_number() OVER (
    PARTITION BY lower(nombre), lower(direccion), lower(telefono) ORDER BY seq) = 1)"""
_BRAND = brand_key_sql("nombre", "municipio_origen")


@query(f"""
WITH {SHOPS_SQL}, {_FIRST_SQL}
SELECT {_BRAND} AS brand_key, count(*) AS num_tiendas FROM firsts GROUP BY 1 HAVING brand_key IS NOT NULL""")
def brand_counts(spark, sf_dir):
    first = first_per_key(with_keys(shops(spark, sf_dir)), "fallback_key", "seq")
    return count_by_brand(with_brand_key(first))


@query(f"""
WITH {SHOPS_SQL}
SELECT seq, coalesce(CASE WHEN k IS NOT NULL THEN count(*) OVER (PARTITION BY k) END, 1) AS num_tiendas
FROM (SELECT seq, {_BRAND} AS k FROM shops)""")
def brand_share(spark, sf_dir):
    return with_store_count(with_brand_key(shops(spark, sf_dir))).select("seq", "num_tiendas")


@query(f"WITH {SHOPS_SQL} SELECT count(DISTINCT {_BRAND}) AS marcas FROM shops")
def brand_number(spark, sf_dir):
    return distinct_brands(with_brand_key(shops(spark, sf_dir)))


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, l_shipdate::VARCHAR AS shipped, p_type FROM lineitem
LEFT JOIN (SELECT p_partkey, p_type FROM part WHERE p_size > 15) ON l_partkey % 7 * 100 = p_partkey""")
def hot_key_lookup(spark, sf_dir):
    """Seven keys hold all line items: the case the look-up join spreads."""
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey",
        F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss").alias("shipped"),
        (F.col("l_partkey") % 7 * 100).alias("k"),
    )
    parts = table(spark, sf_dir, "part").where("p_size > 15")
    return attach(lines, parts.select(F.col("p_partkey").alias("k"), "p_type"), "k").drop("k")


# Distances, bands, avatars -------------------------------------------------

def spots(spark, sf_dir):
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        "c_custkey",
        (36 + (k * 7 % 800) / 100).alias("lat"),
        (-9 + (k * 13 % 1200) / 100).alias("lon"),
    )


_SPOTS = """spots AS (SELECT c_custkey, 36 + (c_custkey * 7 % 800) / 100 AS lat,
  -9 + (c_custkey * 13 % 1200) / 100 AS lon FROM customer)"""


@query(f"""
WITH {_SPOTS}, {sites_sql()},
d AS (SELECT c_custkey, pos, city, {haversine_sql('lat', 'lon', 'slat', 'slon')} AS km FROM spots, sites)
SELECT c_custkey, round(min(km), 6) AS km, arg_min(city, (km, pos)) AS site FROM d GROUP BY c_custkey""")
def nearest_sites(spark, sf_dir):
    near = with_nearest_site(spots(spark, sf_dir), SITES)
    return near.select("c_custkey", F.round("km", 6).alias("km"), "site")


@query(f"""
WITH {_SPOTS} SELECT c_custkey, round({haversine_sql('lat', 'lon', '40.4168', '-3.7038')}, 6) AS km FROM spots""")
def distances(spark, sf_dir):
    km = geo.haversine_km(F.col("lat"), F.col("lon"), F.lit(40.4168), F.lit(-3.7038))
    return spots(spark, sf_dir).select("c_custkey", F.round(km, 6).alias("km"))


_BANDS = [
    ("distancia_eci", "o_orderkey % 160", "min_km", "max_km"),
    ("poblacion_municipio", "o_orderkey * 37 % 200000", "min", "max"),
    ("num_tiendas", "o_orderkey % 1005", "min", "max"),
]


@query(
    "SELECT o_orderkey, "
    + ", ".join(
        case_sql(value, RULES[name]["bandas"], low, high, field, other) + f" AS {name}_{short}"
        for name, value, low, high in _BANDS
        for field, short, other in (
            ("puntos", "puntos", "0"), ("etiqueta", "etiqueta", "'fuera de banda'")
        )
    )
    + " FROM orders"
)
def band_scores(spark, sf_dir):
    out = table(spark, sf_dir, "orders")
    for name, value, low, high in _BANDS:
        out = out.withColumn(name, rules.band(F.expr(value), RULES[name]["bandas"], low, high))
    return out.select(
        "o_orderkey",
        *[
            F.col(f"{name}.{field}").alias(f"{name}_{field}")
            for name, *_ in _BANDS
            for field in ("puntos", "etiqueta")
        ],
    )


def tier_sql(points: str, field: str) -> str:
    ranked = sorted(defaults.WEIGHTS["tramos_prioridad"], key=lambda t: -t["min_puntos"])
    whens = " ".join(f"WHEN {points} >= {t['min_puntos']} THEN {sql_text(t[field])}" for t in ranked)
    other = {"id": "P4", "etiqueta": "Prioridad mínima"}[field]
    return f"CASE {whens} ELSE {sql_text(other)} END"


@query(f"""
SELECT o_orderkey, {tier_sql('(o_orderkey % 106 - 5)', 'id')} AS tier,
  {tier_sql('(o_orderkey % 106 - 5)', 'etiqueta')} AS tier_label FROM orders""")
def score_tiers(spark, sf_dir):
    points = F.col("o_orderkey") % 106 - 5
    ranked = rules.tier(points, defaults.WEIGHTS["tramos_prioridad"])
    return table(spark, sf_dir, "orders").select("o_orderkey", ranked.alias("t")).select(
        "o_orderkey", F.col("t.id").alias("tier"), F.col("t.etiqueta").alias("tier_label")
    )


def avatar_rows_sql() -> str:
    rows = []
    for i, a in enumerate(defaults.AVATARS):
        r = a["criterios"]
        (p0, p1), (d0, d1), (t0, t1) = (
            r["poblacion_municipio"], r["distancia_eci_km"], r["num_tiendas"]
        )
        rows.append(
            f"({i}, {a['id']}, {sql_text(a['nombre'])}, {p0}, {p1}, {d0}, {d1}, {t0}, {t1}, "
            f"{r['ecommerce_requerido']}, {a['encaje_parcial_si_cumple_n']})"
        )
    columns = "pos, id, nombre, p0, p1, d0, d1, t0, t1, needs, n"
    return f"avatars({columns}) AS (VALUES {', '.join(rows)})"


def avatar_sql(source: str, key: str) -> str:
    """CTEs best(key, pts, label, id) for a source with pob, km, n_t, shop."""
    return f"""{avatar_rows_sql()},
met AS (SELECT {key}, a.*, (pob BETWEEN p0 AND p1)::INT + coalesce(km BETWEEN d0 AND d1, false)::INT
    + (n_t BETWEEN t0 AND t1)::INT + (needs AND shop)::INT AS hits, 3 + needs::INT AS total
  FROM {source}, avatars a),
fits AS (SELECT {key}, pos, avatars_id, CASE WHEN hits = total THEN 15 WHEN hits >= n THEN 7 ELSE 0 END AS pts,
    CASE WHEN hits = total THEN 'claro' ELSE 'parcial' END AS kind, nombre_a
  FROM (SELECT *, id AS avatars_id, nombre AS nombre_a FROM met)),
best AS (SELECT {key}, max(pts) AS pts,
    coalesce(arg_min('encaje ' || kind || ' con Avatar ' || avatars_id::VARCHAR || ' (' || nombre_a || ')', (-pts, pos))
      FILTER (WHERE pts > 0), 'no encaja con ningún avatar') AS label,
    arg_min(avatars_id, (-pts, pos)) FILTER (WHERE pts > 0) AS id
  FROM fits GROUP BY {key})"""


_AVATAR_INPUT = """SELECT o_orderkey, o_orderkey * 37 % 250000 AS pob,
    CASE WHEN o_orderkey % 7 > 0 THEN o_orderkey % 130 + 0.5 END AS km,
    o_orderkey % 11 AS n_t, o_orderkey % 2 = 0 AS shop"""


@query(f"""
WITH ctx AS ({_AVATAR_INPUT} FROM orders), {avatar_sql('ctx', 'o_orderkey')}
SELECT o_orderkey, pts AS puntos, label AS etiqueta, id AS avatar_id FROM best""")
def avatar_match(spark, sf_dir):
    k = F.col("o_orderkey")
    hits = rules.avatar_hits(
        k * 37 % 250000, F.when(k % 7 > 0, k % 130 + 0.5), k % 11, k % 2 == 0, defaults.AVATARS
    )
    best = rules.best_avatar(F.col("hits"), defaults.AVATARS, RULES["encaje_avatar"]["valores"])
    counted = table(spark, sf_dir, "orders").select("o_orderkey", hits.alias("hits"))
    return counted.select("o_orderkey", best.alias("a")).select(
        "o_orderkey", "a.puntos", "a.etiqueta", F.col("a.id").alias("avatar_id")
    )


def _round1(x: str) -> str:
    return f"round_even({x}, 1)"


def score_sql(source: str, key: str, extra: str = "") -> str:
    """CTEs scored(key, puntuacion, prioridad, justificacion, …) for a source with
    lat, lon, pob, n_t, madurez, tec."""
    bands = {
        name: (case_sql(value, RULES[rule]["bandas"], low, high, "puntos", "0"),
               case_sql(value, RULES[rule]["bandas"], low, high, "etiqueta", "'fuera de banda'"))
        for name, rule, value, low, high in (
            ("d", "distancia_eci", "km", "min_km", "max_km"),
            ("p", "poblacion_municipio", "pob", "min", "max"),
            ("t", "num_tiendas", "n_t", "min", "max"),
        )
    }
    tec = RULES["madurez_digital"]["por_tecnologia"]
    by_tec = " ".join(
        f"WHEN madurez = 'ecommerce_funcional' AND tec = '{n}' THEN {v}" for n, v in tec.items()
    )
    by_level = " ".join(
        f"WHEN madurez = '{n}' THEN {v}" for n, v in RULES["madurez_digital"]["valores"].items()
    )
    names = ", ".join(sql_text(n) for n in tec)
    return f"""{sites_sql()},
near AS (SELECT {key}, min(km) AS km, arg_min(city, (km, pos)) AS site FROM (
    SELECT {key}, pos, city, {haversine_sql('lat', 'lon', 'slat', 'slon')} AS km
    FROM {source}, sites WHERE lat IS NOT NULL AND lon IS NOT NULL) GROUP BY {key}),
ctx AS (SELECT s.*, km, site, madurez = 'ecommerce_funcional' AS shop FROM {source} s LEFT JOIN near USING ({key})),
{avatar_sql('ctx', key)},
judged AS (SELECT ctx.*, pts AS pts_a, label AS et_a, best.id AS av_id,
    CASE WHEN km IS NULL THEN 0 ELSE {bands['d'][0]} END AS pts_d, {bands['d'][1]} AS et_d,
    {bands['p'][0]} AS pts_p, {bands['p'][1]} AS et_p, {bands['t'][0]} AS pts_t, {bands['t'][1]} AS et_t,
    CASE {by_tec} {by_level} ELSE 0 END AS pts_m,
    CASE WHEN madurez = 'ecommerce_funcional' AND tec IN ({names})
      THEN 'ecommerce_funcional (' || tec || ')' ELSE madurez END AS et_m
  FROM ctx JOIN best USING ({key})),
summed AS (SELECT *, pts_d + pts_p + pts_t + pts_m + pts_a AS total FROM judged),
scored AS (SELECT *, {tier_sql('total', 'id')} AS tier_id, {tier_sql('total', 'etiqueta')} AS tier_label,
    CASE WHEN km IS NULL THEN 'sin coordenadas (0pts dist)'
      ELSE 'ECI ' || site || ' a ' || printf('%.1f', {_round1('km')}) || 'km [' || et_d || '=' || pts_d::VARCHAR || 'pts]' END
    || '; pob ' || format('{{:,}}', pob::BIGINT) || ' [' || et_p || '=' || pts_p::VARCHAR || 'pts]; '
    || n_t::VARCHAR || ' tiendas [' || et_t || '=' || pts_t::VARCHAR || 'pts]; madurez=' || et_m
    || ' [' || pts_m::VARCHAR || 'pts]; ' || et_a || ' [' || pts_a::VARCHAR || 'pts]' AS why
  FROM summed)"""


_SUPPLIER_SQL = """src AS (SELECT s_suppkey,
    CASE WHEN s_suppkey % 9 > 0 THEN 36 + (s_suppkey % 80) / 10 END AS lat,
    CASE WHEN s_suppkey % 9 > 0 THEN -9 + (s_suppkey % 120) / 10 END AS lon,
    1000 * (1 + s_suppkey % 250) AS pob, 1 + s_suppkey % 12 AS n_t,
    CASE s_suppkey % 3 WHEN 0 THEN 'ecommerce_funcional' WHEN 1 THEN 'solo_redes_sociales'
      ELSE 'sin_presencia' END AS madurez,
    CASE s_suppkey % 4 WHEN 0 THEN 'WooCommerce' WHEN 1 THEN 'Wix' END AS tec
  FROM supplier)"""


@query(f"""
WITH {_SUPPLIER_SQL}, {score_sql('src', 's_suppkey')}
SELECT s_suppkey, total AS puntuacion, tier_id AS prioridad, tier_label AS prioridad_etiqueta,
  why AS justificacion, pts_d, pts_p, pts_t, pts_m, pts_a, av_id, site,
  {_round1('km')} AS km FROM scored""")
def supplier_scores(spark, sf_dir):
    k = F.col("s_suppkey")
    src = table(spark, sf_dir, "supplier").select(
        "s_suppkey",
        F.when(k % 9 > 0, 36 + (k % 80) / 10).alias("lat"),
        F.when(k % 9 > 0, -9 + (k % 120) / 10).alias("lon"),
        (1000 * (1 + k % 250)).alias("poblacion"),
        (1 + k % 12).alias("num_tiendas"),
        F.when(k % 3 == 0, "ecommerce_funcional").when(k % 3 == 1, "solo_redes_sociales")
        .otherwise("sin_presencia").alias("madurez"),
        F.when(k % 4 == 0, "WooCommerce").when(k % 4 == 1, "Wix").alias("tecnologia"),
    )
    b = "breakdown"
    return score_listings(src, SITES).select(
        "s_suppkey", "puntuacion", "prioridad", "prioridad_etiqueta", "justificacion",
        F.col(f"{b}.distancia_eci.puntos").alias("pts_d"),
        F.col(f"{b}.poblacion.puntos").alias("pts_p"),
        F.col(f"{b}.num_tiendas.puntos").alias("pts_t"),
        F.col(f"{b}.madurez_digital.puntos").alias("pts_m"),
        F.col(f"{b}.avatar.puntos").alias("pts_a"),
        F.col(f"{b}.avatar.valor_avatar_id").alias("av_id"),
        F.col(f"{b}.distancia_eci.eci").alias("site"),
        F.col(f"{b}.distancia_eci.valor_km").alias("km"),
    )


# The whole analysis --------------------------------------------------------

_FEATURES_SQL = f"""features AS (
  SELECT url, {PLATFORM_SQL} AS plataforma, {first_email_sql('html')} AS email,
    {first_handle_sql('html')} AS perfil FROM pages WHERE NOT ends_with(url, '#top')
  QUALIFY row_number() OVER (PARTITION BY url ORDER BY plataforma NULLS FIRST, email NULLS FIRST, perfil NULLS FIRST) = 1)"""
_EXCLUDED = " OR ".join(
    f"contains(lower(nombre), {sql_text(b.lower())})" for b in BRANDS if b.strip()
)
_SLUG = "regexp_replace(lower(nombre), '[^a-z0-9]+', '', 'g')"

ANALYSIS_SQL = f"""{SHOPS_SQL}, {_FIRST_SQL}, {TOWNS_SQL}, {_FEATURES_SQL},
counted AS (SELECT *, {_EXCLUDED} AS excluded,
    CASE WHEN k IS NULL THEN 1 ELSE count(*) OVER (PARTITION BY k) END AS n_t
  FROM (SELECT *, {_BRAND} AS k FROM firsts)),
webbed AS (SELECT c.*, CASE WHEN web <> '' AND NOT regexp_matches(web, '^https?://') THEN 'https://' || web ELSE web END AS w
  FROM counted c),
paged AS (SELECT webbed.*, f.url IS NOT NULL AS read_ok, f.plataforma, f.email AS found, f.perfil,
    w <> '' AND NOT regexp_matches(lower(w), 'instagram\\.com|facebook\\.com|fb\\.com') AS asked,
    coalesce(t.population, 0) AS pob
  FROM webbed LEFT JOIN features f ON w = f.url AND NOT regexp_matches(lower(w), 'instagram\\.com|facebook\\.com|fb\\.com')
  LEFT JOIN towns t ON lower(trim(municipio_origen)) = trim(t.name)),
ready AS (SELECT seq, nombre, excluded, perfil, n_t, pob, municipio_origen,
    CASE WHEN NOT read_ok THEN '-' WHEN plataforma IS NULL THEN 'No' ELSE 'Sí' END AS es_tienda,
    asked AND NOT read_ok AS page_error, plataforma AS tec,
    coalesce(found, 'vmarketing@' || {_SLUG} || '.com') AS email,
    CASE WHEN found IS NULL THEN 'placeholder' ELSE 'page' END AS email_source,
    CASE WHEN plataforma IS NOT NULL THEN 'ecommerce_funcional' WHEN w <> '' THEN 'solo_redes_sociales'
      ELSE 'sin_presencia' END AS madurez,
    {coordinates_sql('lat')} AS lat, {coordinates_sql('lon')} AS lon FROM paged)"""

_SCORED_COLUMNS = """seq, nombre, es_tienda, coalesce(tec, '-') AS tecnologia, n_t AS num_tiendas, pob AS poblacion,
  CASE WHEN tec = 'Casa' THEN 'Ya cliente' ELSE tier_id END AS prioridad,
  CASE WHEN tec = 'Casa' THEN 0 ELSE total END AS puntuacion,
  CASE WHEN tec = 'Casa' THEN 'Ya cliente (web hecha con Casa) — sin serlo sería ' || tier_id ELSE why END AS justificacion,
  email, email_source"""


def analysed(spark, sf_dir, keep_excluded=False):
    pages = table(spark, sf_dir, "pages").select(
        "url", "html", F.when(F.endswith("url", F.lit("#top")), 500).alias("status")
    )
    features = page_features(pages, SIGNATURES, CART_WORDS)
    return analyse(
        shops(spark, sf_dir), features, towns(spark, sf_dir), SITES, BRANDS,
        own_platform="Casa", keep_excluded=keep_excluded,
    )


@query(f"""
WITH {ANALYSIS_SQL}, kept AS (SELECT * FROM ready WHERE NOT excluded), {score_sql('kept', 'seq')}
SELECT {_SCORED_COLUMNS} FROM scored""")
def listing_scores(spark, sf_dir):
    return analysed(spark, sf_dir).select(
        "seq", "nombre", "es_tienda", "tecnologia", "num_tiendas", "poblacion", "prioridad",
        "puntuacion", "justificacion", "email", "email_source",
    )


# Handles ------------------------------------------------------------------

def search_rows(spark, sf_dir):
    """A saved search response for each customer's shop, spelled out of its key."""
    k = F.col("c_custkey")
    name = letters(k)
    customer = table(spark, sf_dir, "customer")

    def item(kind, title, url, crumb):
        return F.struct(
            kind.alias("type"), title.alias("title"), url.alias("url"), crumb.alias("breadcrumb")
        )

    none = F.lit(None).cast("string")
    shop = F.concat(F.lit("x"), name, F.lit("moda"))
    items = F.array(
        item(F.lit("ads"), F.concat(shop, F.lit(" (@"), shop, F.lit(")")), none, none),
        item(F.lit("organic"), F.concat(F.upper(shop), F.lit(" (@"), shop, F.lit("_vigo)")),
             F.lit("https://x.com/a"), none),
        item(F.lit("organic"),
             F.concat(shop, F.lit(" (@"), shop, F.lit(")"), F.when(k % 3 == 0, " | TikTok").otherwise("")),
             F.concat(F.lit("https://www.instagram.com/"), F.when(k % 4 == 0, "p").otherwise("otra_casa")),
             none),
        item(F.lit("organic"), F.concat(F.lit("Tienda "), shop), none,
             F.concat(F.lit("https://www.instagram.com › "), shop, F.lit("_oficial"))),
    )
    return customer.select(
        k.alias("seq"),
        F.concat(F.lit("Tienda X"), name, F.lit("móda "),
                 F.when(k % 5 == 0, "Boutique").otherwise("")).alias("nombre"),
        F.when(k % 2 == 0, "Vigo").otherwise("Lugo").alias("municipio_origen"),
        F.when(k % 7 > 0, items).alias("items"),
        F.when(k % 6 == 0, 0.0).otherwise(0.002).alias("cost"),
        "c_mktsegment",
        "c_acctbal",
    )


_SHOP = "'x' || translate(c_custkey::VARCHAR, '0123456789', 'abcdefghij') || 'moda'"
# Shops in Vigo match their '<shop>_vigo' profile; the others have to wait for
# the plain handle, and for the breadcrumb where that title is another network's.
_HANDLE_SQL = f"""CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN c_custkey % 2 = 0 THEN {_SHOP} || '_vigo'
    WHEN c_custkey % 3 > 0 THEN {_SHOP} ELSE {_SHOP} || '_oficial' END"""


@query(f"SELECT c_custkey AS seq, {_HANDLE_SQL} AS handle FROM customer")
def best_profiles(spark, sf_dir):
    best = best_profile(F.col("items"), F.col("nombre"), F.col("municipio_origen"))
    return search_rows(spark, sf_dir).select("seq", best.alias("handle"))


@query("""
SELECT p_partkey, len(list_filter(string_split(lower(p_name), ' '), lambda w:
  len(w) >= 3 AND contains(lower(regexp_replace(p_brand, '#', '')) || lower(p_name[3:]) || ' ' || lower(p_type), w))) > 0 AS matches
FROM part""")
def matching_names(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    handle = F.concat(F.regexp_replace("p_brand", "#", ""), F.expr("substring(p_name, 3)"))
    return part.select(
        "p_partkey",
        matches_business(F.col("p_name"), F.regexp_replace(handle, " ", "."), F.col("p_type"))
        .alias("matches"),
    )


@query("""
SELECT event_type || '|' || (user_id % 97)::VARCHAR AS key,
  arg_max(CASE WHEN event_id % 3 = 0 THEN '' ELSE 'https://instagram.com/u' || event_id::VARCHAR END, event_id) AS url,
  max(event_id) AS ts FROM events GROUP BY 1""")
def search_cache(spark, sf_dir):
    e = F.col("event_id")
    cache = table(spark, sf_dir, "events").select(
        F.concat_ws("|", "event_type", (F.col("user_id") % 97).cast("string")).alias("key"),
        F.when(e % 3 == 0, "").otherwise(
            F.concat(F.lit("https://instagram.com/u"), e.cast("string"))
        ).alias("url"),
        e.alias("ts"),
    )
    return latest_lookup(cache)


_RESOLVE_SQL = f"""rows AS (SELECT c_custkey AS seq, c_mktsegment = 'BUILDING' AS on_page,
    CASE WHEN c_mktsegment = 'MACHINERY' THEN c_acctbal > 5000 END AS cached_known,
    CASE WHEN c_custkey % 6 = 0 THEN 0.0 ELSE 0.002 END AS cost, {_HANDLE_SQL} AS handle FROM customer),
asked AS (SELECT *, sum(cost) OVER w AS spent, count(*) FILTER (WHERE cost > 0) OVER w AS paid_before FROM rows
  WHERE NOT on_page AND cached_known IS NULL
  WINDOW w AS (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
allowed AS (SELECT seq, coalesce(spent, 0) + 0.002 <= 0.5 + 1e-9 AS ok FROM asked)"""


def _handle_inputs(spark, sf_dir):
    rows = search_rows(spark, sf_dir)
    k = F.col("seq")
    key = search_key(F.col("nombre"), F.col("municipio_origen"))

    def link(word):
        return F.concat(F.lit(f"https://instagram.com/{word}"), k.cast("string"))

    listings = rows.select(
        "seq", "nombre", "municipio_origen",
        F.when(F.col("c_mktsegment") == "BUILDING", link("page")).alias("perfil"),
    )
    cache = rows.where("c_mktsegment = 'MACHINERY'").select(
        key.alias("key"),
        F.when(F.col("c_acctbal") > 5000, link("cache")).otherwise("").alias("url"),
        k.alias("ts"),
    )
    return listings, cache, rows.select(key.alias("key"), "items", "cost")


@query(f"""
WITH {_RESOLVE_SQL},
state AS (SELECT *, CASE WHEN on_page THEN 'page' WHEN cached_known IS NOT NULL THEN 'cache' ELSE 'paid' END AS one FROM rows),
runs AS (SELECT 1 AS run, one AS search_state, CASE WHEN one = 'paid' THEN cost ELSE 0 END AS usd FROM state
  UNION ALL SELECT 2, CASE WHEN one = 'paid' AND cost > 0 THEN 'cache' ELSE one END, 0 FROM state)
SELECT run::INT AS run, search_state, count(*) AS n, round(sum(usd), 6)::DOUBLE AS usd FROM runs GROUP BY ALL""")
def handles_of_two_runs(spark, sf_dir):
    """A second run finds the first one's searches in the cache and pays nothing."""
    listings, cache, searches = _handle_inputs(spark, sf_dir)
    counted = []
    for run in (1, 2):
        rows, new, report = resolve_and_account(listings, cache, searches, 10**12 + run, max_usd=10_000.0)
        cache = cache.unionByName(new.select(*cache.columns))
        spent = report.agg(F.round(F.coalesce(F.sum("spent"), F.lit(0.0)), 6)).scalar()
        per_state = rows.groupBy("search_state").agg(F.count(F.lit(1)).alias("n"))
        counted.append(per_state.select(
            F.lit(run).alias("run"), "search_state", "n",
            F.when(F.col("search_state") == "paid", spent).otherwise(0.0).alias("usd"),
        ))
    return counted[0].unionByName(counted[1])


@query(f"""
WITH {_RESOLVE_SQL}
SELECT seq, CASE WHEN on_page THEN 'https://instagram.com/page' || seq::VARCHAR
    WHEN cached_known THEN 'https://instagram.com/cache' || seq::VARCHAR
    WHEN cached_known IS NULL AND ok AND handle IS NOT NULL THEN 'https://instagram.com/' || handle ELSE '' END AS instagram,
  CASE WHEN on_page THEN 'web' WHEN cached_known OR (cached_known IS NULL AND ok AND handle IS NOT NULL)
    THEN 'dataforseo' ELSE '-' END AS instagram_fuente
FROM rows LEFT JOIN allowed USING (seq)""")
def resolved_handles(spark, sf_dir):
    listings, cache, searches = _handle_inputs(spark, sf_dir)
    done = analyse_with_handles(listings, cache, searches, max_usd=0.5)
    return done.select("seq", "instagram", "instagram_fuente")


@query(f"""
WITH {ANALYSIS_SQL}
SELECT count(*) AS total, count(*) FILTER (WHERE excluded) AS filtered, count(*) FILTER (WHERE NOT excluded) AS analyzed,
  count(*) FILTER (WHERE NOT excluded AND es_tienda = 'Sí') AS stores,
  count(*) FILTER (WHERE NOT excluded AND page_error) AS errors,
  count(*) FILTER (WHERE NOT excluded AND perfil IS NOT NULL) AS ig_web, 0::BIGINT AS ig_dataforseo,
  count(*) FILTER (WHERE NOT excluded AND perfil IS NULL) AS ig_none FROM ready""")
def analysis_counts(spark, sf_dir):
    rows = analysed(spark, sf_dir, keep_excluded=True)
    return analysis_summary(
        rows.withColumn("instagram_fuente", F.when(F.col("perfil").isNull(), "-").otherwise("web"))
    )


@query(f"""
WITH {_RESOLVE_SQL.replace('FROM customer)', 'FROM customer WHERE c_custkey % 11 > 0)')},
f AS (SELECT seq, CASE WHEN on_page THEN 'web' WHEN cached_known OR (cached_known IS NULL AND ok AND handle IS NOT NULL)
    THEN 'dataforseo' ELSE '-' END AS fuente FROM rows LEFT JOIN allowed USING (seq))
SELECT count(*) AS total, count(*) FILTER (WHERE c_custkey % 11 = 0) AS filtered, count(seq) AS analyzed,
  count(*) FILTER (WHERE seq % 3 = 0) AS stores, count(*) FILTER (WHERE seq % 7 = 2) AS errors,
  count(*) FILTER (WHERE fuente = 'web') AS ig_web, count(*) FILTER (WHERE fuente = 'dataforseo') AS ig_dataforseo,
  count(*) FILTER (WHERE fuente = '-') AS ig_none
FROM customer LEFT JOIN f ON seq = c_custkey""")
def analysis_counts_with_handles(spark, sf_dir):
    """Handles from pages, from the cache and from paid searches within a budget, counted by source."""
    listings, cache, searches = _handle_inputs(spark, sf_dir)
    k = F.col("seq")
    flagged = listings.withColumns({
        "excluded": k % 11 == 0, "es_tienda": F.when(k % 3 == 0, "Sí").otherwise("No"), "page_error": k % 7 == 2,
    })
    return summarise_with_handles(flagged, cache, searches, max_usd=0.5)


# First rows and town look-ups ----------------------------------------------

@query(f"""
WITH {SHOPS_SQL}
SELECT seq, nombre, maps_url FROM shops QUALIFY row_number() OVER (PARTITION BY
  CASE WHEN maps_url <> '' THEN maps_url ELSE lower(nombre || '|' || direccion || '|' || telefono) END ORDER BY seq) = 1""")
def first_per_link(spark, sf_dir):
    return first_per_full_url(shops(spark, sf_dir), "seq").select("seq", "nombre", "maps_url")


@query("""
SELECT event_id, user_id, event_type FROM events
QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1""")
def first_per_event_key(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return first_per_key(events, ["user_id", "event_type"], "ts", "event_id").select(
        "event_id", "user_id", "event_type"
    )


@query("""
WITH t AS (SELECT lower(p_name) AS name, arg_min(1000 + p_partkey * 7 % 90000, p_partkey) AS population
  FROM part WHERE p_size > 10 GROUP BY 1)
SELECT l_orderkey, l_linenumber, l_partkey, coalesce(population, 0) AS poblacion
FROM lineitem LEFT JOIN part ON l_partkey = p_partkey
LEFT JOIN t ON name = lower(CASE WHEN l_linenumber = 7 THEN 'Nowhere' ELSE p_name END)""")
def town_populations(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    dim = part.where("p_size > 10").select(
        F.concat(F.lit(" "), F.upper("p_name")).alias("name"),
        (1000 + k * 7 % 90000).alias("population"), k.alias("pos"),
    )
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    named = lines.join(part.select("p_partkey", "p_name"), F.col("l_partkey") == k, "left").select(
        "l_orderkey", "l_linenumber", "l_partkey",
        F.when(F.col("l_linenumber") == 7, "Nowhere").otherwise(F.col("p_name"))
        .alias("municipio_origen"),
    )
    return town_population(named, dim).drop("municipio_origen")
