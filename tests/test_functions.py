import pytest
from pyspark.sql import functions as F

from vitrina import defaults
from vitrina.functions import geo, handles, page, rules, text

C = F.col


@pytest.mark.parametrize("raw, want", [
    ("  hola   mundo  ", "hola mundo"), ("a  b\t\n", "a b"), ("Tel", "Tel"),
    (None, ""), (" x\x1cy", "x y"),
])
def test_clean_text(one, raw, want):
    assert one(text.clean_text(C("x")), x=raw) == want


@pytest.mark.parametrize("raw, want", [
    ("4,6", "4.6"), ("n/a", ""), ("10", "10"), ("4.25", "4.2"), ("4.35", "4.3"), ("4.45", "4.5"), ("-0,75", "-0.8"), ("4.5d", ""), ("", ""),
    ("5.0", "5"), (".5", "0.5"), ("1e1", "10"), ("nan", ""), ("0", "0"), ("-3,25", "-3.2"),
])
def test_clean_rating(one, raw, want):
    assert one(text.clean_rating(C("x")), x=raw) == want


def test_clean_rating_cleans_its_text_once(spark):
    plan = spark.range(1).select(text.clean_rating(F.col("id").cast("string")))._jdf.queryExecution().analyzed().toString()
    assert plan.count("cast(id#") == 1


def test_with_scheme(one):
    assert one(text.with_scheme(C("x")), x="shop.es") == "https://shop.es"
    assert one(text.with_scheme(C("x")), x="http://shop.es") == "http://shop.es"
    assert one(text.with_scheme(C("x")), x="") == ""


@pytest.mark.parametrize("name, norm", [
    ("Lolitamoda - Vigo (centro)", "lolitamoda vigo"), ("Zapaterías 54", "zapaterías"),
    ("  A&B / C|D. ", "a b c d"), ("(solo)", ""),
])
def test_brand_norm(one, name, norm):
    assert one(text.brand_norm(C("x")), x=name) == norm


@pytest.mark.parametrize("name, town, key", [
    ("Lolitamoda Noia", "Noia", "lolitamoda"), ("Noia", "Noia", "noia"),
    ("Casa Casa Vigo", "vigo", "casa casa"), ("12", "Vigo", ""), ("Bar", None, "bar"),
])
def test_brand_key(one, name, town, key):
    assert one(text.brand_key(C("x"), C("y")), x=name, y=town) == key


@pytest.mark.parametrize("raw, want", [
    ("Santiago de Compostela, España", "santiago_de_compostela_espana"), ("MADRID", "madrid"),
    ("a, b", "a_b"), ("a" * 60, "a" * 40), ("--", ""),
])
def test_slug(one, raw, want):
    assert one(text.slug(C("x")), x=raw) == want


@pytest.mark.parametrize("name, want", [
    ("Boutique Lolita", "boutiquelolita"), ("Joyería Águila & Co. (Vigo)", "joyeriaaguilacovigo"),
    ("La Tienda - de - María", "latiendademaria"), ("", "negocio"), ("   ", "negocio"),
    ("---!!---", "negocio"), ("Straße Ñandú œuvre Łódź", "strassenanduoeuvrelodz"),
])
def test_placeholder_email(one, name, want):
    assert one(page.placeholder_email(C("x")), x=name) == f"vmarketing@{want}.com"


@pytest.mark.parametrize("raw, want", [
    ("Καφές Ψυχή", "kaphespsukhe"), ("Щука и Ёж", "shchukaiiozh"), ("Ресторан №1", "restoranno1"), ("日本", "negocio"),
])
def test_business_slug_of_other_scripts(one, raw, want):
    assert one(text.business_slug(C("x")), x=raw) == want


def test_fold_parts_words_at_other_signs(one):
    assert one(text.words(C("x")), x="D A·N «Dará»…fin") == ["d", "a", "n", "dara", "fin"]


@pytest.mark.parametrize("raw, want", [
    ("Teléfono: +34 981 00 00 00", "+34 981 00 00 00"), ("12 34", ""), ("a: b: 981-00-00-00 x", "981-00-00-00"),
    ("", ""),
])
def test_phone_like(one, raw, want):
    assert one(text.phone_like(C("x")), x=raw) == want


@pytest.mark.parametrize("html, want", [
    ('<a href="mailto:info@example.com">x</a>', "info@example.com"),
    ("Escríbenos a contacto@negocio.es para info", "contacto@negocio.es"),
    ("Contacta info@a.com o ventas@b.com", "info@a.com"),
    ('<img src="logo@2x.png" />', None), ('<link href="font@1x.woff2" />', None),
    ("noreply@example.com es nuestro automático", None),
    ("noreply@example.com pero contacta a hola@example.com", "hola@example.com"),
    ("'https://abc@sentry.io/1234'", None), ("12.34@a.com", None), ("", None), (None, None),
    ("a@b.png_c@d.es", "c@d.es"), ("._x@y.com", "x@y.com"), ("x-@y.com z@w.com", "z@w.com"),
    ("a@b.css.+c@d.es@e.fr", "c@d.es"),
])
def test_first_email(one, html, want):
    assert one(page.first_email(C("x")), x=html) == want


def test_first_email_is_linear_in_long_runs(one):
    blob = "A1" * 400_000
    assert one(page.first_email(C("x")), x=blob + " hola@tienda.es") == "hola@tienda.es"


_OWN = defaults.signatures_with("Casa", ["casa.example", "casa_config"])


@pytest.mark.parametrize("html, want", [
    ('<script src="https://cdn.shopify.com/s/x.js">', "Shopify"),
    ("/wp-content/plugins/woocommerce/a.css", "WooCommerce"), ("var prestashop = {};", "PrestaShop"),
    ('{"mage/cookies":{}}', "Magento"), ("https://static.squarespace.com/u.css", "Squarespace"),
    ("https://static.wixstatic.com/f.css", "Wix"), ("https://uploads-ssl.webflow.com/m.js", "Webflow"),
    ('<button class="add-to-cart">', "Desconocida"), ('<a href="/CHECKOUT">', "Desconocida"),
    ("AÑADIR AL CARRITO", "Desconocida"), ("<p>Bienvenido</p>", None),
    ("www.casa.example Magento", "Casa"), ("data:image/png", "Magento"),
])
def test_platform(one, html, want):
    assert one(page.platform(C("x"), F.lower("x"), _OWN), x=html) == want


def test_platform_strict(one):
    assert one(page.platform(C("x"), F.lower("x"), strict=True), x="data:image/png") is None
    assert one(page.platform(C("x"), F.lower("x"), strict=True), x='"mage/cookies"') == "Magento"


@pytest.mark.parametrize("html, want", [
    ('<a href="https://instagram.com/faro.vigo">', "faro.vigo"), ("https://instagram.com/p/abc/", None),
    ("//www.Instagram.com/Tienda_1/", "Tienda_1"), ("instagram.com/x", None),
    ("//instagram.com/reel/1 //instagram.com/mi... //instagram.com/ok", "ok"),
])
def test_first_handle(one, html, want):
    want = want and f"https://instagram.com/{want}"
    assert one(page.first_handle(C("x")), x=html) == want


_ITEM = "array<struct<type:string,title:string,url:string,breadcrumb:string>>"


@pytest.mark.parametrize("titles, name, town, want", [
    (["Pulsera @otra_marca", "Faro Joyas (@farojoyas) - Instagram"], "Faro", "", "farojoyas"),
    (["Lunaria (@lunaria) - Instagram"], "Muebles Teo", "", None),
    (["SÓLEO | Ropa (@soleo_burgos)", "SOLEO NORTE (@soleo_norte)", "S Ó L E O (@soleo_shop)"],
     "Sóleo", "Vila Alta", "soleo_shop"),
    (["Rincón Verde Mar (@rin...)"], "Rincón Verde Mar", "", None),
    (["Faro (@faro) | TikTok"], "Faro", "", None),
    (["Faro Joyas (@faro.vilaalta) - Mentions"], "Faro", "", None),
    ([], "Faro", "", None),
])
def test_best_profile(spark, titles, name, town, want):
    items = [("organic", t, "https://google.com/goto?url=x", None) for t in titles]
    df = spark.createDataFrame([(items, name, town)], f"items {_ITEM}, name string, town string")
    assert df.select(handles.best_profile(C("items"), C("name"), C("town"))).first()[0] == want


def test_best_profile_reads_links_and_breadcrumbs(spark):
    rows = [
        ([("organic", "x", None, "https://www.instagram.com › popular › lunaria")], None),
        ([("organic", "x", None, "https://www.instagram.com › lunaria_oficial ")], "lunaria_oficial"),
        ([("ads", "Lunaria (@lunaria)", None, None), ("organic", "y", "//instagram.com/Lunaria.es?hl", "z")],
         "Lunaria.es"),
    ]
    df = spark.createDataFrame(rows, f"items {_ITEM}, want string")
    got = df.select(handles.best_profile(C("items"), F.lit("Lunaria"), F.lit("")).alias("g"), "want")
    assert all(r["g"] == r["want"] for r in got.collect())


def test_matches_business(one):
    assert one(handles.matches_business(C("n"), C("h"), F.lit("")), n="Sóleo", h="soleooficial")
    assert not one(handles.matches_business(C("n"), C("h"), F.lit("")), n="Tienda Verde", h="lunaria")


@pytest.mark.parametrize("lat, lon, url, want", [
    ("", "", "https://www.google.com/maps/place/Foo/@43.21,-8.69,17z/data=abc", (43.21, -8.69)),
    ("", "", "x/@1.5,2.5/data=!8m2!3d42.234976!4d-8.716834!16s", (42.234976, -8.716834)),
    ("40.1", "-3", "x/@1.5,2.5", (40.1, -3.0)), ("n/a", "-3", "x/@1.5,2.5", (1.5, 2.5)),
    ("40.1", "", "https://example.com", None), (None, None, None, None), ("", "", "x/@43,-8", None),
])
def test_coordinates(one, lat, lon, url, want):
    got = one(geo.coordinates(C("a"), C("b"), C("u")), a=lat, b=lon, u=url)
    assert (tuple(got) if got else None) == want


def test_haversine(one):
    km = one(geo.haversine_km(F.lit(40.4168), F.lit(-3.7038), F.lit(41.3851), F.lit(2.1734)))
    assert 500 < km < 510


_RULES = defaults.WEIGHTS["criterios"]


@pytest.mark.parametrize("rule, low, high, value, points", [
    ("distancia_eci", "min_km", "max_km", 60.0, 20), ("distancia_eci", "min_km", "max_km", 15.0, 10),
    ("distancia_eci", "min_km", "max_km", 45.0, 20), ("distancia_eci", "min_km", "max_km", 30.0, 15),
    ("distancia_eci", "min_km", "max_km", 85.0, 20), ("distancia_eci", "min_km", "max_km", 120.0, 15),
    ("poblacion_municipio", "min", "max", 25000, 15), ("poblacion_municipio", "min", "max", 3000, 3),
    ("poblacion_municipio", "min", "max", 300000, 10), ("num_tiendas", "min", "max", 4, 30),
    ("num_tiendas", "min", "max", 2, 15), ("num_tiendas", "min", "max", 1, 5),
    ("num_tiendas", "min", "max", 10, 30), ("num_tiendas", "min", "max", 1000, 0),
    ("num_tiendas", "min", "max", 0, 0),
])
def test_bands(one, rule, low, high, value, points):
    got = one(rules.band(C("x"), _RULES[rule]["bandas"], low, high), x=value)
    assert got["puntos"] == points
    assert points or got["etiqueta"] == "fuera de banda"


@pytest.mark.parametrize("level, tech, points", [
    ("ecommerce_funcional", None, 10), ("solo_redes_sociales", None, 15), ("sin_presencia", None, 5),
    ("ecommerce_funcional", "WooCommerce", 20), ("ecommerce_funcional", "Shopify", 8),
    ("ecommerce_funcional", "Casa", 10), ("solo_redes_sociales", "Shopify", 15), ("otro", None, 0),
])
def test_maturity_points(one, level, tech, points):
    got = one(rules.maturity_points(C("l"), C("t"), _RULES["madurez_digital"]), l=level, t=tech)
    assert got["puntos"] == points


@pytest.mark.parametrize("points, want", [(80, "P1"), (75, "P1"), (60, "P2"), (40, "P3"), (10, "P4"), (-1, "P4")])
def test_tier(one, points, want):
    assert one(rules.tier(C("x"), defaults.WEIGHTS["tramos_prioridad"]), x=points)["id"] == want


@pytest.mark.parametrize("pop, km, stores, shop, points, who", [
    (25000, 60.0, 4, True, 15, 1), (250000, 5.0, 5, False, 7, 3), (500, 200.0, 50, False, 15, 4),
    (500, 200.0, 1, False, 0, None), (25000, None, 4, True, 0, None), (60000, 85.0, 2, False, 15, 2),
])
def test_avatar(spark, pop, km, stores, shop, points, who):
    df = spark.createDataFrame([(pop, km, stores, shop)], "p int, k double, n int, s boolean")
    hits = df.withColumn("h", rules.avatar_hits(C("p"), C("k"), C("n"), C("s"), defaults.AVATARS))
    best = rules.best_avatar(C("h"), defaults.AVATARS, _RULES["encaje_avatar"]["valores"])
    got = hits.select(best.alias("b")).first()["b"]
    assert (got["puntos"], got["id"]) == (points, who)


@pytest.mark.parametrize("category, want", [
    ("zapaterías", "shoe_store"), ("Tiendas de ropa", "clothing_store"),
    ("Tiendas de deportes", "sporting_goods_store"), ("Tiendas de niños", "clothing_store"),
    ("restaurantes", "restaurant"), ("cosa rara sin tipo", None), ("Barbería", "bar"), (None, None),
])
def test_guess_type(one, category, want):
    assert one(rules.guess_type(C("x")), x=category) == want
