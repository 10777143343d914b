import random
import re

import pytest
from pyspark.sql import functions as F

from vitrina import defaults, model
from vitrina.operators import brands, contact, dedup, durable, grid, lookups, nearest, ordering, runs, score, towns, usage
from vitrina.plans.analyse import analyse, analyse_with_handles
from vitrina.plans.collect import clean_listings, collect_pages, collect_places

SITES = [
    {"ciudad": "A Coruña", "lat": 43.3499, "lon": -8.4123},
    {"ciudad": "Vigo", "lat": 42.2333, "lon": -8.7163},
    {"ciudad": "Madrid", "lat": 40.4470, "lon": -3.6906},
]


def listing(seq, **given):
    base = dict.fromkeys(model.LISTING_COLUMNS, "") | {"nombre": "A", "direccion": "Calle 1"}
    return (seq, *(base | given).values())


def listings(spark, *rows):
    return spark.createDataFrame(
        [listing(i, **r) for i, r in enumerate(rows)],
        "seq long, " + ", ".join(f"{c} string" for c in model.LISTING_COLUMNS),
    )


def seqs(df):
    return sorted(r["seq"] for r in df.select("seq").collect())


# Duplicates -----------------------------------------------------------------

def greedy(rows):
    seen, kept = set(), []
    for seq, url, key in rows:
        if (url is not None and ("u", url) in seen) or ("f", key) in seen:
            continue
        if url is not None:
            seen.add(("u", url))
        seen.add(("f", key))
        kept.append(seq)
    return kept


@pytest.mark.parametrize("seed", [7, 8])
def test_two_key_dedup_is_the_sequential_rule(spark, seed):
    rng = random.Random(seed)
    rows = []
    for seq in rng.sample(range(10_000), 600):
        # One url holds a third of all rows, one name another third.
        url = None if rng.random() < 0.2 else "hot" if rng.random() < 0.33 else f"u{rng.randrange(80)}"
        key = "hot" if rng.random() < 0.33 else f"f{rng.randrange(120)}"
        rows.append((seq, url, key))
    df = spark.createDataFrame(rows, "seq long, url_key string, fallback_key string")
    got = dedup.dedup_two_keys(df)
    assert seqs(got) == sorted(greedy(sorted(rows)))


def test_two_key_dedup_of_a_chain(spark):
    rows = [(0, "u1", "f1"), (1, "u2", "f1"), (2, "u2", "f2"), (3, "u3", "f2"), (4, "u3", "f3")]
    df = spark.createDataFrame(rows, "seq long, url_key string, fallback_key string")
    assert seqs(dedup.dedup_two_keys(df)) == [0, 2, 4]


def test_two_key_dedup_of_a_long_chain(spark, monkeypatch):
    # Every pair waits for the one before; doubling settles all of them in one round.
    written = []
    keep = dedup.keep
    monkeypatch.setattr(dedup, "keep", lambda df, label: written.append(label) or keep(df, label))
    df = spark.range(100_000).selectExpr(
        "id AS seq", "string((id + 1) div 2) AS url_key", "string(id div 2) AS fallback_key"
    )
    got = dedup.dedup_two_keys(df).agg(F.count("*"), F.sum("seq"), F.max(F.col("seq") % 2)).first()
    assert tuple(got) == (50_000, sum(range(0, 100_000, 2)), 0)
    assert written.count("ranked") == 1 and written.count("chain") <= 20


def test_two_key_dedup_moves_the_links_of_a_long_chain_few_times(spark, monkeypatch):
    rows = []
    keep = dedup.keep

    def counted(df, label):
        kept = keep(df, label)
        rows.append(kept.count() if label == "chain" else 0)
        return kept

    monkeypatch.setattr(dedup, "keep", counted)
    monkeypatch.setattr(dedup, "DIRECT", 500, raising=False)
    n = 10_000
    # One chain, in an order that has nothing to do with the numbers of its keys, and a few short ones.
    order = random.Random(3).sample(range(n), n)
    chain = [(i, f"u{order[(i + 1) // 2]}", f"f{order[i // 2]}") for i in range(n)]
    short = [(n + i, f"v{(i + i // 5) // 2}", f"g{i}" if i % 5 else f"g{i - 1}") for i in range(200)]
    df = spark.createDataFrame(chain + short, "seq long, url_key string, fallback_key string")
    assert seqs(dedup.dedup_two_keys(df)) == sorted(greedy(chain + short))
    assert sum(rows) < 8 * n


def test_two_key_dedup_of_nothing(spark):
    df = spark.createDataFrame([], "seq long, url_key string, fallback_key string")
    assert seqs(dedup.dedup_two_keys(df)) == []


def test_keys(spark):
    rows = listings(
        spark,
        {"maps_url": "https://m.com/p/abc?hl=es"}, {"maps_url": "https://m.com/p/abc?hl=en", "nombre": "B"},
        {"nombre": "Tienda X", "direccion": " Rua A"}, {"nombre": "tienda x", "direccion": "Rua A "},
    )
    assert seqs(collect_pages(rows)) == [0, 2]
    keyed = dedup.with_keys(rows).collect()
    assert keyed[0]["url_key"] == "https://m.com/p/abc" and keyed[2]["url_key"] is None


def test_places_are_compared_by_full_link(spark):
    rows = listings(spark, *[{"maps_url": f"https://m.com/?cid={i}"} for i in (1, 2, 1)], {}, {})
    assert seqs(collect_places(rows)) == [0, 1, 3]
    assert seqs(collect_places(rows, max_records=2)) == [0, 1]


def test_cap_and_name(spark):
    rows = listings(spark, {"nombre": ""}, *[{"nombre": f" N  {i}"} for i in range(10)])
    assert seqs(collect_pages(rows, max_records=3)) == [1, 2, 3]
    assert len(seqs(collect_pages(rows))) == 10
    assert clean_listings(rows).where("seq = 3").first()["nombre"] == "N 2"


def test_first_n_beyond_the_sorted_limit(spark):
    df = spark.range(30_000).select(((F.col("id") * 7919) % 30_000).alias("k"))
    got = ordering.first_n(df, 12_345, "k").agg(F.count("k"), F.max("k"), F.count_distinct("k")).first()
    assert tuple(got) == (12_345, 12_344, 12_345)


# Look-ups and running values --------------------------------------------------

def test_attach_with_hot_and_null_keys(spark):
    left = spark.range(3000).select(
        "id", F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 7 == 0, None)
        .otherwise((F.col("id") % 900).cast("string")).alias("k"),
        F.create_map(F.lit("a"), "id").alias("m"),
    )
    lookup = spark.createDataFrame([("hot", 1)] + [(str(i), i) for i in range(0, 900, 2)], "k string, v int")
    for threshold in ("-1", "10MB"):
        # Above the planner's threshold hot rows are spread; below it nothing is shuffled.
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        got = lookups.attach(left, lookup, "k")
        assert got.columns == ["id", "k", "m", "v"] and got.count() == 3000
        for r in got.collect():
            if r["k"] is None:
                assert r["v"] is None
            elif r["k"] == "hot":
                assert r["v"] == 1
            else:
                assert r["v"] == (int(r["k"]) if int(r["k"]) % 2 == 0 else None)
    near = lookups.attach(left, durable.keep(lookup, "small"), "k")
    assert near.where("v is not null").count() == got.where("v is not null").count()
    assert "Exchange hashpartitioning" not in near._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    plan = lookups.attach(left, lookup, "k")._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"hashpartitioning\(k#\d+, _to#\d+", plan)  # hot rows are spread
    hot_less = lookups.attach(left, lookup.where("k <> 'hot'"), "k").where("k = 'hot'")
    assert hot_less.where("v is null").count() == 1000
    assert lookups.without(left, lookup, "k").where("k = 'hot'").count() == 0
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_running_values(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice(["big", "big", "a", None]), rng.randrange(5), rng.choice([None, i])) for i in range(500)]
    df = spark.createDataFrame(rows, "n long, g string, v long, w long")
    got = ordering.running(df, ["g"], ["n"], {"s": "v"}, {"l": "w"}, strictly_before=True)
    sums, lasts = {}, {}
    for r in sorted(got.collect(), key=lambda r: r["n"]):
        assert (r["s"], r["l"]) == (sums.get(r["g"], 0), lasts.get(r["g"]))
        sums[r["g"]] = r["s"] + r["v"]
        lasts[r["g"]] = r["w"] if r["w"] is not None else r["l"]


# Brands, sites, score ---------------------------------------------------------

def test_excluded_brands(one):
    test = brands.names_brand
    assert one(test(F.col("x"), ["ZARA", "MANGO"]), x="zara kids")
    assert one(test(F.col("x"), ["Adolfo Dominguez"]), x="Adolfo Dominguez (Santiago)")
    assert not one(test(F.col("x"), ["ZARA", "MANGO"]), x="Tienda de zapatos")
    assert not one(test(F.col("x"), []), x="ZARA") and not one(test(F.col("x"), [" "]), x="a b")
    assert one(test(F.col("x"), ["H&M", "C.A|x", "é (y)"]), x="tienda h&m")
    assert not one(test(F.col("x"), ["C.A"]), x="casa") and one(test(F.col("x"), ["É (y)"]), x="la é (Y)")


def test_store_counts(spark):
    rows = [("Lolitamoda Noia", "Noia"), ("Lolitamoda Boiro", "Boiro"), ("Casais Noia", "Noia"),
            ("Casais Ribeira", "Ribeira"), ("Único Concept Store", "Vigo"), ("Calzados Mara", "Foz"), ("12", "")]
    df = brands.with_brand_key(spark.createDataFrame(rows, "nombre string, municipio_origen string"))
    got = {r["nombre"]: r["num_tiendas"] for r in brands.with_store_count(df).collect()}
    assert got["Lolitamoda Noia"] == 2 and got["Casais Ribeira"] == 2
    assert got["Calzados Mara"] == 1 and got["12"] == 1
    assert brands.distinct_brands(df).first()[0] == 4
    other = spark.createDataFrame([("Lolitamoda Cee", "Cee"), ("Otra", "")], "nombre string, municipio_origen string")
    counted = brands.with_store_count(brands.with_brand_key(other), brands.count_by_brand(df))
    assert {r["nombre"]: r["num_tiendas"] for r in counted.collect()} == {"Lolitamoda Cee": 2, "Otra": 1}


def test_nearest_site_is_that_of_the_full_comparison(spark):
    rng = random.Random(5)
    sites = [{"ciudad": f"c{i}", "lat": rng.uniform(27, 44), "lon": rng.uniform(-18, 5)} for i in range(60)]
    sites += [dict(sites[3], ciudad="twin")]  # same place: the first one wins
    points = [(i, rng.uniform(20, 50), rng.uniform(-30, 15)) for i in range(400)]
    points += [(400, sites[3]["lat"], sites[3]["lon"]), (401, None, 1.0), (402, -60.0, 170.0)]
    df = spark.createDataFrame(points, "id int, lat double, lon double")
    for r in nearest.with_nearest_site(df, sites).collect():
        if r["lat"] is None:
            assert r["km"] is None and r["site"] is None
            continue
        all_km = [float(nearest._km(r["lat"], r["lon"], s["lat"], s["lon"])) for s in sites]
        best = min(range(len(sites)), key=lambda i: all_km[i])
        assert r["site"] == sites[best]["ciudad"] and r["km"] == pytest.approx(all_km[best], abs=1e-9)


def test_full_score(spark):
    rows = [(0, 43.21, -8.69, 31000, 4, "ecommerce_funcional", "WooCommerce"),
            (1, 40.985, -3.690, 25000, 4, "ecommerce_funcional", None),
            (2, None, None, 25000, 4, "ecommerce_funcional", None),
            (3, 43.21, -8.69, 0, 1, "sin_presencia", "Casa")]
    df = spark.createDataFrame(
        rows, "id int, lat double, lon double, poblacion int, num_tiendas int, madurez string, tecnologia string"
    )
    got = {r["id"]: r for r in score.apply_existing_customer(score.score_listings(df, SITES), "Casa").collect()}
    assert (got[0]["puntuacion"], got[0]["prioridad"]) == (75, "P1")
    assert got[0]["justificacion"].startswith("ECI A Coruña a 27.3km [sombra ECI (<30km)=10pts]; pob 31,000 [")
    assert got[1]["prioridad"] == "P1" and got[1]["breakdown"]["avatar"]["valor_avatar_id"] == 1
    assert got[2]["breakdown"]["distancia_eci"]["puntos"] == 0
    assert got[2]["justificacion"].startswith("sin coordenadas (0pts dist); ")
    assert (got[3]["puntuacion"], got[3]["prioridad"]) == (0, "Ya cliente")
    assert got[3]["justificacion"] == "Ya cliente (web hecha con Casa) — sin serlo sería P4"


def test_analysis_of_a_small_table(spark):
    rows = listings(
        spark,
        {"nombre": "Lolita Noia", "municipio_origen": "NOIA ", "web": "shop.es", "maps_url": "x/@43.21,-8.69,1z"},
        {"nombre": "LOLITA NOIA", "municipio_origen": "Noia"},  # the same shop again
        {"nombre": "Lolita Foz", "municipio_origen": "Foz", "web": "https://www.facebook.com/lolita"},
        {"nombre": "Zara Lolita", "web": "http://gone.es"}, {"nombre": "Bar", "web": "http://gone.es"},
    )
    pages = spark.createDataFrame(
        [("https://shop.es", 200, "woocommerce hola@shop.es //instagram.com/lolita"), ("http://gone.es", 404, "x")],
        "url string, status int, html string",
    )
    dim = spark.createDataFrame([("Noia", 14000, 0), ("noia", 1, 1)], "name string, population int, pos int")
    done = analyse(rows, contact.page_features(pages), dim, SITES, ["ZARA"], keep_excluded=True)
    got = {r["nombre"]: r for r in done.collect()}
    assert sorted(got) == ["Bar", "Lolita Foz", "Lolita Noia", "Zara Lolita"]
    first = got["Lolita Noia"]
    assert (first["es_tienda"], first["tecnologia"], first["poblacion"]) == ("Sí", "WooCommerce", 14000)
    assert (first["num_tiendas"], first["email"], first["lat"]) == (2, "hola@shop.es", "")
    assert (got["Lolita Foz"]["es_tienda"], got["Lolita Foz"]["page_error"]) == ("-", False)
    assert got["Bar"]["page_error"] and got["Bar"]["email"] == "vmarketing@bar.com"
    assert got["Zara Lolita"]["excluded"] and not got["Bar"]["excluded"]
    cache = spark.createDataFrame(
        [("bar|", "https://instagram.com/old", 1), ("bar|", "", 2)], "key string, url string, ts long"
    )
    item = [("organic", "Lolita (@lolita_foz)", None, None)]
    searches = spark.createDataFrame(
        [("lolita foz|foz", item, 0.002), ("zara lolita|", item, 0.002)],
        "key string, items array<struct<type:string,title:string,url:string,breadcrumb:string>>, cost double",
    )
    out = {r["nombre"]: r for r in analyse_with_handles(done, cache, searches, 0.003).collect()}
    assert (out["Lolita Noia"]["instagram"], out["Lolita Noia"]["instagram_fuente"]) == (
        "https://instagram.com/lolita", "web")
    assert (out["Lolita Foz"]["instagram"], out["Lolita Foz"]["instagram_fuente"]) == (
        "https://instagram.com/lolita_foz", "dataforseo")
    assert (out["Bar"]["instagram"], out["Bar"]["instagram_fuente"]) == ("", "-")
    assert out["Zara Lolita"]["instagram_fuente"] == "-"  # the budget is spent


# Budget and usage ---------------------------------------------------------------

def sequential_budget(rows, max_usd):
    """rows of (key, cost) in order; the rule one search at a time."""
    spent, last, cache, states = 0.0, defaults.FIRST_SEARCH_COST, set(), []
    for key, cost in rows:
        if key in cache:
            states.append("repeat")
        elif spent + last > max_usd + 1e-9:
            states.append("refused")
        else:
            states.append("paid")
            spent += cost
            if cost > 0:
                last = cost
                cache.add(key)
    return states


@pytest.mark.parametrize("max_usd", [0.0, 0.05, 0.31, 5.0])
def test_budget_is_the_sequential_rule(spark, max_usd):
    rng = random.Random(11)
    rows = [(f"k{rng.randrange(60)}", rng.choice([0.0, 0.002, 0.01])) for _ in range(300)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "seq long, key string, cost double")
    got = usage.with_budget(df, [], ["seq"], max_usd, key="key").orderBy("seq").collect()
    assert [r["search_state"] for r in got] == sequential_budget(rows, max_usd)


def test_budget_report(spark):
    df = spark.createDataFrame([("r", i, 0.01) for i in range(3)], "run string, seq long, cost double")
    state = usage.with_budget(df, ["run"], ["seq"], 0.01)
    report = usage.budget_report(state, ["run"], ["seq"], 0.01).first()
    assert (report["pending"], report["spent"], report["est"]) == (2, 0.01, 0.02)


def test_usage(spark):
    ledger = spark.createDataFrame(
        [("2026-05-01 10:00:00", 600), ("2026-05-02 10:00:00", 600), ("2026-06-01 10:00:00", 5)],
        "ts string, requests long",
    ).select(F.to_timestamp("ts").alias("run_ts"), "requests")
    rows = usage.running_quota(ledger, ["run_ts"]).orderBy("run_ts").collect()
    assert [(r["month_requests"], r["within_free"], r["remaining"]) for r in rows] == [
        (600, True, 400), (1200, False, 0), (5, True, 995)]
    assert rows[1]["est_cost_usd"] == 7.0
    may = usage.monthly_usage(ledger).where("month = '2026-05'").first()
    assert (may["month_requests"], may["est_cost_usd"]) == (1200, 7.0)
    assert usage.free_cap() == 1000 and usage.free_cap("pro") == 5000


@pytest.mark.parametrize("n, tier, want", [(1000, "enterprise", 0.0), (2000, "enterprise", 35.0),
                                           (6000, "pro", 32.0), (99999, "essentials", 0.0)])
def test_cost(one, n, tier, want):
    assert one(usage.estimate_cost(F.col("n"), tier), n=n) == want


# Grid ---------------------------------------------------------------------------

def running_grid(min_lat, max_lat, min_lon, max_lon, cell=0.01):
    out, lat = set(), min_lat + cell / 2
    while lat <= max_lat:
        lon = min_lon + cell / 2
        while lon <= max_lon:
            out.add((round(lat, 6), round(lon, 6)))
            lon += cell
        lat += cell
    return out


def test_grid(spark):
    rng = random.Random(2)
    boxes = []
    for i in range(40):
        lat, lon = rng.uniform(-40, 40), rng.uniform(-90, 90)
        boxes.append((i, lat, lat + rng.uniform(0, 0.06), lon, lon + rng.uniform(0, 0.06)))
    df = spark.createDataFrame(boxes, "id int, min_lat double, max_lat double, min_lon double, max_lon double")
    got = {}
    for r in grid.grid_cells(df).collect():
        got.setdefault(r["id"], set()).add((r["lat"], r["lon"]))
    for i, *box in boxes:
        assert got.get(i, set()) == running_grid(*box)


def test_subdivision(spark):
    cells = spark.createDataFrame(
        [(40.0, -3.0, 14, 0.01, True), (41.0, -3.0, 16, 0.0025, True), (42.0, 0.0, 16, 0.00125, True),
         (43.0, 0.0, 14, 0.01, False)], "lat double, lon double, zoom int, cell_deg double, full boolean")
    got = grid.subdivide(cells, F.col("full")).orderBy("lat", "part").collect()
    assert len(got) == 8 and {r["zoom"] for r in got if r["lat"] < 41 - 0.1} == {15}
    north_west = next(r for r in got if r["part"] == 0)
    assert (north_west["lat"], north_west["lon"], north_west["cell_deg"]) == (40.0025, -3.0025, 0.005)
    assert {r["zoom"] for r in got if r["lat"] > 40.5} == {16}
    assert grid.heuristic_stops(cells, F.col("full")).count() == 1


def test_dense_cells_hold_every_point_once(spark):
    rng = random.Random(4)
    points = spark.createDataFrame(
        [(40 + rng.random() ** 3 / 20, -4 + rng.random() ** 3 / 20) for _ in range(3000)], "lat double, lon double")
    cells = grid.adaptive_cells(points, limit=50).collect()
    assert sum(r["n"] for r in cells) == 3000
    assert all(r["n"] < 50 for r in cells if r["level"] < 3)
    assert {r["cell_deg"] for r in cells} <= {0.01, 0.005, 0.0025, 0.00125}


# Towns, runs, logs --------------------------------------------------------------

TOWNS = [("Galicia", "Pontevedra", "Vigo", 293642, 0), ("Galicia", "A Coruña", "Aldea", 1200, 1),
         ("Galicia", "A Coruña", "Carballo", 31370, 2), ("Cataluña", "Barcelona", "Barcelona", 1620343, 3),
         ("Cataluña", "Lleida", "Vigo", 9, 4)]


def town_table(spark):
    return spark.createDataFrame(TOWNS, "region string, province string, name string, population int, pos int")


def test_towns(spark, monkeypatch):
    dim = town_table(spark)
    assert [r[0] for r in towns.regions(dim).collect()] == ["Cataluña", "Galicia"]
    assert [r["name"] for r in towns.region_towns(dim, "Galicia", 5000).collect()] == ["Carballo", "Vigo"]
    with pytest.raises(KeyError):
        towns.region_towns(dim, "Cantabria", 5000)
    rows = spark.createDataFrame([(" vigo",), ("BARCELONA",), ("Inventado",), ("",)], "municipio_origen string")
    got = {r["municipio_origen"]: r["poblacion"] for r in towns.town_population(rows, dim).collect()}
    assert got == {" vigo": 293642, "BARCELONA": 1620343, "Inventado": 0, "": 0}
    target = towns.search_targets(dim.where("pos = 0"), "bares").first()
    assert (target["city"], target["source_query"]) == ("Vigo, Pontevedra, España", "bares en Vigo, Pontevedra")
    done = spark.createDataFrame([("VIGO ",), ("",)], "municipio_origen string")
    assert {r["name"] for r in towns.skip_processed(dim, done).collect()} == {"Aldea", "Carballo", "Barcelona"}
    ranked = {(r["region"], r["name"]): r["place"] for r in towns.towns_by_region(dim).collect()}
    assert ranked[("Galicia", "Carballo")] == 2 and ranked[("Cataluña", "Vigo")] == 2
    asked = spark.createDataFrame([(n,) for n in (0, 1, 20, 21, 60, 500)], "n int")
    assert [r[0] for r in asked.select(towns.pages_for(F.col("n"))).collect()] == [3, 1, 1, 2, 3, 3]


def test_runs(spark):
    history = spark.createDataFrame(
        [("a", "Madrid", "bares", "2026-03-25", "done", 42, 1, {}), ("b", "Galicia", "x", "", "running", 3, 2, None),
         ("c", "galicia ", "ropa", "2026-03-26", "running", 3, 9, None)],
        "job_id string, city string, category string, started_at string, status string, valid_count long, "
        "pid long, params map<string,string>")
    counts = spark.createDataFrame([("a", 7), ("c", 8)], "job_id string, real_count long")
    alive = spark.createDataFrame([(9,)], "pid long")
    got = {r["job_id"]: r for r in runs.reconcile_runs(history, counts, alive).collect()}
    assert (got["a"]["valid_count"], got["b"]["status"], got["b"]["pid"]) == (7, "stopped", None)
    assert (got["c"]["status"], got["c"]["valid_count"]) == ("running", 3)
    assert [r["job_id"] for r in runs.newest_first(history, "started_at").collect()] == ["c", "a"]
    regions = spark.createDataFrame([("Galicia",)], "region string")
    params = {r["job_id"]: r["params"] for r in runs.infer_region(history, regions).collect()}
    assert params["c"] == {"comunidad": "galicia", "category": "ropa"} and not params["a"]
    ended = spark.createDataFrame(
        [("a", "running", 1), ("b", "running", 1), ("c", "stopped", 0), ("d", "running", 0)],
        "job_id string, status string, exit_code int")
    out = {r["job_id"]: r["status"] for r in runs.run_outcome(ended, counts).collect()}
    assert out == {"a": "partial", "b": "error", "c": "stopped", "d": "done"}


def test_log_lines(spark):
    rows = ["INFO STATS discovered=9 processed=8 valid=7 errors=0", "noise", "ASTATS filtered=1 analyzed=2 stores=3 errors=4",
            "discover=10 processed=9 valid=8 duplicates=1 errors=2 elapsed_s=1.00",
            "APISTATS run_requests=3 month_requests=4 free_cap=1000 remaining=996 within_free=true est_cost_usd=0.00",
            "IGBUDGET spent=0.99 cap=1.00 pending=5 est=0.01"]
    lines = spark.createDataFrame([("r", i, t) for i, t in enumerate(rows)], "run string, line_no long, line string")
    got = {r["kind"]: r["counters"] for r in runs.latest_counters(runs.parse_log_lines(lines)).collect()}
    assert got["stats"] == {"discovered": "10", "processed": "9", "valid": "8", "errors": "2"}
    assert got["analysis"]["stores"] == "3" and got["api"]["within_free"] == "true"
    assert got["budget"] == {"spent": "0.99", "cap": "1.00", "pending": "5", "est": "0.01"}
    assert runs.latest_valid(lines).first()["valid"] == 8
