import json
import time

from pyspark.sql import functions as F

from vitrina import defaults, model
from vitrina.functions import geo
from vitrina.operators import grid
from vitrina.operators.contact import latest_lookup
from vitrina.operators.usage import monthly_usage
from vitrina.sources import config, ledgers, listings, pages, responses
from vitrina.streaming.append import append_deduped, stored
from vitrina.streaming.logs import current_counters, read_log_stream, start_counters


def test_listing_files_keep_odd_texts(spark, tmp_path):
    odd = ['say "hi", ok', "two\nlines", "back\\slash", "", " pad ", "ñ“", '"']
    rows = [tuple(odd[(i + j) % len(odd)] for j in range(12)) for i in range(7)]
    df = spark.createDataFrame(rows, model.LISTING)
    listings.write_listings(df, str(tmp_path / "out"))
    back = listings.read_listings(spark, str(tmp_path / "out"))
    assert back.columns == model.LISTING_COLUMNS
    assert sorted(map(tuple, back.collect())) == sorted(rows)


def test_listing_file_of_an_older_layout(spark, tmp_path):
    (tmp_path / "a.csv").write_text('nombre,web,telefono\n"A ""x"", y",w,1\nB,,2\n', encoding="utf-8")
    (tmp_path / "b ñ%20.csv").write_text("nombre,web,telefono\nC,z,\n", encoding="utf-8")
    got = listings.read_listings(spark, str(tmp_path), ordered=True).orderBy("seq").collect()
    assert [(r["nombre"], r["web"], r["telefono"], r["lat"]) for r in got] == [
        ('A "x", y', "w", "1", ""), ("B", "", "2", ""), ("C", "z", "", "")]


def test_listing_files_of_two_layouts(spark, tmp_path):
    (tmp_path / "a.csv").write_text("nombre,web\nA,w\n", encoding="utf-8")
    (tmp_path / "b.csv").write_text("telefono,nombre,extra,web\n1,B,e,\n2,C,,v\n", encoding="utf-8")
    got = listings.read_listings(spark, str(tmp_path), ordered=True).orderBy("seq").collect()
    assert [(r["nombre"], r["web"], r["telefono"], r["extra"]) for r in got] == [
        ("A", "w", "", ""), ("B", "", "1", "e"), ("C", "v", "2", "")]


def test_ordered_parquet_listings(spark, tmp_path):
    path = str(tmp_path / "l.parquet")
    rows = [(f"n{i}", "w") for i in range(50)]
    spark.createDataFrame(rows, "nombre string, web string").coalesce(1).write.parquet(path)
    got = listings.read_listings(spark, path, ordered=True, format="parquet").orderBy("seq").collect()
    assert [r["nombre"] for r in got] == [r[0] for r in rows] and got[0]["lat"] == ""


def test_analysis_output(spark, tmp_path):
    df = spark.createDataFrame([tuple("abcdefghijkl")], model.LISTING)
    listings.write_analysis(df, df.withColumn("puntuacion", F.lit(3)), str(tmp_path))
    assert spark.read.parquet(str(tmp_path / "original")).columns == model.LISTING_COLUMNS
    scored = spark.read.parquet(str(tmp_path / "analysis")).columns
    assert scored == ["nombre", "telefono", "direccion", "web", "categoria", "municipio_origen", "puntuacion"]


def test_places(spark, tmp_path):
    places = [
        {"displayName": {"text": "Calzados Mara"}, "formattedAddress": "Rúa X, Ferrol",
         "internationalPhoneNumber": "+34 981 00 00 00", "rating": 4.0, "googleMapsUri": "https://m/?cid=7"},
        {"displayName": {"text": "Y"}, "nationalPhoneNumber": "981", "internationalPhoneNumber": "+34",
         "location": {"latitude": 43.56, "longitude": -7.25}}]
    document = {"query": "q", "municipio_origen": "Foz", "retrieved_at_utc": "t", "places": places}
    (tmp_path / "r.json").write_text(json.dumps(document) + "\n" + json.dumps({"query": "none"}), encoding="utf-8")
    a, b = responses.read_places(spark, str(tmp_path)).collect()
    assert (a["telefono"], a["rating"], a["categoria"], a["lat"]) == ("+34 981 00 00 00", "4.0", "", "")
    assert (b["telefono"], b["lat"], b["lon"], b["source_query"]) == ("981", "43.56", "-7.25", "q")


def test_searches(spark, tmp_path):
    one = {"nombre": "A", "municipio": "B", "cost": 0.01,
           "tasks": [{"cost": 0.002, "result": [{"items": [{"type": "organic", "title": "t"}]}]}]}
    two = {"nombre": "C", "municipio": "D", "cost": 0.01, "tasks": [{"result": None}]}
    (tmp_path / "r.json").write_text(json.dumps(one) + "\n" + json.dumps(two), encoding="utf-8")
    a, b = responses.read_searches(spark, str(tmp_path)).orderBy("nombre").collect()
    assert (a["cost"], a["items"][0]["title"]) == (0.002, "t")
    assert (b["cost"], b["items"]) == (0.01, [])


def test_outlines(spark, tmp_path):
    square = [[[0, 0], [0.06, 0], [0.06, 0.06], [0, 0.06], [0, 0]],
              [[0.02, 0.02], [0.04, 0.02], [0.04, 0.04], [0.02, 0.04], [0.02, 0.02]]]
    island = [[[0.08, 0], [0.1, 0], [0.1, 0.02], [0.08, 0.02], [0.08, 0]]]
    box = ["0.0", "0.06", "0.0", "0.1"]
    rows = [{"place": "p", "boundingbox": box, "geojson": {"type": "Polygon", "coordinates": square}},
            {"place": "m", "boundingbox": box, "geojson": {"type": "MultiPolygon", "coordinates": [square, island]}},
            {"place": "none", "boundingbox": box}]
    (tmp_path / "o.json").write_text("\n".join(map(json.dumps, rows)), encoding="utf-8")
    cells = grid.grid_cells(responses.read_outlines(spark, str(tmp_path)), edges="edges")
    counts = {r["place"]: r["count"] for r in cells.groupBy("place").count().collect()}
    assert counts == {"p": 32, "m": 36, "none": 60}


def test_outline_of_points(spark):
    ring = geo.literal_edges([[(0, 0), (4, 0), (4, 4), (0, 4)]])
    points = spark.createDataFrame([(1.0, 1.0), (5.0, 1.0), (1.0, -1.0)], "lat double, lon double")
    assert grid.within_outline(points, ring).count() == 1


def test_zones(spark):
    df = spark.createDataFrame([('[{"lat": 1.5, "lon": 2}, {"lat": 3, "lon": 4, "zoom": 16}]',)], "z string")
    assert [tuple(r) for r in responses.zones(df, "z").collect()] == [(1.5, 2.0, 14, 0.01), (3.0, 4.0, 16, 0.01)]


def test_rule_files(spark, tmp_path):
    def write(name, content):
        (tmp_path / name).write_text(json.dumps(content, indent=1), encoding="utf-8")
        return str(tmp_path / name)

    assert config.load_brands(spark, write("b.json", {"brands": ["ZARA", "MANGO"]})) == ["ZARA", "MANGO"]
    assert config.load_brands(spark, write("e.json", {})) == []
    assert config.load_weights(spark, write("w.json", defaults.WEIGHTS)) == defaults.WEIGHTS
    assert config.load_avatars(spark, write("a.json", {"avatares": defaults.AVATARS})) == defaults.AVATARS
    assert config.load_pricing(spark, write("p.json", defaults.PRICING)) == defaults.PRICING
    site = {"ciudad": "Vigo", "nombre": "x", "lat": 1.0, "lon": 2.0}
    assert config.load_sites(spark, write("s.json", {"centros": [site]})) == [site]
    town = {"nombre": "Vigo", "provincia": "P", "poblacion": 5}
    towns = config.read_towns(spark, write("t.json", {"G": {"provincias": ["P"], "municipios": [town, town]}}))
    assert [tuple(r)[:4] for r in towns.orderBy("pos").collect()] == [("G", "P", "Vigo", 5)] * 2


def test_detail_page(spark):
    html = """<div><h1>Ferretería <i>Loureiro</i> e Fillos</h1><p>
      <button data-item-id="phone:1">+34 986 12 34 56</button>
      <button data-item-id="address">Praza do Sol 3,\n Lalín</button>
      <a data-item-id="authority" href="https://loureiro.example">Web</a>
      <div role="img" aria-label="4,2 estrellas"></div>
      <button jsaction="pane.rating.category">Ferretería</button></div>"""
    bare = '<h1>B</h1><span aria-hidden="true">x</span><span aria-hidden="true">3,5</span><p>(981) 22-33-44 55'
    df = spark.createDataFrame([("u1", html), ("u2", bare), ("u3", None)], "url string, html string")
    got = {r["maps_url"]: r for r in pages.listings_from_detail_pages(df, F.lit("q"), F.lit("t")).collect()}
    a = got["u1"]
    assert (a["nombre"], a["telefono"], a["direccion"]) == ("Ferretería Loureiro e Fillos", "+34 986 12 34 56", "Praza do Sol 3, Lalín")
    assert (a["web"], a["rating"], a["categoria"]) == ("https://loureiro.example", "4.2", "Ferretería")
    assert (got["u2"]["rating"], got["u2"]["telefono"]) == ("3.5", "981) 22-33-44 55")
    assert got["u3"]["nombre"] == ""


def test_detail_page_of_open_paragraphs_is_read_in_linear_time():
    start = time.perf_counter()
    page = pages._detail("u", "<h1>N</h1>" + "<p>x" * 100_000 + "</b>" * 100_000)
    assert page[1] == "N" and time.perf_counter() - start < 5


def test_detail_page_passes_its_town_and_order_on(spark):
    df = spark.createDataFrame([(4, "u1", "<h1>A</h1>", "Lugo")], "n long, url string, html string, town string")
    row = pages.listings_from_detail_pages(df, F.concat(F.lit("q"), "town"), F.lit("t"), F.col("town"), F.col("n")).first()
    assert (row["seq"], row["municipio_origen"], row["source_query"]) == (4, "Lugo", "qLugo")


def test_saved_places_are_numbered_in_file_order(spark, tmp_path):
    for name, shops in (("b.json", ["C", "D"]), ("a.json", ["A", "B"])):
        lines = [{"query": "q", "municipio_origen": "", "retrieved_at_utc": "t",
                  "places": [{"displayName": {"text": s + n}} for n in "12"]} for s in shops]
        (tmp_path / name).write_text("\n".join(json.dumps(x) for x in lines))
    got = responses.read_places(spark, str(tmp_path)).orderBy("seq")
    assert [r["nombre"] for r in got.collect()] == ["A1", "A2", "B1", "B2", "C1", "C2", "D1", "D2"]


def test_stream_of_many_files_is_one_pass(spark, tmp_path):
    rows = [(i, None if i % 5 == 0 else f"u{i * 7 % 23}", f"f{i * 11 % 37}") for i in range(120)]
    schema = "seq long, url_key string, fallback_key string"
    seen, want = set(), []
    for seq, url, key in rows:
        if (url and "u" + url in seen) or key in seen:
            continue
        seen |= {"u" + url, key} if url else {key}
        want.append(seq)
    for cap, name in ((0, "all"), (20, "cap")):
        source, out = str(tmp_path / f"in_{name}"), str(tmp_path / f"out_{name}")
        for part in range(4):  # four files, four runs of the stream
            spark.createDataFrame(rows[part * 30:part * 30 + 30], schema).coalesce(1).write.mode("append").parquet(source)
            stream = spark.readStream.schema(schema).parquet(source)
            append_deduped(stream, out, str(tmp_path / f"ck_{name}"), max_records=cap).awaitTermination()
        got = sorted(r["seq"] for r in stored(spark, out, spark.createDataFrame([], schema).schema).collect())
        assert got == (want[:cap] if cap else want)


def test_replayed_batch_writes_the_same_rows(spark, tmp_path):
    from vitrina.streaming.append import append_batch, seed_output

    schema = "seq long, url_key string, fallback_key string"
    first = spark.createDataFrame([(0, "a", "x"), (1, "a", "y")], schema)
    second = spark.createDataFrame([(2, "b", "x"), (3, "b", "z")], schema)
    out = str(tmp_path / "out")
    seed_output(spark.createDataFrame([(-5, "q", "y")], schema), out)
    for n, batch in ((0, first), (1, second), (1, second)):
        append_batch(batch, n, out, "seq", "url_key", "fallback_key")
    assert sorted(r["seq"] for r in stored(spark, out, first.schema).collect()) == [-5, 0, 3]


def test_live_counters(spark, tmp_path):
    lines = [("r", i, f"ASTATS filtered=0 analyzed={i} stores=0 errors=0") for i in range(6)]
    df = spark.createDataFrame(lines, model.LOG_LINES)
    for part in range(3):
        df.where(F.col("line_no") % 3 == part).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    stream = read_log_stream(spark, str(tmp_path / "in"), files_per_batch=1)
    start_counters(stream, str(tmp_path / "live"), str(tmp_path / "ck")).awaitTermination()
    row = current_counters(spark, str(tmp_path / "live")).first()
    assert (row["kind"], row["counters"]["analyzed"]) == ("analysis", "5")


def test_ledgers(spark, tmp_path):
    cache, used = str(tmp_path / "cache"), str(tmp_path / "usage")
    for ts, url in ((1, "a"), (2, "")):
        ledgers.append_cache(spark.createDataFrame([("k", url, ts)], model.LOOKUP_CACHE), cache)
    assert latest_lookup(ledgers.read_cache(spark, cache)).first()["url"] == ""
    (tmp_path / "c.json").write_text(json.dumps({"k|": {"url": "u", "ts": 5}}), encoding="utf-8")
    assert tuple(ledgers.cache_from_json(spark, str(tmp_path / "c.json")).first()) == ("k|", "u", 5)
    row = spark.createDataFrame([(600,)], "requests long").withColumn("run_ts", F.current_timestamp())
    ledgers.append_usage(row, used)
    ledgers.append_usage(row, used)
    assert monthly_usage(ledgers.read_usage(spark, used)).first()["month_requests"] == 1200


def test_history_and_logs(spark, tmp_path):
    runs = [{"job_id": "j1", "city": "Vigo", "started_at": "2026", "status": "done", "valid_count": 4,
             "output": "o", "params": {"a": "b"}, "category": "c"}, {"job_id": "j2"}]
    (tmp_path / "h.json").write_text(json.dumps(runs, indent=1), encoding="utf-8")
    history = ledgers.read_history(spark, str(tmp_path / "h.json"))
    ledgers.write_history(history, str(tmp_path / "saved"))
    back = spark.read.schema(model.RUN_HISTORY).json(str(tmp_path / "saved"))
    assert {r["job_id"]: r["params"] for r in back.collect()} == {"j1": {"a": "b"}, "j2": None}
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs" / "run.1.log").write_text("a\nSTATS discovered=1 processed=1 valid=1 errors=0\nvalid=9\n")
    lines = ledgers.read_run_logs(spark, str(tmp_path / "logs")).orderBy("line_no").collect()
    assert [(r["run"], r["line"]) for r in lines][1:] == [
        ("run.1", "STATS discovered=1 processed=1 valid=1 errors=0"), ("run.1", "valid=9")]


def test_responses_are_parsed_once(spark):
    bodies = ['{"query": "q", "places": [{"displayName": {"text": "A"}}, null, {"rating": 4.5}]}', '{"query": "none", "places": []}', '{"query": "null"}']
    saved = spark.createDataFrame(list(enumerate(bodies)), "line int, body string").select(
        "line", F.from_json("body", model.PLACES_RESPONSE).alias("r")
    ).select("line", "r.*")
    listed = responses.places_to_listings(saved.repartition(2))
    assert listed._jdf.queryExecution().executedPlan().toString().count("from_json(") == 1
    rows = responses.places_to_listings(saved, ["line"]).orderBy("seq").collect()
    assert [(r["nombre"], r["rating"], r["source_query"]) for r in rows] == [("A", "", "q"), ("", "", "q"), ("", "4.5", "q")]
