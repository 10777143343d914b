"""Reading listing files once, run metrics and summaries, zones, logs of several folders."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from vitrina import model
from vitrina.operators.runs import collection_report, collection_summary
from vitrina.plans.collect import collect_places_run, work_table
from vitrina.sources import ledgers, responses
from vitrina.sources.listings import read_listings


def test_headers_and_rows_in_one_reading(spark, tmp_path):
    (tmp_path / "a.csv").write_text('﻿nombre,"note, long",maps_url\r\n"Quo ""te""\nd","x,y",m1\r\nnombre,"note, long",maps_url\r\nlast,,\r\n', encoding="utf-8")
    (tmp_path / "b.csv").write_text("maps_url,nombre,extra\nm2,two\nm3,three,e,beyond\n", encoding="utf-8")
    (tmp_path / "c.csv").write_text("", encoding="utf-8")
    (tmp_path / "d.csv").write_text("nombre\n", encoding="utf-8")
    got = read_listings(spark, str(tmp_path), ordered=True).orderBy("seq").collect()
    assert [(r["nombre"], r["maps_url"], r["note, long"], r["extra"]) for r in got] == [
        ('Quo "te"\nd', "m1", "x,y", ""), ("nombre", "maps_url", "note, long", ""), ("last", "", "", ""),
        ("two", "m2", "", ""), ("three", "m3", "", "e"),
    ]
    plain = read_listings(spark, str(tmp_path))
    assert plain.columns == [*[c for c in ("nombre", "maps_url")], "extra", "note, long", *[c for c in model.LISTING_COLUMNS if c not in ("nombre", "maps_url")]]
    assert plain.count() == 5
    with pytest.raises(ValueError, match="max_columns"):
        read_listings(spark, str(tmp_path), max_columns=2)


def test_logs_of_the_same_name_in_two_folders(spark, tmp_path):
    for folder, n in (("one", 1), ("two", 2)):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "run+1 a.log").write_text(f"STATS discovered={n} processed=0 valid=0 errors=0\n")
    (tmp_path / "top.v2.log").write_text("x\n")
    (tmp_path / "plain").write_text("y\n")
    lines = ledgers.read_run_logs(spark, str(tmp_path)).collect()
    assert sorted((r["run"], r["line"][:18]) for r in lines) == [
        ("one/run+1 a", "STATS discovered=1"), ("plain", "y"), ("top.v2", "x"), ("two/run+1 a", "STATS discovered=2"),
    ]
    alone = ledgers.read_run_logs(spark, str(tmp_path / "top.v2.log")).collect()
    assert [r["run"] for r in alone] == ["top.v2"]


def test_summaries_with_groups_without_a_value(spark):
    records = spark.createDataFrame(
        [("r1", "A", "x"), ("r1", "A", ""), ("r1", None, "y"), ("r1", None, "y"), ("r2", None, None), ("r2", "B", "z")],
        "run string, town string, nombre string",
    )
    kept = spark.createDataFrame([("r1", "A", "x"), ("r1", None, "y"), ("r2", "B", "z")], records.schema)
    got = {r["town"]: tuple(r)[1:] for r in collection_summary(records, kept, ["town"]).collect()}
    assert got == {"A": (2, 1, 1, 1, 0), None: (3, 2, 1, 1, 1), "B": (1, 1, 0, 1, 0)}
    stops = spark.createDataFrame([("r1", "A"), ("r1", "A"), ("r3", None)], "run string, town string")
    rows = collection_report(records, kept, ["run", "town"], stops)
    assert rows.columns == ["run", "town", "discovered", "processed", "errors", "valid", "heuristic_stops", "duplicates", "level"]
    got = {(r["level"], r["run"], r["town"]): tuple(r)[2:8] for r in rows.collect()}
    assert got == {
        (2, "r1", "A"): (2, 1, 1, 1, 2, 0), (2, "r1", None): (2, 2, 0, 1, 0, 1), (2, "r2", None): (1, 0, 1, 0, 0, 0),
        (2, "r2", "B"): (1, 1, 0, 1, 0, 0), (2, "r3", None): (0, 0, 0, 0, 1, 0),
        (1, "r1", None): (4, 3, 1, 2, 2, 1), (1, "r2", None): (2, 1, 1, 1, 0, 0), (1, "r3", None): (0, 0, 0, 0, 1, 0),
        (0, None, None): (6, 4, 2, 3, 3, 1),
    }
    assert collection_report(records.limit(0), kept.limit(0), ["run"]).count() == 0


@pytest.mark.parametrize("cap,written", [(0, 3), (2, 2), (9, 3)])
def test_a_run_counts_what_it_reads_and_writes(spark, tmp_path, cap, written):
    rows = [(i, f"n{i}", link) for i, link in enumerate(["m?cid=1", "m?cid=2", "m?cid=1", "", "m?cid=2"])]
    columns = {c: F.lit("") for c in model.LISTING_COLUMNS if c not in ("nombre", "maps_url")}
    listings = spark.createDataFrame(rows, "seq long, nombre string, maps_url string").withColumns(columns).repartition(3)
    requests = spark.createDataFrame([("q2", True), ("q1", True), ("q1", False)], "source_query string, answered boolean")
    output, ledger = str(tmp_path / "out"), str(tmp_path / "usage")
    first = collect_places_run(listings, requests, output, ledger, "bares", max_records=cap, now=datetime(2026, 5, 31, 23, 59))
    row = first.first()
    assert (row["category"], row["queries"], row["requests"], row["pages"]) == ("bares", ["q1", "q2"], 3, 2)
    assert (row["results_raw"], row["results_deduped"]) == (5, written) and row["elapsed_s"] >= 0
    assert row["quota"].asDict() == {"month": "2026-05", "run_requests": 3, "month_requests": 3, "free_cap": 1000,
                                     "remaining": 997, "within_free": True, "est_cost_usd": 0.0}
    names = [r["nombre"] for r in read_listings(spark, output).orderBy("nombre").collect()]
    assert names == ["n0", "n1", "n3"][:written]
    saved = json.loads(next((tmp_path / "out.metrics").glob("part-*.json")).read_text())
    assert saved["results_raw"] == 5 and saved["retrieved_at_utc"] == "2026-05-31T23:59:00+00:00"
    again = collect_places_run(listings, requests, output, ledger, "bares", now=datetime(2026, 5, 1)).first()
    assert again["quota"]["month_requests"] == 6
    later = collect_places_run(listings, requests, output, ledger, "bares", now=datetime(2026, 6, 1)).first()
    assert later["quota"]["month_requests"] == 3


def test_zones_set_by_hand_in_the_work_table(spark):
    towns = spark.createDataFrame([("R", "P", "Vigo", 1, 0), ("R", "P", "Lugo", 1, 1), ("R", "P", "Noia", 1, 2)],
                                  "region string, province string, name string, population int, pos int")
    box = "place string, min_lat double, max_lat double, min_lon double, max_lon double, edges array<struct<x1:double,y1:double,x2:double,y2:double>>"
    outlines = spark.createDataFrame([("Vigo, P, España", 42.0, 42.02, -8.02, -8.0, None), ("Lugo, P, España", 43.0, 43.02, -7.02, -7.0, None)], box)
    plain = work_table(towns, outlines, "bares")
    cities = {r["city"]: r["n"] for r in plain.groupBy("city").agg(F.count("*").alias("n")).collect()}
    assert cities == {"Vigo, P, España": 4, "Lugo, P, España": 4}
    listed = spark.createDataFrame([("Vigo, P, España", '[{"lat": 42.1234567, "lon": -8.5, "zoom": 16}, {"lat": 42.5, "lon": -8.6}]'),
                                    ("Noia, P, España", '[{"lat": 42.7, "lon": -8.9}]'), ("Other", '[{"lat": 1.0, "lon": 1.0}]')], "place string, zones string")
    by_hand = work_table(towns, outlines, "bares", zones=responses.zones(listed, "zones"))
    assert by_hand.columns == plain.columns
    got = sorted((r["city"][:4], r["lat"], r["zoom"]) for r in by_hand.collect())
    assert [g for g in got if g[0] != "Lugo"] == [("Noia", 42.7, 14), ("Vigo", 42.1234567, 16), ("Vigo", 42.5, 14)]
    assert sum(g[0] == "Lugo" for g in got) == 4
