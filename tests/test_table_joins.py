"""Joins with tables of sites, needles, bands and outlines against plain loops."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vitrina.functions.rules import band as band_rule
from vitrina.functions.rules import guess_type
from vitrina.operators.brands import names_brand
from vitrina.operators.contains import exclude_by_table, first_contained, guess_type_by_table
from vitrina.operators import nearest, outlines as outline_module, slabs
from vitrina.operators.nearest import nearest_in_table
from vitrina.operators.outlines import count_in_outlines, points_in_outlines
from vitrina.operators.ranges import first_band


def km(lat1, lon1, lat2, lon2):
    lat1, lon1, lat2, lon2 = (np.radians(v) for v in (lat1, lon1, lat2, lon2))
    a = np.sin((lat2 - lat1) / 2) ** 2 + np.cos(lat1) * np.cos(lat2) * np.sin((lon2 - lon1) / 2) ** 2
    return 2 * 6371.0 * np.arcsin(np.sqrt(np.minimum(1.0, a)))


def test_nearest_of_a_hundred_thousand_sites(spark):
    rng = np.random.default_rng(4)
    n = 100_000
    # A third in one town, some at equal places, the others all over the earth.
    lat = np.concatenate((40 + rng.normal(0, 0.02, n // 3), rng.uniform(-90, 90, n - n // 3)))
    lon = np.concatenate((-3.7 + rng.normal(0, 0.02, n // 3), rng.uniform(-180, 180, n - n // 3)))
    lat[-100:], lon[-100:] = lat[:100], lon[:100]
    pos = rng.permutation(n)
    sites = spark.createDataFrame(
        list(zip(pos.tolist(), [f"s{p}" for p in pos], lat.tolist(), lon.tolist())), "pos long, site string, lat double, lon double"
    )
    points = [(40 + d, -3.7 - d) for d in rng.normal(0, 0.03, 60)] + [(p, q) for p, q in zip(rng.uniform(-90, 90, 60), rng.uniform(-180, 180, 60))]
    points += [(90.0, 0.0), (-90.0, 77.0), (0.0, 180.0), (0.0, -180.0), (12.0, 179.999), (float(lat[5]), float(lon[5])), (float(lat[-7]), float(lon[-7]))]
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(points + points[:9])] + [(900, None, 1.0), (901, 1.0, None)]
    frame = spark.createDataFrame(rows, "k int, lat double, lon double")
    got = nearest_in_table(frame, sites)
    assert got.columns == ["k", "lat", "lon", "km", "site"]
    found = {r["k"]: (r["km"], r["site"]) for r in got.collect()}
    assert len(found) == len(rows)
    for k, a, b in rows:
        if a is None or b is None:
            assert found[k] == (None, None)
            continue
        d = km(a, b, lat, lon)
        assert math.isclose(found[k][0], d.min(), rel_tol=1e-9, abs_tol=1e-9)
        near = np.flatnonzero(d <= d.min() + 1e-9)
        assert found[k][1] in {f"s{pos[i]}" for i in near}
        same = near[(lat[near] == lat[near[0]]) & (lon[near] == lon[near[0]])]
        if len(same) == len(near):
            assert found[k][1] == f"s{pos[same].min()}"


def test_nearest_with_ties_and_without_sites(spark):
    schema = "pos long, site string, lat double, lon double"
    points = spark.createDataFrame([(1, 0.0, 0.0), (1, 0.0, 0.0), (2, 60.0, 100.0)], "k int, lat double, lon double")
    sites = spark.createDataFrame([(5, "east", 0.0, 1.0), (3, "west", 0.0, -1.0), (4, "north", 1.0, 0.0), (9, None, None, 0.0)], schema)
    got = [(r["k"], r["site"]) for r in nearest_in_table(points, sites).orderBy("k").collect()]
    assert got[:2] == [(1, "west"), (1, "west")] and got[2] == (2, "north")
    # The other side of the earth, and a site at the very end of an axis.
    far = spark.createDataFrame([(1, 0.3, 179.6), (2, -0.2, -179.9), (3, -45.0, 170.0)], "k int, lat double, lon double")
    alone = spark.createDataFrame([(0, "axis", 0.0, 0.0)], schema)
    assert [r["site"] for r in nearest_in_table(far, alone).collect()] == ["axis"] * 3
    none = nearest_in_table(points, sites.limit(0))
    assert [r["km"] for r in none.collect()] == [None] * 3
    assert nearest_in_table(points.limit(0), sites).count() == 0


def test_places_outside_a_dense_group_meet_few_of_its_sites(spark, monkeypatch):
    rng = np.random.default_rng(5)
    n = 2000
    sites = [(i, f"s{i}", float(a), float(b)) for i, (a, b) in enumerate(zip(40 + rng.normal(0, 0.02, n), -3.7 + rng.normal(0, 0.02, n)))]
    sites += [(n, "far", -50.0, 100.0), (n + 1, "no number", float("nan"), 0.0)]
    places = [(i, float(a), float(b)) for i, (a, b) in enumerate(zip(40 + rng.uniform(0.2, 2, 150), -3.7 + rng.uniform(-2, 2, 150)))]
    places += [(900, -49.0, 99.0), (901, float("nan"), 1.0)]
    met = spark.sparkContext.accumulator(0)
    plain = nearest.haversine_km

    @F.udf("double")
    def counted(value):
        met.add(1)
        return value

    monkeypatch.setattr(nearest, "haversine_km", lambda *places: counted(plain(*places)))
    frame = spark.createDataFrame(places, "k int, lat double, lon double")
    found = {r["k"]: (r["km"], r["site"]) for r in nearest_in_table(frame, spark.createDataFrame(
        sites, "pos long, site string, lat double, lon double")).collect()}
    lat, lon = (np.array([s[i] for s in sites[:-1]]) for i in (2, 3))
    for k, a, b in places[:-1]:
        d = km(a, b, lat, lon)
        assert math.isclose(found[k][0], d.min(), rel_tol=1e-9) and found[k][1] == sites[int(d.argmin())][1]
    assert math.isnan(found[901][0]) and found[901][1] == "s0"
    # Asked of each place and site at most a few times over, as expressions may be computed twice.
    assert met.value <= 4 * nearest.AT_ONCE * len(places)


def test_needles_in_a_table_equal_the_list_forms(spark):
    rng = random.Random(7)
    def word(n):
        return "".join(rng.choice("abcdeÑ ") for _ in range(n))
    brands = [word(rng.randrange(1, 7)) for _ in range(300)] + ["", "  ", "AB", "ñ", "abcde", "a.c", "(b"]
    names = [word(rng.randrange(0, 25)).title() for _ in range(400)] + ["", None, "Ñ", "xABCDEx", "hot"] + ["hot"] * 200
    rows = spark.createDataFrame(list(enumerate(names)), "k int, nombre string")
    table = spark.createDataFrame([(b,) for b in brands + [None]], "brand string")
    long_ones = [b for b in brands if len(b.strip()) > 3 or not b.strip()]
    for some in (brands, long_ones):
        kept = exclude_by_table(rows, table.where(F.col("brand").isin(some)))
        want = rows.where(~names_brand(F.col("nombre"), some))
        assert sorted(r["k"] for r in kept.collect()) == sorted(r["k"] for r in want.collect())
    stems = [(b, f"t{i}") for i, b in enumerate(b for b in brands if b.strip())]
    rng.shuffle(stems)
    stem_table = spark.createDataFrame([(i, s.lower(), t) for i, (s, t) in enumerate(stems)], "pos int, stem string, type string")
    got = guess_type_by_table(rows.withColumn("categoria", F.coalesce("nombre", F.lit(""))), stem_table)
    want = rows.select("k", guess_type(F.coalesce("nombre", F.lit("")), [(s.lower(), t) for s, t in stems]).alias("t"))
    assert {r["k"]: r["tipo"] for r in got.collect()} == {r["k"]: r["t"] for r in want.collect()}
    assert first_contained(rows, stem_table.limit(0).withColumnRenamed("stem", "needle"), "nombre").where("found is not null").count() == 0


def test_bands_in_a_table_equal_the_list_form(spark):
    rng = random.Random(9)
    for n in (1, 2, 7, 60):
        bands = []
        for i in range(n):
            lo = rng.randrange(0, 50) / 2
            bands.append({"min": lo, "max": lo + rng.choice([0, 0.5, 3, 40, -1]), "puntos": i, "etiqueta": f"b{i}"})
        values = [x / 4 for x in range(-8, 300)] + [None, float("nan"), float("inf"), -0.0, 3.0, 3.0]
        rows = spark.createDataFrame(list(enumerate(values)), "k int, v double").repartition(3)
        table = spark.createDataFrame(
            [(i, b["min"], b["max"], b["puntos"], b["etiqueta"]) for i, b in enumerate(bands)], "pos int, lo double, hi double, puntos int, etiqueta string"
        )
        got = {r["k"]: r["band"] and r["band"]["etiqueta"] for r in first_band(rows, table, "v").collect()}
        want = {r["k"]: r["e"] for r in rows.select("k", band_rule(F.col("v"), bands)["etiqueta"].alias("e")).collect()}
        assert got == {k: None if e == "fuera de banda" else e for k, e in want.items()}
    assert first_band(rows, table.limit(0), "v").where("band is not null").count() == 0


def test_bands_of_several_criteria(spark):
    bands = [("km", 0, 0.0, 10.0, "near"), ("km", 1, 10.0, 50.0, "far"), ("size", 0, 5.0, 20.0, "large"), ("size", 1, 0.0, 30.0, "any"),
             ("km", 2, None, 99.0, "open"), (None, 3, 0.0, 99.0, "none")]
    table = spark.createDataFrame(bands, "criterion string, pos int, lo double, hi double, label string")
    rows = spark.createDataFrame([(c, float(v)) for c in ("km", "size", "other", None) for v in (-1, 0, 5, 10, 25, 40, 60)], "criterion string, v double")
    def plain(c, v):
        fit = [b for b in bands if c is not None and b[0] == c and b[2] is not None and b[2] <= v <= b[3]]
        return min(fit, key=lambda b: b[1])[4] if fit else None
    got = first_band(rows, table, "v", criterion="criterion")
    assert got.count() == rows.count()
    for r in got.collect():
        assert (r["band"] and r["band"]["label"]) == plain(r["criterion"], r["v"])


def ring(rng, x, y, size, n):
    angles = sorted(rng.uniform(0, 2 * math.pi) for _ in range(n))
    return [(x + size * rng.uniform(0.3, 1) * math.cos(a), y + size * rng.uniform(0.3, 1) * math.sin(a)) for a in angles]


def edges_of(rings):
    return [(*a, *b) for r in rings for a, b in zip(r, r[1:] + r[:1])]


@pytest.mark.parametrize("seed", [1, 2])
def test_points_in_many_outlines(spark, seed):
    rng = random.Random(seed)
    outlines = {}
    for i in range(25):
        x, y, size = rng.uniform(-10, 10), rng.uniform(35, 45), 10 ** rng.uniform(-3, 1)
        rings = [ring(rng, x, y, size, rng.randrange(3, 40))]
        if i % 3 == 0:  # a hole, and a part apart
            rings += [ring(rng, x, y, size / 5, 12), ring(rng, x + 3 * size, y, size, 8)]
        outlines[i] = edges_of(rings)
    outlines[100] = edges_of([[(-5.0, 36.0), (5.0, 36.0), (5.0, 44.0), (-5.0, 44.0)]])
    points = [(rng.uniform(-15, 15), rng.uniform(32, 48)) for _ in range(1500)]
    for i in range(25):
        x1, y1, x2, y2 = outlines[i][0]
        points += [(x1 + rng.uniform(-1, 1) * 1e-3, y1 + rng.uniform(-1, 1) * 1e-3) for _ in range(20)] + [((x1 + x2) / 2 + 1e-6, (y1 + y2) / 2)]
    edge = "array<struct<x1:double,y1:double,x2:double,y2:double>>"
    table = spark.createDataFrame(list(outlines.items()) + [(200, []), (201, None)], f"outline int, edges {edge}")
    frame = spark.createDataFrame([(k, y, x) for k, (x, y) in enumerate(points)] + [(-1, None, 1.0)], "k int, lat double, lon double")
    want = set()
    for k, (x, y) in enumerate(points):
        for i, edges in outlines.items():
            odd = sum((y1 > y) != (y2 > y) and x < x1 + (y - y1) * (x2 - x1) / (y2 - y1) for x1, y1, x2, y2 in edges) % 2
            if odd:
                want.add((k, i))
    got = [(r["k"], r["outline"]) for r in points_in_outlines(frame, table).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    counted = {r["outline"]: r["n"] for r in count_in_outlines(frame, table).collect()}
    assert counted[200] == 0 and counted[100] == sum(i == 100 for _, i in want)
    assert points_in_outlines(frame, table.where("outline >= 200")).count() == 0


def test_pairs_of_points_and_outlines_are_not_shuffled(spark):
    square = [(0, 0, 1, 0), (1, 0, 1, 1), (1, 1, 0, 1), (0, 1, 0, 0)]
    outlines = spark.createDataFrame(
        [(i, [tuple(float(v) for v in e) for e in square]) for i in range(50)],
        "outline int, edges array<struct<x1:double, y1:double, x2:double, y2:double>>",
    )
    places = [(0.001 + i / 420, 0.0005 + i % 20 * 0.0005) for i in range(400)] + [(1.5, 0.5), (None, 0.5)]
    points = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(places)], "k int, lat double, lon double")

    def shuffled(df):
        """Rows that exchanges wrote while the result was made."""
        assert df.count() == 400 * 50
        executed = df._jdf.queryExecution()
        df._jdf.collectToPython()
        nodes, total = [executed.executedPlan()], 0
        while nodes:
            node = nodes.pop()
            name = node.getClass().getSimpleName()
            if name == "AdaptiveSparkPlanExec":
                nodes.append(node.executedPlan())
            elif name.endswith("QueryStageExec"):
                nodes.append(node.plan())
            else:
                written = node.metrics().get("shuffleRecordsWritten")
                total += written.get().value() if written.isDefined() else 0
                children = node.children()
                nodes += [children.apply(i) for i in range(children.size())]
        return total

    cells = outline_module._binned(outlines)[1].count()
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        # Rows with a key are shuffled before they meet, what they make is not.
        written = shuffled(points_in_outlines(points, outlines))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert written < cells + 400 * 50 / 2
    counted = count_in_outlines(points, outlines)
    assert {r["n"] for r in counted.collect()} == {400} and counted.count() == 50


def test_strips_of_many_edges_in_outlines(spark):
    rng = random.Random(3)
    turns = [2 * math.pi * i / 3000 for i in range(3000)]
    ring = [((1 + 0.3 * rng.random()) * math.cos(t), (1 + 0.3 * rng.random()) * math.sin(t)) for t in turns]
    edges = [(*a, *b) for a, b in zip(ring, ring[1:] + ring[:1])]
    square = [(-9.0, -9.0, 9.0, -9.0), (9.0, -9.0, 9.0, 9.0), (9.0, 9.0, -9.0, 9.0), (-9.0, 9.0, -9.0, -9.0)]
    outlines = spark.createDataFrame([(1, edges), (2, square), (3, [])], "outline int, edges array<struct<x1:double, y1:double, x2:double, y2:double>>")
    places = [(i, rng.uniform(-1.4, 1.4), rng.uniform(-1.4, 1.4)) for i in range(500)]
    points = spark.createDataFrame(places, "k int, lat double, lon double")

    def within(lat, lon):
        cut = [x1 + (lat - y1) * (x2 - x1) / (y2 - y1) for x1, y1, x2, y2 in edges if (y1 > lat) != (y2 > lat)]
        return sum(lon < x for x in cut) % 2 == 1

    want = {(k, 1) for k, a, b in places if within(a, b)} | {(k, 2) for k, _, _ in places}
    assert outline_module._binned(outlines)[1].where("not whole and edges is null").count() > 0
    got = points_in_outlines(points, outlines).collect()
    assert len(got) == len(want) and {(r["k"], r["outline"]) for r in got} == want
    n = {r["outline"]: r["n"] for r in count_in_outlines(points, outlines).collect()}
    assert n == {1: len(want) - 500, 2: 500, 3: 0}


def plain_counts(places, edges):
    """Points inside each outline, by all pairs."""
    out = {}
    for number, own in edges.items():
        out[number] = sum(
            sum((y1 > y) != (y2 > y) and x < x1 + (y - y1) * (x2 - x1) / (y2 - y1) for x1, y1, x2, y2 in own) % 2 for y, x in places
        )
    return out


def test_counts_in_outlines_test_few_points(monkeypatch):
    """Points far from an outline's edges are counted, not tested."""
    rng = np.random.default_rng(4)
    lat, lon = rng.uniform(0, 1, 2_500), rng.uniform(0, 1, 2_500)
    corners = {i: (rng.uniform(0.3, 0.7, 2), rng.uniform(0.1, 0.3)) for i in range(100)}
    edges = {i: edges_of([[(x - r, y), (x, y + r), (x + r, y), (x, y - r)]]) for i, ((x, y), r) in corners.items()}
    ranges, made = slabs._ranges, []
    monkeypatch.setattr(slabs, "_ranges", lambda starts, sizes: made.append(int(sizes.sum())) or ranges(starts, sizes))
    rows = np.array([(i, *e) for i, own in edges.items() for e in own], dtype=slabs._EDGE)
    numbers, n = slabs.inside_counts(lat, lon, rows, 50)
    assert dict(zip(numbers.tolist(), n.tolist())) == plain_counts(list(zip(lat, lon)), edges)
    assert 0 < sum(made) < 2_500 * 100 / 5


def test_counts_in_outlines_of_crowded_bands(spark, monkeypatch):
    """One latitude with most points, level edges on it, bands that several tasks share, repeated outlines."""
    monkeypatch.setattr(slabs, "SLAB", 4)
    monkeypatch.setattr(slabs, "SLABS", 2)
    monkeypatch.setattr(slabs, "EDGES", 20)
    rng = random.Random(8)
    places = [(0.5, rng.uniform(-1, 1)) for _ in range(300)] + [(rng.uniform(-1, 1), rng.uniform(-1, 1)) for _ in range(300)]
    edges = {i: edges_of([ring(rng, rng.uniform(-1, 1), rng.uniform(-1, 1), 0.6, 9)]) for i in range(30)}
    edges[30] = edges_of([[(-0.9, 0.25), (0.9, 0.25), (0.9, 0.75), (0.0, 0.75), (0.0, 0.625), (-0.9, 0.625)]])
    kind = "outline int, edges array<struct<x1:double,y1:double,x2:double,y2:double>>"
    table = spark.createDataFrame([*edges.items(), (31, edges[30]), (31, edges[30]), (None, edges[30])], kind)
    points = spark.createDataFrame([*places, (None, 0.0), (0.5, float("nan"))], "lat double, lon double").repartition(5)
    got = sorted(((r["outline"], r["n"]) for r in count_in_outlines(points, table).collect()), key=repr)
    # Two equal rows make one outline that is inside nowhere.
    want = [*plain_counts(places, edges).items(), (31, 0), (31, 0), (None, 0)]
    assert got == sorted(want, key=repr)
