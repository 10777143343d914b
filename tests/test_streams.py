"""The key store, listing streams and de-duplication with a watermark."""

import random

import pytest
from pyspark.sql import functions as F

from table_queries import QUERIES, streams as table_streams
from vitrina import model
from vitrina.operators.dedup import with_keys
from vitrina.operators.durable import file_system, names_in, new_path
from vitrina.sources.listings import read_listings, write_listings
from vitrina.streaming import keys as key_module
from vitrina.streaming.append import append_batch, append_deduped, key_store, stored
from vitrina.streaming.keys import KeyStore
from vitrina.streaming.listings import append_listings, current_listings
from vitrina.streaming.watermark import first_listings_within

KEYED = "seq long, url_key string, fallback_key string"


def one_by_one(rows):
    seen, kept = set(), []
    for seq, u, f in sorted(rows):
        own = {("u", u)} if u is not None else set()
        own |= {("f", f)} if f is not None else set()
        if not own & seen:
            kept.append(seq)
            seen |= own
    return kept


def files_below(spark, path):
    system, where = file_system(spark, path)
    listed, found = system.listFiles(where, True), {}
    while listed.hasNext():
        f = listed.next()
        if f.getPath().getName().startswith("part-"):
            found[f.getPath().toString()] = f.getModificationTime()
    return found


def test_a_batch_reads_only_its_buckets(spark, monkeypatch):
    """Fifty batches: what is known is right, and what a batch reads does not grow with the store."""
    read = {}
    plain = KeyStore._read

    def counted(self, touched, batch_id):
        table = plain(self, touched, batch_id)
        read[batch_id] = 0 if table is None else table.count()
        return table

    monkeypatch.setattr(KeyStore, "_read", counted)
    store = KeyStore(spark, new_path(spark, "store"), per_bucket=2)
    rng, have = random.Random(3), set()
    for batch in range(50):
        new = {f"u{rng.randrange(10**9)}" for _ in range(20)} - have
        if batch % 10 == 9:
            # Few keys are asked for, many are stored.
            asked = set(rng.sample(sorted(have), 4)) | set(rng.sample(sorted(new), 2))
            found = store.known(spark.createDataFrame([(k,) for k in asked], "key string"), batch)
            assert {r["key"] for r in found.collect()} == asked & have
        store.add(batch, spark.createDataFrame([(k,) for k in new], "key string").coalesce(1), 20, 20)
        have |= new
    state = store.before(50)
    assert state.keys == len(have) and state.rows == state.seen == 1_000
    assert 2 << (state.bits - 1) < len(have) <= 2 << state.bits
    # At most the six touched buckets of each number of bits in use.
    assert read[49] <= 6 * 4 * (state.bits - key_module.FIRST_BITS + 1) < len(have) / 5
    assert read[49] < 2 * read[19] + 20


def test_replayed_batches_write_the_same(spark):
    out = new_path(spark, "replayed")
    rows = [(0, "a", "x"), (1, None, "y"), (2, "a", "z")], [(3, "b", "x"), (4, "c", "w"), (5, None, "y"), (6, None, "q")]
    frames = [spark.createDataFrame(r, KEYED) for r in rows]

    def run(n):
        append_batch(frames[n], n, out, "seq", "url_key", "fallback_key", per_bucket=1)

    def now():
        return sorted(r["seq"] for r in stored(spark, out, frames[0].schema).collect())

    run(0)
    run(0)
    run(1)
    after = now()
    state = key_store(spark, out, 1).before(2)
    run(1)
    assert now() == after == one_by_one(rows[0] + rows[1])
    assert key_store(spark, out, 1).before(2) == state
    # An attempt that stopped before its totals: the batch runs again from the totals before.
    system, where = file_system(spark, f"{out}.state/log/1.json")
    system.delete(where, True)
    assert key_store(spark, out, 1).before(2).rows == key_store(spark, out, 1).before(1).rows == 2
    run(1)
    assert now() == after and key_store(spark, out, 1).before(2) == state


def test_stream_of_random_keys_with_tiny_buckets(spark, tmp_path):
    rng = random.Random(8)
    rows = [(i, rng.choice([None, f"u{rng.randrange(25)}"]), f"f{rng.randrange(30)}") for i in range(120)]
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for part in range(4):
        spark.createDataFrame(rows[part * 30 : part * 30 + 30], KEYED).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(KEYED).parquet(source)
        append_deduped(stream, out, str(tmp_path / "ck"), per_bucket=2).awaitTermination()
    assert sorted(r["seq"] for r in stored(spark, out, stream.schema).collect()) == one_by_one(rows)


def listing(name, link="", place="", phone=""):
    return {"nombre": name, "maps_url": link, "direccion": place, "telefono": phone}


def write_csv(spark, rows, path, columns=model.LISTING_COLUMNS):
    ordered = [tuple(r.get(c, "") for c in columns) for r in rows]
    frame = spark.createDataFrame(ordered, ", ".join(f"`{c}` string" for c in columns)).coalesce(1)
    frame.write.mode("append").options(header=True, quote='"', escape='"', emptyValue="").csv(path)


def test_listing_files_to_an_output_that_is_resumed(spark, tmp_path):
    folder, earlier, out = (str(tmp_path / n) for n in ("in", "earlier", "out"))
    before = [listing("Old one", "https://m/1?x"), listing('Quoted "two"\nlines', "", "Street, 1"), listing("Old one", "https://m/1?y")]
    columns = ", ".join(f"{c} string" for c in model.LISTING_COLUMNS)
    write_listings(spark.createDataFrame([tuple(r.get(c, "") for c in model.LISTING_COLUMNS) for r in before], columns).coalesce(1), earlier)
    batches = [
        [listing("New", "https://m/2"), listing("old ONE"), listing("Other", "https://m/1"), listing("Comma, shop", "", "a")],
        [listing("new again", "https://m/2?z"), listing('quoted "TWO"\nlines', "https://m/7", "street, 1"), listing("Last", "https://m/8")],
        [],
        [listing("More", "https://m/9"), listing("Beyond", "https://m/10")],
    ]
    for rows in batches:
        if rows:
            write_csv(spark, rows, folder)
        append_listings(spark, folder, out, str(tmp_path / "ck"), resume_from=earlier, max_records=7, files_per_batch=1).awaitTermination()
    got = current_listings(spark, out).orderBy("seq")
    assert got.columns == ["seq", *model.LISTING_COLUMNS]
    names = [r["nombre"] for r in got.collect()]
    # The earlier rows as they were, then the first new ones in order of arrival up to the limit.
    assert names == ["Old one", 'Quoted "two"\nlines', "Old one", "New", "Comma, shop", "Last", "More"]
    assert [r["seq"] for r in got.collect()][3:] == [3, 6, 9, 10]


def test_listing_files_of_another_layout_fail(spark, tmp_path):
    folder = str(tmp_path / "in")
    write_csv(spark, [listing("A", "https://m/1")], folder, ["maps_url", "nombre"])
    query = append_listings(spark, folder, str(tmp_path / "out"), str(tmp_path / "ck"), ["nombre", "maps_url"])
    with pytest.raises(Exception, match="(?i)header"):
        query.awaitTermination()


def test_extra_columns_and_rows_in_file_order(spark, tmp_path):
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    names = ["nombre", "maps_url", "size"]
    write_csv(spark, [listing(f"S{i}", f"https://m/{i}") | {"size": str(i)} for i in range(40)], folder, names)
    append_listings(spark, folder, out, str(tmp_path / "ck"), names).awaitTermination()
    got = current_listings(spark, out, names).orderBy("seq").collect()
    assert [(r["seq"], r["nombre"], r["size"]) for r in got] == [(i, f"S{i}", str(i)) for i in range(40)]
    plain = with_keys(read_listings(spark, folder, ordered=True)).orderBy("seq").collect()
    assert [r["nombre"] for r in plain] == [r["nombre"] for r in got]


def test_first_listings_within_a_watermark(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "n int, maps_url string, nombre string, direccion string, telefono string, at timestamp"
    batches = [
        [(0, "https://m/1?cid=1", "a", "", "", "2024-01-01 00:00:00"), (1, "", "Shop", "s", "", "2024-01-01 00:00:00")],
        # The same link and the same row again; another cid is another listing.
        [(2, " https://m/1?cid=1", "b", "", "", "2024-01-01 05:00:00"), (3, "https://m/1?cid=2", "a", "", "", "2024-01-01 05:00:00"),
         (4, None, "SHOP", "S", "", "2024-01-02 06:00:00")],
        # Late: the watermark is at 06:00 of the first day.
        [(5, "https://m/late", "", "", "", "2024-01-01 05:00:00"), (6, "https://m/5", "", "", "", "2024-01-05 00:00:00")],
        # Forgotten by now, so the link is new again.
        [(7, "https://m/1?cid=1", "a", "", "", "2024-01-05 00:00:00")],
    ]
    for rows in batches:
        frame = spark.createDataFrame(rows, schema.replace("at timestamp", "at string"))
        frame.withColumn("at", F.to_timestamp("at")).coalesce(1).write.mode("append").parquet(source)
        stream = first_listings_within(spark.readStream.schema(schema).parquet(source), "at", "1 day")
        (
            stream.writeStream.option("checkpointLocation", str(tmp_path / "ck")).option("path", out)
            .trigger(availableNow=True).start().awaitTermination()
        )
    assert sorted(r["n"] for r in spark.read.parquet(out).collect()) == [0, 1, 3, 6, 7]


def test_listing_parts_in_several_files_arrive_in_order(spark, tmp_path, monkeypatch):
    spark.range(3000).selectExpr("id * 7 AS o_orderkey").write.parquet(f"{tmp_path}/orders.parquet")
    query = QUERIES["stream_of_listing_files"]
    whole = sorted(tuple(r) for r in query(spark, str(tmp_path)).collect())
    written = []
    new_path = table_streams.new_path
    monkeypatch.setattr(table_streams, "new_path", lambda s, label: written.append(new_path(s, label)) or written[-1])
    monkeypatch.setattr(table_streams, "_FILE_ROWS", 150, raising=False)
    assert sorted(tuple(r) for r in query(spark, str(tmp_path)).collect()) == whole
    folder = next(p for p in written if "listing-files" in p)
    assert len(names_in(spark, folder)) > 12
