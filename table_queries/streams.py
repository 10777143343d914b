"""Streams over the events table, run until they have read it all."""

import time

from pyspark.sql import functions as F

from table_queries.collection import EVENT_PAIRS, event_keys, two_keys_sql
from table_queries.operations import _LOG_SQL, log_lines
from table_queries.registry import query
from table_queries.shops import table
from vitrina.operators.dedup import first_per_key
from vitrina.operators.durable import file_system, keep, names_in, new_path
from vitrina.operators.ordering import numbered
from vitrina.streaming.append import append_deduped, stored
from vitrina.streaming.listings import append_listings, current_listings
from vitrina.streaming.logs import live_counters, read_log_stream
from vitrina.streaming.watermark import first_within


@query(f"WITH RECURSIVE {two_keys_sql(EVENT_PAIRS)} SELECT seq FROM kept")
def stream_of_listings(spark, sf_dir):
    """All events arrive in three parts; the stream is started anew for each."""
    rows = event_keys(spark, sf_dir)
    folder, output, progress = (new_path(spark, n) for n in ("arrivals", "appended", "progress"))
    last = rows.agg(F.max("seq")).scalar()
    part = F.floor(F.col("seq") * 3 / (last + 1))
    for i in range(3):
        rows.where(part == i).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(rows.schema).parquet(folder)
        append_deduped(stream, output, progress).awaitTermination()
    return stored(spark, output, rows.schema).select("seq")


@query(f"""
WITH {_LOG_SQL} SELECT run, kind, arg_max(counters, e) AS counters, max(e) AS line_no FROM l WHERE kind IS NOT NULL GROUP BY run, kind""")
def stream_of_logs(spark, sf_dir):
    """Counters of a log stream read in several batches, as last written."""
    folder, output = new_path(spark, "logs"), new_path(spark, "counters")
    lines = log_lines(spark, sf_dir)
    lines.repartition(4, "line_no").write.json(folder)
    stream = read_log_stream(spark, folder, files_per_batch=2)

    def write(batch, batch_id):
        batch.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").parquet(output)

    (
        live_counters(stream)
        .withColumn("counters", F.array_join(F.map_values("counters"), ","))
        .writeStream.outputMode("complete")
        .foreachBatch(write)
        .option("checkpointLocation", new_path(spark, "progress"))
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )
    return spark.read.parquet(output).drop("batch")


# Events as they come in six batches: a quarter of the rows arrive one to five batches late.
_ARRIVAL = """arrival AS (
  SELECT event_id, ts, event_type || (user_id % 40)::VARCHAR AS k,
    least(5, event_id * 6 // (max(event_id) OVER () + 1) + CASE WHEN event_id % 4 = 0 THEN event_id % 6 ELSE 0 END) AS b
  FROM events
), first_of_batch AS (
  SELECT * FROM arrival QUALIFY row_number() OVER (PARTITION BY b, k ORDER BY event_id) = 1
)"""
_DELAY_DAYS = 2


def _within_sql():
    """State after each batch, spelled out: what is let through, and until when its key is known.

    The watermark moves on after each batch, before the next part arrives.
    """
    delay = f"INTERVAL {_DELAY_DAYS} DAY"
    steps = [f"WITH {_ARRIVAL}", "known_0 AS (SELECT k, ts AS until FROM first_of_batch WHERE false)"]
    for b in range(6):
        def mark(upto):
            return f"(SELECT coalesce(max(ts) - {delay}, TIMESTAMP '1970-01-01') FROM first_of_batch WHERE b < {upto})"
        steps.append(f"""out_{b} AS (
  SELECT * FROM first_of_batch r WHERE b = {b} AND ts > {mark(b)}
    AND NOT EXISTS (SELECT 1 FROM known_{b} n WHERE n.k = r.k))""")
        steps.append(f"""known_{b + 1} AS (
  SELECT * FROM (SELECT k, until FROM known_{b} UNION ALL SELECT k, ts + {delay} FROM out_{b})
  WHERE until > {mark(b + 1)})""")
    return ", ".join(steps) + " " + " UNION ALL ".join(
        f"SELECT event_id, b::INT AS batch FROM out_{b}" for b in range(6)
    )


@query(_within_sql())
def stream_within_watermark(spark, sf_dir):
    """First event per key within two days of event time, read in six batches with late rows."""
    folder, output, progress = (new_path(spark, n) for n in ("arrivals", "within", "progress"))
    e = F.col("event_id")
    last = table(spark, sf_dir, "events").agg(F.max("event_id")).scalar()
    late = F.when(e % 4 == 0, e % 6).otherwise(0)
    arrival = table(spark, sf_dir, "events").select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), F.concat("event_type", (F.col("user_id") % 40).cast("string")).alias("k"),
        F.least(F.lit(5), F.floor(e * 6 / (last + 1)) + late).cast("int").alias("batch"),
    )
    # One row per key and batch: which of several a batch lets through is not defined.
    arrival = keep(first_per_key(arrival, ["batch", "k"], "event_id"), "arrivals")
    for b in range(6):
        arrival.where(F.col("batch") == b).coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(arrival.schema).parquet(folder)
        (
            first_within(stream, "k", "ts", f"{_DELAY_DAYS} days").select("event_id", "batch")
            .writeStream.option("checkpointLocation", progress).option("path", output)
            .trigger(availableNow=True).start().awaitTermination()
        )
    return spark.read.schema("event_id long, batch int").parquet(output)


# Rows of a listing file, about.
_FILE_ROWS = 100_000
_FILE_PAIRS = """SELECT coalesce('u' || CASE WHEN seq % 5 > 0 THEN 'https://maps.example.com/' || (seq % 3000)::VARCHAR END,
    'f' || row_key) AS a, row_key AS b, seq FROM (
  SELECT *, lower('Shop ' || (seq % 700)::VARCHAR) || '|' || (seq % 11)::VARCHAR || '|' AS row_key FROM (
    SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS seq FROM orders))"""


@query(f"""
WITH RECURSIVE {two_keys_sql(_FILE_PAIRS)}
SELECT seq, 'Shop ' || (seq % 700)::VARCHAR AS nombre, (seq % 11)::VARCHAR AS direccion FROM kept""")
def stream_of_listing_files(spark, sf_dir):
    """Orders as listing CSV files that arrive in three parts; the stream is started anew for each."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey")
    rows = numbered(rows, [], ["o_orderkey"], "nth").withColumn("s", F.col("nth") - 1)
    s = F.col("s")
    link = F.when(s % 5 > 0, F.concat(F.lit("https://maps.example.com/"), (s % 3000).cast("string"), F.lit("?hl=es")))
    files = keep(rows.select(
        "s", F.concat(F.lit("Shop "), (s % 700).cast("string")).alias("nombre"),
        (s % 11).cast("string").alias("direccion"), link.alias("maps_url"),
    ), "listing-rows")
    n = files.count()
    folder, output, progress = (new_path(spark, x) for x in ("listing-files", "listings", "progress"))
    names = ["nombre", "direccion", "maps_url"]
    for part in range(3):
        # One task reads a file, so large parts come in several files, named in order and of one time.
        piece = files.where(F.floor(s * 3 / n) == part).repartitionByRange(1 + n // (3 * _FILE_ROWS), "s")
        earlier = set(names_in(spark, folder))
        piece.sortWithinPartitions("s").select(*names).write.mode("append").options(header=True, escape='"').csv(folder)
        now = int(time.time() * 1000)
        for name in set(names_in(spark, folder)) - earlier:
            system, path = file_system(spark, f"{folder}/{name}")
            system.setTimes(path, now, -1)
        append_listings(spark, folder, output, progress, names).awaitTermination()
    return current_listings(spark, output, names).select("seq", "nombre", "direccion")
