"""Listing files as they arrive, appended to one clean output."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from vitrina import model
from vitrina.operators.dedup import with_keys
from vitrina.operators.durable import discard, keep
from vitrina.operators.ordering import running
from vitrina.sources.listings import ROW_BITS, CSV_OPTIONS, read_listings
from vitrina.streaming.append import append_batch, key_store, seed_output, stored
from vitrina.streaming.keys import KEYS_PER_BUCKET

_PLACES = ("_file", "_time", "_row")


def read_listing_stream(
    spark: SparkSession, path: str, columns: Sequence[str] = tuple(model.LISTING_COLUMNS),
    files_per_batch: int | None = None,
) -> DataFrame:
    """A stream of listing CSV files of one layout, with the place of each row.

    ``columns`` are the names in the files' header; a file with another header fails the
    stream instead of filling the wrong columns. Listing columns that the layout lacks
    are empty. ``_file`` and ``_time`` tell the file and when it was written;
    ``arrival_order`` makes a number of them.
    """
    reader = spark.readStream.schema(", ".join(f"`{c}` string" for c in columns))
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    rows = reader.options(**CSV_OPTIONS | {"header": True, "enforceSchema": False}).csv(path)
    missing = [F.lit("").alias(c) for c in model.LISTING_COLUMNS if c not in columns]
    return rows.select(
        *[F.coalesce(f"`{c}`", F.lit("")).alias(c) for c in columns], *missing,
        F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_modification_time").alias("_time"),
    )


def placed_rows(batch: DataFrame) -> DataFrame:
    """A batch of the stream with ``_row``, the place in the task that reads a row; kept.

    One task reads a file from its start, so places follow the file.
    """
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    return keep(batch.withColumn("_row", place), "placed")


def arrival_order(batch: DataFrame, seen: int, order: str = "seq") -> DataFrame:
    """Rows of one batch numbered on from ``seen``: files by time and name, rows as in the file.

    Only the files are sorted; a file's rows get its first number and their place, so rows do
    not move. ``batch`` comes from ``placed_rows``.
    """
    files = batch.groupBy("_file").agg(
        F.min("_time").alias("_time"), F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_n")
    )
    ahead = running(files, [], ["_time", "_file"], {"_ahead": "_n"}, strictly_before=True)
    offsets = ahead.select("_file", (F.col("_ahead") - F.col("_first") + seen).alias("_offset"))
    # The planner broadcasts the files' offsets if they are small.
    numbered = batch.join(offsets, "_file").withColumn(order, F.col("_offset") + F.col("_row"))
    return numbered.drop(*_PLACES, "_offset")


def append_listings(
    spark: SparkSession,
    path: str,
    output: str,
    checkpoint: str,
    columns: Sequence[str] = tuple(model.LISTING_COLUMNS),
    resume_from: str | None = None,
    max_records: int = 0,
    files_per_batch: int | None = None,
    trigger: dict | None = None,
    per_bucket: int = KEYS_PER_BUCKET,
) -> StreamingQuery:
    """Listing files to one output without duplicates by link or by name, address and phone.

    Each batch's rows are numbered in arrival order after all rows seen before, get their
    keys and are appended unless an earlier row has one of them. ``resume_from``
    is an earlier CSV output: all its rows come first, as they are, and their keys count; it
    is read when the output is begun and not again when a stream is restarted.
    ``max_records`` bounds the output, those rows included; 0 means no limit.
    ``current_listings`` reads the result.
    """
    if resume_from is not None and not key_store(spark, output).begun():
        earlier = with_keys(read_listings(spark, resume_from, ordered=True))
        seed_output(earlier.select(*_output_columns(columns)), output, per_bucket=per_bucket)

    def write(batch: DataFrame, batch_id: int) -> None:
        placed = placed_rows(batch)
        seen = key_store(spark, output, per_bucket).before(batch_id).seen
        keyed = with_keys(arrival_order(placed, seen)).select(*_output_columns(columns))
        append_batch(keyed, batch_id, output, "seq", "url_key", "fallback_key", max_records, per_bucket)
        discard(placed)

    return (
        read_listing_stream(spark, path, columns, files_per_batch)
        .writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def current_listings(
    spark: SparkSession, output: str, columns: Sequence[str] = tuple(model.LISTING_COLUMNS)
) -> DataFrame:
    """The listings written so far with ``seq``, their place in arrival order."""
    kinds = {"seq": "long"}
    schema = ", ".join(f"`{c}` {kinds.get(c, 'string')}" for c in _output_columns(columns))
    empty = spark.createDataFrame([], schema)
    return stored(spark, output, empty.schema).drop("url_key", "fallback_key")


def _output_columns(columns: Sequence[str]) -> list[str]:
    extra = [c for c in columns if c not in model.LISTING_COLUMNS]
    return ["seq", *model.LISTING_COLUMNS, *extra, "url_key", "fallback_key"]
