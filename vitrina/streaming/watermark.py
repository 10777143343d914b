"""First row per key of a stream whose keys may be forgotten."""

from __future__ import annotations

from pyspark.sql import DataFrame

from vitrina.operators.dedup import full_url_key


def first_within(stream: DataFrame, key: str | list[str], time: str, delay: str) -> DataFrame:
    """The first row of each key to arrive, as long as the key is remembered.

    The variant of ``first_per_key`` with bounded state, for streams that may not keep every
    key for ever. A key is remembered for ``delay`` of event time after the row that was
    let through; repeated rows in that time are dropped. Rows with an event time ``delay``
    or more behind the latest one of earlier batches are late: they are dropped once the
    watermark has passed them, first seen or not. Without a time limit use ``append_deduped``.
    Rows whose ``time`` is null are never late and never forgotten by Spark; give them one.
    """
    keys = [key] if isinstance(key, str) else key
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def first_listings_within(stream: DataFrame, time: str, delay: str) -> DataFrame:
    """``first_within`` by the key of the places search."""
    return first_within(stream.withColumn("_key", full_url_key()), "_key", time, delay).drop("_key")
