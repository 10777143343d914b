"""A stream of listings appended without duplicates."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from vitrina.operators.dedup import dedup_two_keys
from vitrina.operators.durable import discard, keep
from vitrina.operators.lookups import without
from vitrina.operators.ordering import first_n
from vitrina.streaming.keys import KEYS_PER_BUCKET, KeyStore


def append_deduped(
    stream: DataFrame,
    output: str,
    checkpoint: str,
    order: str = "seq",
    url_key: str = "url_key",
    row_key: str = "fallback_key",
    max_records: int = 0,
    trigger: dict | None = None,
    per_bucket: int = KEYS_PER_BUCKET,
) -> StreamingQuery:
    """Append each row unless one of its keys was stored before.

    ``order`` is a unique long in arrival order. Every micro-batch is written to
    its own folder ``batch=N``, replacing what an interrupted attempt left
    there, and compared with the keys of earlier batches only: a replayed
    batch gives the same rows, and a restart goes on from the stored output.
    ``max_records`` limits the output to its first rows; 0 means no limit.
    ``trigger`` is the stream's trigger; by default it stops when all is read.
    The state is every key ever stored, as the rule has no time limit; it lies beside the
    output (``key_store``), and a batch reads only the buckets its own keys fall in.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        append_batch(batch, batch_id, output, order, url_key, row_key, max_records, per_bucket)

    return (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def key_store(spark: SparkSession, output: str, per_bucket: int = KEYS_PER_BUCKET) -> KeyStore:
    return KeyStore(spark, f"{output}.state", per_bucket)


def seed_output(
    rows: DataFrame, output: str, url_key: str = "url_key", row_key: str = "fallback_key",
    per_bucket: int = KEYS_PER_BUCKET,
) -> None:
    """Put rows of an earlier output, with their keys, before all batches."""
    path = f"{output}/batch=-1"
    rows.write.mode("overwrite").parquet(path)
    written = rows.sparkSession.read.schema(rows.schema).parquet(path)
    n = written.count()
    key_store(rows.sparkSession, output, per_bucket).add(-1, _keys(written, url_key, row_key).distinct(), n, n)


def append_batch(
    batch: DataFrame,
    batch_id: int,
    output: str,
    order: str,
    url_key: str,
    row_key: str,
    max_records: int = 0,
    per_bucket: int = KEYS_PER_BUCKET,
) -> None:
    spark = batch.sparkSession
    store = key_store(spark, output, per_bucket)
    state = store.before(batch_id)
    room = max(0, max_records - state.rows)
    arrived = keep(batch, "arrived")
    seen = arrived.count()
    path = f"{output}/batch={batch_id}"
    if max_records > 0 and room == 0:
        new = arrived.limit(0)
    else:
        known = store.known(_keys(arrived, url_key, row_key).distinct(), batch_id)
        unknown = keep(_unknown(arrived, known, url_key, row_key), "unknown")
        new = first_n(dedup_two_keys(unknown, order, url_key, row_key), room, order)
    new.write.mode("overwrite").parquet(path)
    written = spark.read.schema(batch.schema).parquet(path)
    store.add(batch_id, _keys(written, url_key, row_key).distinct(), written.count(), seen)
    discard(arrived)


def stored(
    spark: SparkSession, output: str, schema: StructType, before: int | None = None
) -> DataFrame:
    """Rows written so far, or by the batches before one."""
    full = StructType([*schema.fields, StructField("batch", LongType())])
    try:
        table = spark.read.schema(full).option("basePath", output).parquet(output)
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
    if before is not None:
        table = table.where(F.col("batch") < before)
    return table.drop("batch")


def _tagged(key: str, tag: str) -> Column:
    return F.concat(F.lit(tag), F.col(key))


def _keys(rows: DataFrame, url_key: str, row_key: str) -> DataFrame:
    """All keys of the rows, those of the link and of the row told apart by their first letter."""
    both = F.array(_tagged(url_key, "u"), _tagged(row_key, "r"))
    return rows.select(F.explode(both).alias("key")).where("key is not null")


def _unknown(batch: DataFrame, known: DataFrame, url_key: str, row_key: str) -> DataFrame:
    """Rows of the batch that share no key with the known ones.

    A key of very many rows and rows without a key are spread over the tasks.
    """
    for key, tag in ((url_key, "u"), (row_key, "r")):
        gone = known.where(F.col("key").startswith(tag)).select(F.substr("key", F.lit(2)).alias(key))
        batch = without(batch, gone, key)
    return batch
