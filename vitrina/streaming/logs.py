"""Live counters of running jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from vitrina import model
from vitrina.operators.dedup import first_per_key
from vitrina.operators.runs import latest_counters, parse_log_lines


def read_log_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """Log lines (run, line_no, line) arriving as JSON files."""
    reader = spark.readStream.schema(model.LOG_LINES)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.json(path)


def live_counters(lines: DataFrame) -> DataFrame:
    """Last counters per run and kind; state is one row per run and kind."""
    return latest_counters(parse_log_lines(lines))


def start_counters(
    lines: DataFrame, output: str, checkpoint: str, trigger: dict | None = None
) -> StreamingQuery:
    """Write the counters that each batch changes to ``output``, a folder per batch.

    A batch that is run again replaces its folder. ``trigger`` is the stream's trigger;
    by default it stops when it has read what is there.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{output}/batch={batch_id}")

    return (
        live_counters(lines)
        .writeStream.outputMode("update")
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def current_counters(spark: SparkSession, output: str) -> DataFrame:
    """The counters of each run and kind as last written."""
    return first_per_key(
        spark.read.parquet(output), ["run", "kind"], F.col("batch").desc()
    ).drop("batch")
