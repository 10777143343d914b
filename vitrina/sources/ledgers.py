"""Tables that grow with every run: search cache, usage, history, logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from vitrina import model
from vitrina.operators.durable import file_system
from vitrina.operators.ordering import with_order


def append(df: DataFrame, path: str, schema: str) -> None:
    """Add rows of a schema to a ledger table."""
    names = [f.split()[0] for f in schema.replace("map<string,string>", "map").split(", ")]
    df.select(*names).write.mode("append").parquet(path)


def append_cache(entries: DataFrame, path: str) -> None:
    append(entries, path, model.LOOKUP_CACHE)


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(model.LOOKUP_CACHE).parquet(path)


def cache_from_json(spark: SparkSession, path: str) -> DataFrame:
    """key, url, ts of a cache kept as one JSON document {key: {url, ts}}."""
    text = spark.read.text(path, wholetext=True)
    entries = F.from_json("value", "map<string, struct<url:string, ts:long>>")
    return text.select(F.explode(entries).alias("key", "hit")).select("key", "hit.url", "hit.ts")


def append_usage(usage: DataFrame, path: str) -> None:
    append(usage, path, model.USAGE_LEDGER)


def read_usage(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(model.USAGE_LEDGER).parquet(path)


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """Runs of a history document (a JSON array)."""
    return spark.read.schema(model.RUN_HISTORY).option("multiLine", True).json(path)


def write_history(runs: DataFrame, path: str) -> None:
    names = [f.split()[0] for f in model.RUN_HISTORY.replace("map<string,string>", "map").split(", ")]
    runs.select(*names).write.mode("overwrite").json(path)


def read_run_logs(spark: SparkSession, path: str) -> DataFrame:
    """run, line_no, line of log files; a run is a file, named without its ending.

    A log is one text file per run; the lines keep the order of the file. Files may lie in
    folders below ``path``; the run then has the folders in its name, so files of the same name
    in two folders are two runs. Where ``path`` is a pattern, a run is the file's whole path.
    """
    lines = spark.read.option("recursiveFileLookup", True).text(path).select(
        F.regexp_replace(_below(spark, path), r"(?<=[^/])\.[^./]*\z", "").alias("run"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_row"),
        F.col("value").alias("line"),
    )
    placed = with_order(lines, "run", "_block", "_row")
    return placed.select("run", F.col("seq").alias("line_no"), "line")


def _below(spark: SparkSession, path: str) -> Column:
    """The file's path from ``path`` on; its name if ``path`` is the file itself."""
    files, where = file_system(spark, path)
    root = files.makeQualified(where).toUri().getPath().rstrip("/") + "/"
    whole = F.url_decode(F.replace(F.regexp_replace("_metadata.file_path", r"\A[a-zA-Z0-9+.-]+:(//[^/]*)?", ""),
                                   F.lit("+"), F.lit("%2B")))
    return (
        F.when(whole.startswith(root), F.substr(whole, F.lit(len(root) + 1)))
        .when(whole == root.rstrip("/"), F.col("_metadata.file_name")).otherwise(whole)
    )
