"""Intermediate tables kept in the shared folder the session names."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see: ``spark.checkpoint.dir`` of the session.

    Where nothing is set, a local session (tests) gets a temporary folder; on a
    cluster a machine's own disk would not survive its loss, so that is an error.
    """
    context = spark.sparkContext
    folder = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not re.fullmatch(r"local(\[.*\])?", context.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="vitrina-")
    context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/vitrina-{label}-{uuid.uuid4().hex}"


def keep(df: DataFrame, label: str) -> DataFrame:
    """Write a table and read it back: short lineage, and exact sizes for the planner.

    ``discard`` deletes it once nothing reads it any more.
    """
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    kept = df.sparkSession.read.schema(df.schema).parquet(path)
    kept.kept_at = path
    return kept


def discard(*tables: DataFrame) -> None:
    """Delete tables made by ``keep``."""
    for table in tables:
        files, path = file_system(table.sparkSession, table.kept_at)
        files.delete(path, True)


def file_system(spark: SparkSession, path: str):
    """The file system of a path and the path, as the readers see them."""
    context = spark.sparkContext
    where = context._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(context._jsc.hadoopConfiguration()), where


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder that are not hidden; none if it is not there."""
    files, where = file_system(spark, path)
    if not files.exists(where):
        return []
    names = [s.getPath().getName() for s in files.listStatus(where)]
    return [n for n in names if not n.startswith(("_", "."))]


def write_note(spark: SparkSession, path: str, text: str) -> None:
    """Put a short text into a file, all of it or nothing; replaces what is there."""
    files, where = file_system(spark, path)
    _, aside = file_system(spark, f"{path}.{uuid.uuid4().hex}.tmp")
    stream = files.create(aside, True)
    stream.write(text.encode())
    stream.close()
    files.delete(where, False)
    files.rename(aside, where)


def read_note(spark: SparkSession, path: str) -> str | None:
    files, where = file_system(spark, path)
    if not files.exists(where):
        return None
    stream = files.open(where)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def planned_bytes(df: DataFrame) -> int:
    """What the planner takes a table's size to be."""
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return int(str(size))


def may_broadcast(df: DataFrame) -> bool:
    """Whether the planner would broadcast the table by itself."""
    limit = df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    return planned_bytes(df) <= limit
