"""Listing files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from vitrina import model
from vitrina.operators.durable import keep
from vitrina.operators.ordering import numbered

ROW_BITS = 33

CSV_OPTIONS = {"header": False, "multiLine": True, "quote": '"', "escape": '"', "encoding": "UTF-8"}


# Columns that a file may have, unless the caller says otherwise.
MAX_COLUMNS = 64


def read_listings(
    spark: SparkSession, path: str, ordered: bool = False, format: str = "csv", max_columns: int = MAX_COLUMNS
) -> DataFrame:
    """Listings of CSV files with a header, or of a table in another format; '' for missing.

    Every CSV file's columns are found by its own header, so files of several layouts
    may lie in one folder; columns that a file lacks are empty. Quoted line breaks are
    allowed, so one task reads a CSV file. The files are read once, header and rows
    alike, into a table in the shared folder; a header of more than ``max_columns`` columns is
    an error. ``ordered`` adds ``seq``, the position over files by name and rows in a file.
    """
    if format == "csv":
        df = _csv_rows(spark, path, max_columns)
    else:
        row = F.col("_metadata.row_index") if format == "parquet" else F.monotonically_increasing_id()
        df = spark.read.format(format).load(path).withColumns(
            {"_file": F.col("_metadata.file_path"), "_row": row}
        )
    for column in model.LISTING_COLUMNS:
        if column not in df.columns:
            df = df.withColumn(column, F.lit(""))
    df = df.fillna("")
    if not ordered:
        return df.drop("_file", "_row")
    # The places of CSV rows are in a table already; others hold for one reading only.
    return _numbered(df if format == "csv" else keep(df, "listings"))


def _csv_rows(spark: SparkSession, path: str, max_columns: int) -> DataFrame:
    """Rows of all files with the columns that any header names, _file and _row (place in it)."""
    cells = [f"_c{i}" for i in range(max_columns + 1)]
    rows = spark.read.options(**CSV_OPTIONS).schema(", ".join(f"{c} string" for c in cells)).csv(path)
    # One task reads a file from its start, so the place in the task's part of the rows
    # follows the file.
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    placed = keep(
        rows.select(F.array(*cells).alias("_cells"), F.col("_metadata.file_path").alias("_file"), place.alias("_row")),
        "cells",
    )
    # The first row of a file is its header; one like it further down is a row.
    top = placed.groupBy("_file").agg(F.min("_row").alias("_head"))
    names = F.transform("_cells", lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), "\\A\\uFEFF", ""))
    heads = keep(
        placed.join(top, "_file").where("_row = _head").select("_file", "_head", names.alias("_names")), "headers"
    )
    if not heads.where(F.get("_names", F.lit(max_columns)) != "").isEmpty():
        raise ValueError(f"a header has more than {max_columns} columns; raise max_columns")
    # The distinct column names of all layouts, not the files' names.
    listed = heads.select(F.explode("_names").alias("n")).where("n <> ''").distinct().orderBy("n")
    known = [r["n"] for r in listed.collect()]
    # The planner broadcasts the headers if they are small.
    headed = placed.join(heads, "_file").where("_row > _head")
    columns = [n for n in model.LISTING_COLUMNS if n in known]
    columns += [n for n in known if n not in model.LISTING_COLUMNS]
    return headed.select(
        "_file",
        "_row",
        *[F.get("_cells", F.array_position("_names", F.lit(n)).cast("int") - 1).alias(n) for n in columns],
    )


def _numbered(placed: DataFrame) -> DataFrame:
    """seq out of the file's rank and the row's place, without moving the rows."""
    ranks = keep(numbered(placed.select("_file").distinct(), [], ["_file"], "_rank"), "file-ranks")
    seq = F.shiftleft(F.col("_rank") - 1, ROW_BITS) + F.col("_row")
    return placed.join(ranks, "_file").withColumn("seq", seq).drop("_file", "_row", "_rank")


def write_listings(df: DataFrame, path: str) -> None:
    """The listing columns as CSV files with a header; replaces what is there."""
    out = df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
                      for c in model.LISTING_COLUMNS])
    out.write.mode("overwrite").options(
        header=True, quote='"', escape='"', emptyValue="", ignoreLeadingWhiteSpace=False,
        ignoreTrailingWhiteSpace=False,
    ).csv(path)


def write_analysis(original: DataFrame, scored: DataFrame, path: str) -> None:
    """Two tables: all de-duplicated rows, and the scored ones without raw columns."""
    original.write.mode("overwrite").parquet(f"{path}/original")
    scored.drop(*model.ANALYSIS_DROPPED).write.mode("overwrite").parquet(f"{path}/analysis")


def write_run_metrics(metrics: DataFrame, path: str) -> None:
    metrics.write.mode("overwrite").json(path)
