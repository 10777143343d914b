"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from vitrina.operators.durable import new_path

# ASCII white space; every other character belongs to a word.
SPACE = " \t\n\x0b\x0c\r"
WORD = "[^\\x20\\x09-\\x0D]+"
SPACES = "[\\x20\\x09-\\x0D]+"


def keep(df: DataFrame, label: str, codec: str | None = None, group_bytes: int | None = None) -> DataFrame:
    """Write a table to the shared folder and read it back; ``discard`` removes it.

    With ``group_bytes`` a row group ends with the row that brings it to so many bytes, looked
    at after every row: neither writing nor reading then holds many large rows at once.
    """
    path = new_path(df.sparkSession, label)
    write = df.write if codec is None else df.write.option("compression", codec)
    if group_bytes is not None:
        write = write.option("parquet.block.size", group_bytes)
        for each in ("min", "max"):
            write = write.option(f"parquet.page.size.row.check.{each}", 1)
    write.parquet(path)
    kept = df.sparkSession.read.schema(df.schema).parquet(path)
    kept.kept_at = path
    return kept


def discard(*tables: DataFrame) -> None:
    """Delete tables made by ``keep`` that nothing reads any more."""
    for table in tables:
        context = table.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(table.kept_at)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def split_words(text: Column) -> Column:
    """Words of a text as an array; a null text has none."""
    pieces = F.split(F.coalesce(text, F.lit("")), SPACES)
    return F.filter(pieces, lambda w: w != "")


def with_columns_of(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Only the named columns, whatever else the table has."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def group_key(column: Column) -> Column:
    """A grouping key that is never null, with the null group apart from all others."""
    return F.coalesce(F.concat(F.lit("="), column.cast("string")), F.lit("-"))


def unit_hash(*columns: Column, seed: int) -> Column:
    """A number in [0, 1) that depends on the columns' values and the seed alone."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *columns), 11)
    return bits.cast("double") / F.lit(float(1 << 53))
