"""Whole rows packed into blocks that are written once and never shuffled."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from vitrina.llm.common import discard
from vitrina.operators.durable import new_path

# A block ends before it has more text or more rows; a longer text is a block by itself.
BLOCK_BYTES = 4_000_000
# A row's number: task, block of the task and place in the block, from high to low bits.
PLACE_BITS = 20
BLOCK_BITS = 15


class Blocks:
    """The rows of a table, each known by a number (``row``), in blocks that stay where they are.

    The blocks are a table bucketed by their number, written without an exchange. What is
    decided about rows is light; it alone goes through a shuffle, to the rows' blocks.
    Rows keep all their columns, whatever their names, and equal rows stay apart.
    """

    def __init__(self, docs: DataFrame, text: str):
        self.spark = docs.sparkSession
        self.columns = docs.columns
        size = docs.agg(F.sum(F.coalesce(F.octet_length(F.col(f"`{text}`").cast("string")), F.lit(0)).cast("long")))
        total = size.first()[0] or 0
        least = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        buckets = max(least, -(-total // (4 * BLOCK_BYTES)))
        self.name, self.path = f"vitrina_rows_{uuid.uuid4().hex}", new_path(self.spark, "rows")
        # Columns by place, as their names may clash with anything.
        plain = docs.toDF(*[f"c{k}" for k in range(len(self.columns))])
        at = self.columns.index(text)
        item = StructType([StructField(f.name, f.dataType) for f in plain.schema.fields])
        schema = StructType([StructField("block", LongType()), StructField("rows", ArrayType(item))])

        def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            number = TaskContext.get().partitionId() << BLOCK_BITS
            for batch in batches:
                ends = np.cumsum(_sizes(batch.column(at)))
                struct = pa.StructArray.from_arrays(batch.columns, names=batch.schema.names)
                lo = 0
                while lo < batch.num_rows:
                    before = ends[lo - 1] if lo else 0
                    hi = int(np.searchsorted(ends, before + BLOCK_BYTES, side="right"))
                    hi = min(max(hi, lo + 1), lo + (1 << PLACE_BITS), batch.num_rows)
                    rows = pa.ListArray.from_arrays(pa.array([0, hi - lo], pa.int32()), struct.slice(lo, hi - lo))
                    yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), rows], names=["block", "rows"])
                    number += 1
                    lo = hi

        (
            plain.mapInArrow(packed, schema).write.format("parquet").option("compression", "zstd")
            .option("path", self.path).bucketBy(buckets, "block").saveAsTable(self.name)
        )
        self.table = self.spark.table(self.name)
        self.table.kept_at = self.path

    def _field(self, row: Column, column: str) -> Column:
        return row[f"c{self.columns.index(column)}"]

    def rows(self, **columns: str) -> DataFrame:
        """All rows: row and the named columns, as new name = column."""
        each = self.table.select("block", F.posexplode("rows").alias("at", "r"))
        number = F.shiftleft("block", PLACE_BITS) + F.col("at")
        return each.select(number.alias("row"), *[self._field(F.col("r"), c).alias(n) for n, c in columns.items()])

    def _picked(self, wanted: DataFrame, times: Column) -> DataFrame:
        """Blocks with the places wanted in them; a block's list is bounded by its rows."""
        places = F.col("row").bitwiseAND((1 << PLACE_BITS) - 1).cast("int")
        lists = wanted.select(
            F.shiftright("row", PLACE_BITS).alias("block"), F.struct(places.alias("at"), times.alias("n")).alias("pick")
        ).groupBy("block").agg(F.sort_array(F.collect_list("pick")).alias("picks"))
        return self.table.join(lists.hint("shuffle_hash"), "block")

    def some(self, wanted: DataFrame, **columns: str) -> DataFrame:
        """The rows whose numbers are in ``wanted`` (row, each once): row and the named columns."""
        picked = self._picked(wanted, F.lit(1)).select("block", F.explode(F.transform(
            "picks", lambda p: F.struct(p["at"].alias("at"), F.get("rows", p["at"]).alias("r"))
        )).alias("e"))
        number = F.shiftleft("block", PLACE_BITS) + F.col("e.at")
        return picked.select(number.alias("row"), *[self._field(F.col("e.r"), c).alias(n) for n, c in columns.items()])

    def whole(self, wanted: DataFrame, times: Column | None = None) -> DataFrame:
        """Whole rows as they were, those in ``wanted`` (row, each once), each so many times."""
        times = F.lit(1) if times is None else times.cast("int")
        picked = self._picked(wanted, times).select(F.explode(F.flatten(F.transform(
            "picks", lambda p: F.array_repeat(F.get("rows", p["at"]), p["n"])
        ))).alias("r"))
        return picked.select("r.*").toDF(*self.columns)

    def delete(self) -> None:
        self.spark.sql(f"DROP TABLE {self.name}")
        discard(self.table)


def _sizes(column: pa.Array) -> np.ndarray:
    lengths = pc.binary_length(column.cast(pa.large_string()).cast(pa.large_binary()))
    return lengths.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
