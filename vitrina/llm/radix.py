"""Exact duplicates by distributed most-significant-digit radix partitioning."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from vitrina.llm.common import discard, keep
from vitrina.operators.durable import new_path

# Bytes of the first digit, and by how much each digit is longer than the one before:
# texts of n bytes are settled in about log n rounds.
FIRST = 16
GROWTH = 8
# Bytes and rows of one block of texts.
BLOCK_BYTES = 8_000_000
_AT_BITS = 16


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256.

    Rows whose texts are equal byte by byte are a group; of each group the row with the
    largest id is kept. All rows start in one group. A round splits every group by the
    next bytes of its texts, its digit: rows are counted by (group, digit) in the tasks
    that read them and only distinct digits with their counts are moved, so a group of
    very many rows is no burden. A child of one row is done; a child whose texts all end
    with the digit is a group of equal texts; the others take part in the next round,
    with a digit eight times as long. No digest decides: digits are compared as they are,
    and text_sha256 is only reported.

    Texts are laid into blocks once, where they are read, and never move as a whole; a
    round moves the digits of rows that share all bytes before with another row. A null text
    counts as empty. A null id is smaller than all others. Of rows with equal text and
    id one is kept, which one does not matter. Very long texts take more rounds, no more
    memory than the text. Other columns are ignored; an empty table gives an empty one.
    """
    spark = docs.sparkSession
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).cast("binary")
    plain = docs.select(F.col(f"`{id_col}`").alias("id"), body.alias("body"))
    total = plain.agg(F.sum(F.octet_length("body").cast("long"))).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // (4 * BLOCK_BYTES)))
    name, path = f"vitrina_texts_{uuid.uuid4().hex}", new_path(spark, "texts")
    (
        _blocks(plain).write.format("parquet").option("compression", "zstd")
        .option("path", path).bucketBy(buckets, "block").saveAsTable(name)
    )
    blocks = spark.table(name)
    row = F.shiftleft("block", _AT_BITS) + F.col("at")
    light = blocks.select("block", F.posexplode("rows").alias("at", "r")).select(row.alias("row"), "r.*")

    done = []
    digits = keep(
        light.select("row", "id", F.lit(0).cast("long").alias("group"),
                     F.col("head").alias("digit"), (F.col("size") > FIRST).alias("more")),
        "digits",
        "zstd",
    )
    start, width = FIRST, FIRST * GROWTH
    while True:
        children = keep(_children(digits), "children", "zstd")
        split = keep(_members(digits, children), "split", "zstd")
        discard(digits, children)
        done.append(split)
        still = split.where("more")
        if still.isEmpty():
            break
        digits = keep(_digits(blocks, still, start, width), "digits", "zstd")
        start, width = start + width, width * GROWTH

    settled = reduce(DataFrame.unionByName, [d.where("not more") for d in done]).drop("more")
    joined = light.select("row", "id", "sha").join(settled, "row", "left")
    alone = F.col("n").isNull()
    result = keep(
        joined.select(
            F.col("id").alias(id_col),
            F.when(alone, F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
            F.coalesce("n", F.lit(1).cast("long")).alias("group_size"),
            (alone | (F.col("group") == F.col("row"))).alias("kept"),
            F.lower(F.hex("sha")).alias("text_sha256"),
        ),
        "groups",
        "zstd",
    )
    spark.sql(f"DROP TABLE {name}")
    blocks.kept_at = path
    discard(blocks, *done)
    return result


_CHILD = ["group", "digit", "more"]


def _children(digits: DataFrame) -> DataFrame:
    """The children with two rows or more; a child is named by the row it would keep."""
    counted = digits.groupBy(*_CHILD).agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("id", "row")).alias("best"))
    return counted.where("n > 1")


def _members(digits: DataFrame, children: DataFrame) -> DataFrame:
    """The children's rows. Both sides are tables, so the join's large partitions can be split."""
    return digits.select("row", *_CHILD).join(children, _CHILD).select(
        "row", "more", "n", F.col("best.row").alias("group"), F.col("best.id").alias("keep_id")
    )


def _blocks(plain: DataFrame) -> DataFrame:
    """Rows of (id, body) as blocks of whole texts; nothing moves."""
    kind = plain.schema["id"].dataType.simpleString()
    schema = f"block long, data binary, rows array<struct<id:{kind},size:long,sha:binary,head:binary>>"

    def laid(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 24
        ids, texts, held = [], [], 0

        def block() -> pa.RecordBatch:
            rows = pa.StructArray.from_arrays(
                [
                    pa.concat_arrays(ids),
                    pa.array([len(t) for t in texts], pa.int64()),
                    pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary()),
                    pa.array([t[:FIRST] for t in texts], pa.binary()),
                ],
                names=["id", "size", "sha", "head"],
            )
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([number], pa.int64()), pa.array([b"".join(texts)], pa.binary()),
                    pa.ListArray.from_arrays(pa.array([0, len(texts)], pa.int32()), rows),
                ],
                names=["block", "data", "rows"],
            )

        for batch in batches:
            first = 0
            for i, body in enumerate(batch.column(1)):
                texts.append(body.as_py())
                held += len(texts[-1])
                if held >= BLOCK_BYTES or len(texts) == 1 << _AT_BITS:
                    ids.append(batch.column(0).slice(first, i + 1 - first))
                    yield block()
                    number, first = number + 1, i + 1
                    ids, texts, held = [], [], 0
            if first < batch.num_rows:
                ids.append(batch.column(0).slice(first))
        if texts:
            yield block()

    return plain.mapInArrow(laid, schema)


def _digits(blocks: DataFrame, still: DataFrame, start: int, width: int) -> DataFrame:
    """The next digit of each open row: row, id, group, digit, more."""
    at = F.col("row").bitwiseAND(F.lit((1 << _AT_BITS) - 1)).cast("int")
    # At most a block's rows.
    lists = still.groupBy(F.shiftright("row", _AT_BITS).alias("block")).agg(
        F.collect_list(F.struct(at.alias("at"), "group")).alias("open")
    )
    kind = blocks.schema["rows"].dataType.elementType["id"].dataType.simpleString()
    schema = f"row long, id {kind}, `group` long, digit binary, more boolean"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ends = np.cumsum(batch.column(2)[i].values.to_numpy(zero_copy_only=False))
                data, opened = batch.column(1)[i].as_buffer(), batch.column(4)[i].values
                places = opened.field("at").to_numpy(zero_copy_only=False)
                stops = ends[places]
                begins = np.where(places > 0, ends[places - 1], 0) + start
                upto = np.minimum(begins + width, stops)
                digit = [data[b:e].to_pybytes() for b, e in zip(begins.tolist(), upto.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array((batch.column(0)[i].as_py() << _AT_BITS) + places.astype(np.int64)),
                        batch.column(3)[i].values.take(pa.array(places)),
                        opened.field("group"),
                        pa.array(digit, pa.binary()),
                        pa.array(stops > upto),
                    ],
                    names=["row", "id", "group", "digit", "more"],
                )

    some = blocks.select("block", "data", F.col("rows.size").alias("sizes"), F.col("rows.id").alias("ids"))
    joined = some.join(lists.hint("shuffle_hash"), "block")
    return joined.select("block", "data", "sizes", "ids", "open").mapInArrow(cut, schema)
