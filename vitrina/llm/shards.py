"""Minimum-cost-flow resharding: fewest bytes moved from old shards to new capacities."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from vitrina.llm.common import keep
from vitrina.operators.ordering import running

OVERHEAD = 16


def row_bytes(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + F.lit(OVERHEAD)).cast("long")


def stay_free(old: int, new: int) -> int:
    """Cost per byte: a block that stays in its shard costs nothing."""
    return 0 if old == new else 1


def min_cost_flow(
    sizes: list[int], capacities: list[int], cost: Callable[[int, int], int] = stay_free
) -> dict[tuple[int, int], int]:
    """Bytes to put from each old into each new shard, at the least total cost.

    Successive cheapest paths over the graph of shards; the graph has one node per
    shard, whatever the data. Costs are whole numbers. All sizes fit into the
    capacities, or ValueError is raised.
    """
    if sum(sizes) > sum(capacities):
        raise ValueError("the capacities hold less than the shards")
    n_old, n_new = len(sizes), len(capacities)
    flow: dict[tuple[int, int], int] = {}
    left, room = list(sizes), list(capacities)
    while any(left):
        # Cheapest way from any shard with bytes left, in the residual graph.
        best = [0 if left[i] else None for i in range(n_old)] + [None] * n_new
        came: list[int | None] = [None] * (n_old + n_new)
        waiting, queued = deque(i for i in range(n_old) if left[i]), set()
        while waiting:
            u = waiting.popleft()
            queued.discard(u)
            if u < n_old:
                edges = [(n_old + j, cost(u, j)) for j in range(n_new)]
            else:
                j = u - n_old
                edges = [(i, -cost(i, j)) for i in range(n_old) if flow.get((i, j))]
            for v, c in edges:
                if best[v] is None or best[u] + c < best[v]:
                    best[v], came[v] = best[u] + c, u
                    if v not in queued:
                        queued.add(v)
                        waiting.append(v)
        ends = [n_old + j for j in range(n_new) if room[j] and best[n_old + j] is not None]
        end = min(ends, key=lambda v: (best[v], v))
        path = [end]
        while came[path[-1]] is not None:
            path.append(came[path[-1]])
        path.reverse()
        steps = list(zip(path, path[1:]))
        amount = min(
            [left[path[0]], room[end - n_old]]
            + [flow[(v, u - n_old)] for u, v in steps if u >= n_old]
        )
        for u, v in steps:
            edge, sign = ((u, v - n_old), 1) if u < n_old else ((v, u - n_old), -1)
            flow[edge] = flow.get(edge, 0) + sign * amount
        left[path[0]] -= amount
        room[end - n_old] -= amount
    return {edge: amount for edge, amount in flow.items() if amount}


def equal_capacities(total: int, shards: int) -> list[int]:
    return [total // shards + (i < total % shards) for i in range(shards)]


def reshard(
    docs: DataFrame,
    old_shard: Column,
    n_old: int,
    n_new: int,
    id_col: str = "doc_id",
    text: str = "text",
    cost: Callable[[int, int], int] = stay_free,
    slots: bool = True,
    row: Column | None = None,
) -> tuple[DataFrame, list[tuple[int, int, int]]]:
    """Give every row a new shard; return the rows and the block transfers.

    The rows have id, size, text_crc32, old_shard, shard and, if wanted, slot (gapless
    from 0 in each shard, by id) and offset (bytes in the shard before the row). Transfers are (old, new, bytes), blocks that stay
    included. The new capacities are equal. The flow over the shards' sizes (``n_old``
    numbers) is solved on the driver. The bytes of an old shard are laid out largest
    row first; the block that stays comes first, so that the cuts between blocks fall
    between small rows; a row goes where its middle lies. Running sums span tasks, so a
    shard may be of any size. A null text counts as empty; equal rows are told apart by
    their place in the table and are interchangeable; rows need no unique id. Extra
    columns are ignored. An empty table gives no rows and no transfers. ``row`` names a
    row in every reading of the table; it becomes a last column _name, for ``rewrite``.
    """
    named = [] if row is None else ["_name"]
    rows = keep(
        docs.select(
            F.col(id_col).alias("_id"),
            row_bytes(F.col(text)).alias("size"),
            F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"),
            old_shard.cast("int").alias("old_shard"),
            *([] if row is None else [row.alias("_name")]),
        ).withColumn("_row", F.monotonically_increasing_id()),
        "shard-rows",
        "zstd",
    )
    found = {r["old_shard"]: r["bytes"] for r in rows.groupBy("old_shard").agg(F.sum("size").alias("bytes")).collect()}
    sizes = [found.get(i, 0) for i in range(n_old)]
    flow = min_cost_flow(sizes, equal_capacities(sum(sizes), n_new), cost)
    transfers = sorted((i, j, n) for (i, j), n in flow.items())
    blocks = []
    for i in range(n_old):
        mine = sorted((t for t in transfers if t[0] == i), key=lambda t: (t[1] != i, t[1]))
        starts, at = [], 0
        for _, _, amount in mine:
            starts.append(at)
            at += amount
        blocks.append((i, starts, [t[1] for t in mine]))
    spark = docs.sparkSession
    # One row per old shard.
    layout = F.broadcast(
        spark.createDataFrame(blocks, "old_shard int, _starts array<long>, _to array<int>")
    )
    laid = running(
        rows.withColumn("_large", -F.col("size")),
        ["old_shard"], ["_large", "_id", "text_crc32", "_row"], sums={"_end": "size"},
    )
    middle = F.col("_end") - F.col("size") / 2
    placed = laid.join(layout, "old_shard").select(
        "_id", "size", "text_crc32", "old_shard", "_row",
        F.element_at("_to", F.size(F.filter("_starts", lambda s: s <= middle))).alias("shard"),
        *named,
    )
    if slots:
        sums = {"_nth": "_one", "_upto": "size"}
        placed = running(
            placed.withColumn("_one", F.lit(1).cast("long")), ["shard"], ["_id", "text_crc32", "_row"], sums
        ).withColumns({"slot": F.col("_nth") - 1, "offset": F.col("_upto") - F.col("size")}).drop("_one", *sums)
    return placed.drop("_row").withColumnRenamed("_id", id_col), transfers


def affected(transfers: list[tuple[int, int, int]]) -> list[int]:
    """Shards whose files change: those that give bytes away or get some."""
    return sorted({s for i, j, n in transfers if i != j and n for s in (i, j)})


def _free_name(name: str, taken: list[str]) -> str:
    while name in [c.lower() for c in taken]:
        name = "_" + name
    return name


def rewrite(
    docs: DataFrame,
    placed: DataFrame,
    transfers: list[tuple[int, int, int]],
    path: str,
    id_col: str = "doc_id",
    bytes_per_file: int = 64_000_000,
    text: str = "text",
    row: Column | None = None,
) -> list[int]:
    """Write the affected shards' rows below ``path``, one folder per shard.

    Shards that no block leaves or enters stay as they are; the folder of a shard that
    nothing is left in goes. With the ``row`` that ``reshard`` was given, rows are joined
    by it; else by id, size, check sum and a number within equals, which are
    interchangeable. All columns of ``docs`` are written, and ``shard`` and ``slot`` (with
    a line before the name where ``docs`` has it). A file takes the rows that begin in
    one range of ``bytes_per_file`` of its shard, so no task holds more, but for one long row.
    """
    shards = affected(transfers)
    shard, slot = _free_name("shard", docs.columns), _free_name("slot", docs.columns)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    moved = placed.where(F.col("shard").isin(shards))
    if row is not None:
        left = docs.select(F.struct(*columns).alias("_doc"), row.alias("_name"))
        right = moved.select(F.col("_name"), F.col("shard").alias("_shard"), F.col("slot").alias("_slot"),
                             F.col("offset").alias("_offset"))
        joined = left.join(right, "_name")
    else:
        key = ["_id", "_size", "_crc"]
        # Numbers before the rows of other shards go, as equal rows may lie in several.
        nth = F.row_number().over(Window.partitionBy(*key).orderBy(F.lit(0)))
        left = docs.select(
            F.struct(*columns).alias("_doc"), F.col(id_col).alias("_id"), row_bytes(F.col(text)).alias("_size"),
            F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("_crc"),
        ).withColumn("_nth", nth)
        right = placed.select(
            F.col(id_col).alias("_id"), F.col("size").alias("_size"), F.col("text_crc32").alias("_crc"),
            F.col("shard").alias("_shard"), F.col("slot").alias("_slot"), F.col("offset").alias("_offset"),
        ).withColumn("_nth", nth).where(F.col("_shard").isin(shards))
        same = left["_id"].eqNullSafe(right["_id"])
        for c in ("_size", "_crc", "_nth"):
            same = same & (left[c] == right[c])
        joined = left.join(right, same)
    part = F.floor(F.col("_offset") / bytes_per_file)
    (
        joined.select("_doc", "_shard", "_slot", "_offset")
        .repartition("_shard", part)
        .sortWithinPartitions("_shard", "_slot")
        .select("_doc.*", F.col("_slot").alias(slot), F.col("_shard").alias(shard))
        .write.partitionBy(shard)
        .option("partitionOverwriteMode", "dynamic")
        .option("compression", "zstd")
        .mode("overwrite")
        .parquet(path)
    )
    full = {r[0] for r in moved.select("shard").distinct().collect()}
    context = docs.sparkSession.sparkContext
    for empty in sorted(set(shards) - full):
        folder = context._jvm.org.apache.hadoop.fs.Path(f"{path}/{shard}={empty}")
        folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)
    return shards
