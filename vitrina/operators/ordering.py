"""A total row order in chunks, and running values over it.

A window over a whole group puts the group into one task. Here the rows are
range-partitioned by group and order, so that a large group spans many chunks;
each chunk is one small window, and the chunks' totals are carried over.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from vitrina.operators.durable import keep

_CHUNK_BITS = 33


def with_order(df: DataFrame, *order: str, name: str = "seq") -> DataFrame:
    """Add a unique long that follows the given order.

    The order columns must tell all rows apart. The table is kept in the shared
    folder, so every later use sees the same numbers.
    """
    ranged = df.repartitionByRange(*[F.col(c) for c in order]).sortWithinPartitions(*order)
    return keep(ranged.withColumn(name, F.monotonically_increasing_id()), "order")


def _chunk() -> Column:
    return F.shiftright(F.col("_seq"), _CHUNK_BITS).cast("int")


def running(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    sums: dict[str, str] | None = None,
    lasts: dict[str, str] | None = None,
    strictly_before: bool = False,
) -> DataFrame:
    """Running sums and last non-null values per group, in order.

    ``sums`` and ``lasts`` map new column names to input columns. With
    ``strictly_before`` a row's own value is left out.
    """
    placed = with_order(df, *group, *order, name="_seq")
    return running_over(placed, group, "_seq", sums, lasts, strictly_before).drop("_seq")


def running_over(
    placed: DataFrame,
    group: Sequence[str],
    seq: str,
    sums: dict[str, str] | None = None,
    lasts: dict[str, str] | None = None,
    strictly_before: bool = False,
) -> DataFrame:
    """The same over rows that ``with_order`` has placed by group and order."""
    sums, lasts = sums or {}, lasts or {}
    group = list(group)
    placed = placed.withColumn("_chunk", F.shiftright(F.col(seq), _CHUNK_BITS).cast("int"))
    parts = [*group, "_chunk"]

    totals = placed.groupBy(*parts).agg(
        *[F.sum(c).alias(f"_t_{n}") for n, c in sums.items()],
        *[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(seq))).alias(f"_t_{n}")
          for n, c in lasts.items()],
    )
    # One row per group and chunk; a group has at most as many rows as chunks.
    earlier = Window.partitionBy(*group).orderBy("_chunk").rowsBetween(
        Window.unboundedPreceding, -1
    )
    # Only the first group of a chunk can have begun in an earlier chunk, so the
    # rows with something to carry over are no more than the chunks.
    offsets = F.broadcast(
        totals.select(
            *[F.col(c).alias(f"_p_{c}") for c in parts],
            *[F.sum(f"_t_{n}").over(earlier).alias(f"_o_{n}") for n in sums],
            *[F.last(f"_t_{n}", ignorenulls=True).over(earlier).alias(f"_o_{n}") for n in lasts],
            F.count(F.lit(1)).over(earlier).alias("_before"),
        )
        .where("_before > 0")
        .drop("_before")
    )
    inside = Window.partitionBy(*parts).orderBy(seq).rowsBetween(
        Window.unboundedPreceding, -1 if strictly_before else 0
    )
    same_part = F.lit(True)
    for c in parts:
        same_part = same_part & F.col(c).eqNullSafe(F.col(f"_p_{c}"))
    joined = placed.join(offsets, same_part, "left")
    added = {
        n: F.coalesce(F.sum(c).over(inside), F.lit(0)) + F.coalesce(F.col(f"_o_{n}"), F.lit(0))
        for n, c in sums.items()
    } | {
        n: F.coalesce(F.last(c, ignorenulls=True).over(inside), F.col(f"_o_{n}"))
        for n, c in lasts.items()
    }
    return joined.withColumns(added).drop(
        "_chunk", *[f"_p_{c}" for c in parts], *[f"_o_{n}" for n in added]
    )


def numbered(df: DataFrame, group: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """1-based position of each row in its group."""
    counted = running(df.withColumn("_one", F.lit(1).cast("long")), group, order, {name: "_one"})
    return counted.drop("_one")


def first_n(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The first ``n`` rows in order; 0 keeps all."""
    if n <= 0:
        return df
    return numbered(df, [], order, "_nth").where(F.col("_nth") <= n).drop("_nth")
