"""Look-up joins that stay balanced when one key holds a large part of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from vitrina.operators.durable import may_broadcast

# A hot key holds more than a quarter of an even task's rows. With n tasks there are
# fewer than 4 n such keys whatever the data: that list may always be broadcast.
_LEAST_SHARE = 256


def hot_share(spark: SparkSession) -> int:
    return max(_LEAST_SHARE, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))


def key_counts(df: DataFrame, key: Sequence[str]) -> DataFrame:
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("_rows"))


def hot_keys(counts: DataFrame, key: Sequence[str], rows: str = "_rows") -> DataFrame:
    total = counts.agg(F.sum(rows)).scalar()
    return counts.where(F.col(rows) * hot_share(counts.sparkSession) > total).select(*key)


def attach(
    left: DataFrame,
    lookup: DataFrame,
    key: str | Sequence[str],
    counts: DataFrame | None = None,
) -> DataFrame:
    """Left join with a look-up table of at most one row per key.

    A look-up table that the planner itself takes to be below its broadcast threshold is
    left to it: the rows then stay where they are. Otherwise rows of hot keys get their values from a broadcast of the few hot look-up
    rows and are spread over the tasks of the shuffle join that serves all
    other rows. Rows with a null key match nothing and are spread as well.
    ``counts`` (key, _rows) saves the counting pass when the caller has it.
    """
    key = [key] if isinstance(key, str) else list(key)
    values = [c for c in lookup.columns if c not in key]
    if may_broadcast(lookup):
        # Null keys are the left side's, which does not move.
        near = lookup.select(
            *[F.col(k).alias(f"_k_{k}") for k in key], *[F.col(v).alias(f"_v_{v}") for v in values]
        )
        same = [left[k] == near[f"_k_{k}"] for k in key]
        return left.join(near, same, "left").select(
            *[left[c] for c in left.columns], *[F.col(f"_v_{v}").alias(v) for v in values]
        )
    counts = key_counts(left, key) if counts is None else counts
    hot = hot_keys(counts, key)

    by_key = {k: f"_k_{k}" for k in key}
    plain = lookup.select(
        *[F.col(k).alias(by_key[k]) for k in key],
        *[F.col(v).alias(f"_v_{v}") for v in values],
        # Always 0; written so that it stays a join key and is not folded away.
        F.pmod(F.xxhash64(*key), F.lit(1)).cast("int").alias("_to"),
    )
    hot_lookup = lookup.join(F.broadcast(hot), key, "left_semi")
    hot_rows = F.broadcast(
        hot.join(F.broadcast(hot_lookup), key, "left").select(
            *key, F.lit(True).alias("_hot"), *[F.col(v).alias(f"_h_{v}") for v in values]
        )
    )
    any_null = F.lit(False)
    for k in key:
        any_null = any_null | F.col(k).isNull()
    # By the row's place, so that equal rows are spread as well.
    spread = 1 + F.pmod(
        F.xxhash64(F.monotonically_increasing_id()), F.lit(4 * hot_share(left.sparkSession))
    )
    marked = left.join(hot_rows, key, "left").withColumn(
        "_to",
        F.when(F.col("_hot") | any_null, spread.cast("int")).otherwise(F.lit(0)),
    )
    on = [marked[k] == plain[by_key[k]] for k in key] + [marked["_to"] == plain["_to"]]
    joined = marked.join(plain, on, "left")
    return joined.select(
        *[marked[c] for c in left.columns],
        *[
            F.when(F.col("_hot"), F.col(f"_h_{v}")).otherwise(F.col(f"_v_{v}")).alias(v)
            for v in values
        ],
    )


def without(left: DataFrame, gone: DataFrame, key: str, counts: DataFrame | None = None) -> DataFrame:
    """Rows whose key is not in ``gone`` (one row per key)."""
    flagged = attach(left, gone.select(key).withColumn("_gone", F.lit(True)), key, counts)
    return flagged.where(F.col("_gone").isNull()).drop("_gone")
