"""Excluded brands and shops per brand."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from vitrina.functions.text import brand_key, let, literal, text
from vitrina.operators.durable import keep
from vitrina.operators.lookups import attach


def names_brand(name: Column, brands: Sequence[str]) -> Column:
    """The name contains one of the brands, in any letter case.

    The brands come from a configuration list, so they are one pattern in the
    scan's stage instead of a join. Blank brands are ignored.
    """
    by_first = {}
    for needle in sorted({b.lower() for b in brands if b.strip()}):
        by_first.setdefault(needle[0], []).append(literal(needle[1:]))
    if not by_first:
        return F.lit(False)
    # Grouped by first letter: most places of a name are settled by one letter.
    pattern = "|".join(f"{literal(ch)}(?:{'|'.join(rest)})" for ch, rest in by_first.items())
    return F.lower(text(name)).rlike(pattern)


def exclude_brands(df: DataFrame, brands: Sequence[str], name: str = "nombre") -> DataFrame:
    return df.where(~names_brand(F.col(name), brands))


def with_brand_key(df: DataFrame, name: str = "nombre", town: str = "municipio_origen") -> DataFrame:
    """Add brand_key, null when the name leaves nothing."""
    key = brand_key(F.col(name), F.col(town))
    return df.withColumn("brand_key", let(key, lambda k: F.nullif(k, F.lit(""))))


def count_by_brand(df: DataFrame) -> DataFrame:
    """Rows per brand key; rows without one are not counted."""
    return (
        df.where(F.col("brand_key").isNotNull())
        .groupBy("brand_key")
        .agg(F.count(F.lit(1)).alias("num_tiendas"))
    )


def with_store_count(df: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """Add num_tiendas: the brand's rows in ``counts`` (default: in df), at least 1.

    The counts are kept, so the brand keys are made once for them and once for the rows.
    """
    counts = keep(count_by_brand(df) if counts is None else counts, "brand-counts")
    # Where a brand has many shops it has many rows to look up.
    joined = attach(df, counts, "brand_key", counts.withColumnRenamed("num_tiendas", "_rows"))
    return joined.withColumn("num_tiendas", F.coalesce("num_tiendas", F.lit(1)))


def distinct_brands(df: DataFrame) -> DataFrame:
    return df.agg(F.count_distinct("brand_key").alias("marcas"))
