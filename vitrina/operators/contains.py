"""Which of a table of needles a text contains: the first one in the needles' order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from vitrina.functions.text import let, text
from vitrina.operators.durable import keep
from vitrina.operators.lookups import attach

# Characters of the part of a needle by which it is found.
GRAM = 3


def grams(value: Column, n: int) -> Column:
    """All distinct parts of ``n`` characters of a text; none if it is shorter."""
    starts = F.sequence(F.lit(1), F.length(value) - n + 1)
    parts = F.transform(starts, lambda i: F.substr(value, i, F.lit(n)))
    return F.when(F.length(value) >= n, F.array_distinct(parts)).otherwise(F.array().cast("array<string>"))


def first_contained(df: DataFrame, needles: DataFrame, column: str, name: str = "found") -> DataFrame:
    """Add ``name``: the needles' row (struct) of least ``pos`` whose needle the text contains, or null.

    ``needles`` has pos (unique), needle, and any further columns; letter case is
    ignored, and blank needles are. Each needle is entered once, under the one of its parts of
    three characters that fewest needles share (shorter needles under themselves); a text looks
    up its own parts and tests only the needles it meets there. Texts are looked up once
    each, however often they occur, and only needles that share a part with a
    text ever meet it, so neither side has to be small.
    """
    lowered = needles.withColumn("_needle", F.lower(text(F.col("needle")))).where(F.trim("_needle") != "")
    width = F.least(F.length("_needle"), F.lit(GRAM))
    parts = F.when(width == GRAM, grams(F.col("_needle"), GRAM)).otherwise(F.array("_needle"))
    entered = keep(
        lowered.select("*", F.explode(parts).alias("_gram")).select(
            "pos", "_needle", "_gram", F.struct(*[F.col(f"`{c}`") for c in needles.columns]).alias("_row")
        ),
        "grams",
    )
    shared = entered.groupBy("_gram").agg(F.count(F.lit(1)).alias("_n"))
    index = keep(
        entered.join(shared, "_gram").groupBy("pos", "_needle")
        .agg(F.min_by(F.struct("_gram", "_row"), F.struct("_n", "_gram")).alias("_e"))
        .select("pos", "_needle", "_e._gram", "_e._row"),
        "needles",
    )
    # At most three numbers.
    widths = [r["w"] for r in index.select(F.length("_gram").alias("w")).distinct().collect()]
    low = F.lower(text(F.col(column)))
    texts = df.select(low.alias("_text")).distinct()
    own = F.array_distinct(F.concat(*[grams(F.col("_text"), w) for w in sorted(widths)])) if widths else (
        F.array().cast("array<string>")
    )
    looked_up = texts.select("_text", F.explode(own).alias("_gram")).join(index, "_gram")
    met = looked_up.where(F.contains("_text", F.col("_needle")))
    best = met.groupBy("_text").agg(F.min_by("_row", "pos").alias(name))
    return attach(df.withColumn("_text", low), best, "_text").drop("_text")


def exclude_by_table(df: DataFrame, brands: DataFrame, name: str = "nombre") -> DataFrame:
    """Rows whose name contains none of a table of brands (brand), in any letter case."""
    needles = brands.select(F.col("brand").alias("needle")).distinct().withColumn("pos", F.col("needle"))
    flagged = first_contained(df, needles, name, "_brand")
    return flagged.where("_brand is null").drop("_brand")


def guess_type_by_table(df: DataFrame, stems: DataFrame, category: str = "categoria", name: str = "tipo") -> DataFrame:
    """Add the type of the first stem (pos, stem, type) that a category text contains, or null."""
    needles = stems.select("pos", F.col("stem").alias("needle"), "type")
    found = first_contained(df, needles, category, "_stem")
    return found.withColumn(name, F.col("_stem.type")).drop("_stem")
