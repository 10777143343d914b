"""Bands kept as a table: the first band that holds a value."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from vitrina.operators.durable import keep
from vitrina.operators.lookups import attach
from vitrina.operators.ordering import running

# Bits of a piece's number.
_DEPTH = 40


def first_band(
    df: DataFrame, bands: DataFrame, value: str, name: str = "band", criterion: str | None = None
) -> DataFrame:
    """Add ``name``: the bands' row (struct) of least ``pos`` that holds the value, or null.

    ``bands`` has pos (unique within its criterion), lo and hi, both ends included, and any further
    columns. With ``criterion``, a column of both tables, each row meets only the
    bands of its own. Bands may overlap, touch and leave gaps; those with lo above hi or without
    an end hold nothing.

    The ends cut the line into points and the gaps between them, numbered in order. A
    band covers a run of these; the run is entered as the few aligned blocks it is made of,
    at most two for each power of two, so n bands give about n log n entries however they
    overlap. Each piece takes the least ``pos`` of the blocks above it. A value's piece is that
    of the last end before it, a running value over both tables in order: no row
    meets a band it is not in, and no list of bands has to be small.
    """
    by = [criterion] if criterion else []
    group = [F.col(f"`{c}`").alias("_by") for c in by] or [F.lit(0).alias("_by")]
    given = bands.select(
        *group, F.col("lo").cast("double").alias("_lo"), F.col("hi").cast("double").alias("_hi"), "pos",
        F.struct(*[F.col(f"`{c}`") for c in bands.columns]).alias("_band"),
    ).where("_lo <= _hi and _by is not null")
    given = keep(given, "bands")
    ends = given.select("_by", F.explode(F.array("_lo", "_hi")).alias("_cut")).distinct()
    # Point i is piece 2 i, the gap after it piece 2 i + 1.
    cuts = keep(running(ends.withColumn("_one", F.lit(1).cast("long")), [], ["_by", "_cut"], {"_nth": "_one"})
                .select("_by", "_cut", (2 * F.col("_nth")).alias("_piece")), "cuts")
    low = cuts.select("_by", F.col("_cut").alias("_lo"), F.col("_piece").alias("_from"))
    high = cuts.select("_by", F.col("_cut").alias("_hi"), F.col("_piece").alias("_to"))
    spans = given.join(low, ["_by", "_lo"]).join(high, ["_by", "_hi"])
    blocks = spans.select("pos", "_band", F.explode(_aligned()).alias("_b")).groupBy("_b").agg(
        F.min_by(F.struct("pos", "_band"), "pos").alias("_best")
    )
    pieces = cuts.select("_by", F.explode(F.array("_piece", F.col("_piece") + 1)).alias("_piece"))
    above = F.array(*[
        F.struct(F.lit(d).alias("depth"), F.shiftright("_piece", d).alias("at")) for d in range(_DEPTH)
    ])
    met = pieces.select("_by", "_piece", F.explode(above).alias("_b")).join(blocks, "_b")
    first = keep(met.groupBy("_piece").agg(F.min_by("_best._band", "_best.pos").alias(name)), "pieces")

    rows = df.select("*", *group).withColumn("_v", F.col(f"`{value}`").cast("double"))
    return _with_piece(rows, cuts, df.columns, first, name)


def _aligned():
    """The aligned blocks (depth, at) that make up the pieces from _from to _to."""
    entries = []
    for d in range(_DEPTH):
        lo, hi = f"(shiftright(_from + {(1 << d) - 1}, {d}))", f"(shiftright(_to + 1, {d}))"
        # At each depth the blocks at either edge that no block twice their size covers.
        left = f"if({lo} < {hi} and {lo} % 2 = 1, struct({d} as depth, {lo} as at), null)"
        right = f"if({lo} < {hi} and {hi} % 2 = 1, struct({d} as depth, {hi} - 1 as at), null)"
        entries += [F.expr(left), F.expr(right)]
    return F.array_compact(F.array(*entries))


def _with_piece(rows: DataFrame, cuts: DataFrame, columns: list[str], first: DataFrame, name: str) -> DataFrame:
    """Each row's piece, by the last cut at or before its value, and that piece's band."""
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    marks = cuts.select(
        *[F.lit(None).cast(kinds[c]).alias(c) for c in columns],
        F.col("_by").cast(kinds["_by"]).alias("_by"), F.col("_cut").alias("_v"),
        F.struct("_cut", "_piece").alias("_mark"), F.lit(0).alias("_kind"), F.lit(0).cast("long").alias("_row"),
    )
    mark = marks.schema["_mark"].dataType
    # A unique place tells equal rows apart.
    own = rows.where("_v is not null and _by is not null").withColumns(
        {"_mark": F.lit(None).cast(mark), "_kind": F.lit(1), "_row": F.monotonically_increasing_id()}
    )
    placed = running(marks.unionByName(own), ["_by"], ["_v", "_kind", "_row"], lasts={"_last": "_mark"}).where("_kind = 1")
    exact = F.col("_v") == F.col("_last._cut")
    piece = F.when(exact, F.col("_last._piece")).otherwise(F.col("_last._piece") + 1)
    found = attach(placed.withColumn("_piece", piece), first, "_piece").select(*columns, name)
    none = rows.where("_v is null or _by is null").select(*columns, F.lit(None).cast(first.schema[name].dataType).alias(name))
    return found.unionByName(none)
