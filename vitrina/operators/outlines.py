"""Which outlines of a table each point lies in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from vitrina.functions.geo import crossings, inside
from vitrina.operators.durable import keep
from vitrina.operators.slabs import count_by_slabs

# Cells along the longer side of an outline's box, at least; sides are 2 ** -level degrees.
CELLS = 32
COARSEST, FINEST = -8, 20
# Edges of a strip that its cells bring along.
AT_HAND = 64
_AT = ["_level", "_iy", "_ix"]


def points_in_outlines(points: DataFrame, outlines: DataFrame, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """One row per point and outline around it: the point's columns and ``outline``.

    ``outlines`` has outline (unique) and edges (array<struct<x1, y1, x2, y2>> over all rings and
    parts, as ``read_outlines`` gives them). Every outline's box is cut into cells of a size that
    fits it, 32 to 64 along its longer side. Cells that no edge touches lie wholly inside or
    outside: points in those inside are answered without an edge. The edges are binned in strips
    one cell high; a point in any other cell tests its strip's edges alone. Points meet cells by
    an equi-join, once for each cell size in use, so neither side has to be small. Cells bring
    their edges along, so that what the join makes is not shuffled; only where a strip has more
    than ``AT_HAND`` edges are they looked up after it.

    Points without coordinates and outlines without edges give no rows; whether a point exactly
    on an edge is inside is not defined. Repeated points are rows of their own. Runs jobs
    while the plan is built.
    """
    strips, cells = _binned(outlines)
    levels = _levels(cells)
    if not levels:
        return points.join(outlines.select("outline").limit(0), F.lit(False))
    placed = _placed(points, levels, lat, lon)
    whole = placed.join(cells.where("whole").select(*_AT, "outline"), _AT)
    cut = _cut(placed, strips, cells, lat, lon)
    return whole.select(*points.columns, "outline").unionByName(cut.select(*points.columns, "outline"))


def count_in_outlines(points: DataFrame, outlines: DataFrame, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """outline, n: points inside each outline, 0 for those without any.

    No pair of a point and an outline is made but where an edge passes close by: see
    ``count_by_slabs``. Rows that share an outline are one, each with its number; runs jobs.
    """
    each = outlines.where("outline is not null").groupBy("outline").agg(F.flatten(F.collect_list("edges")).alias("edges"))
    numbered = keep(each.withColumn("number", F.monotonically_increasing_id()), "outlines")
    whole = numbered.select("number", F.filter("edges", lambda e: e.isNotNull()).alias("edges"))
    places = points.select(F.col(lat).cast("double").alias("lat"), F.col(lon).cast("double").alias("lon"))
    places = places.where("lat is not null and lon is not null and not isnan(lat) and not isnan(lon)")
    n = count_by_slabs(places, whole).join(numbered.select("outline", "number"), "number").select("outline", "n")
    return outlines.select("outline").join(n, "outline", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def _levels(cells: DataFrame) -> list[int]:
    """At most one number for each cell size."""
    return sorted(r["_level"] for r in cells.select("_level").distinct().collect())


def _placed(points: DataFrame, levels: list[int], lat: str, lon: str) -> DataFrame:
    """Each point once for every cell size, with the cell it lies in."""
    at = F.array(*[
        F.struct(F.lit(v).alias("level"), _cell(F.col(lat), v).alias("iy"), _cell(F.col(lon), v).alias("ix"))
        for v in levels
    ])
    located = points.where(F.col(lat).isNotNull() & F.col(lon).isNotNull()).select("*", F.explode(at).alias("_at"))
    return located.select(*points.columns, *[F.col(f"_at.{c[1:]}").alias(c) for c in _AT])


def _cut(placed: DataFrame, strips: DataFrame, cells: DataFrame, lat: str, lon: str) -> DataFrame:
    """The points that lie inside an outline, in cells that its edges touch."""
    touched = cells.where("not whole")

    def within(met: DataFrame) -> DataFrame:
        return met.where(inside(crossings(F.col("_edges"), F.col(lat)), F.col(lon))).drop("_edges")

    light = touched.where("edges is not null").select(*_AT, "outline", F.col("edges").alias("_edges"))
    found = within(placed.join(light, _AT))
    heavy = touched.where("edges is null").select(*_AT, "outline")
    if heavy.isEmpty():
        return found
    own = strips.where(F.size("edges") > AT_HAND).select(
        "outline", F.col("level").alias("_level"), F.col("iy").alias("_iy"), F.col("edges").alias("_edges")
    )
    far = within(placed.join(heavy, _AT).join(own, ["outline", "_level", "_iy"]))
    return found.unionByName(far.select(*found.columns))


def _cell(degrees: Column, level: int) -> Column:
    return F.floor(degrees * 2.0**level)


def _binned(outlines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Strips (outline, level, iy, edges) and cells (outline, _level, _iy, _ix, whole, edges) of all outlines.

    Cells that are not whole have their strip's edges, or null where these are more than ``AT_HAND``.
    """
    edges = keep(outlines.select("outline", F.explode("edges").alias("e")).select("outline", "e.*"), "edges")
    x, y = (F.least("x1", "x2"), F.greatest("x1", "x2")), (F.least("y1", "y2"), F.greatest("y1", "y2"))
    boxes = edges.groupBy("outline").agg(
        F.min(x[0]).alias("west"), F.max(x[1]).alias("east"), F.min(y[0]).alias("south"), F.max(y[1]).alias("north")
    )
    span = F.greatest(F.col("east") - F.col("west"), F.col("north") - F.col("south"), F.lit(1e-9))
    level = F.least(F.greatest(F.ceil(F.log2(F.lit(float(CELLS)) / span)), F.lit(COARSEST)), F.lit(FINEST)).cast("int")
    boxes = keep(boxes.withColumn("level", level).withColumn("scale", F.pow(F.lit(2.0), F.col("level"))), "boxes")

    def cell(c: Column) -> Column:
        return F.floor(c * F.col("scale"))

    # Every strip that an edge touches, and the part of it there.
    spread = edges.join(boxes, "outline").select(
        "outline", "level", "scale", "x1", "y1", "x2", "y2", "west", "east",
        F.explode(F.sequence(cell(y[0]), cell(y[1]))).alias("iy"),
    )
    low, high = F.col("iy") / F.col("scale"), (F.col("iy") + 1) / F.col("scale")

    def x_at(edge_lat: Column) -> Column:
        flat = F.col("y1") == F.col("y2")
        slope = (F.col("x2") - F.col("x1")) / F.when(~flat, F.col("y2") - F.col("y1"))
        return F.col("x1") + (edge_lat - F.col("y1")) * slope

    at_low, at_high = x_at(F.greatest(low, y[0])), x_at(F.least(high, y[1]))
    # A cell more at either end, as the cut is rounded.
    margin = 1e-9 / F.col("scale")
    begin = F.greatest(x[0], F.least(at_low, at_high) - margin)
    end = F.least(x[1], F.greatest(at_low, at_high) + margin)
    flat = F.col("y1") == F.col("y2")
    touched = F.sequence(cell(F.when(flat, x[0]).otherwise(begin)), cell(F.when(flat, x[1]).otherwise(end)))
    binned = spread.withColumn("touched", touched)
    strips = keep(
        binned.groupBy("outline", "level", "scale", "iy", "west", "east").agg(
            F.collect_list(F.struct("x1", "y1", "x2", "y2")).alias("edges"),
            F.array_distinct(F.flatten(F.collect_set("touched"))).alias("touched"),
        ),
        "strips",
    )
    middle = (F.col("iy") + 0.5) / F.col("scale")
    cut = strips.withColumn("cuts", crossings(F.col("edges"), middle))
    across = F.sequence(cell(F.col("west")), cell(F.col("east")))
    whole = F.filter(
        F.array_except(across, F.col("touched")), lambda i: inside(F.col("cuts"), (i + 0.5) / F.col("scale"))
    )
    marked = F.concat(
        F.transform("touched", lambda i: F.struct(i.alias("ix"), F.lit(False).alias("whole"))),
        F.transform(whole, lambda i: F.struct(i.alias("ix"), F.lit(True).alias("whole"))),
    )
    near = F.when(F.size("edges") <= AT_HAND, F.col("edges"))
    cells = cut.select("outline", "level", "iy", near.alias("edges"), F.explode(marked).alias("c")).select(
        "outline", F.col("level").alias("_level"), F.col("iy").alias("_iy"), F.col("c.ix").alias("_ix"), "c.whole",
        F.when(~F.col("c.whole"), F.col("edges")).alias("edges"),
    )
    return strips.select("outline", "level", "iy", "edges"), keep(cells, "cells")
