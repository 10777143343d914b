"""Search grids: cells of a place, cells inside its outline, finer cells."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from vitrina import defaults
from vitrina.functions.geo import crossings, inside


def _steps(low: Column, high: Column, cell: float) -> Column:
    """Indices of the cell centres from low + cell/2 up to high; null when none fit."""
    last = F.floor((high - low - F.lit(cell / 2)) / F.lit(cell) + F.lit(1e-9))
    return F.when(last >= 0, F.sequence(F.lit(0).cast("long"), last))


def _centre(low: Column, index: Column, cell: float) -> Column:
    return F.round(low + F.lit(cell / 2) + index * F.lit(cell), 6)


def grid_cells(
    places: DataFrame,
    cell: float = defaults.CELL_DEGREES,
    zoom: int = defaults.START_ZOOM,
    edges: str | None = None,
) -> DataFrame:
    """Cells of each place's box (min_lat, max_lat, min_lon, max_lon).

    With ``edges`` (array of outline edges, null for none) only cells whose
    centre lies inside the outline remain; a place without one keeps them all.
    The outline is cut once for each row of cells, not for each cell. Rows are
    only expanded, never shuffled.
    """
    own = [c for c in places.columns if c != edges]
    rows = places.withColumn(
        "_i", F.explode(_steps(F.col("min_lat"), F.col("max_lat"), cell))
    ).withColumn("lat", _centre(F.col("min_lat"), F.col("_i"), cell))
    cuts = [] if edges is None else [crossings(F.col(edges), F.col("lat")).alias("_cuts")]
    cells = (
        rows.select(*own, "lat", *cuts)
        .withColumn("_j", F.explode(_steps(F.col("min_lon"), F.col("max_lon"), cell)))
        .withColumn("lon", _centre(F.col("min_lon"), F.col("_j"), cell))
    )
    if edges is not None:
        cells = cells.where(F.col("_cuts").isNull() | inside(F.col("_cuts"), F.col("lon")))
    return cells.select(
        *own, "lat", "lon", F.lit(zoom).alias("zoom"), F.lit(float(cell)).alias("cell_deg")
    )


def within_outline(points: DataFrame, edges: Column) -> DataFrame:
    """Points (lat, lon) inside an outline given as an array of edges."""
    return points.where(inside(crossings(edges, F.col("lat")), F.col("lon")))


def children(cell: Column) -> Column:
    """The four quarter cells NW, NE, SW, SE of a cell struct, one zoom step closer."""
    half = cell["cell_deg"] / 2
    shift = half / 2

    def child(north: int, east: int) -> Column:
        return F.struct(
            (cell["lat"] + north * shift).alias("lat"),
            (cell["lon"] + east * shift).alias("lon"),
            F.least(cell["zoom"] + 1, F.lit(defaults.MAX_ZOOM)).alias("zoom"),
            half.alias("cell_deg"),
        )

    return F.array(child(1, -1), child(1, 1), child(-1, -1), child(-1, 1))


def can_divide(cell_deg: Column) -> Column:
    return cell_deg > defaults.MIN_CELL_DEGREES


def subdivide(cells: DataFrame, saturated: Column) -> DataFrame:
    """The quarter cells of the saturated cells that are not yet minimal."""
    parts = F.struct("lat", "lon", "zoom", "cell_deg")
    own = [c for c in cells.columns if c not in ("lat", "lon", "zoom", "cell_deg")]
    return (
        cells.where(saturated & can_divide(F.col("cell_deg")))
        .select(*own, F.posexplode(children(parts)).alias("part", "_child"))
        .select(*own, "part", "_child.*")
    )


def heuristic_stops(cells: DataFrame, saturated: Column) -> DataFrame:
    """Saturated cells too small to be divided."""
    return cells.where(saturated & ~can_divide(F.col("cell_deg")))


def levels(cell: float = defaults.CELL_DEGREES) -> list[float]:
    """Cell sizes from the start size down to the first that is not divided."""
    sizes = [cell]
    while sizes[-1] > defaults.MIN_CELL_DEGREES:
        sizes.append(sizes[-1] / 2)
    return sizes


def adaptive_cells(
    points: DataFrame,
    limit: int = defaults.RESULTS_PER_CELL,
    cell: float = defaults.CELL_DEGREES,
    zoom: int = defaults.START_ZOOM,
) -> DataFrame:
    """Final cells (ix, iy, level, cell_deg, zoom, n) for the density of points.

    A cell with ``limit`` points or more is divided while it may be. Points are
    counted once, in the finest cells and before the shuffle; every coarser
    level sums those counts, so a crowded cell never gathers its points.
    """
    sizes = levels(cell)
    finest = len(sizes) - 1
    parts = 2**finest
    step = F.lit(sizes[finest])
    fine = points.groupBy(
        F.floor(F.col("lat") / step).alias("iy"), F.floor(F.col("lon") / step).alias("ix")
    ).agg(F.count(F.lit(1)).alias("n"))

    def coarser(level: int) -> DataFrame:
        by = parts >> level
        return fine.groupBy(
            F.floor(F.col("iy") / by).alias("iy"), F.floor(F.col("ix") / by).alias("ix")
        ).agg(F.sum("n").alias("n"))

    full = F.col("n") >= limit
    current = coarser(0)
    done = []
    for level in range(finest + 1):
        last = level == finest
        leaf = current if last else current.where(~full)
        done.append(
            leaf.select(
                "iy", "ix", F.lit(level).alias("level"), F.lit(sizes[level]).alias("cell_deg"),
                F.lit(min(zoom + level, max(zoom, defaults.MAX_ZOOM))).alias("zoom"), "n",
            )
        )
        if not last:
            quarter = F.array(
                *[
                    F.struct((F.col("iy") * 2 + y).alias("iy"), (F.col("ix") * 2 + x).alias("ix"))
                    for y in (0, 1)
                    for x in (0, 1)
                ]
            )
            split = current.where(full).select(F.explode(quarter).alias("c")).select("c.*")
            current = split.join(coarser(level + 1), ["iy", "ix"], "left").withColumn(
                "n", F.coalesce("n", F.lit(0).cast("long"))
            )
    return reduce(DataFrame.unionByName, done)
