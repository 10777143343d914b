"""Numbers of points inside outlines, by bands of points that lie in slabs, each in order from west to east."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from vitrina.operators.durable import discard, keep

# Points of a slab: the root of all points, this at least; slabs of a band.
SLAB = 128
SLABS = 32
# Edges that are dealt to bands at once, and that a task takes for one band; tests made at once.
EDGES = 1_000_000
TESTS = 2_000_000


def count_by_slabs(places: DataFrame, outlines: DataFrame) -> DataFrame:
    """number, n: places (lat, lon: double, no nulls) inside each outline (number, edges), if any.

    Points are cut by latitude into bands of some points each, so a crowded place has narrower
    ones, and an outline's edges go to the bands they pass. A task cuts its band into slabs whose points
    lie in order from west to east. Where an edge passes a slab, only the points between its most
    western and most eastern place there are tested, against the outline's edges; all others are
    counted by their place in that order. With n points an edge costs the root of n look-ups and
    about as many tests. A band with too many points (of one latitude) or edges is dealt to
    several tasks.
    """
    total = places.count()
    slab = max(SLAB, int(total**0.5))
    most = slab * SLABS
    n_bands = -(-total // most)
    bounds = np.empty(0)
    if n_bands > 1:
        shares = [i / n_bands for i in range(1, n_bands)]
        cut = places.agg(F.percentile_approx("lat", shares, 20 * n_bands)).first()[0]
        bounds = np.unique(np.array(cut))
    points = keep(_points_of_bands(places, bounds), "points-of-bands")
    edges = keep(_edges_of_bands(outlines, bounds), "edges-of-bands")
    # One row for each band; there are about as many as the root of the points by SLABS.
    counts = points.groupBy("band").agg(F.sum("n").alias("n_points")).join(
        edges.groupBy("band").agg(F.sum("n").alias("n_edges")), "band"
    ).select("band", F.ceil(F.col("n_points") / (2 * most)).alias("chunks"), F.ceil(F.col("n_edges") / EDGES).alias("parts"))
    counts = keep(counts, "counts-of-bands")

    def dealt(rows: DataFrame, own: str, other: str) -> DataFrame:
        mine = F.pmod(F.xxhash64("row"), F.col(own)).alias(own)
        met = rows.join(counts, "band").select("band", "data", mine, F.sequence(F.lit(0).cast("long"), F.col(other) - 1).alias("every"))
        return met.select("band", "data", own, F.explode("every").alias(other))

    def counted(left: pa.Table, right: pa.Table) -> pa.Table:
        numbers, n = np.empty(0, np.int64), np.empty(0, np.int64)
        if left.num_rows and right.num_rows:
            at = _joined(left, [("lat", "<f8"), ("lon", "<f8")])
            numbers, n = inside_counts(at["lat"], at["lon"], _joined(right, _EDGE), slab)
        return pa.table({"number": pa.array(numbers, pa.int64()), "n": pa.array(n, pa.int64())})

    key = ["band", "chunks", "parts"]
    groups = dealt(points, "chunks", "parts").groupBy(*key).cogroup(dealt(edges, "parts", "chunks").groupBy(*key))
    result = keep(groups.applyInArrow(counted, "number long, n long").groupBy("number").agg(F.sum("n").alias("n")), "counted")
    discard(points, edges, counts)
    return result


_EDGE = [("number", "<i8"), ("x1", "<f8"), ("y1", "<f8"), ("x2", "<f8"), ("y2", "<f8")]
_ROWS = "band int, row long, n long, data binary"


def _joined(table: pa.Table, kind: list) -> np.ndarray:
    return np.concatenate([np.frombuffer(v.as_buffer(), dtype=kind) for c in table.column("data").chunks for v in c])


def _packed(band: np.ndarray, rows: np.ndarray, row: int) -> pa.RecordBatch:
    """One row for each band, with its part of ``rows``."""
    order = np.argsort(band, kind="stable")
    band, rows = band[order], rows[order]
    cuts = np.flatnonzero(np.diff(band, prepend=-1))
    ends = np.append(cuts[1:], len(band))[: len(cuts)]
    data = [rows[lo:hi].tobytes() for lo, hi in zip(cuts.tolist(), ends.tolist())]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(band[cuts], pa.int32()), pa.array(np.full(len(cuts), row), pa.int64()),
            pa.array(ends - cuts, pa.int64()), pa.array(data, pa.binary()),
        ],
        names=["band", "row", "n", "data"],
    )


def _points_of_bands(places: DataFrame, bounds: np.ndarray) -> DataFrame:
    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 32
        for batch in batches:
            rows = np.empty(batch.num_rows, dtype=[("lat", "<f8"), ("lon", "<f8")])
            rows["lat"], rows["lon"] = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if len(rows):
                yield _packed(np.searchsorted(bounds, rows["lat"], side="right").astype(np.int32), rows, row)
            row += 1

    return places.select("lat", "lon").mapInArrow(packed, _ROWS)


def _edges_of_bands(outlines: DataFrame, bounds: np.ndarray) -> DataFrame:
    """Edges in the bands they pass; all that an outline has in a band lie in one row."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 32
        for batch in batches:
            lists, flat = batch.column(1), batch.column(1).flatten()
            edges = np.empty(len(flat), dtype=_EDGE)
            size = np.diff(lists.offsets.to_numpy())
            edges["number"] = np.repeat(batch.column(0).to_numpy(), size)
            for name in ("x1", "y1", "x2", "y2"):
                edges[name] = flat.field(name).cast(pa.float64()).to_numpy(zero_copy_only=False)
            # Those without all numbers are none.
            edges = edges[~np.isnan(sum(edges[c] for c in ("x1", "y1", "x2", "y2")))]
            low = np.searchsorted(bounds, np.minimum(edges["y1"], edges["y2"]), side="right")
            times = np.searchsorted(bounds, np.maximum(edges["y1"], edges["y2"]), side="right") - low + 1
            # Whole outlines at a time, of about so many edges and bands.
            share = np.cumsum(times) // EDGES
            first = np.flatnonzero(np.diff(edges["number"], prepend=edges["number"][:1] - 1)) if len(edges) else np.empty(0, np.int64)
            cuts = first[np.flatnonzero(np.diff(share[first], prepend=-1))].tolist()
            for lo, hi in zip(cuts, [*cuts[1:], len(edges)]):
                n = times[lo:hi]
                nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                yield _packed((np.repeat(low[lo:hi], n) + nth).astype(np.int32), np.repeat(edges[lo:hi], n), row)
                row += 1

    return outlines.select("number", "edges").mapInArrow(packed, _ROWS)


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which range each number belongs to, and the numbers of all ranges, from ``starts`` on."""
    which = np.repeat(np.arange(len(sizes)), sizes)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(sizes) - sizes - starts, sizes)


def inside_counts(lat: np.ndarray, lon: np.ndarray, edges: np.ndarray, slab: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the outlines that ``edges`` belong to, and how many of the points lie in each."""
    edges = edges[np.argsort(edges["number"], kind="stable")]
    numbers, of = np.unique(edges["number"], return_inverse=True)
    out = np.zeros(len(numbers), dtype=np.int64)
    low, high = np.minimum(edges["y1"], edges["y2"]), np.maximum(edges["y1"], edges["y2"])
    order = np.argsort(lat, kind="stable")
    for at in range(0, len(order), slab):
        own = order[at : at + slab]
        bottom, top = lat[own[0]], lat[own[-1]]
        own = own[np.argsort(lon[own], kind="stable")]
        met = np.flatnonzero((low <= top) & (high >= bottom))
        if len(met):
            _add_slab(out, lat[own], lon[own], edges[met], of[met], bottom, top)
    return numbers, out


def _crossing(edges: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Longitude where each edge, or the line it lies on, is at a latitude; as ``geo.crossings`` has it."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return edges["x1"] + (y - edges["y1"]) * (edges["x2"] - edges["x1"]) / (edges["y2"] - edges["y1"])


def _add_slab(
    out: np.ndarray, y: np.ndarray, x: np.ndarray, edges: np.ndarray, of: np.ndarray, bottom: float, top: float
) -> None:
    """Add the points of one slab, ascending by ``x``, to their outlines' numbers.

    Where no edge of an outline is, all points of a slab between two of its edges are inside or all
    are outside, as they would be at the latitude ``middle``. All are counted like that; then
    the points that an edge passes by are put right one by one.
    """
    middle = bottom + (top - bottom) / 2
    crosses = (edges["y1"] > middle) != (edges["y2"] > middle)
    cut = np.where(crosses, _crossing(edges, middle), -np.inf)
    before = np.searchsorted(x, cut, side="left")
    by = np.lexsort((-cut, of))
    begins = np.flatnonzero(np.diff(of, prepend=-1))
    degree = np.diff(np.append(begins, len(of)))
    nth = np.arange(len(of)) - np.repeat(begins, degree)
    sign = 1 - 2 * (nth & 1)
    np.add.at(out, of[by], sign * before[by])

    low, high = np.minimum(edges["y1"], edges["y2"]), np.maximum(edges["y1"], edges["y2"])
    # A level edge crosses no parallel, but parts the slab.
    level = low == high
    ends = [
        np.where(level, edges[end], _crossing(edges, y_at))
        for end, y_at in (("x1", np.maximum(low, bottom)), ("x2", np.minimum(high, top)))
    ]
    margin = 1e-9 * (np.abs(edges["x1"]) + np.abs(edges["x2"]))
    first = np.searchsorted(x, np.minimum(*ends) - margin, side="left")
    last = np.searchsorted(x, np.maximum(*ends) + margin, side="right")
    # Ranges of points that edges pass by; those of one outline are made not to overlap.
    group = np.repeat(np.arange(len(begins)), degree)
    base = group * (len(x) + 1)
    by = np.argsort(base + first, kind="stable")
    start, stop = (base + first)[by], np.maximum.accumulate((base + last)[by])
    start[1:] = np.maximum(start[1:], stop[:-1])
    size = np.maximum(stop - start, 0)
    some = size > 0
    start, size, group = (start - base[by])[some], size[some], group[by][some]
    work = np.cumsum(size * degree[group])
    cuts = np.flatnonzero(np.diff(work // TESTS, prepend=-1)).tolist()
    for lo, hi in zip(cuts, [*cuts[1:], len(size)]):
        which, point = _ranges(start[lo:hi], size[lo:hi])
        own = group[lo:hi][which]
        pair, edge = _ranges(begins[own], degree[own])
        e, py, px = edges[edge], y[point][pair], x[point][pair]
        east = ((e["y1"] > py) != (e["y2"] > py)) & (px < _crossing(e, py))
        firsts = np.cumsum(degree[own]) - degree[own]
        exact = np.add.reduceat(east, firsts, dtype=np.int64) & 1
        rough = np.add.reduceat(px < cut[edge], firsts, dtype=np.int64) & 1
        np.add.at(out, of[begins[own]], exact - rough)
