"""Near duplicates of embeddings by sorted projection passes."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from vitrina.llm.common import discard, keep
from vitrina.llm.components import components

COSINE = 0.9
WINDOW = 128
RECALL = 0.999
BITS = 63
SEED = 90_001
# Rows of one block of an exhaustive comparison: of a component's members, of the table.
BLOCK = 256
TABLE_BLOCK = 2048


def passes_needed(n: int, cosine: float, window: int, recall: float) -> int:
    """Passes after which a pair at the threshold was in one window with the wanted chance.

    For vectors spread evenly: in one pass two are neighbours if they share about
    log2(n / window) leading bits; each bit is shared with the chance 1 - angle / pi.
    These are the least passes; how full the prefixes are then tells how many it takes.
    """
    bits = max(math.log2(max(n, 2) / window), 1.0)
    same = (1 - math.acos(cosine) / math.pi) ** bits
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - same)))


def passes_for(caught: list[tuple[float, int]], recall: float) -> int | None:
    """Passes that leave the wanted share of pairs, from (chance in one pass, rows).

    None if no number below 2**40 is enough.
    """
    rows = sum(n for _, n in caught)

    def missed(passes: int) -> float:
        return sum(n * (1 - q) ** passes for q, n in caught)

    high = 1
    while missed(high) > (1 - recall) * rows:
        high *= 2
        if high > 1 << 40:
            return None
    low = high // 2
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (low, middle) if missed(middle) <= (1 - recall) * rows else (middle, high)
    return high


def usable(vector: Column) -> Column:
    """Not null, some component not zero, every component a finite number."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(vector, lambda x: x != 0)


def _matrix(column: pa.Array) -> np.ndarray:
    """Unit rows in double precision from a column of equally long lists of doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(len(column), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # keeps the squares from overflowing
    return x / np.linalg.norm(x, axis=1, keepdims=True)


class _Links:
    """Links of a sorted run, reduced to the ones that connect something new."""

    def __init__(self, window: int, cosine: float):
        self.window, self.cosine = window, cosine
        self.a: list[int] = []
        self.b: list[int] = []

    def run(self, ids: np.ndarray, x: np.ndarray, labels: np.ndarray, start: int) -> None:
        """Compare each row from ``start`` on with the ``window`` rows before it."""
        for lo in range(start, len(ids), 512):
            hi, base = min(lo + 512, len(ids)), max(0, lo - self.window)
            row, col = np.nonzero(x[lo:hi] @ x[base:hi].T >= self.cosine)
            row, col = row + lo, col + base
            near = (col < row) & (row - col <= self.window)
            row, col = row[near], col[near]
            each, first = np.unique(row, return_index=True)
            for r, group in zip(each, np.split(col, first[1:])):
                roots = np.unique(np.append(labels[group], labels[r]))
                for other in roots[1:]:
                    self.a.append(int(other))
                    self.b.append(int(roots[0]))
                    recent = labels[base:hi]
                    recent[recent == other] = roots[0]


def _runs(dim: np.ndarray, pass_: np.ndarray) -> list[tuple[int, int]]:
    change = np.flatnonzero((dim[1:] != dim[:-1]) | (pass_[1:] != pass_[:-1])) + 1
    edges = [0, *change.tolist(), len(dim)]
    return [(a, b) for a, b in zip(edges, edges[1:]) if a < b]


def _means(vectors: DataFrame) -> dict[int, np.ndarray]:
    """Mean unit vector of each dimension: one row per task and dimension is gathered."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        count: dict[int, int] = {}
        for batch in batches:
            dims = pa.compute.list_value_length(batch.column(0)).to_numpy(zero_copy_only=False)
            for dim in np.unique(dims).tolist():
                x = _matrix(batch.column(0).filter(pa.array(dims == dim)))
                total[dim] = total.get(dim, 0) + x.sum(axis=0)
                count[dim] = count.get(dim, 0) + len(x)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(list(total), pa.int32()),
                pa.array(list(count.values()), pa.int64()),
                pa.array([t.tolist() for t in total.values()], pa.list_(pa.float64())),
            ],
            names=["dim", "n", "total"],
        )

    total: dict[int, np.ndarray] = {}
    count: dict[int, int] = {}
    for r in vectors.select("_x").mapInArrow(summed, "dim int, n long, total array<double>").collect():
        total[r["dim"]] = total.get(r["dim"], 0) + np.array(r["total"])
        count[r["dim"]] = count.get(r["dim"], 0) + r["n"]
    # Rounded, so that the order of the sums does not matter.
    return {dim: np.round(t / count[dim], 9) for dim, t in total.items()}


def _pass_rows(vectors: DataFrame, means: dict[int, np.ndarray], first: int, last: int) -> DataFrame:
    """Every vector once per pass with its code: concatenated signs of random projections.

    What is projected is the vector's difference from the mean.
    """
    schema = "_dim int, _pass int, _code long, _id long, _x array<double>"

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[tuple[int, int], np.ndarray] = {}
        weights = np.left_shift(np.int64(1), np.arange(BITS - 1, -1, -1, dtype=np.int64))
        for batch in batches:
            dims = pa.compute.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False)
            for dim in np.unique(dims).tolist():
                rows = batch.filter(pa.array(dims == dim))
                for lo in range(0, rows.num_rows, 2000):
                    part = rows.slice(lo, 2000)
                    centred = _matrix(part.column(1)) - means[dim]
                    for p in range(first, last):
                        if (dim, p) not in planes:
                            planes[dim, p] = np.random.default_rng([SEED, dim, p]).standard_normal((dim, BITS))
                        codes = (centred @ planes[dim, p] >= 0) @ weights
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(np.full(part.num_rows, dim, np.int32)),
                                pa.array(np.full(part.num_rows, p, np.int32)),
                                pa.array(codes),
                                part.column(0),
                                part.column(1),
                            ],
                            names=["_dim", "_pass", "_code", "_id", "_x"],
                        )

    return vectors.select("_id", "_x").mapInArrow(coded, schema)


class _Fullness:
    """How likely a pass brings a pair at the threshold together, row by row in sorted order.

    A partner that shares more leading bits with a row than the rows ``window`` places
    before and after it lies between them. Each bit is shared with the chance
    1 - angle / pi, the angle being seen from the mean.
    """

    def __init__(self, window: int, cosine: float, means: dict[int, np.ndarray]):
        self.window, self.means = window, means
        self.apart = math.sqrt(2 - 2 * cosine)
        self.tail: list[np.ndarray] | None = None

    def same_bit(self, dim: int, x: np.ndarray) -> np.ndarray:
        away = np.maximum(np.linalg.norm(x - self.means[dim], axis=1), 1e-12)
        return 1 - 2 * np.arcsin(np.minimum(1, self.apart / (2 * away))) / math.pi

    def of(self, new: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and chances of the rows that have ``window`` rows on both sides by now.

        ``new`` are the next rows' dimensions, passes, codes, ids and chances of a bit.
        """
        rows = new if self.tail is None else [np.concatenate(c) for c in zip(self.tail, new)]
        self.tail = [c[-2 * self.window :] for c in rows]
        dim, pass_, code, ids, same = rows
        at = np.arange(self.window, len(ids) - self.window)
        shared = np.zeros(len(at), dtype=np.int64)
        for other in (at - self.window, at + self.window):
            run = (dim[other] == dim[at]) & (pass_[other] == pass_[at])
            differ = code[other] ^ code[at]
            # Leading bits in common: in halves, as a float of 53 bits would round up.
            high, low = differ >> 32, differ & 0xFFFFFFFF
            common = np.where(high > 0, 31 - np.frexp(high.astype(np.float64))[1], 63 - np.frexp(low.astype(np.float64))[1])
            shared = np.maximum(shared, np.where(run, common, 0))
        return ids[at], same[at] ** np.minimum(shared + 1, BITS)


def _window_links(
    coded: DataFrame, n_rows: int, window: int, cosine: float, means: dict[int, np.ndarray]
) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) between rows at most ``window`` places apart in any pass.

    Also (_id, _caught) of the rows in the passes: the chance to meet a partner.
    """
    spark = coded.sparkSession
    order = ["_dim", "_pass", "_code", "_id"]
    most = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = max(1, min(most, n_rows // (16 * window)))
    schema = "a long, b long, _edge int, _head boolean, _dim int, _pass int, _code long, _id long, _x array<double>, _caught double"
    fields = ["_dim", "_pass", "_code", "_id", "_x"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        links, tail, labels = _Links(window, cosine), None, np.empty(0, np.int64)
        fullness = _Fullness(window, cosine, means)
        heads = 0
        for batch in batches:
            if heads < window:
                yield _border(batch.slice(0, window - heads), part, True)
                heads += min(window - heads, batch.num_rows)
            kept = tail.num_rows if tail is not None else 0
            table = pa.Table.from_batches([batch] if tail is None else [tail, batch]).combine_chunks()
            ids = table.column(3).to_numpy().astype(np.int64)
            labels = np.concatenate((labels, ids[kept:]))
            same = np.zeros(len(ids))
            for lo, hi in _runs(table.column(0).to_numpy(), table.column(1).to_numpy()):
                if hi > kept:
                    x = _matrix(table.column(4).slice(lo, hi - lo).combine_chunks())
                    links.run(ids[lo:hi], x, labels[lo:hi], max(0, kept - lo))
                    same[lo:hi] = fullness.same_bit(int(table.column(0)[lo].as_py()), x)
            yield _measured(*fullness.of([*[table.column(c).to_numpy()[kept:] for c in range(3)], ids[kept:], same[kept:]]))
            tail = table.slice(max(0, table.num_rows - window)).to_batches()[0]
            labels = labels[-tail.num_rows :].copy()
            if links.a:
                yield _found(links)
        if tail is not None:
            yield _border(tail, part + 1, False)

    def _nulls(n: int, *types: pa.DataType) -> list[pa.Array]:
        return [pa.nulls(n, t) for t in types]

    def _measured(ids: np.ndarray, caught: np.ndarray) -> pa.RecordBatch:
        n = len(ids)
        before = _nulls(n, pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.int32(), pa.int32(), pa.int64())
        return pa.RecordBatch.from_arrays(
            [*before, pa.array(ids, pa.int64()), *_nulls(n, pa.list_(pa.float64())), pa.array(caught, pa.float64())],
            names=names,
        )

    def _found(links: _Links) -> pa.RecordBatch:
        n = len(links.a)
        empty = _nulls(
            n, pa.int32(), pa.bool_(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.float64()
        )
        out = pa.RecordBatch.from_arrays(
            [pa.array(links.a, pa.int64()), pa.array(links.b, pa.int64()), *empty], names=names
        )
        links.a, links.b = [], []
        return out

    def _border(rows: pa.RecordBatch, edge: int, head: bool) -> pa.RecordBatch:
        n = rows.num_rows
        return pa.RecordBatch.from_arrays(
            [pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.array(np.full(n, edge, np.int32)),
             pa.array(np.full(n, head)), *rows.columns, *_nulls(n, pa.float64())],
            names=names,
        )

    names = ["a", "b", "_edge", "_head", *fields, "_caught"]
    ranged = coded.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    scanned = keep(ranged.mapInArrow(scan, schema), "scanned")

    def across(table: pa.Table) -> pa.Table:
        """The last rows of one task and the first of the next, in order."""
        table = table.sort_by([(c, "ascending") for c in ["_head", *order]]).combine_chunks()
        links = _Links(window, cosine)
        ids = table.column("_id").to_numpy().astype(np.int64)
        for lo, hi in _runs(table.column("_dim").to_numpy(), table.column("_pass").to_numpy()):
            x = _matrix(table.column("_x").slice(lo, hi - lo).combine_chunks())
            links.run(ids[lo:hi], x, ids[lo:hi].copy(), 1)
        return pa.table({"a": pa.array(links.a, pa.int64()), "b": pa.array(links.b, pa.int64())})

    borders = scanned.where("_edge is not null").drop("a", "b", "_caught")
    between = borders.groupBy("_edge").applyInArrow(across, "a long, b long")
    links = scanned.where("a is not null").select("a", "b").unionByName(between).distinct()
    return links, scanned.where("_caught is not null").select("_id", "_caught")


def _all_links(vectors: DataFrame, n: int, cosine: float) -> DataFrame:
    """Links (a, b) that connect all linked vectors: every block of the table meets every other."""
    n_blocks = -(-n // TABLE_BLOCK)
    own = F.pmod(F.xxhash64("_id"), F.lit(n_blocks)).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))
    met = vectors.select("_id", "_x", own.alias("_own")).select("_id", "_x", "_own", other.alias("_other"))
    # Groups of one block alone are of use only if there is no second one.
    met = met.where(F.lit(n_blocks == 1) | (F.col("_own") != F.col("_other")))
    pairs = met.select(F.least("_own", "_other").alias("_one"), F.greatest("_own", "_other").alias("_two"), "_id", "_x")

    def compare(table: pa.Table) -> pa.Table:
        table = table.append_column("_dim", pa.compute.list_value_length(table.column("_x")))
        table = table.sort_by([("_dim", "ascending"), ("_id", "ascending")]).combine_chunks()
        links = _Links(table.num_rows, cosine)
        ids = table.column("_id").to_numpy().astype(np.int64)
        dims = table.column("_dim").to_numpy()
        for lo, hi in _runs(dims, dims):
            x = _matrix(table.column("_x").slice(lo, hi - lo).combine_chunks())
            links.run(ids[lo:hi], x, ids[lo:hi].copy(), 1)
        return pa.table({"a": pa.array(links.a, pa.int64()), "b": pa.array(links.b, pa.int64())})

    return pairs.groupBy("_one", "_two").applyInArrow(compare, "a long, b long").distinct()


def _links_of(vectors: DataFrame, n: int, cosine: float, window: int, recall: float) -> DataFrame:
    """Links (a, b) that connect the linked vectors, by as many passes as the wanted recall needs.

    The first passes measure how full the prefixes are. Where passes would compare more
    than all pairs, all pairs are compared.
    """
    first = passes_needed(n, cosine, window, recall)
    if first * window >= n:
        return _all_links(vectors, n, cosine)
    means = _means(vectors)
    links, caught = _window_links(_pass_rows(vectors, means, 0, first), n * first, window, cosine, means)
    rows = caught.groupBy("_id").agg(F.avg("_caught").alias("_q"))
    # At most some thousand bins of a fiftieth of a power of e; their lower ends count.
    bins = rows.groupBy(F.floor(F.log(F.greatest("_q", F.lit(1e-30))) * 50).alias("_bin")).count().collect()
    passes = passes_for([(math.exp(r["_bin"] / 50), r["count"]) for r in bins], recall)
    if passes is None or passes * window >= n:
        return _all_links(vectors, n, cosine)
    if passes <= first:
        return links
    more, _ = _window_links(_pass_rows(vectors, means, first, passes), n * (passes - first), window, cosine, means)
    return links.unionByName(more).distinct()


def _count_links(members: DataFrame, cosine: float) -> DataFrame:
    """Exact number of links of every member (_id, _x, component) inside its component.

    Members within half the threshold's angle of their component's centre are all linked
    to one another: they are counted, not compared. Each of the others is compared with
    all members, in blocks.
    """
    half = math.sqrt((1 + cosine) / 2) + 1e-9
    centres = members.where("_id = component").select("component", F.col("_x").alias("_c"))
    dot = F.aggregate(F.zip_with("_x", "_c", lambda x, c: x * c), F.lit(0.0), lambda a, v: a + v)

    def norm(v: str) -> Column:
        return F.sqrt(F.aggregate(F.col(v), F.lit(0.0), lambda a, x: a + x * x))

    placed = keep(
        members.join(centres, "component").select(
            "component", "_id", "_x", (dot / norm("_x") / norm("_c") >= half).alias("_in")
        ),
        "placed",
    )
    sizes = keep(
        placed.groupBy("component").agg(
            F.count(F.lit(1)).alias("_all"), F.sum(F.col("_in").cast("long")).alias("_inside")
        ),
        "component-sizes",
    )
    counted = placed.select("component", "_id", "_in").join(sizes, "component").select(
        "_id", F.when(F.col("_in"), F.col("_inside") - 1).otherwise(0).alias("_links")
    )
    spread = sizes.where("_all > _inside")
    rows = placed.join(spread, "component")

    def blocks(df: DataFrame, size: str, name: str) -> DataFrame:
        block = F.pmod(F.xxhash64("_id"), F.ceil(F.col(size) / BLOCK).cast("long"))
        return df.groupBy("component", block.alias(f"_block_{name}")).agg(
            F.collect_list(F.struct("_id", "_in", "_x")).alias(name)
        )

    outside = blocks(rows.where("not _in").withColumn("_n", F.col("_all") - F.col("_inside")), "_n", "_few")
    pairs = keep(outside, "blocks").join(keep(blocks(rows, "_all", "_all_rows"), "blocks"), "component")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                few, rest = batch.column(0).slice(i, 1).flatten(), batch.column(1).slice(i, 1).flatten()
                hits = _matrix(few.field("_x")) @ _matrix(rest.field("_x")).T >= cosine
                one, two = few.field("_id").to_numpy(), rest.field("_id").to_numpy()
                hits &= one[:, None] != two[None, :]
                inside = rest.field("_in").to_numpy(zero_copy_only=False).astype(bool)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate((one, two[inside]))),
                        pa.array(np.concatenate((hits.sum(axis=1), hits[:, inside].sum(axis=0))).astype(np.int64)),
                    ],
                    names=["_id", "_links"],
                )

    compared = pairs.select("_few", "_all_rows").mapInArrow(compare, "_id long, _links long")
    return counted.unionByName(compared).groupBy("_id").agg(F.sum("_links").alias("n_links"))


def near_vectors(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector: str = "embedding",
    cosine: float = COSINE,
    window: int = WINDOW,
    recall: float = RECALL,
) -> DataFrame:
    """One row per id: id, n_links, component_id, kept.

    Each pass sorts all distinct vectors by a code of the signs of their random
    projections, seen from the mean, and compares every vector with the ``window`` rows
    before it, also across tasks; the passes' confirmed links are united. There are as
    many passes as the wanted recall of a pair at the threshold needs by how full the
    codes' prefixes are; if all pairs are fewer, they are compared. ``n_links`` then counts all links inside the components, not only
    those seen in windows, so large groups are counted whole. Vectors that are null, zero
    or hold null or non-finite numbers, and null ids, link with nothing; vectors of
    different lengths do not link. Of rows that share an id one is taken, that with the
    greatest array. Extra columns are ignored; an empty table gives an empty one.
    """
    rows = keep(
        vectors.select(F.col(id_col).cast("long").alias("_id"), F.col(vector).cast("array<double>").alias("_x"))
        .groupBy("_id").agg(F.max("_x").alias("_x")),
        "vectors",
    )
    good = rows.where(usable(F.col("_x")) & F.col("_id").isNotNull())
    n = good.count()
    ids = rows.select(F.col("_id").alias(id_col))
    if not n:
        return ids.select(
            id_col, F.lit(0).cast("long").alias("n_links"), F.col(id_col).alias("component_id"),
            F.lit(True).alias("kept"),
        )
    # Equal vectors take part once: copies would fill the windows.
    classes = keep(good.groupBy("_x").agg(F.min("_id").alias("_first")), "distinct")
    single = classes.select(F.col("_first").alias("_id"), "_x")
    links = _links_of(single, single.count(), cosine, window, recall)
    copies = good.join(classes, "_x").where("_id != _first").select(F.col("_id").alias("a"), F.col("_first").alias("b"))
    found = keep(components(links.unionByName(copies)), "components")
    members = keep(good.join(found.withColumnRenamed("node", "_id"), "_id"), "members")
    counts = _count_links(members, cosine)
    joined = rows.select("_id").join(members.select("_id", "component").join(counts, "_id", "left"), "_id", "left")
    component = F.coalesce("component", "_id")
    return joined.select(
        F.col("_id").alias(id_col),
        F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        component.alias("component_id"),
        component.eqNullSafe(F.col("_id")).alias("kept"),
    )
