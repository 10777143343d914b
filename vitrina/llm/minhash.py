"""Near duplicates of documents by a chosen-path set similarity join."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from vitrina.llm.blocks import Blocks
from vitrina.llm.common import discard, keep
from vitrina.llm.components import components
from vitrina.llm.shingles import Shingler, text_slices

# Links: 100 * intersection >= PERCENT * union.
PERCENT = 75
# Minwise tokens per document, four bytes each, so that few documents share one by chance;
# their last two bits make the sketch, 32 to a long. Of a pair at the threshold 13 of 16 of those agree on average, and fewer than
# LEAST_EQUAL with a chance of about one in 100,000.
TOKENS = 128
LEAST_EQUAL = 85
SKETCH = ["s0", "s1", "s2", "s3"]
ODD = np.uint64(0x5555555555555555)
# Independent trees. A node chooses 4/3 tokens on average (1 / 0.75), so that a linked
# pair has at least one common child on average; a pair at the threshold that takes three
# levels to get into a small node is missed by all trees with a chance of about 1e-4.
TREES = 10
# A small node holds at most FEW * FEW documents: all its pairs are looked at in one task. A node with
# several components is compared on whole sets when its documents outside the largest component have at
# most the pairs of a small node with all its documents, and at most HASHES shingles; else it branches.
FEW = 64
# Documents of the largest component come in parts of at most PART, or of about HASHES shingles.
PART = 4_096
HASHES = 2_000_000
# Pairs per document up to which a small node yields all of them instead of a forest of the likeliest.
SPARSE = 2
# Documents that a level's larger nodes share among them to compare the others with first.
PIVOTS = 4
SEED = 40_009


def document_keys(blocks: Blocks, id_col: str, text: str) -> DataFrame:
    """One row per row: _row, _id, n_shingles, _key (16 bytes, equal for equal sets; null for empty ones)."""
    rows = blocks.rows(_id=id_col, _text=text).select("row", "_id", F.col("_text").cast("string").alias("_text"))
    schema = f"_row long, _id {dict(rows.dtypes)['_id']}, n_shingles long, _key binary"

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for batch in batches:
            for lo, hi, data, ends in text_slices(batch.column(2)):
                found, sizes = shingler.sets(data, ends)
                own = [found[e - n : e] for e, n in zip(np.cumsum(sizes), sizes)]
                keys = [hashlib.blake2b(x.tobytes(), digest_size=16).digest() if len(x) else None for x in own]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo),
                        pa.array(sizes), pa.array(keys, pa.binary()),
                    ],
                    names=["_row", "_id", "n_shingles", "_key"],
                )

    return rows.mapInArrow(keyed, schema)


def document_sets(blocks: Blocks, wanted: DataFrame, text: str, tokens: int = TOKENS) -> DataFrame:
    """One row per wanted row (_row) with a set: _row, n_shingles, _tokens, s0 to s3.

    ``_tokens`` are the minwise tokens, one hash function each. They are made where the texts lie.
    """
    schema = "_row long, n_shingles long, _tokens binary" + "".join(f", {s} long" for s in SKETCH)
    factors = np.random.default_rng(SEED).integers(0, 2**64, tokens, dtype=np.uint64) | np.uint64(1)

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for batch in batches:
            for lo, hi, data, ends in text_slices(batch.column(1)):
                found, sizes = shingler.sets(data, ends)
                full = np.flatnonzero(sizes)
                if not len(full):
                    continue
                starts = np.concatenate(([0], np.cumsum(sizes[full])[:-1]))
                least = np.empty((len(full), tokens), dtype=np.uint32)
                for k, factor in enumerate(factors):
                    # The high bits of a minimum are small numbers; those in the middle are even.
                    least[:, k] = np.minimum.reduceat(found * factor, starts) >> np.uint64(16)
                pairs_of_bits = (least & 3).astype(np.uint64).reshape(len(full), len(SKETCH), 32)
                sketch = (pairs_of_bits << np.arange(0, 64, 2, dtype=np.uint64)).sum(axis=2, dtype=np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, hi - lo).take(pa.array(full)), pa.array(sizes[full]),
                        pa.array([x.tobytes() for x in least], pa.binary()),
                        *[pa.array(np.ascontiguousarray(c).view(np.int64)) for c in sketch.T],
                    ],
                    names=["_row", "n_shingles", "_tokens", *SKETCH],
                )

    some = blocks.some(wanted.select(F.col("_row").alias("row")), _text=text)
    return some.select("row", F.col("_text").cast("string").alias("_text")).mapInArrow(signed, schema)


def _full_sets(blocks: Blocks, wanted: DataFrame, text: str) -> DataFrame:
    """Whole sets (sorted 8-byte hashes) of the wanted rows (_row)."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for batch in batches:
            for lo, hi, data, ends in text_slices(batch.column(1)):
                found, sizes = shingler.sets(data, ends)
                own = [found[e - n : e].tobytes() for e, n in zip(np.cumsum(sizes), sizes)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(own, pa.binary())], names=["_row", "_set"]
                )

    some = blocks.some(wanted.select(F.col("_row").alias("row")), _text=text)
    return some.select("row", F.col("_text").cast("string").alias("_text")).mapInArrow(whole, "_row long, _set binary")


def _linked(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two whole sets meet the threshold."""
    if 100 * min(len(x), len(y)) < PERCENT * max(len(x), len(y)):
        return False
    merged = np.concatenate((x, y))
    merged.sort(kind="stable")
    common = int((merged[1:] == merged[:-1]).sum())
    return 100 * common >= PERCENT * (len(merged) - common)


def _whole_sets(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(s.as_buffer(), dtype=np.uint64) for s in column]


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose whole sets meet the threshold."""
    both = pairs.join(sets.select(F.col("_row").alias("a"), F.col("_set").alias("_a")), "a").join(
        sets.select(F.col("_row").alias("b"), F.col("_set").alias("_b")), "b"
    ).select("a", "b", "_a", "_b")

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = zip(_whole_sets(batch.column(2)), _whole_sets(batch.column(3)))
            hits = pa.array([_linked(x, y) for x, y in ends], pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).filter(hits), batch.column(1).filter(hits)], names=["a", "b"]
            )

    return both.mapInArrow(linked, "a long, b long")


def _near(other: str) -> Column:
    """Whether a document's sketch and size are near those of the one in the struct column."""
    differ = F.lit(0)
    for c in SKETCH:
        x = F.col(c).bitwiseXOR(F.col(f"{other}.{c}"))
        differ = differ + F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(int(ODD))))
    n, m = F.col("n_shingles"), F.col(f"{other}.n_shingles")
    return (differ <= TOKENS - LEAST_EQUAL) & (100 * F.least(n, m) >= PERCENT * F.greatest(n, m))


def _differ(sketch: np.ndarray, size: np.ndarray, i: np.ndarray | int) -> np.ndarray:
    """In how many tokens all documents differ from the i-th (or each of some); 255 if in too many, or too unlike in size."""
    x = sketch[i][..., None, :] ^ sketch
    differ = np.bitwise_count((x | (x >> np.uint64(1))) & ODD).sum(axis=-1, dtype=np.uint8)
    n = size[i][..., None]
    differ[(100 * np.minimum(size, n) < PERCENT * np.maximum(size, n)) | (differ > TOKENS - LEAST_EQUAL)] = 255
    return differ


def _sketches(table: pa.Table) -> np.ndarray:
    return np.stack([table[c].to_numpy() for c in SKETCH], axis=1).view(np.uint64)


def _forest(differ: np.ndarray, group: np.ndarray) -> list[tuple[int, int]]:
    """Pairs that join all that likely pairs can join, the likeliest ones; equal groups are joined already."""
    n = len(differ)
    near = np.full(n, 255, dtype=np.uint8)
    source = np.zeros(n, dtype=np.int64)
    out = np.ones(n, dtype=bool)
    found = []
    for _ in range(n):
        v = int(np.argmin(np.where(out, near, 255)))
        if not out[v]:
            v = int(np.argmax(out))
        if near[v] < 255 and group[v] != group[source[v]]:
            found.append((int(source[v]), v))
        out[v] = False
        own = np.where(group == group[v], 0, differ[v])
        nearer = own < near
        near[nearer] = own[nearer]
        source[nearer] = v
    return found


def _likely(members: DataFrame) -> DataFrame:
    """Likely links (a, b) of small nodes; where they are many, a forest of them and the node's documents.

    ``members`` has node, _row, component, n_shingles, s0 to s3. All pairs of a node whose documents are in
    different components are looked at. The documents (node, a, n_shingles, s0 to s3; b is null) are those
    with such a pair.
    """
    names = ["a", "b", "node", "n_shingles", *SKETCH]

    def compared(table: pa.Table) -> pa.RecordBatch:
        node, row, component, size = [table[c].to_numpy() for c in ("node", "_row", "component", "n_shingles")]
        sketch = _sketches(table)
        starts = np.concatenate(([0], np.flatnonzero(node[1:] != node[:-1]) + 1))
        counts = np.diff(np.append(starts, len(node)))
        one = starts[counts == 2]
        x = sketch[one] ^ sketch[one + 1]
        agree = np.bitwise_count((x | (x >> np.uint64(1))) & ODD).sum(axis=1) <= TOKENS - LEAST_EQUAL
        agree &= 100 * np.minimum(size[one], size[one + 1]) >= PERCENT * np.maximum(size[one], size[one + 1])
        one = one[agree & (component[one] != component[one + 1])]
        pairs, dense = [np.stack([one, one + 1], axis=1)], [np.empty(0, dtype=np.int64)]
        for lo, n in zip(starts[counts > 2], counts[counts > 2]):
            own = slice(lo, lo + n)
            differ = np.concatenate(
                [_differ(sketch[own], size[own], np.arange(k, min(k + 64, n))) for k in range(0, n, 64)]
            )
            _, group = np.unique(component[own], return_inverse=True)
            likely = differ < 255
            for k in range(0, n, 64):
                likely[k : k + 64] &= group[k : k + 64, None] != group
            if likely.sum() <= 2 * SPARSE * n:
                a, b = np.nonzero(likely)
                pairs.append(lo + np.stack([a, b], axis=1)[a < b])
            else:
                pairs.append(lo + np.array(_forest(differ, group), dtype=np.int64).reshape(-1, 2))
                dense.append(lo + np.flatnonzero(likely.any(axis=1)))
        ends, dense = row[np.concatenate(pairs)], np.concatenate(dense)
        none = pa.nulls(len(ends), pa.int64())
        columns = [pa.array(ends.min(axis=1)), pa.array(ends.max(axis=1)), *[none] * 6]
        whole = [row[dense], None, node[dense], size[dense], *[table[c].to_numpy()[dense] for c in SKETCH]]
        whole = [pa.nulls(len(dense), pa.int64()) if c is None else pa.array(c) for c in whole]
        return pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in zip(columns, whole)], names=names)

    def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The last node of a batch may go on in the next one.
        rest = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            table = (table if rest is None else pa.concat_tables([rest, table])).combine_chunks()
            node = table["node"].to_numpy()
            last = int(np.flatnonzero(np.append(True, node[1:] != node[:-1]))[-1])
            if last:
                yield compared(table.slice(0, last))
            rest = table.slice(last)
        if rest is not None:
            yield compared(rest)

    columns = members.select("node", "_row", "component", "n_shingles", *SKETCH)
    return columns.repartition("node").sortWithinPartitions("node").mapInArrow(nodes, ", ".join(f"{c} long" for c in names))


def _partners(table: pa.Table) -> Iterator[tuple[int, np.ndarray]]:
    """For every document outside the largest component: its place, and others' places.

    Others are those of other components whose sketches agree enough, likeliest first.
    """
    component, size = [table[c].to_numpy() for c in ("component", "n_shingles")]
    sketch = _sketches(table)
    for i in np.flatnonzero(component != table["_main"][0].as_py()):
        differ = _differ(sketch, size, i)
        others = np.flatnonzero((differ < 255) & (component != component[i]))
        yield i, others[np.argsort(differ[others], kind="stable")]


def _involved(few: DataFrame) -> DataFrame:
    """Documents that agree with one of another component of their node in enough tokens.

    Documents outside the largest component meet all others; those inside it are dealt
    to parts, and those outside go to each part. A task sees one part at a time.
    """
    parts = F.greatest(F.ceil(F.col("_all") / PART), F.ceil(F.col("_hashes") / HASHES)).cast("int")
    inside = F.array(F.pmod(F.xxhash64("_row"), parts).cast("int"))
    chosen = F.when(F.col("component") == F.col("_main"), inside).otherwise(F.sequence(F.lit(0), parts - 1))
    dealt = few.select(
        "node", "_row", "component", "_main", "n_shingles", *SKETCH, F.explode(chosen).alias("part")
    )

    def alike(table: pa.Table) -> pa.Table:
        found = np.zeros(table.num_rows, dtype=bool)
        for i, others in _partners(table.combine_chunks()):
            found[others] = True
            found[i] |= len(others) > 0
        return table.filter(pa.array(found))

    return dealt.groupBy("node", "part").applyInArrow(alike, dealt.schema)


def _spanning(involved: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b), confirmed on whole sets, that join the components met in each part.

    Every pair that agrees in enough tokens is looked at, likeliest first, unless links
    found in the part have joined its components already.
    """

    def joined(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        row, component = [table[c].to_numpy() for c in ("_row", "component")]
        whole = _whole_sets(table["_set"].combine_chunks())
        size = np.array([len(x) for x in whole])
        begins = np.concatenate(([0], np.cumsum(size)))
        _, hashes = np.unique(np.concatenate(whole), return_inverse=True)
        held = np.zeros(hashes.max() + 1, dtype=np.int64)
        _, group = np.unique(component, return_inverse=True)
        found = []
        for i, others in _partners(table):
            own = hashes[begins[i] : begins[i + 1]]
            held[own] = 1
            for lo in range(0, len(others), FEW):
                some = others[lo : lo + FEW]
                some = some[group[some] != group[i]]
                if not len(some):
                    continue
                # The hashes of some sets after one another: how many of each are the document's.
                ends = np.cumsum(size[some])
                at = np.arange(ends[-1]) + np.repeat(begins[some] - ends + size[some], size[some])
                common = np.add.reduceat(held[hashes[at]], ends - size[some])
                for j in some[100 * common >= PERCENT * (size[i] + size[some] - common)]:
                    if group[i] != group[j]:
                        group[group == group[j]] = group[i]
                        found.append((row[i], row[j]))
            held[own] = 0
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})

    return involved.join(sets, "_row").groupBy("node", "part").applyInArrow(joined, "a long, b long")


def _branch(members: DataFrame) -> DataFrame:
    """Children of every node: one token chosen by the node, and a second one a third of the time."""
    first = F.pmod(F.xxhash64("node", F.lit(1)), F.lit(TOKENS)).cast("int")
    second = F.pmod(first + 1 + F.pmod(F.xxhash64("node", F.lit(2)), F.lit(TOKENS - 1)), F.lit(TOKENS)).cast("int")
    twice = F.pmod(F.xxhash64("node", F.lit(3)), F.lit(PERCENT)) < 100 - PERCENT
    chosen = F.when(twice, F.array(first, second)).otherwise(F.array(first))
    picked = members.select("_row", "node", "_tokens", "n_shingles", *SKETCH, F.explode(chosen).alias("_at"))
    token = F.substring(F.col("_tokens"), F.col("_at") * 4 + 1, F.lit(4))
    return picked.select("_row", "n_shingles", *SKETCH, F.xxhash64("node", "_at", token).alias("node"))


def _near_pivots(members: DataFrame, level: int) -> DataFrame:
    """Likely links (a, b) of larger nodes' documents with one of each node.

    A level's nodes use few orders of the documents, so that nodes with the same
    documents have few pivots among them, and other levels have others.
    """
    by = F.xxhash64(F.lit(level), F.pmod("node", F.lit(PIVOTS)), "_row")
    pivots = members.groupBy("node").agg(F.min_by(F.struct("_row", "component", "n_shingles", *SKETCH), by).alias("_pivot"))
    near = members.join(pivots, "node").where(_near("_pivot") & (F.col("component") != F.col("_pivot.component")))
    return near.select(F.least("_pivot._row", "_row").alias("a"), F.greatest("_pivot._row", "_row").alias("b"))


def _labelled(members: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Members with their component, the least row known to be reachable."""
    if labels is None:
        return members.withColumn("component", F.col("_row"))
    return members.join(labels.withColumnRenamed("node", "_row"), "_row", "left").withColumn(
        "component", F.coalesce("component", "_row")
    )


def _open(members: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Members of nodes with several components, with the nodes' counts.

    Added: component, _main (the largest component), _all and _hashes (members and their shingles),
    _out and _out_hashes (those outside the largest component).
    """
    labelled = keep(_labelled(members, labels), "labelled")
    parts = labelled.groupBy("node", "component").agg(F.count(F.lit(1)).alias("_n"), F.sum("n_shingles").alias("_h"))
    nodes = parts.groupBy("node").agg(
        F.sum("_n").alias("_all"), F.sum("_h").alias("_hashes"), F.max(F.struct("_n", "component", "_h")).alias("_most")
    ).select(
        "node", "_all", "_hashes", (F.col("_all") - F.col("_most._n")).alias("_out"),
        (F.col("_hashes") - F.col("_most._h")).alias("_out_hashes"), F.col("_most.component").alias("_main"),
    )
    nodes = keep(nodes.where("_out > 0"), "open-nodes")
    opened = keep(labelled.join(nodes, "node"), "open-members")
    discard(labelled, nodes)
    return opened


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id, kept; see ``near_rows``."""
    blocks = Blocks(docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text}`").alias("text")), "text")
    rows = near_rows(blocks, "id", "text")
    blocks.delete()
    return rows.select(F.col("_id").alias(id_col), "n_shingles", "component_id", "kept")


def near_rows(blocks: Blocks, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of the blocks: _row, _id, n_shingles, component_id, kept, first.

    ``kept`` holds for all rows with the least id of their component. ``first`` holds for
    one row of each component only, and for every row without words.

    Equal sets are joined first, so that groups of copies take part once. Trees: the
    documents of a node are dealt to children by minwise tokens that the node chooses.
    In a small node all pairs are looked at, and its likely pairs, or a forest of them where
    they are many, are confirmed on whole sets; of a larger node's documents those near one of
    them are. What a node's documents are then still apart by is compared if few are
    outside its largest component, in parts, each of which yields no more links than join
    its components; else the node branches, until no node is left.
    What agrees in enough bits of its minwise tokens is confirmed on whole sets;
    pairs inside a component found before are not compared again. Links between
    different texts are lost only with the small chance that no tree brings a pair
    together. The texts stay in their blocks; tokens and whole sets are made where they lie.

    Rows without words have no links: component_id is their own id. Rows that
    share an id share its outcome if their texts do; a null id counts as larger than all
    others. Other columns are ignored; an empty table gives an empty one.
    """
    rows = keep(document_keys(blocks, id_col, text), "keys", "zstd")
    least = F.min(F.struct(F.col("_id").isNull().alias("_none"), "_id", "_row")).alias("_least")
    classes = keep(
        rows.where("n_shingles > 0").groupBy("_key").agg(least).select("_key", "_least._id", "_least._row"), "classes", "zstd"
    )
    reps = keep(document_sets(blocks, classes, text), "representatives", "zstd")
    trees = F.explode(F.array(*[F.lit(t) for t in range(TREES)])).alias("_tree")
    roots = reps.select("_row", "_tokens", "n_shingles", *SKETCH, trees).select(
        "_row", "_tokens", "n_shingles", *SKETCH, F.xxhash64(F.lit(SEED), "_tree").alias("node")
    )
    level = 1
    children = _branch(roots)
    labels = None

    def label(links: DataFrame) -> None:
        """Components with the confirmed links; what was known goes in as its stars."""
        nonlocal labels
        links = keep(links, "confirmed")
        if not links.isEmpty():
            if labels is None:
                labels = keep(components(links), "components")
            else:
                known = labels.where("node != component").select(F.col("node").alias("a"), F.col("component").alias("b"))
                joined = keep(components(links.unionByName(known)), "components")
                discard(labels)
                labels = joined
        discard(links)

    def sets_of(wanted: DataFrame) -> DataFrame:
        return keep(_full_sets(blocks, wanted.distinct(), text), "full-sets", "zstd")

    while True:
        counts = children.groupBy("node").agg(F.count(F.lit(1)).alias("_n"))
        large = keep(counts.where(f"_n > {FEW * FEW}").select("node"), "large-nodes")
        found = keep(_likely(_labelled(children.join(large, "node", "left_anti"), labels)), "found", "zstd")
        dense = found.where("b is null").select("node", F.col("a").alias("_row"), "n_shingles", *SKETCH)
        likely = found.where("b is not null").select("a", "b")
        members = None
        if not large.isEmpty():
            members = keep(children.join(large, "node", "left_semi"), "members", "zstd")
            likely = likely.unionByName(_near_pivots(_labelled(members, labels), level))
            dense = dense.unionByName(members.select(*dense.columns))
        likely = keep(likely.distinct(), "candidates")
        if not likely.isEmpty():
            sets = sets_of(likely.select(F.explode(F.array("a", "b")).alias("_row")))
            label(_confirmed(likely, sets))
            discard(sets)
        discard(likely, large)

        again = _open(dense, labels)
        discard(found, *([] if members is None else [members]))
        few = (F.col("_out") * F.col("_all") <= FEW**4) & (F.col("_out_hashes") <= HASHES)
        involved = keep(_involved(again.where(few)), "involved", "zstd")
        if not involved.isEmpty():
            sets = sets_of(involved.select("_row"))
            label(_spanning(involved, sets))
            discard(sets)
        discard(involved)

        larger = again.where(~few).select("node", "_row")
        done = larger.isEmpty()
        if level > 1:
            discard(children)
        if done:
            discard(again)
            break
        level += 1
        children = keep(_branch(larger.join(reps.select("_row", "_tokens", "n_shingles", *SKETCH), "_row")), "children")
        discard(again)

    named = keep(_labelled(classes, labels), "named")
    # Representatives are the first rows of their keys, so one of them is the component's.
    first = F.min(F.struct(F.col("_id").isNull(), F.col("_id"), F.col("_row")))["_row"]
    least = keep(named.groupBy("component").agg(F.min("_id").alias("_least"), first.alias("_least_row")), "least")
    by_key = keep(named.join(least, "component").select("_key", "_least", "_least_row"), "by-key")
    discard(classes, reps, named, least)
    # A key may be that of very many copies: a plain join of two kept tables.
    joined = rows.select("_id", "n_shingles", "_key", "_row").join(by_key, "_key", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("_least")).otherwise(F.col("_id"))
    return joined.select(
        "_row", "_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("_id")).alias("kept"),
        ((F.col("n_shingles") == 0) | (F.col("_row") == F.col("_least_row"))).alias("first"),
    )
