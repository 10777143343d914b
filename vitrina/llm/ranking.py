"""Ranked lexical search: an index of impacts, searched by Block-Max MaxScore."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from vitrina.llm.common import discard, keep

# Documents and bytes of text in one shard of the index, postings in one block of a list.
SHARD_DOCS = 50_000
SHARD_BYTES = 16_000_000
BLOCK = 128
# Bytes of a row group of the index, which its readers hold at once; a larger shard has its own.
GROUP_BYTES = 4_000_000
# Queries whose terms are sent to the tasks together, and bytes of their texts.
QUERIES = 1_000
QUERY_BYTES = 1_000_000
# Documents whose essential postings are scored before the threshold is looked at for the
# first time; each such range is four times as long as the one before.
RANGE = 256
# Postings of a shard that are packed together.
CHUNK = 1 << 17

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UP, _DOWN = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FOLD = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256)
)

_INDEX = (
    "shard long, sizes binary, n_docs long, n_terms long, terms array<binary>, dfs array<long>, "
    "first_block binary, block_last binary, block_byte binary, block_impact binary, "
    "impact_tf binary, impact_size binary, postings binary"
)


def terms_of(text: Column) -> Column:
    """The terms of a text in order; none for null."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), _UP, _DOWN), F.lit(TERM), F.lit(0))


def packed_numbers(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Seven bits a byte, the last byte of a number below 128; and where each number begins."""
    size = np.ones(len(values), dtype=np.int64)
    for bits in range(7, 63, 7):
        size += values >= (1 << bits)
    begins = np.concatenate(([0], np.cumsum(size)))
    out = np.zeros(int(begins[-1]), dtype=np.uint8)
    for k in range(int(size.max(initial=0))):
        some = size > k
        part = (values[some] >> (7 * (size[some] - 1 - k))) & 127
        out[begins[:-1][some] + k] = part | np.where(k < size[some] - 1, 128, 0)
    return out, begins


def unpacked_numbers(data: np.ndarray) -> np.ndarray:
    last = data < 128
    ends = np.flatnonzero(last)
    begins = np.concatenate(([0], ends[:-1] + 1))
    values = np.zeros(len(ends), dtype=np.int64)
    for k in range(int((ends - begins).max(initial=-1)) + 1):
        some = begins + k <= ends
        values[some] = (values[some] << 7) | (data[begins[some] + k] & 127)
    return values


def index_of(texts: list[bytes]) -> dict:
    """The shard of some documents, in the given order: lists of postings in blocks.

    A posting is a document's place and the term's occurrences there. For each block
    the pairs (occurrences, size) are kept that no other pair of the block beats in
    both, so its greatest score is known for any statistics without unpacking it.
    """
    number: dict[bytes, int] = {}
    sizes, distinct, codes, counts = [], [], [], []
    for t in texts:
        terms = t.translate(_FOLD).split()
        counted = Counter(terms)
        sizes.append(len(terms))
        distinct.append(len(counted))
        codes.append(np.array([number.setdefault(w, len(number)) for w in counted], dtype=np.int32))
        counts.append(np.array(list(counted.values()), dtype=np.int32))
    sizes = np.array(sizes, dtype=np.int64)
    term = np.concatenate(codes) if codes else np.empty(0, np.int32)
    tf = np.concatenate(counts) if counts else term
    del codes, counts
    by_term = np.argsort(term, kind="stable")
    doc = np.repeat(np.arange(len(texts), dtype=np.int32), distinct)[by_term]
    tf, term = tf[by_term], term[by_term]
    del by_term
    df = np.bincount(term, minlength=len(number)).astype(np.int64)
    first = np.concatenate(([0], np.cumsum(df)))[:-1]
    first_block = np.concatenate(([0], np.cumsum(-(-df // BLOCK))))
    # Where the blocks of all lists begin: every BLOCK postings from the list's first on.
    nth = np.arange(int(first_block[-1])) - np.repeat(first_block[:-1], np.diff(first_block))
    starts = np.repeat(first, np.diff(first_block)) + nth * BLOCK
    ends = np.append(starts[1:], len(term))[: len(starts)]
    del term, nth
    packed, begins, held, impact_tf, impact_size, n_impacts = [], [], 0, [], [], []
    # Some whole blocks at a time, as what follows takes many numbers for each posting.
    cuts = np.unique(np.searchsorted(starts, np.arange(0, int(starts[-1]) + 1 if len(starts) else 0, CHUNK))).tolist()
    for low, high in zip(cuts, [*cuts[1:], len(starts)]):
        own = slice(int(starts[low]), int(ends[high - 1]))
        at = starts[low:high] - own.start
        size_of_block = ends[low:high] - starts[low:high]
        # Documents as steps inside a block, from 0 at its start.
        step = np.diff(doc[own], prepend=0)
        step[at] = doc[own][at]
        data, places = packed_numbers(np.stack((step, tf[own]), axis=1).ravel())
        packed.append(data)
        begins.append(places[::2][at] + held)
        held += len(data)
        block = np.repeat(np.arange(high - low), size_of_block)
        by, best_tf, best_size = _best_pairs(block, tf[own].astype(np.int64), sizes[doc[own]])
        n_impacts.append(np.bincount(by, minlength=high - low))
        impact_tf.append(best_tf)
        impact_size.append(best_size)

    def joined(parts: list[np.ndarray]) -> np.ndarray:
        return np.concatenate(parts) if parts else np.empty(0, np.int64)

    numbers = {
        "sizes": sizes, "first_block": first_block, "block_last": doc[ends - 1], "block_byte": np.append(joined(begins), held),
        "block_impact": np.append(0, np.cumsum(joined(n_impacts))), "impact_tf": joined(impact_tf), "impact_size": joined(impact_size),
    }
    # None reaches 2^31, as the postings are one binary value.
    return {name: values.astype("<i4") for name, values in numbers.items()} | {
        "n_docs": int((sizes > 0).sum()), "n_terms": int(sizes.sum()), "terms": list(number), "dfs": df,
        "postings": np.concatenate(packed) if packed else np.empty(0, np.uint8),
    }


def _best_pairs(block: np.ndarray, tf: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Block, occurrences and size of the pairs that no other pair of their block beats in both."""
    most_tf, most_size = int(tf.max(initial=0)), int(size.max(initial=0))
    if (int(block[-1]) + 1) * (most_tf + 1) * (most_size + 1) < 1 << 62:
        order = np.argsort((block * (most_tf + 1) + most_tf - tf) * (most_size + 1) + size)
    else:
        order = np.lexsort((size, -tf, block))
    by, own = block[order], size[order]
    # Sizes smaller than those of all pairs before in the block; lower blocks lie higher.
    level = own - by * (most_size + 1)
    before = np.concatenate(([np.iinfo(np.int64).max], np.minimum.accumulate(level)[:-1]))
    best = np.flatnonzero(level < before)
    return by[best], tf[order][best], own[best]


def build_index(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The table of shards of a table's documents; kept in the shared folder.

    A task makes a shard of each run of its documents, in order of their ids within the
    shard; texts are read once and do not move. All terms of all documents are indexed.
    Row groups end with a shard, so that a task holds a few shards however many it makes or reads.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"ids array<{kind}>, {_INDEX}"

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        ids, texts, held = [], [], 0

        def shard() -> pa.RecordBatch:
            own = pa.concat_arrays(ids)
            order = pc.array_sort_indices(own, null_placement="at_end")
            index = index_of([texts[i] for i in order.to_pylist()])
            arrays = [
                pa.ListArray.from_arrays(pa.array([0, len(texts)], pa.int32()), own.take(order)),
                pa.array([number], pa.int64()),
            ]
            for name, type_ in [c.strip().split(" ") for c in _INDEX.split(",")][1:]:
                value = index[name]
                if type_ == "binary":
                    arrays.append(pa.array([value.tobytes()], pa.binary()))
                elif type_ == "long":
                    arrays.append(pa.array([value], pa.int64()))
                else:
                    arrays.append(pa.array([value], pa.list_(pa.binary() if name == "terms" else pa.int64())))
            return pa.RecordBatch.from_arrays(arrays, names=["ids", *[c.strip().split(" ")[0] for c in _INDEX.split(",")]])

        for batch in batches:
            begin = 0
            for i, body in enumerate(batch.column(1)):
                texts.append(body.as_py())
                held += len(texts[-1])
                if held >= SHARD_BYTES or len(texts) == SHARD_DOCS:
                    ids.append(batch.column(0).slice(begin, i + 1 - begin))
                    yield shard()
                    number, begin = number + 1, i + 1
                    ids, texts, held = [], [], 0
            if begin < batch.num_rows:
                ids.append(batch.column(0).slice(begin))
        if texts:
            yield shard()

    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).cast("binary")
    shards = docs.select(F.col(f"`{id_col}`").alias("id"), body.alias("body")).mapInArrow(made, schema)
    return keep(shards, "index", group_bytes=GROUP_BYTES)


def gain(tf: np.ndarray, size: np.ndarray, n: int, total: int) -> np.ndarray:
    """What one unit of a term's weight is worth in a document."""
    m = 50 + (50 * size * n) // total
    return (1_000_000_000 * tf) // (1_000 * tf + 20 * m)


class Postings:
    """One term's list in a shard; each block is unpacked when it is first asked for."""

    def __init__(self, shard: Shard, lo: int, hi: int, size: int):
        self.shard, self.lo, self.hi, self.size = shard, lo, hi, size
        self.last = shard.block_last[lo:hi]
        self.gains = shard.block_gain[lo:hi]
        self.most = int(self.gains.max())
        self.ready = np.zeros(hi - lo, dtype=bool)
        self.doc = np.empty((hi - lo) * BLOCK, dtype=np.int64)
        self.gain = np.empty((hi - lo) * BLOCK, dtype=np.int64)

    def of(self, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Documents and gains of the postings of some blocks, ascending."""
        new = blocks[~self.ready[blocks]]
        if len(new):
            doc, gains = self.shard.unpack(self.lo + new)
            at = (new[:, None] * BLOCK + np.arange(BLOCK)).ravel()[: len(doc)]
            self.doc[at], self.gain[at] = doc, gains
            self.ready[new] = True
        if blocks[-1] - blocks[0] == len(blocks) - 1:
            own = slice(int(blocks[0]) * BLOCK, min((int(blocks[-1]) + 1) * BLOCK, self.size))
            return self.doc[own], self.gain[own]
        at = (blocks[:, None] * BLOCK + np.arange(BLOCK)).ravel()
        at = at[at < self.size]
        return self.doc[at], self.gain[at]


class Shard:
    """One shard, unpacked as far as it is looked at."""

    def __init__(self, row: dict, n: int, total: int):
        self.ids, self.terms, self.n, self.total = row["ids"], row["terms"], n, total
        for name in ("sizes", "first_block", "block_last", "block_byte", "block_impact", "impact_tf", "impact_size"):
            setattr(self, name, np.frombuffer(row[name], dtype="<i4").astype(np.int64))
        self.packed = np.frombuffer(row["postings"], dtype=np.uint8)
        self.dfs = row["dfs"]
        self.unpacked = 0
        self.lists: dict[int, Postings] = {}
        gains = gain(self.impact_tf, self.impact_size, n, total)
        self.block_gain = np.maximum.reduceat(gains, self.block_impact[:-1]) if len(gains) else gains

    def blocks_of(self, term: int) -> int:
        return int(self.first_block[term + 1] - self.first_block[term])

    def postings(self, term: int) -> Postings:
        if term not in self.lists:
            lo, hi = self.first_block[term : term + 2].tolist()
            self.lists[term] = Postings(self, lo, hi, self.dfs[term].as_py())
        return self.lists[term]

    def unpack(self, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Documents and gains of the postings of some blocks of one list."""
        self.unpacked += len(blocks)
        if blocks[-1] - blocks[0] == len(blocks) - 1:
            data = self.packed[self.block_byte[blocks[0]] : self.block_byte[blocks[-1] + 1]]
        else:
            begins, ends = self.block_byte[blocks].tolist(), self.block_byte[blocks + 1].tolist()
            data = np.concatenate([self.packed[a:b] for a, b in zip(begins, ends)])
        pairs = unpacked_numbers(data).reshape(-1, 2)
        # All blocks but a list's last are full; a block's steps add up to its last document.
        before = np.cumsum(self.block_last[blocks]) - self.block_last[blocks]
        doc = np.cumsum(pairs[:, 0]) - np.repeat(before, BLOCK)[: len(pairs)]
        return doc, gain(pairs[:, 1], self.sizes[doc], self.n, self.total)


def best_of_shard(
    shard: Shard, query: list[tuple[int, int]], k: int, floor: int = 0
) -> tuple[np.ndarray, np.ndarray]:
    """Places and scores of a shard's best documents for a query of (term, weight).

    All documents that score above ``floor`` or equal it and belong to the best ``k``
    here are returned, perhaps more. Lists are ordered by their global bounds. Those whose
    bounds add up to less than the threshold are not essential: a document in none
    but those cannot enter. The documents of the essential lists are scored range by
    range; the non-essential lists are then tried from the greatest bound on: a
    candidate whose score so far, with the maxima of the blocks it would be in and the
    bounds of the lists after, stays below the threshold is rejected before a block
    is unpacked for it.
    """
    lists = sorted(((shard.postings(term), weight) for term, weight in query), key=lambda x: x[0].most * x[1])
    upto = np.cumsum([0] + [p.most * weight for p, weight in lists])
    threshold = max(floor, 1)
    places, scores = np.empty(0, np.int64), np.empty(0, np.int64)
    n_docs, begin, step = len(shard.sizes), 0, RANGE
    while begin < n_docs:
        end = min(begin + step, n_docs)
        # The lists before this one cannot lift a document to the threshold by themselves.
        essential = int(np.searchsorted(upto[1:], threshold, side="left"))
        if essential == len(lists):
            break
        score, seen = np.zeros(end - begin, dtype=np.int64), np.zeros(end - begin, dtype=bool)
        for p, weight in lists[essential:]:
            a, b = np.searchsorted(p.last, (begin, end - 1)).tolist()
            if a == len(p.last):
                continue
            doc, gains = p.of(np.arange(a, min(b + 1, len(p.last))))
            if doc[0] < begin or doc[-1] >= end:
                own = slice(*np.searchsorted(doc, (begin, end)).tolist())
                doc, gains = doc[own], gains[own]
            score[doc - begin] += weight * gains
            seen[doc - begin] = True
        cand = np.flatnonzero(seen)
        have = score[cand]
        cand += begin
        for i in range(essential - 1, -1, -1):
            if not len(cand):
                break
            p, weight = lists[i]
            at = np.searchsorted(p.last, cand)
            inside = at < len(p.last)
            most = np.where(inside, weight * p.gains[np.minimum(at, len(p.last) - 1)], 0)
            stay = have + most + upto[i] >= threshold
            cand, have, at = cand[stay], have[stay], at[stay]
            at = at[at < len(p.last)]
            if len(at):
                doc, gains = p.of(at[np.diff(at, prepend=-1) > 0])
                where = np.minimum(np.searchsorted(doc, cand), len(doc) - 1)
                have = have + np.where(doc[where] == cand, weight * gains[where], 0)
        good = have >= threshold
        places, scores = np.concatenate((places, cand[good])), np.concatenate((scores, have[good]))
        if len(scores) > k:
            # Ids rise with places, so of equal scores the first stay.
            top = np.sort(np.lexsort((places, -scores))[:k])
            places, scores = places[top], scores[top]
        if len(scores) >= k:
            threshold = max(threshold, int(scores.min()))
        begin, step = end, 4 * step
    return places, scores


def _term_weights(index: DataFrame, queries: DataFrame, n: int) -> DataFrame:
    """Per query term that some document holds: term, weight."""
    wanted = queries.select(F.explode("terms").alias("term")).distinct()
    held = index.select(F.explode(F.arrays_zip("terms", "dfs")).alias("t")).select(
        F.col("t.terms").alias("term"), F.col("t.dfs").alias("df")
    )
    df = held.join(wanted, "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
    ratio = (2 * F.lit(n) + 2).cast("double") / (2 * F.col("df") + 1).cast("double")
    return df.select("term", F.floor(F.lit(1000.0) * F.ln(ratio)).cast("long").alias("weight"))


def search(
    docs: DataFrame, queries: DataFrame, k: int = 50, id_col: str = "doc_id", text: str = "text",
    query_id: str = "item_id", query_text: str = "text",
) -> DataFrame:
    """The ``k`` best documents of every query: query id, rank, id, score.

    A document's score sums, over the query's distinct terms, the term's weight (from
    the number of documents that hold it) times its gain there (from its occurrences
    and the document's size). Only scores above 0 count; equal ones rank by
    ascending id, a null id last; rows that share an id are documents of their own.

    The index is built in place, a shard for some 16 MB of text, and read once for every
    block of at most 1,000 queries: their terms, bounded in bytes, are what the
    tasks get. A task searches its shards one after another and goes on from its heap's
    threshold; what comes out is at most ``k`` rows for a query and task, whose heaps a
    window merges. Queries that share an id are queries of their own to the search; their
    rows follow one another in rank. Empty or null texts on either side match nothing;
    other columns are ignored; empty tables give an empty result.
    """
    spark = docs.sparkSession
    index = build_index(docs, id_col, text)
    stats = index.agg(F.sum("n_docs").alias("n"), F.sum("n_terms").alias("total")).first()
    n, total = stats["n"] or 0, stats["total"] or 0
    asked = queries.select(
        F.col(f"`{query_id}`").alias("query"),
        F.transform(F.array_distinct(terms_of(F.col(f"`{query_text}`").cast("string"))),
                    lambda t: t.cast("binary")).alias("terms"),
    ).withColumn("number", F.monotonically_increasing_id())
    asked = keep(asked, "queries")
    weights = keep(_term_weights(index, asked, n), "weights")
    # Weighted terms of each query; terms that no document holds are left out.
    weighted = (
        asked.select("query", "number", F.explode("terms").alias("term")).join(weights, "term")
        .where("weight > 0").groupBy("number", "query")
        .agg(F.collect_list(F.struct("term", "weight")).alias("terms"))
    )
    weighted = keep(weighted.repartitionByRange("number").sortWithinPartitions("number"), "weighted")

    kinds = {"query": weighted.schema["query"].dataType, "id": docs.schema[id_col].dataType}
    schema = f"number long, id {kinds['id'].simpleString()}, score long"
    heaps = []
    for block in _query_blocks(weighted):
        sent = spark.sparkContext.broadcast(block)

        def searched(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            heap: dict[int, list[tuple]] = {}
            kind = None
            for batch in batches:
                kind = batch.column(0).type.value_type
                for i in range(batch.num_rows):
                    _search_shard(Shard(_row(batch, i), n, total), sent.value, k, heap)
                # Not held while the next one is read.
                del batch
            rows = [(number, *r) for number, best in heap.items() for r in best]
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([r[0] for r in rows], pa.int64()),
                        pa.array([r[2] for r in rows], kind),
                        pa.array([r[1] for r in rows], pa.int64()),
                    ],
                    names=["number", "id", "score"],
                )

        heaps.append(keep(index.mapInArrow(searched, schema), "heaps"))
        sent.destroy()
    if not heaps:
        empty = f"`{query_id}` {kinds['query'].simpleString()}, rank int, `{id_col}` {kinds['id'].simpleString()}, score long"
        return spark.createDataFrame([], empty)
    merged = heaps[0]
    for more in heaps[1:]:
        merged = merged.unionByName(more)
    best = Window.partitionBy("number").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
    ranked = merged.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    result = ranked.join(asked.select("number", "query"), "number").select(
        F.col("query").alias(query_id), "rank", F.col("id").alias(id_col), "score"
    )
    result = keep(result, "ranked")
    discard(index, asked, weights, weighted, *heaps)
    return result


def _query_blocks(weighted: DataFrame) -> Iterator[list[tuple[int, list[tuple[bytes, int]]]]]:
    """Blocks of (number, weighted terms) of bounded size, read one after another."""
    block, held = [], 0
    for row in weighted.select("number", "terms").toLocalIterator():
        terms = [(bytes(t["term"]), t["weight"]) for t in row["terms"]]
        block.append((row["number"], terms))
        held += sum(len(t) + 16 for t, _ in terms)
        if len(block) == QUERIES or held >= QUERY_BYTES:
            yield block
            block, held = [], 0
    if block:
        yield block


def _row(batch: pa.RecordBatch, i: int) -> dict:
    out = {}
    for name, column in zip(batch.schema.names, batch.columns):
        value = column[i]
        out[name] = value.values if pa.types.is_list(column.type) else (
            value.as_buffer() if pa.types.is_binary(column.type) else value.as_py()
        )
    return out


def _search_shard(shard: Shard, queries: list, k: int, heap: dict[int, list[tuple]]) -> None:
    """Put a shard's best documents for all queries into the task's heaps."""
    distinct = sorted({t for _, terms in queries for t, _ in terms})
    found = pc.index_in(pa.array(distinct, pa.binary()), value_set=shard.terms).to_pylist()
    place = {t: at for t, at in zip(distinct, found) if at is not None}
    for number, terms in queries:
        query = [(place[t], w) for t, w in terms if t in place]
        if not query:
            continue
        own = heap.get(number, [])
        floor = own[-1][0] if len(own) >= k else 0
        places, scores = best_of_shard(shard, query, k, floor)
        if len(places):
            ids = shard.ids.take(pa.array(places)).to_pylist()
            both = own + list(zip(scores.tolist(), ids))
            heap[number] = sorted(both, key=lambda r: (-r[0], r[1] is None, r[1] if r[1] is not None else 0))[:k]
