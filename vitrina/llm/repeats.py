"""Suffix-array removal of byte strings that occur in an earlier document."""

from __future__ import annotations

import functools
import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from vitrina.llm.common import discard, keep
from vitrina.llm.shingles import text_slices
from vitrina.llm.suffixes import permuted_common_prefixes, suffix_array
from vitrina.operators.durable import new_path

LENGTH = 50
# Every string of LENGTH bytes holds LENGTH - ANCHOR + 1 strings of ANCHOR bytes; the one
# with the least hash, the leftmost of equals, is its anchor.
ANCHOR = 16
# Bytes of text in one block, in the hash buckets of one task and in one shard.
BLOCK_BYTES = 4_000_000
PART_BYTES = 6_000_000
SHARD_BYTES = 1_000_000
# Contexts that one suffix array may take, about twice those of a shard that is all shared.
SHARD_CONTEXTS = 100_000
# Strings of a shard with more contexts have anchors of twice the bytes instead.
LONG_ANCHOR = 2 * ANCHOR
PASSED_ON = -1
LAST_ID = np.iinfo(np.int64).max

_C = [np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x94D049BB133111EB)]
_CONTEXT = np.random.default_rng(3_001).integers(0, 2**64, 16, dtype=np.uint64) | np.uint64(1)
_OF_BYTE = np.random.default_rng(3_003).integers(0, 2**64, 256, dtype=np.uint64)
_STRING = np.random.default_rng(3_002).integers(0, 2**64, (2, 16), dtype=np.uint64) | np.uint64(1)


def _words(data: np.ndarray, n: int) -> np.ndarray:
    """The 8 bytes from each of the first ``n`` places on, as one number."""
    return np.ascontiguousarray(np.ndarray(buffer=data, shape=(n,), dtype="<u8", strides=(1,)))


def _hash(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    h = low * _C[0] + high * _C[1]
    h ^= h >> np.uint64(32)
    h *= _C[2]
    h ^= h >> np.uint64(29)
    return h


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    step = 1
    while step * 2 <= width:
        x = np.minimum(x[..., :-step], x[..., step:])
        step *= 2
    rest = width - step
    return np.minimum(x[..., :-rest], x[..., rest:]) if rest else x


def anchors(data: np.ndarray, ends: np.ndarray, length: int) -> np.ndarray:
    """Places of all anchors of texts laid one after another, ascending."""
    window = length - ANCHOR + 1
    n = len(data)
    found = []
    padded = np.concatenate((data, np.zeros(16, dtype=np.uint8)))
    # Starts of whole strings: not within the last length - 1 bytes of a text.
    sizes = np.diff(ends, prepend=0)
    rest = np.minimum(sizes, length - 1)
    whole = np.repeat(np.tile([True, False], len(ends)), np.stack((sizes - rest, rest), axis=1).ravel())
    step = 1 << 17
    for lo in range(0, n, step):
        hi = min(lo + step, n)
        # Hashes around [lo, hi), so that every string that covers a place is seen.
        first, last = max(0, lo - window + 1), min(n, hi + window - 1)
        w = _words(padded[first:], last - first + 8)
        h = _hash(w[:-8], w[8:])
        least = _sliding_min(h, window)
        least = np.where(whole[first : first + len(least)], least, np.uint64(0))
        around = np.zeros(len(h) + window - 1, dtype=np.uint64)
        around[window - 1 : window - 1 + len(least)] = least
        most = ~_sliding_min(~around, window)
        own = np.flatnonzero(h == most) + first
        found.append(own[(own >= lo) & (own < hi)])
    return np.concatenate(found) if found else np.empty(0, np.int64)


def _anchor_hashes(data: np.ndarray, places: np.ndarray, anchor: int = ANCHOR) -> np.ndarray:
    padded = np.concatenate((data, np.zeros(anchor, dtype=np.uint8)))
    words = np.ndarray(buffer=padded, shape=(len(padded) - 8,), dtype="<u8", strides=(1,))
    first = _hash(words[places], words[places + 8])
    return _evened(first if anchor == ANCHOR else _hash(first, _hash(words[places + 16], words[places + 24])))


def _evened(hashes: np.ndarray) -> np.ndarray:
    """Anchors are what has the least hash, so theirs are small: other ones, spread over all numbers."""
    h = hashes * _C[1]
    h ^= h >> np.uint64(31)
    return h * _C[0]


def _part(hashes: np.ndarray, parts: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


class Block:
    """Some texts after one another, as stored: ids, ends, digests, places of anchors, bytes."""

    def __init__(self, ids: bytes, ends: bytes, digests: bytes, places: bytes, data: bytes):
        self.ids = np.frombuffer(ids, dtype="<i8")
        self.ends = np.frombuffer(ends, dtype="<i8")
        self.begins = np.concatenate(([0], self.ends[:-1])).astype(np.int64)
        # A text's tag: 48 bits of its digest, never 0.
        self.tags = np.frombuffer(digests, dtype="<u8")[::2] >> np.uint64(16) | np.uint64(1 << 48)
        self.places = np.cumsum(np.frombuffer(places, dtype="<u4"), dtype=np.int64)
        self.data = np.frombuffer(data, dtype=np.uint8)

    @functools.cached_property
    def text_of(self) -> np.ndarray:
        return np.searchsorted(self.ends, self.places, side="right")

    @functools.cached_property
    def _distinct(self) -> tuple[np.ndarray, np.ndarray]:
        return np.unique(_anchor_hashes(self.data, self.places), return_inverse=True)

    @property
    def hashes(self) -> np.ndarray:
        """Distinct anchors in ascending order."""
        return self._distinct[0]

    @property
    def which(self) -> np.ndarray:
        """Which of the distinct anchors is at each place."""
        return self._distinct[1]

    def slices(self, parts: int) -> Iterator[tuple[int, int, int]]:
        """Part, and where its distinct anchors begin and end."""
        part = _part(self.hashes, parts)
        cuts = np.concatenate(([0], np.flatnonzero(part[1:] != part[:-1]) + 1, [len(part)]))
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            if lo < hi:
                yield int(part[lo]), lo, hi


_BLOCK = "block long, ids binary, ends binary, digests binary, places binary, data binary"
_BLOCK_COLUMNS = ["ids", "ends", "digests", "places", "data"]


def _pack_blocks(texts: DataFrame, length: int) -> DataFrame:
    """Rows of (_id, _text) to blocks of about BLOCK_BYTES; texts are not moved."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        ids: list[np.ndarray] = []
        parts: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        held = 0

        def out() -> pa.RecordBatch:
            data = np.concatenate(parts)
            ends = np.cumsum(np.concatenate(sizes)).astype("<i8")
            begins = np.concatenate(([0], ends[:-1]))
            raw = data.tobytes()
            digests = b"".join(
                hashlib.blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(begins.tolist(), ends.tolist())
            )
            places = anchors(data, ends, length)
            steps = np.diff(places, prepend=0).astype("<u4")
            values = [np.concatenate(ids).astype("<i8").tobytes(), ends.tobytes(), digests, steps.tobytes(), raw]
            return pa.RecordBatch.from_arrays(
                [pa.array([number], pa.int64()), *[pa.array([v], pa.binary()) for v in values]],
                names=["block", *_BLOCK_COLUMNS],
            )

        for batch in batches:
            own = batch.column(0).fill_null(LAST_ID).to_numpy(zero_copy_only=False).astype(np.int64)
            for lo, hi, data, ends in text_slices(batch.column(1)):
                ids.append(own[lo:hi])
                parts.append(np.array(data))
                sizes.append(np.diff(ends, prepend=0))
                held += len(data)
                if held >= BLOCK_BYTES:
                    yield out()
                    number, held = number + 1, 0
                    ids.clear(), parts.clear(), sizes.clear()
        if ids:
            yield out()

    return texts.mapInArrow(packed, _BLOCK)


def _rows(columns: dict[str, tuple[list, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(v, t) for v, t in columns.values()], names=list(columns)
    )


def _entries(blocks: DataFrame, parts: int) -> DataFrame:
    """Per block and part: its distinct anchors (5 bytes each) and their texts' tags (7 bytes).

    The tag of an anchor that two different texts of the block hold is 0.
    """

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                number, *values = [c[i].as_py() for c in batch.columns]
                block = Block(*values)
                if not len(block.hashes):
                    continue
                order = np.argsort(block.which, kind="stable")
                tags = block.tags[block.text_of[order]]
                starts = np.searchsorted(block.which[order], np.arange(len(block.hashes)))
                least, most = np.minimum.reduceat(tags, starts), np.maximum.reduceat(tags, starts)
                tag = np.where(least == most, least, np.uint64(0))
                low = block.hashes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]
                seven = tag.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :7]
                both = np.concatenate((low, seven), axis=1)
                found = [(p, both[lo:hi].tobytes()) for p, lo, hi in block.slices(parts)]
                yield _rows({
                    "part": ([p for p, _ in found], pa.int32()),
                    "block": ([number] * len(found), pa.int64()),
                    "entries": ([e for _, e in found], pa.binary()),
                })

    return blocks.mapInArrow(listed, "part int, block long, entries binary")


def _shared(entries: DataFrame) -> DataFrame:
    """Which entries' anchors occur in two different texts: block, part, bits."""

    def compare(table: pa.Table) -> pa.Table:
        raw = [np.frombuffer(e.as_buffer(), dtype=np.uint8).reshape(-1, 12) for c in table.column("entries").chunks for e in c]
        sizes = np.array([len(r) for r in raw])
        rows = np.concatenate(raw)
        wide = np.zeros((len(rows), 16), dtype=np.uint8)
        wide[:, :5], wide[:, 8:15] = rows[:, :5], rows[:, 5:]
        wide = wide.view("<u8")
        order = np.argsort(wide[:, 0], kind="stable")
        key, tag = wide[order, 0], wide[order, 1]
        starts = np.concatenate(([0], np.flatnonzero(key[1:] != key[:-1]) + 1))
        least, most = np.minimum.reduceat(tag, starts), np.maximum.reduceat(tag, starts)
        several = (least != most) | (least == 0)
        hit = np.empty(len(rows), dtype=bool)
        hit[order] = np.repeat(several, np.diff(np.append(starts, len(rows))))
        own = np.split(hit, np.cumsum(sizes)[:-1])
        some = [k for k, h in enumerate(own) if h.any()]
        return pa.table({
            "block": table.column("block").combine_chunks().take(pa.array(some, pa.int64())),
            "part": table.column("part").combine_chunks().take(pa.array(some, pa.int64())),
            "bits": pa.array([np.packbits(own[k]).tobytes() for k in some], pa.binary()),
        })

    return entries.groupBy("part").applyInArrow(compare, "block long, part int, bits binary")


def _context_rows(block: Block, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes around anchors: all strings of ``length`` bytes that hold them, inside their text.

    Returns a matrix of bytes (zeros after the end), the anchor's place in it and its length.
    """
    text = block.text_of[at]
    place = block.places[at]
    reach = length - ANCHOR
    start = np.maximum(block.begins[text], place - reach)
    end = np.minimum(block.ends[text], place + length)
    size = end - start
    width = reach + length
    padded = np.concatenate((block.data, np.zeros(width, dtype=np.uint8)))
    matrix = np.lib.stride_tricks.sliding_window_view(padded, width)[start]
    matrix[np.arange(width) >= size[:, None]] = 0
    return matrix, place - start, size


def _context_keys(matrix: np.ndarray, lead: np.ndarray, size: np.ndarray) -> np.ndarray:
    wide = np.zeros((len(matrix), -(-matrix.shape[1] // 8) * 8), dtype=np.uint8)
    wide[:, : matrix.shape[1]] = matrix
    words = wide.view("<u8")
    key = (lead.astype(np.uint64) << np.uint64(32)) + size.astype(np.uint64)
    for k in range(words.shape[1]):
        key = (key ^ words[:, k]) * _CONTEXT[k]
        key ^= key >> np.uint64(31)
    return key


def _contexts(blocks: DataFrame, shared: DataFrame, parts: int, shards: int, length: int) -> DataFrame:
    """Contexts of shared anchors: shard, block, n_contexts, payload.

    Of equal contexts a block sends the one of its least document. The others are passed
    on to the block's marks: either as a copy of that one's marks (same document) or as
    wholly repeated (a later document). Passed-on rows have a negative shard.
    """
    masks = shared.groupBy("block").agg(F.collect_list(F.struct("part", "bits")).alias("masks"))
    joined = blocks.join(masks.hint("shuffle_hash"), "block")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                number, *values, masks = [c[i].as_py() for c in batch.columns]
                block = Block(*values)
                hit = np.zeros(len(block.hashes), dtype=bool)
                bits = {m["part"]: m["bits"] for m in masks}
                for part, lo, hi in block.slices(parts):
                    if part in bits:
                        hit[lo:hi] = np.unpackbits(np.frombuffer(bits[part], np.uint8), count=hi - lo)
                at = np.flatnonzero(hit[block.which])
                matrix, lead, size = _context_rows(block, at, length)
                key = _context_keys(matrix, lead, size)
                ids = block.ids[block.text_of[at]]
                order = np.lexsort((block.places[at], ids, key))
                first = np.concatenate(([True], key[order][1:] != key[order][:-1]))
                leader = order[np.flatnonzero(first)[np.cumsum(first) - 1]]
                # Others: copies of the leader's marks, or wholly repeated (all bits).
                other = order[~first]
                own = np.where(ids[other] == ids[leader[~first]], block.places[at[leader[~first]]], -1)
                passed = np.stack((block.places[at[other]], own), axis=1).astype("<i8").tobytes()
                sent = order[first]
                record = np.zeros(len(sent), dtype=_record(length, ANCHOR))
                record["id"], record["place"] = ids[sent], block.places[at[sent]]
                record["lead"], record["size"], record["bytes"] = lead[sent], size[sent], matrix[sent]
                yield _rows({
                    "shard": ([PASSED_ON - number % shards], pa.int32()), "block": ([number], pa.int64()),
                    "n_contexts": ([0], pa.int64()), "payload": ([_squeezed(passed)], pa.binary()),
                })
                yield _dealt(number, record, block.hashes[block.which[at[sent]]], shards)

    return joined.select("block", *_BLOCK_COLUMNS, "masks").mapInArrow(cut, _CONTEXTS)


_CONTEXTS = "shard int, block long, n_contexts long, payload binary"


def _dealt(block: int, records: np.ndarray, hashes: np.ndarray, shards: int) -> pa.RecordBatch:
    """Contexts of a block to the shards of their anchors' hashes."""
    shard = _part(hashes, shards)
    by = np.argsort(shard, kind="stable")
    shard = shard[by]
    cuts = np.flatnonzero(np.diff(shard, prepend=-1))
    ends = np.append(cuts[1:], len(shard))[: len(cuts)]
    payload = [_squeezed(records[by[lo:hi]].tobytes()) for lo, hi in zip(cuts.tolist(), ends.tolist())]
    return _rows({
        "shard": (shard[cuts].astype(np.int32), pa.int32()), "block": ([block] * len(cuts), pa.int64()),
        "n_contexts": (ends - cuts, pa.int64()), "payload": (payload, pa.binary()),
    })


def _owned(rows: np.ndarray, hashes: np.ndarray, length: int) -> np.ndarray:
    """Per context, which of its strings have its anchor for their own: no anchor of less hash."""
    wide = length - ANCHOR + 1
    least = _sliding_min(hashes[:, : 2 * wide - 1], wide)
    own = hashes[np.arange(len(rows)), rows["lead"]]
    at = np.arange(wide)
    return (least == own[:, None]) & (at <= rows["lead"][:, None]) & (at + length <= rows["size"][:, None])


def _long_anchored(rows: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Contexts of longer anchors, cut from ``rows``, and the hashes of those anchors.

    Of each string of a context the longer anchor is the leftmost of least hash; strings
    next to one another with the same one make a context. Equal strings have equal ones.
    """
    wide, first = length - LONG_ANCHOR + 1, length - ANCHOR + 1
    flat = np.ascontiguousarray(rows["bytes"])
    width = flat.shape[1]
    words = _words(np.concatenate((flat.ravel(), np.zeros(16, dtype=np.uint8))), flat.size + 8)
    short = _hash(words[:-8], words[8:])
    long = _hash(short, np.concatenate((short[ANCHOR:], short[:ANCHOR]))).reshape(len(rows), width)
    inner = np.lib.stride_tricks.sliding_window_view(long[:, : first + wide - 1], wide, axis=1)
    row, bit = np.nonzero(_owned(rows, short.reshape(len(rows), width), length))
    at = bit + inner[row, bit].argmin(axis=1)
    starts = np.flatnonzero((np.diff(row, prepend=-1) != 0) | (np.diff(at, prepend=-1) != 0))
    lasts = np.append(starts[1:], len(row))[: len(starts)] - 1
    row, at, low, high = row[starts], at[starts], bit[starts], bit[lasts]
    out = np.zeros(len(row), dtype=_record(length, LONG_ANCHOR))
    out["id"], out["place"], out["bit"] = rows["id"][row], rows["place"][row], rows["bit"][row] + low
    out["lead"], out["size"] = at - low, high - low + length
    each = np.arange(out["bytes"].shape[1])
    taken = flat[row[:, None], np.minimum(low[:, None] + each, width - 1)]
    taken[each >= out["size"][:, None]] = 0
    out["bytes"] = taken
    return out, _evened(long[row, at])


def _long_contexts(contexts: DataFrame, shards: int, length: int) -> DataFrame:
    """The contexts of large shards by longer anchors, of which each string has one."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, payload in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows = np.frombuffer(_unsqueezed(payload.as_buffer()), dtype=_record(length, ANCHOR))
                some = [_long_anchored(rows[lo : lo + 4_000], length) for lo in range(0, len(rows), 4_000)]
                if some:
                    yield _dealt(number, np.concatenate([r for r, _ in some]), np.concatenate([h for _, h in some]), shards)

    return contexts.select("block", "payload").mapInArrow(cut, _CONTEXTS)


def _divided(contexts: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """Contexts of shards with at most ``most`` of them, and of the others."""
    sizes = contexts.where("shard >= 0").groupBy("shard").agg(F.sum("n_contexts").alias("_n"))
    large = keep(sizes.where(F.col("_n") > most).select("shard"), "large-shards")
    return contexts.join(large, "shard", "left_anti"), contexts.join(large, "shard", "left_semi")


def _record(length: int, anchor: int) -> np.dtype:
    """A context: document, place of its (short) anchor, number of its first string around
    that, place of its anchor in it, size, bytes."""
    return np.dtype([
        ("id", "<i8"), ("place", "<u4"), ("bit", "u1"), ("lead", "u1"), ("size", "u1"),
        ("bytes", "u1", (2 * length - anchor,)),
    ])


def _squeezed(raw: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(raw)


def _unsqueezed(raw) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(raw)


def repeated_starts(data: np.ndarray, ends: np.ndarray, ids: np.ndarray, length: int) -> np.ndarray:
    """Places where a string of ``length`` bytes begins that also begins in a text of smaller id.

    By the suffix array of all the texts: runs of suffixes that agree in ``length`` bytes,
    found by their permuted common prefixes.
    """
    out = np.zeros(len(data), dtype=bool)
    if not len(data):
        return out
    sa = suffix_array(data, length)
    common = permuted_common_prefixes(data, sa, length)
    text_of = np.searchsorted(ends, sa, side="right")
    inside = ends[text_of] - sa >= length
    id_of = np.where(inside, ids[text_of], LAST_ID)
    starts = np.flatnonzero(common[sa] < length)
    least = np.minimum.reduceat(id_of, starts)
    run = np.diff(np.append(starts, len(sa)))
    out[sa] = inside & (id_of > np.repeat(least, run))
    return out


def _own_hashes(contexts: np.ndarray, anchor: int) -> np.ndarray:
    """The hash of each context's anchor."""
    rows = np.ascontiguousarray(contexts["bytes"])
    return _anchor_hashes(rows.ravel(), np.arange(len(rows)) * rows.shape[1] + contexts["lead"], anchor)


def _several(contexts: np.ndarray, anchor: int) -> np.ndarray:
    """Which of the distinct contexts share their anchor with another one."""
    _, which, count = np.unique(_own_hashes(contexts, anchor), return_inverse=True, return_counts=True)
    return count[which] > 1


def _judged(contexts: np.ndarray, length: int) -> np.ndarray:
    """Per context, as bits: which of its strings also begin in a context of smaller id."""
    wide = contexts["bytes"].shape[1] - length + 1
    taken = np.arange(contexts["bytes"].shape[1]) < contexts["size"][:, None]
    ends = np.cumsum(contexts["size"].astype(np.int64))
    repeated = repeated_starts(contexts["bytes"][taken], ends, contexts["id"], length)
    padded = np.concatenate((repeated, np.zeros(wide, dtype=bool)))
    bits = np.lib.stride_tricks.sliding_window_view(padded, wide)[ends - contexts["size"]]
    bits = bits & (np.arange(wide) + length <= contexts["size"][:, None])
    return (bits * (np.uint64(1) << np.arange(wide, dtype=np.uint64))).sum(axis=1, dtype=np.uint64)


def _joined(contexts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct contexts, each with its least document, and which of them each context is."""
    key = _context_keys(contexts["bytes"], contexts["lead"], contexts["size"])
    order = np.lexsort((contexts["id"], key))
    first = np.concatenate(([True], key[order][1:] != key[order][:-1]))
    group = np.empty(len(contexts), dtype=np.int64)
    group[order] = np.cumsum(first) - 1
    return contexts[order[first]], group


def _masks(contexts: np.ndarray, least: np.ndarray, group: np.ndarray, masks: np.ndarray, length: int) -> np.ndarray:
    """Per context, as bits: all its strings if it is a smaller document's too, else those of its group."""
    strings = contexts["size"].astype(np.uint64) - np.uint64(length - 1)
    return np.where(contexts["id"] > least["id"][group], (np.uint64(1) << strings) - np.uint64(1), masks[group])


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _string_hashes(contexts: np.ndarray, length: int) -> np.ndarray:
    """A number for the ``length`` bytes from each place of each context on; equal bytes have equal ones."""
    width = contexts["bytes"].shape[1]
    wide = width - length + 1
    powers, back = _powers(int(_C[0]), width), _powers(pow(int(_C[0]), -1, 1 << 64), wide)
    out = np.empty((len(contexts), wide), dtype=np.uint64)
    for lo in range(0, len(contexts), 4_000):
        rows = contexts["bytes"][lo : lo + 4_000]
        sums = np.zeros((len(rows), width + 1), dtype=np.uint64)
        np.cumsum(_OF_BYTE[rows] * powers, axis=1, out=sums[:, 1:])
        out[lo : lo + 4_000] = (sums[:, length:] - sums[:, :wide]) * back
    return out


def _twice(contexts: np.ndarray, length: int, anchor: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the first string of each context begins that may occur twice around its anchor,
    and how many bytes there are up to the end of the last such one: 0 if there is none."""
    hashes = _string_hashes(contexts, length) ^ _own_hashes(contexts, anchor)[:, None]
    inside = np.arange(hashes.shape[1]) + length <= contexts["size"][:, None]
    flat = hashes[inside]
    order = np.argsort(flat)
    same = flat[order][1:] == flat[order][:-1]
    found = np.empty(len(flat), dtype=bool)
    found[order] = np.append(same, False) | np.append(False, same)
    twice = np.zeros(hashes.shape, dtype=bool)
    twice[inside] = found
    begin, last = twice.argmax(axis=1), hashes.shape[1] - 1 - twice[:, ::-1].argmax(axis=1)
    return begin, np.where(twice.any(axis=1), last - begin + length, 0)


def _cut(contexts: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """So many bytes of each context, from a place on."""
    out = contexts.copy()
    width = out["bytes"].shape[1]
    each = np.arange(width)
    taken = np.take_along_axis(contexts["bytes"], np.minimum(begin[:, None] + each, width - 1), axis=1)
    taken[each >= size[:, None]] = 0
    out["bytes"], out["lead"], out["size"] = taken, contexts["lead"] - begin, size
    return out


def _decided(contexts: np.ndarray, length: int, anchor: int) -> np.ndarray:
    """Per distinct context, as bits: which of its strings also begin in a context of smaller id.

    A string that occurs once around its anchor by its hash is nobody else's, so contexts are
    cut to what lies between the first and the last of the others; contexts that are equal then are joined
    under their least document. Where an anchor still has several surroundings, the suffix
    array decides.
    """
    begin, size = _twice(contexts, length, anchor)
    some = np.flatnonzero(size)
    masks = np.zeros(len(contexts), dtype=np.uint64)
    if len(some):
        cut = _cut(contexts[some], begin[some], size[some])
        least, group = _joined(cut)
        own = np.zeros(len(least), dtype=np.uint64)
        rest = np.flatnonzero(_several(least, anchor))
        own[rest] = _judged(least[rest], length)
        masks[some] = _masks(cut, least, group, own, length) << begin[some].astype(np.uint64)
    return masks


def _marks(contexts: DataFrame, length: int, anchor: int) -> DataFrame:
    """Per block: which strings around which anchors are repeated (block, marks)."""

    def judge(table: pa.Table) -> pa.Table:
        blocks = table.column("block").combine_chunks()
        payloads = [_unsqueezed(p.as_buffer()) for c in table.column("payload").chunks for p in c]
        if table.column("shard")[0].as_py() < 0:
            return pa.table({"block": blocks, "passed": pa.array([True] * len(blocks)), "marks": pa.array(payloads, pa.binary())})
        rows = [np.frombuffer(p, dtype=_record(length, anchor)) for p in payloads]
        sizes = np.array([len(r) for r in rows])
        every = np.concatenate(rows)
        least, group = _joined(every)
        masks = np.zeros(len(least), dtype=np.uint64)
        # An anchor with one surrounding shares no string but with that one's equals.
        some = np.flatnonzero(_several(least, anchor))
        masks[some] = _decided(least[some], length, anchor)
        mask = _masks(every, least, group, masks, length)
        mask <<= every["bit"].astype(np.uint64)
        out = []
        for at, n in zip(np.cumsum(sizes) - sizes, sizes):
            own, found = every["place"][at : at + n], mask[at : at + n]
            some = found != 0
            out.append(own[some].astype("<u4").tobytes() + found[some].astype("<u8").tobytes())
        return pa.table({"block": blocks, "passed": pa.array([False] * len(blocks)), "marks": pa.array(out, pa.binary())})

    return contexts.groupBy("shard").applyInArrow(judge, "block long, passed boolean, marks binary")


def _string_keys(strings: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each row of bytes."""
    wide = np.zeros((len(strings), -(-strings.shape[1] // 8) * 8), dtype=np.uint8)
    wide[:, : strings.shape[1]] = strings
    words = wide.view("<u8")
    keys = []
    for lane in range(2):
        key = np.full(len(words), _C[lane], dtype=np.uint64)
        for k in range(words.shape[1]):
            key = (key ^ words[:, k]) * _STRING[lane, k % _STRING.shape[1]]
            key ^= key >> np.uint64(29)
        keys.append(key.view(np.int64))
    return keys[0], keys[1]


def _string_marks(contexts: DataFrame, length: int) -> DataFrame:
    """The marks of ``_marks`` for longer anchors that one suffix array cannot take.

    Here a group is one string, by its hash and its anchor's place in it, so that an
    anchor with very many surroundings spreads over all tasks; the least document of
    equal strings is an aggregate, of which each map task sends one row.
    """
    wide = length - LONG_ANCHOR + 1

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, payload in zip(batch.column(0).to_pylist(), batch.column(1)):
                every = np.frombuffer(_unsqueezed(payload.as_buffer()), dtype=_record(length, LONG_ANCHOR))
                for lo in range(0, len(every), 4_000):
                    rows = every[lo : lo + 4_000]
                    row, at = np.nonzero(np.arange(wide) + length <= rows["size"][:, None])
                    windows = np.lib.stride_tricks.sliding_window_view(np.ascontiguousarray(rows["bytes"]), length, axis=1)
                    one, two = _string_keys(windows[row, at])
                    yield _rows({
                        "_one": (one, pa.int64()), "_two": (two, pa.int64()),
                        "_offset": ((rows["lead"][row] - at).astype(np.int32), pa.int32()),
                        "_id": (rows["id"][row], pa.int64()), "block": (np.full(len(row), number), pa.int64()),
                        "place": (rows["place"][row].astype(np.int64), pa.int64()),
                        "bit": ((rows["bit"][row] + at).astype(np.int32), pa.int32()),
                    })

    schema = "_one long, _two long, _offset int, _id long, block long, place long, bit int"
    every = contexts.select("block", "payload").mapInArrow(strings, schema)
    same = ["_one", "_two", "_offset"]
    least = every.groupBy(*same).agg(F.min("_id").alias("_least"), F.max("_id").alias("_most"))
    least = keep(least.where("_least < _most").drop("_most"), "least-documents")
    repeated = every.join(least, same).where("_id > _least")
    masks = repeated.groupBy("block", "place").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("mask"))

    def of_block(table: pa.Table) -> pa.Table:
        place, mask = table.column("place").to_numpy(), table.column("mask").to_numpy()
        marks = place.astype("<u4").tobytes() + mask.astype("<u8").tobytes()
        return pa.table({
            "block": pa.array([table.column("block")[0].as_py()], pa.int64()),
            "passed": pa.array([False]), "marks": pa.array([marks], pa.binary()),
        })

    # One block's places, which are as many as a block's text has at most.
    return masks.groupBy("block").applyInArrow(of_block, "block long, passed boolean, marks binary")


def _covered(block: Block, marks: list[dict], copies: np.ndarray, length: int) -> np.ndarray:
    """Which bytes of the block go."""
    n = len(block.data)
    wide = length - ANCHOR + 1
    full = ~np.uint64(0)
    places, masks = [], []
    for m in marks:
        if not m["passed"]:
            count = len(m["marks"]) // 12
            places.append(np.frombuffer(m["marks"], dtype="<u4", count=count).astype(np.int64))
            masks.append(np.frombuffer(m["marks"], dtype="<u8", offset=4 * count))
    place = np.concatenate(places) if places else np.empty(0, np.int64)
    mask = np.concatenate(masks) if masks else np.empty(0, np.uint64)
    by_place = np.zeros(n + 1, dtype=np.uint64)
    np.bitwise_or.at(by_place, place, mask)
    for m in marks:
        if m["passed"]:
            pairs = np.frombuffer(m["marks"], dtype="<i8").reshape(-1, 2)
            by_place[pairs[:, 0]] = np.where(pairs[:, 1] < 0, full, by_place[pairs[:, 1]])
    at = np.flatnonzero(by_place[:n])
    text = np.searchsorted(block.ends, at, side="right")
    start = np.maximum(block.begins[text], at - (length - ANCHOR))
    last = np.minimum(block.ends[text] - length, at)
    masks = by_place[at]
    begun = np.zeros(n + 1, dtype=bool)
    for k in range(wide):
        hit = ((masks >> np.uint64(k)) & np.uint64(1) == 1) & (start + k <= last)
        begun[start[hit] + k] = True
    # Strings that meet make one run.
    at = np.flatnonzero(begun)
    apart = np.diff(at) > length
    runs = np.stack((at[np.append(True, apart)[: len(at)]], at[np.append(apart, True)[: len(at)]] + length), axis=1)
    lengths = np.diff(runs.ravel(), prepend=0, append=n)
    gone = np.repeat(np.arange(len(lengths)) % 2 == 1, lengths)
    for t in np.flatnonzero(copies).tolist():
        if block.ends[t] - block.begins[t] >= length:
            gone[block.begins[t] : block.ends[t]] = True
    return gone


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", length: int = LENGTH
) -> DataFrame:
    """One row per row of ``docs``: id, n_bytes, n_removed, n_spans, kept_sha256, spans.

    A byte goes if a string of ``length`` bytes that covers it also begins in a document
    of smaller id; the input decides, not what is left. ``spans`` are the removed runs.

    Texts are packed into blocks once and stay there. Anchors (one per string, chosen by
    hash) find strings that may occur in two different texts; the bytes around each such
    anchor go to the shard of its hash, where equal ones are joined under their least
    document and a suffix array, built by induced sorting, and its permuted common
    prefixes tell exactly which strings are repeated. In a shard with more contexts than
    one suffix array may take, as that of an anchor with very many surroundings, each
    string gets an anchor of twice the bytes, and the bytes around that go to its shard
    and suffix array; what is too much for one there goes by whole strings, the least
    document of each by an aggregate. Only those decisions return to the blocks. A text that equals one of a smaller id goes as a whole if it is long enough.

    A null text is empty. A null id is larger than all others; rows that share an id are
    one document to the rule and do not remove one another's bytes. Ids are whole
    numbers. Other columns are ignored; an empty table gives an empty one. The blocks are
    a bucketed table in the shared folder; it and all other intermediate tables are
    deleted before the result is returned.
    """
    spark = docs.sparkSession
    plain = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text).cast("string").alias("_text"))
    total = plain.agg(F.sum(F.coalesce(F.octet_length("_text"), F.lit(0)).cast("long"))).first()[0] or 0
    parts = max(1, -(-total // PART_BYTES))
    shards = max(1, -(-total // SHARD_BYTES))
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // (4 * BLOCK_BYTES)))
    name, path = f"vitrina_blocks_{uuid.uuid4().hex}", new_path(spark, "blocks")
    (
        _pack_blocks(plain, length).write.format("parquet").option("compression", "zstd")
        .option("path", path).bucketBy(buckets, "block").saveAsTable(name)
    )
    blocks = spark.table(name)

    owners = blocks.select("block", "ids", "digests").mapInArrow(
        _owners, "block long, at int, _id long, _key binary"
    )
    owners = keep(owners, "owners")
    first = keep(owners.groupBy("_key").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1"), "first")
    copies = owners.join(first, "_key").where("_id > _first").groupBy("block").agg(F.collect_list("at").alias("copies"))

    shared = keep(_shared(_entries(blocks, parts)), "shared")
    contexts = keep(_contexts(blocks, shared, parts, shards, length), "contexts")
    few, many = _divided(contexts, SHARD_CONTEXTS)
    marks = [keep(_marks(few, length, ANCHOR), "marks")]
    n_many = many.agg(F.sum("n_contexts")).first()[0]
    if n_many:
        # A context has some three longer anchors.
        more = max(1, -(-3 * n_many // (SHARD_CONTEXTS // 3 + 1)))
        longer = keep(_long_contexts(many, more, length), "long-contexts")
        discard(contexts)
        few, many = _divided(longer, SHARD_CONTEXTS)
        marks.append(keep(_marks(few, length, LONG_ANCHOR), "marks"))
        if not many.isEmpty():
            marks.append(keep(_string_marks(many, length), "marks"))
        discard(longer)
    else:
        discard(contexts)
    every = functools.reduce(DataFrame.unionByName, marks)
    by_block = every.groupBy("block").agg(F.collect_list(F.struct("passed", "marks")).alias("marks"))
    sides = by_block.join(copies, "block", "full").select("block", "marks", "copies")
    joined = blocks.join(sides.hint("shuffle_hash"), "block", "left")

    schema = (
        "_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, "
        "spans array<struct<start:long,end:long>>"
    )

    def cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
        for batch in batches:
            for i in range(batch.num_rows):
                _, *values, marks, copies = [c[i].as_py() for c in batch.columns]
                block = Block(*values)
                whole = np.zeros(len(block.ids), dtype=bool)
                whole[copies or []] = True
                gone = _covered(block, marks or [], whole, length)
                out = {c: [] for c in ("_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans")}
                for t, (a, b) in enumerate(zip(block.begins.tolist(), block.ends.tolist())):
                    own = gone[a:b]
                    edges = np.flatnonzero(np.diff(own.astype(np.int8), prepend=0, append=0))
                    out["_id"].append(None if block.ids[t] == LAST_ID else int(block.ids[t]))
                    out["n_bytes"].append(b - a)
                    out["n_removed"].append(int(own.sum()))
                    out["n_spans"].append(len(edges) // 2)
                    out["kept_sha256"].append(hashlib.sha256(block.data[a:b][~own].tobytes()).hexdigest())
                    out["spans"].append([{"start": s, "end": e} for s, e in edges.reshape(-1, 2).tolist()])
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(span)]
                yield _rows({c: (v, k) for (c, v), k in zip(out.items(), kinds)})

    result = keep(joined.select("block", *_BLOCK_COLUMNS, "marks", "copies").mapInArrow(cleaned, schema), "cleaned")
    spark.sql(f"DROP TABLE {name}")
    blocks.kept_at = path
    discard(blocks, owners, first, shared, *marks)
    return result.withColumnRenamed("_id", id_col)


def _owners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text's id and digest, and its place in its block."""
    for batch in batches:
        for number, ids, digests in zip(*[c.to_pylist() for c in batch.columns]):
            owner = np.frombuffer(ids, dtype="<i8")
            yield _rows({
                "block": ([number] * len(owner), pa.int64()),
                "at": (list(range(len(owner))), pa.int32()),
                "_id": (owner.tolist(), pa.int64()),
                "_key": ([digests[k : k + 16] for k in range(0, len(digests), 16)], pa.binary()),
            })
