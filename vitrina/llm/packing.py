"""Best-fit packing of token sequences, certified by dual-feasible lower bounds."""

from __future__ import annotations

import re
from collections import ChainMap
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from vitrina.llm.common import discard, keep

CAPACITY = 2048
END = 0
# Pieces that one task packs together.
PER_PART = 20_000
MAX_ROUNDS = 8
# Words that a worker remembers, and characters of text it encodes together.
REMEMBERED = 600_000
TOGETHER = 500_000

# Texts of these characters are split into words here and each word is encoded once;
# in all other texts the library does everything. No character of the class has a
# composed form, and lower() maps each within the class.
PLAIN = re.compile("[\\t\\n\\r -~¡-ªº»¿À-ÖØ-öø-ÿ‘’“”–—…]*")
PLAIN_WORD = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zªºß-öø-ÿ]+|[0-9]|[^\\sa-z0-9ªºß-öø-ÿ]+")

# Byte-level files write a byte as the character of its number, but for those that are no
# visible Latin-1 character: they take the numbers from 256 on, in order.
_VISIBLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_CHARS = {b: chr(256 + k) for k, b in enumerate(sorted(set(range(256)) - set(_VISIBLE)))}


class WordEncoder:
    """Ids of texts by a tokenizer file whose words are encoded independently."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]

    def _ids(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.asarray(e.ids, dtype="<u4").tobytes() for e in found]

    def _word_ids(self, word: str) -> bytes:
        """Ids of a single plain word; its bytes stand for characters as in all byte-level files."""
        tokens = self.tokenizer.model.tokenize(word.encode().decode("latin-1").translate(BYTE_CHARS))
        return np.asarray([t.id for t in tokens], dtype="<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit numbers."""
        split = [
            PLAIN_WORD.findall(t.lower()) if PLAIN.fullmatch(t) and not any(s in t for s in self.special) else None
            for t in texts
        ]
        known = self.known
        new: set[str] = set()
        for words in split:
            if words:
                new |= set(words).difference(known)
        if new:
            coded = {w: self._word_ids(w) for w in new}
            if len(known) < REMEMBERED:
                known.update(coded)
            else:
                # Full: what came first and so is frequent stays; the rest is encoded again.
                known = ChainMap(coded, known)
        return [
            self._ids([t])[0] if words is None else b"".join([known[w] for w in words])
            for t, words in zip(texts, split)
        ]


@lru_cache(maxsize=1)
def _encoder(path: str) -> WordEncoder:
    """Kept by a worker from task to task."""
    return WordEncoder(path)


def _together(column: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts of about TOGETHER characters, with the place of the first; nulls are empty."""
    first, held, texts = 0, 0, []
    for at, value in enumerate(column):
        texts.append(value.as_py() or "")
        held += len(texts[-1])
        if held >= TOGETHER:
            yield first, texts
            first, held, texts = at + 1, 0, []
    if texts:
        yield first, texts


def tokenize(
    docs: DataFrame,
    tokenizer: str,
    id_col: str = "doc_id",
    text: str = "text",
    capacity: int = CAPACITY,
    end: int = END,
) -> DataFrame:
    """One row per piece: id, piece, start, length, ids (binary, 4 bytes each).

    ``tokenizer`` is the name of a public tokenizer's file. A document's ids end with
    ``end``; a null text is empty and has that id alone. Only longer documents are cut.
    """
    schema = f"_id {dict(docs.dtypes)[id_col]}, piece int, start long, length long, ids binary"

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        import public_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder = _encoder(public_tokenizers.path(tokenizer))
        last = np.asarray([end], dtype="<u4").tobytes()
        step = 4 * capacity
        for batch in batches:
            for lo, texts in _together(batch.column(1)):
                rows, piece, start, length, data = [], [], [], [], []
                for at, ids in enumerate(encoder.encode(texts)):
                    coded = ids + last
                    for k, cut in enumerate(range(0, len(coded), step)):
                        part = coded[cut : cut + step]
                        rows.append(lo + at)
                        piece.append(k)
                        start.append(cut // 4)
                        length.append(len(part) // 4)
                        data.append(part)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(rows, pa.int64())),
                        pa.array(piece, pa.int32()),
                        pa.array(start, pa.int64()),
                        pa.array(length, pa.int64()),
                        pa.array(data, pa.binary()),
                    ],
                    names=["_id", "piece", "start", "length", "ids"],
                )

    plain = docs.select(F.col(id_col).alias("_id"), F.col(text).alias("_text"))
    return plain.mapInArrow(pieces, schema).withColumnRenamed("_id", id_col)


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """The best dual-feasible bound on the number of bins.

    The functions are the identity and, for every threshold that is a length, the step
    that counts large pieces whole, drops small ones and keeps those between; each maps
    any set that fits one bin to at most one bin's worth.
    """
    if not len(lengths):
        return 0
    counts = np.bincount(lengths, minlength=capacity + 1)
    values = np.arange(capacity + 1)
    total = np.cumsum(counts * values)
    number = np.cumsum(counts)
    bounds = [-(-int(total[-1]) // capacity)]
    eps = np.unique(lengths[lengths <= capacity // 2])
    large = number[-1] - number[capacity - eps]
    between = total[capacity - eps] - total[eps - 1]
    if len(eps):
        bounds.append(int((large + -(-between // capacity)).max()))
    # Steps: a piece of more than capacity * i / (k + 1) counts i of k, exact multiples as they are.
    for k in range(1, 21):
        scaled = values * (k + 1)
        whole = scaled % capacity == 0
        step = np.where(whole, values * k, (scaled // capacity) * capacity)
        bounds.append(-(-int((step * counts).sum()) // (k * capacity)))
    return max(bounds)


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of each piece (given longest first), and the number of bins."""
    bins = np.empty(len(lengths), dtype=np.int64)
    offsets = np.empty(len(lengths), dtype=np.int64)
    with_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, used = 0, 0
    for i, n in enumerate(lengths.tolist()):
        above = mask >> n
        if above:
            room = (above & -above).bit_length() - 1 + n
            bin_ = with_room[room].pop()
            if not with_room[room]:
                mask &= ~(1 << room)
        else:
            room, bin_ = capacity, used
            used += 1
        bins[i], offsets[i] = bin_, capacity - room
        if room > n:
            with_room[room - n].append(bin_)
            mask |= 1 << (room - n)
    return bins, offsets, used


def pack(pieces: DataFrame, capacity: int = CAPACITY, per_part: int = PER_PART) -> DataFrame:
    """Add sequence_id and offset to rows with a ``length`` from 1 to ``capacity``.

    Pieces are dealt by hash to parts of about ``per_part`` and each part is packed best
    fit decreasing, next to its lower bound. A part that uses as many bins as its bound
    is certified. Bins without a gap are final; the pieces of all other bins are dealt
    anew, to fewer parts, and packed again, until the bins of the open pieces meet the
    bound on all of them together or a round saves nothing. No round drops a piece: if
    a round's result is worse than the one before, the one before stays.
    """
    order = [c for c in pieces.columns]
    rows = keep(pieces.withColumn("_row", F.monotonically_increasing_id()), "pieces")
    full = rows.where(F.col("length") == capacity).withColumns(
        {"sequence_id": F.col("_row"), "offset": F.lit(0).cast("long")}
    )
    open_rows = rows.where(F.col("length") < capacity)
    done, before = [full], None
    n_open = open_rows.count()
    for round_ in range(MAX_ROUNDS):
        if not n_open:
            break
        n_parts = -(-n_open // per_part)
        packed = keep(_pack_parts(open_rows, n_parts, round_, capacity), "packed")
        sums = packed.agg(
            F.count_distinct("sequence_id").alias("bins"), F.sum("length").alias("tokens")
        ).first()
        if before is not None and sums["bins"] >= before[0]:
            discard(packed)
            break
        if before is not None:
            discard(before[1])
        closed = packed.where("_gap = 0 ")
        still = packed.where("_gap > 0")
        left = still.agg(
            F.count(F.lit(1)).alias("n"), F.count_distinct("sequence_id").alias("bins"),
            F.coalesce(F.sum("length"), F.lit(0)).alias("tokens"),
        ).first()
        if left["bins"] <= -(-left["tokens"] // capacity) or n_parts == 1:
            done.append(packed.drop("_gap"))
            n_open, before = 0, None
            break
        done.append(closed.drop("_gap"))
        kept_still = keep(still, "open-pieces")
        before = (left["bins"], kept_still)
        open_rows = kept_still.drop("sequence_id", "offset", "_gap")
        n_open = left["n"]
    if before is not None:
        done.append(before[1].drop("_gap"))
    result = done[0]
    for part in done[1:]:
        result = result.unionByName(part)
    return result.select(*order, "sequence_id", "offset")


def _pack_parts(rows: DataFrame, n_parts: int, round_: int, capacity: int) -> DataFrame:
    light = rows.withColumn("_part", F.pmod(F.xxhash64(F.lit(round_), "_row"), F.lit(n_parts)).cast("int"))
    schema = "_row long, sequence_id long, offset long, _gap long"

    def place(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["length", "_row"], ascending=[False, True])
        lengths = frame["length"].to_numpy()
        bins, offsets, used = best_fit_decreasing(lengths, capacity)
        gap = capacity - np.bincount(bins, weights=lengths, minlength=used).astype(np.int64)
        if used > 1 and used == lower_bound(lengths, capacity) and gap.sum() < capacity:
            # Certified: only the emptiest bin takes part in the next exchange.
            gap[np.arange(used) != gap.argmax()] = 0
        part = int(frame["_part"].iloc[0])
        base = -1 - ((round_ << 56) | (part << 24))
        return pd.DataFrame(
            {"_row": frame["_row"].to_numpy(), "sequence_id": base - bins, "offset": offsets, "_gap": gap[bins]}
        )

    placed = light.select("_row", "length", "_part").groupBy("_part").applyInPandas(place, schema)
    return rows.join(placed, "_row")


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    id_col: str = "doc_id",
    text: str = "text",
    capacity: int = CAPACITY,
    per_part: int = PER_PART,
    keep_ids: bool = True,
) -> DataFrame:
    """Tokenize, cut and pack: id, piece, start, length, ids_crc32, sequence_id, offset.

    With ``keep_ids`` the pieces' ids follow. Repeated rows are packed as often as they
    occur, rows with a null id too; other columns are ignored; an empty table gives an
    empty one.
    """
    pieces = tokenize(docs, tokenizer, id_col, text, capacity).select(
        id_col, "piece", "start", "length", F.crc32("ids").alias("ids_crc32"),
        *(["ids"] if keep_ids else []),
    )
    return pack(pieces, capacity, per_part)
