"""Periodic runs of words: recursive frequency splitting, then a scan over lags."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

# A run has a period's words at least so many times, and so many words.
TIMES = 3
LEAST = 24
# Bytes of text that are split into words together.
SLICE = 1_000_000

_SPACES = b" \t\n\x0b\x0c\r"


def surviving_segments(codes: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stretches that can hold runs, of the stretches [begins, ends) of ``codes``.

    Every word of a run occurs at least TIMES times in it. A word that occurs less often
    within its segment is in no run of it and splits the segment; the parts are counted
    anew until no part splits. All segments of a step are counted together. A segment
    that a step leaves whole is stable; only parts of split ones are looked at again.
    """
    done_lo, done_hi = [], []
    lo, hi = begins, ends
    values = int(codes.max(initial=0)) + 1
    while True:
        long = hi - lo >= LEAST
        lo, hi = lo[long], hi[long]
        if not len(lo):
            break
        sizes = hi - lo
        base = np.concatenate(([0], np.cumsum(sizes)))
        segment = np.repeat(np.arange(len(lo)), sizes)
        place = np.arange(base[-1]) - base[segment] + lo[segment]
        _, which, counts = np.unique(
            segment * values + codes[place], return_inverse=True, return_counts=True
        )
        alive = counts[which] >= TIMES
        whole = np.logical_and.reduceat(alive, base[:-1])
        done_lo.append(lo[whole])
        done_hi.append(hi[whole])
        # Stretches of living words inside the split segments.
        go = alive & ~whole[segment]
        edge = np.ones(len(go) + 1, dtype=bool)
        edge[1:-1] = (go[1:] != go[:-1]) | (segment[1:] != segment[:-1])
        cuts = np.flatnonzero(edge)
        live = go[cuts[:-1]]
        lo = place[cuts[:-1]][live]
        hi = place[cuts[1:] - 1][live] + 1
    return (
        np.concatenate(done_lo) if done_lo else np.empty(0, np.int64),
        np.concatenate(done_hi) if done_hi else np.empty(0, np.int64),
    )


def _stretches(equal: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    change = np.diff(equal.astype(np.int8), prepend=0, append=0)
    return np.flatnonzero(change == 1), np.flatnonzero(change == -1)


def segment_runs(words: np.ndarray) -> list[tuple[int, int, int]]:
    """All runs (start, length, period) of a segment given as word numbers.

    A run of lag q is a stretch of max(LEAST, TIMES * q) - q or more equal pairs of words
    q apart. Short lags are scanned whole. At a longer one such a stretch covers
    one of the blocks [k q, (k + 1) q), so only blocks whose first words, then some more,
    then all are equal to the next block's lead to a scan. Lags rise; what lies in
    a run whose period divides the lag is that run again and is passed over.
    """
    n, found = len(words), []
    by_period: dict[int, list[tuple[int, int]]] = {}

    def enter(q: int, equal: np.ndarray) -> None:
        lo, hi = _stretches(equal)
        wide = hi - lo >= max(LEAST, TIMES * q) - q
        for a, b in zip(lo[wide].tolist(), (hi[wide] + q).tolist()):
            if not known(q, a, b):
                by_period.setdefault(q, []).append((a, b))
                found.append((a, b - a, q))

    def known(q: int, a: int, b: int) -> bool:
        return any(s <= a and b <= e for p, runs in by_period.items() if q % p == 0 for s, e in runs)

    short = LEAST // TIMES
    for q in range(1, min(short, n // TIMES) + 1):
        enter(q, words[:-q] == words[q:])
    for q in range(short + 1, n // TIMES + 1):
        heads = words[::q]
        blocks = np.flatnonzero(heads[:-1] == heads[1:]) * q
        blocks = blocks[blocks + 2 * q <= n]
        for part in (q // 2, q // 4, 3 * q // 4, q - 1):
            if not len(blocks):
                break
            blocks = blocks[words[blocks + part] == words[blocks + part + q]]
        if not len(blocks):
            continue
        for p, runs in by_period.items():
            if q % p == 0:
                for s, e in runs:
                    blocks = blocks[(blocks < s) | (blocks + 2 * q > e)]
        if any(np.array_equal(words[b : b + q], words[b + q : b + 2 * q]) for b in blocks.tolist()):
            enter(q, words[:-q] == words[q:])
    return sorted(found, key=lambda r: (r[0], r[2]))


def text_runs(texts: list[bytes]) -> list[tuple[list[bytes], list[tuple[int, int, int]]]]:
    """Words and runs of each text."""
    split = [t.split() for t in texts]
    number: dict[bytes, int] = {}
    codes = np.array([number.setdefault(w, len(number)) for ws in split for w in ws], dtype=np.int64)
    ends = np.cumsum([len(ws) for ws in split])
    begins = np.concatenate(([0], ends[:-1])).astype(np.int64)
    runs: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    lo, hi = surviving_segments(codes, begins, ends)
    order = np.argsort(lo, kind="stable")
    for a, b in zip(lo[order].tolist(), hi[order].tolist()):
        t = int(np.searchsorted(ends, a, side="right"))
        first = int(begins[t])
        runs[t] += [(a - first + s, length, q) for s, length, q in segment_runs(codes[a:b])]
    return list(zip(split, (sorted(r, key=lambda x: (x[0], x[2])) for r in runs)))


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words but those that any run holds after its first period, joined by spaces."""
    if not runs:
        return b" ".join(words)
    gone = np.zeros(len(words), dtype=bool)
    for start, length, period in runs:
        gone[start + period : start + length] = True
    return b" ".join([w for w, g in zip(words, gone.tolist()) if not g])


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_words, runs, collapsed.

    Words are ``[^\\x20\\x09-\\x0D]+``. A run is a stretch of words in which words one period
    apart are equal, of at least 24 words and three periods, that no neighbouring
    word extends; its period is the smallest. ``runs`` are all of them as (start, length,
    period), by start, then period; ``collapsed`` is the text without what repeats.

    Rows stay where they are: nothing is shuffled, every text is taken whole and alone,
    and a task holds about a megabyte of texts or one longer text at a time. A null or empty text has no words,
    no runs and an empty ``collapsed``. Null and repeated ids are rows like all others.
    Other columns are ignored; an empty table gives an empty one.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first = 0
            while first < batch.num_rows:
                texts, held, stop = [], 0, first
                while stop < batch.num_rows and (not texts or held < SLICE):
                    texts.append(batch.column(1)[stop].as_py())
                    held += len(texts[-1])
                    stop += 1
                results = text_runs(texts)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, stop - first),
                        pa.array([len(w) for w, _ in results], pa.int64()),
                        pa.array([[dict(zip(("start", "length", "period"), r)) for r in rs] for _, rs in results],
                                 pa.list_(run)),
                        pa.array([collapsed(w, rs).decode() for w, rs in results], pa.string()),
                    ],
                    names=["id", "n_words", "runs", "collapsed"],
                )
                first = stop

    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).cast("binary")
    found = docs.select(F.col(f"`{id_col}`").alias("id"), body.alias("body")).mapInArrow(searched, schema)
    return found.withColumnRenamed("id", id_col)


def strongest(runs: Column) -> Column:
    """The run with the greatest length / period, compared exactly; the first of equals; null without runs."""
    def better(best: Column, run: Column) -> Column:
        more = run["length"] * best["period"] > best["length"] * run["period"]
        return F.when(best.isNull() | more, run).otherwise(best)

    none = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    return F.aggregate(runs, none, better)
