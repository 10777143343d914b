"""Sets of word shingles as sorted 64-bit hashes, for many texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

WIDTH = 5
# Bytes of text that are hashed together; a longer text is hashed by itself.
SLICE = 1_000_000

_RANDOM = np.random.default_rng(7_561)
_BYTE = _RANDOM.integers(0, 2**64, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_PLACE = _RANDOM.integers(0, 2**64, WIDTH, dtype=np.uint64) | np.uint64(1)
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Shingler:
    """Turns texts into sets; keeps the powers it needs."""

    def __init__(self):
        self.up = _powers(_BASE, SLICE + 2)
        self.down = _powers(pow(_BASE, -1, 2**64), SLICE + 2)

    def _grow(self, n: int) -> None:
        if n > len(self.up):
            self.up = _powers(_BASE, n)
            self.down = _powers(pow(_BASE, -1, 2**64), n)

    def sets(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All texts' sets after one another, and each set's size.

        ``data`` holds the texts' bytes; text i ends before ``ends[i]``.
        """
        n_texts = len(ends)
        sizes = np.zeros(n_texts, dtype=np.int64)
        if not len(data):
            return np.empty(0, np.uint64), sizes
        self._grow(len(data) + 2)
        inside = ~_SPACE[data]
        begins = np.concatenate(([0], ends[:-1]))
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        text_first = begins[begins < len(data)]
        first[text_first] = inside[text_first]
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        text_last = ends[(ends > 0)] - 1
        last[text_last] = inside[text_last]
        lo, hi = np.flatnonzero(first), np.flatnonzero(last) + 1
        if not len(lo):
            return np.empty(0, np.uint64), sizes
        sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(_BYTE[_FOLD[data]] * self.up[: len(data)], out=sums[1:])
        words = _mixed((sums[hi] - sums[lo]) * self.down[lo] + (hi - lo).astype(np.uint64))
        del sums
        # Words per text, and the place of each text's first word.
        text_of = np.searchsorted(ends, lo, side="right")
        n_words = np.bincount(text_of, minlength=n_texts)
        word0 = np.concatenate(([0], np.cumsum(n_words)[:-1]))
        n_grams = np.where(n_words >= WIDTH, n_words - WIDTH + 1, 0)
        grams = np.zeros(max(len(words) - WIDTH + 1, 0), dtype=np.uint64)
        for k in range(WIDTH):
            grams += words[k : k + len(grams)] * _PLACE[k]
        grams = _mixed(grams)
        parts = []
        for i in np.flatnonzero(n_words):
            if n_grams[i]:
                own = np.unique(grams[word0[i] : word0[i] + n_grams[i]])
            else:
                few = words[word0[i] : word0[i] + n_words[i]]
                own = _mixed((few * _PLACE[: len(few)]).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(few)))
            sizes[i] = len(own)
            parts.append(own)
        return np.concatenate(parts), sizes


def text_slices(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Slices of a column of texts: first row, next row, bytes, ends. Nulls are empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
    row = 0
    while row < len(column):
        stop = int(np.searchsorted(offsets, offsets[row] + SLICE, side="right")) - 1
        stop = min(max(stop, row + 1), len(column))
        yield row, stop, data[offsets[row] : offsets[stop]], offsets[row + 1 : stop + 1] - offsets[row]
        row = stop
