"""Suffix arrays by induced sorting, vectorised bucket by bucket."""

from __future__ import annotations

import numpy as np

_RANDOM = np.random.default_rng(5_003)
_BYTE = _RANDOM.integers(0, 2**64, 256, dtype=np.uint64)
_BASE = 0xD6E8FEB86659FD93


def suffix_types(t: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one; the empty suffix is the smallest."""
    n = len(t)
    out = np.zeros(n, dtype=bool)
    if n > 1:
        decided = np.where(t[:-1] != t[1:], np.arange(n - 1), n)
        after = np.minimum.accumulate(decided[::-1])[::-1]
        known = after < n
        smaller = t[:-1] < t[1:]
        out[:-1][known] = smaller[after[known]]
    return out


def _deal(places: np.ndarray, chars: np.ndarray, buckets: list[list[np.ndarray]]) -> None:
    """Append places to the buckets of their characters, in order."""
    if not len(places):
        return
    order = np.argsort(chars, kind="stable")
    places, chars = places[order], chars[order]
    cuts = np.flatnonzero(chars[1:] != chars[:-1]) + 1
    starts = [0, *cuts.tolist()]
    for lo, hi in zip(starts, [*starts[1:], len(places)]):
        buckets[chars[lo]].append(places[lo:hi])


def _joined(parts: list[np.ndarray]) -> np.ndarray:
    if not parts:
        return np.empty(0, dtype=np.int32)
    return parts[0] if len(parts) == 1 else np.concatenate(parts)


def induce(t: np.ndarray, smaller: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """All suffixes, ordered from the order of the leftmost-smaller ones (``seeds``).

    Each bucket of a first character is passed once in each direction. Its suffixes
    place their left neighbours; a neighbour of the same character joins the bucket that
    is being passed and is handled in the next turn, in order.
    """
    n = len(t)
    seeded: list[list[np.ndarray]] = [[] for _ in range(256)]
    _deal(seeds, t[seeds], seeded)
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    waiting[t[n - 1]].append(np.array([n - 1], dtype=np.int32))
    larger: list[np.ndarray] = []
    for c in range(256):
        done, now = [], _joined(waiting[c])
        while len(now):
            done.append(now)
            left = now[now > 0] - 1
            left = left[~smaller[left]]
            chars = t[left]
            same = chars == c
            _deal(left[~same], chars[~same], waiting)
            now = left[same]
        larger.append(_joined(done))
        if seeded[c]:
            left = _joined(seeded[c]) - 1
            _deal(left, t[left], waiting)
    waiting = [[] for _ in range(256)]
    parts: list[np.ndarray] = []
    for c in range(255, -1, -1):
        done, now = [], _joined(waiting[c])
        while len(now):
            done.append(now)
            left = now[now > 0] - 1
            left = left[smaller[left]]
            chars = t[left]
            same = chars == c
            _deal(left[~same], chars[~same], waiting)
            now = left[same]
        parts.append(_joined(done)[::-1])
        parts.append(larger[c])
        left = larger[c][::-1]
        left = left[left > 0] - 1
        left = left[smaller[left]]
        _deal(left, t[left], waiting)
    return np.concatenate(parts[::-1])


def suffix_array(t: np.ndarray, depth: int) -> np.ndarray:
    """Starts of all suffixes of the bytes ``t``, sorted by at least their first ``depth`` bytes.

    Leftmost-smaller substrings are sorted by induction and named; the shorter text of
    names is sorted in turn, by ranks of doubled length, up to as many names as ``depth``
    bytes can hold (two names never start closer than two bytes); its order induces that
    of all suffixes. Suffixes that agree in ``depth`` bytes may stand in any order.
    """
    n = len(t)
    if n == 0:
        return np.empty(0, dtype=np.int32)
    smaller = suffix_types(t)
    leftmost = smaller.copy()
    leftmost[0] = False
    leftmost[1:] &= ~smaller[:-1]
    seeds = np.flatnonzero(leftmost).astype(np.int32)
    if len(seeds) > 1:
        first = induce(t, smaller, seeds)
        ordered = first[leftmost[first]]
        seeds = seeds[_order_of_names(_names(t, seeds, ordered), depth)]
    return induce(t, smaller, seeds)


def _names(t: np.ndarray, seeds: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Name of each leftmost-smaller substring in text order: its rank among distinct ones."""
    n = len(t)
    powers = np.full(n + 1, _BASE, dtype=np.uint64)
    powers[0] = 1
    np.multiply.accumulate(powers, out=powers)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_BYTE[t] * powers[:n], out=sums[1:])
    ends = np.append(seeds[1:] + 1, n)
    # Equal substrings have equal sums up to the power of their start; bring all to one power.
    place = np.empty(n, dtype=np.int32)
    place[seeds] = np.arange(len(seeds), dtype=np.int32)
    at = place[ordered]
    lo, hi = seeds[at], ends[at]
    value = sums[hi] - sums[lo]
    a, b = lo[:-1], lo[1:]
    # value_a * base^(b) == value_b * base^(a) if the substrings are equal.
    same = (hi[:-1] - a == hi[1:] - b) & (value[:-1] * powers[b] == value[1:] * powers[a])
    rank = np.concatenate(([0], np.cumsum(~same)))
    names = np.empty(len(seeds), dtype=np.int64)
    names[at] = rank
    return names


def _order_of_names(names: np.ndarray, depth: int) -> np.ndarray:
    """Order of the suffixes of a text of names."""
    m, step = len(names), 1
    order = np.argsort(names, kind="stable")
    while names[order[-1]] < m - 1 and 2 * step < depth:
        after = np.zeros(m, dtype=np.int64)
        after[:-step] = names[step:] + 1 if step < m else 0
        key = names * (m + 1) + after
        order = np.argsort(key, kind="stable")
        ranked = key[order]
        names = np.empty(m, dtype=np.int64)
        names[order] = np.concatenate(([0], np.cumsum(ranked[1:] != ranked[:-1])))
        step *= 2
        if step >= m:
            break
    return order


def permuted_common_prefixes(t: np.ndarray, sa: np.ndarray, most: int) -> np.ndarray:
    """For every place in text order: bytes in common with its forerunner in ``sa``, up to ``most``."""
    n = len(t)
    padded = np.concatenate((t, np.zeros(most + 8, dtype=np.uint8)))
    words = np.ndarray(buffer=padded, shape=(n + most,), dtype="<u8", strides=(1,))
    before = np.empty(n, dtype=np.int32)
    before[sa[0]] = -1
    before[sa[1:]] = sa[:-1]
    out = np.zeros(n, dtype=np.int32)
    live = np.flatnonzero(before >= 0)
    for at in range(0, most, 8):
        differ = words[live + at] ^ words[before[live] + at]
        unequal = differ != 0
        low = differ[unequal]
        low &= ~low + np.uint64(1)
        out[live[unequal]] = at + (np.log2(low.astype(np.float64)).astype(np.int64) >> 3)
        live = live[~unequal]
    out[live] = most
    # No prefix reaches beyond the text.
    room = n - np.maximum(np.arange(n), before)
    return np.minimum(np.minimum(out, room), most)
