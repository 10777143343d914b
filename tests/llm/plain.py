"""Plain versions of the operators' rules, and small tables with odd rows."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np

WORD = re.compile("[^\x20\x09-\x0D]+")
UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, kept string, n_words string, _row string"
PAGE_SCHEMA = "page_id long, url string, html string, host string, text string, ratio string"


def prose(seed: int, n: int, vocabulary: int = 400) -> str:
    rng = np.random.default_rng(seed)
    words = ["".join(rng.choice(list("abcdefghijklmnop"), rng.integers(2, 8))) for _ in range(vocabulary)]
    return " ".join(words[i] for i in rng.integers(0, vocabulary, n))


def odd_rows() -> list[tuple]:
    """Nulls, empty and long texts, copies, near copies, shared passages, repeated rows."""
    base, passage, long = prose(1, 120), prose(2, 40), prose(3, 9_000)
    texts: list[tuple] = [
        (0, base, "a"), (1, base, "a"), (2, base.upper(), "b"), (3, base + " one more word here", None),
        (4, None, "a"), (5, "", "b"), (6, " \t\n ", "b"), (7, "word", "c"), (8, "WORD", "c"), (9, "a b c", "c"),
        (10, passage, "a"), (11, prose(4, 60) + " " + passage + " " + prose(5, 50), "a"),
        (12, prose(6, 30) + "\n" + passage, None), (13, long, "b"), (14, long + " x", "b"),
        (15, "same line here\nsame line here\nsame line here\n\n\nother", "d"), (16, "# * $ % & | < >", "d"),
        (17, "é ü ß 日本語 текст " + base, "é"), (18, "x" * 5_000, "d"), (19, "ab" * 3_000, "d"),
        (20, "one two three four five " * 30, "d"), (21, base.replace(" ", "\n"), "a"),
        (22, "tail " + passage[:200], "c"), (23, passage[10:], "c"), (None, "no id here " + passage, "c"),
    ]
    texts += [(100 + i, prose(50 + i, 80), "a" if i % 2 else "hot") for i in range(20)]
    texts += [(200 + i, base + f" tail{i}", "hot") for i in range(15)]
    texts += [texts[0], texts[5]]
    return [(i, t, "en", s, 1, "size", "kept", "words", "row") for i, t, s in texts]


def words(text: str | None) -> list[str]:
    return WORD.findall(text or "")


def shingles(text: str | None) -> frozenset:
    w = words((text or "").translate(UP))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))


def roots(nodes, links) -> dict:
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def repeat_words(w: list[str]) -> int:
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    count = Counter(grams)
    return len({i + k for i, g in enumerate(grams) if count[g] > 1 for k in range(5)})


def removed_bytes(rows: list[tuple], length: int = 50) -> dict[int, list[bool]]:
    """Per row (by place): which bytes go."""
    first: dict[bytes, float] = {}
    data = [(float("inf") if i is None else i, (t or "").encode()) for i, t in rows]
    for i, b in data:
        for k in range(len(b) - length + 1):
            s = b[k : k + length]
            first[s] = min(first.get(s, float("inf")), i)
    out = {}
    for at, (i, b) in enumerate(data):
        gone = [False] * len(b)
        for k in range(len(b) - length + 1):
            if first[b[k : k + length]] < i:
                gone[k : k + length] = [True] * length
        out[at] = gone
    return out


def water_fill(sizes: dict, weights: dict, most: int = 3) -> dict:
    total, capped = sum(sizes.values()), {}
    while True:
        free = [s for s in sizes if s not in capped]
        rest = total - sum(capped.values())
        share = {s: rest * weights[s] / sum(weights[f] for f in free) for s in free}
        over = [s for s in free if share[s] > most * sizes[s]]
        if not over:
            return capped | share
        capped |= {s: most * sizes[s] for s in over}


def by_key(rows, *names):
    out = defaultdict(list)
    for r in rows:
        out[tuple(r[n] for n in names)].append(r)
    return out
