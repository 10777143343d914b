"""Exact copies, periodic runs and ranked search against plain versions."""

import glob
import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tests.llm.plain import DOC_SCHEMA, UP, odd_rows, prose, words
from vitrina.llm import ranking
from vitrina.llm.periods import LEAST, periodic_runs, segment_runs, strongest, surviving_segments
from vitrina.llm.queries import planted_periods
from vitrina.llm.radix import exact_groups


# Exact copies ---------------------------------------------------------------

def plain_groups(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    out = Counter()
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        left = 1
        for i in ids:
            kept = i == keep and left == 1
            left -= kept
            out[(i, keep, len(ids), kept, hashlib.sha256(t.encode()).hexdigest())] += 1
    return out


def test_copies_equal_plain_groups(spark, odd):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    found = exact_groups(odd)
    assert found.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert Counter(tuple(r) for r in found.collect()) == plain_groups(rows)


def test_copies_of_long_texts_and_shared_beginnings(spark):
    """Texts that part at every digit's edge, before it and after it."""
    long = "ab" * 50_000
    cuts = [0, 1, 15, 16, 17, 143, 144, 145, 1_167, 1_168, 1_169, 9_359, 9_360, 9_361, 99_999, 100_000]
    texts = [long[:c] for c in cuts] + [long[:c] + "x" for c in cuts] + [long[:c] + "é" for c in cuts]
    rows = [(i, t) for i, t in enumerate(texts)] + [(1_000 + i, t) for i, t in enumerate(texts) if i % 3]
    rows += [(None, long), (None, None), (5_000, long), (5_000, long)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert Counter(tuple(r) for r in exact_groups(docs).collect()) == plain_groups(rows)


def test_copies_with_text_ids_and_empty_tables(spark, none):
    assert exact_groups(none).count() == 0
    docs = spark.createDataFrame([("b", "x"), ("a", "x"), ("c", None), (None, "")], "`my.id` string, body string")
    found = exact_groups(docs, "my.id", "body")
    assert {(r[0], r[1], r[2], r[3]) for r in found.collect()} == {
        ("b", "b", 2, True), ("a", "b", 2, False), ("c", "c", 2, True), (None, "c", 2, False)
    }


# Periodic runs --------------------------------------------------------------

def plain_runs(w):
    """All runs of a list, by comparing everything."""
    n, found = len(w), []
    for q in range(1, n // 3 + 1):
        i = 0
        while i < n - q:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j < n - q and w[j] == w[j + q]:
                j += 1
            start, length = i, j - i + q
            own = w[start : start + length]
            smallest = all(any(own[k] != own[k + p] for k in range(length - p)) for p in range(1, q))
            if length >= max(24, 3 * q) and smallest:
                found.append((start, length, q))
            i = j
    return sorted(found, key=lambda r: (r[0], r[2]))


def run_texts():
    rng = np.random.default_rng(11)
    out = ["", "a " * 23, "a " * 24, "a " * 500, "x " + "a b " * 12 + "y", "a b " * 11 + "a b c", "a b c " * 8 + "a b c d " * 8]
    for k in range(60):
        letters = list("abcd"[: 2 + k % 3])
        unit = list(rng.choice(letters, rng.integers(1, 30)))
        inner = list(rng.choice(letters, rng.integers(1, 4))) * int(rng.integers(3, 12))
        parts = [list(rng.choice(letters, rng.integers(0, 40))), unit * int(rng.integers(2, 6)), inner, (unit + inner) * 3]
        out.append(" ".join(w for p in rng.permutation(4) for w in parts[p]))
    return out


@pytest.mark.parametrize("text", run_texts())
def test_segment_runs_equal_plain_ones(text):
    w = text.split()
    codes = np.array([ord(c) for c in w], dtype=np.int64)
    want = plain_runs(w)
    assert segment_runs(codes) == want
    # Splitting loses none of them.
    lo, hi = surviving_segments(codes, np.array([0]), np.array([len(w)]))
    parts = [(a + s, n, q) for a, b in zip(lo.tolist(), hi.tolist()) for s, n, q in segment_runs(codes[a:b])]
    assert sorted(parts, key=lambda r: (r[0], r[2])) == want


def test_rare_words_split_until_nothing_changes():
    # The 9s split first, which leaves 1 and 2 too rare on the left, which leaves nothing there.
    left = [1, 2, 1, 2, 9] + [5] * 10
    codes = np.array(left + [9] + [7, 8] * 20, dtype=np.int64)
    lo, hi = surviving_segments(codes, np.array([0]), np.array([len(codes)]))
    assert list(zip(lo.tolist(), hi.tolist())) == [(len(left) + 1, len(codes))]
    assert LEAST == 24


def test_runs_of_documents(spark, odd, none):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()] + list(enumerate(run_texts(), 10_000))
    docs = spark.createDataFrame([(i, t, "size") for i, t in rows], "doc_id long, text string, runs string").repartition(3)
    found = periodic_runs(docs)
    got = Counter()
    for r in found.collect():
        got[(r["doc_id"], r["n_words"], tuple((x["start"], x["length"], x["period"]) for x in r["runs"]), r["collapsed"])] += 1
    want = Counter()
    for i, t in rows:
        w = words(t)
        runs = plain_runs(w) if len(w) < 2_000 else [] if len(set(w)) > 50 else None
        gone = {k for s, n, q in runs for k in range(s + q, s + n)}
        want[(i, len(w), tuple(runs), " ".join(x for k, x in enumerate(w) if k not in gone))] += 1
    assert got == want
    assert periodic_runs(none).count() == 0


def test_strongest_run_is_compared_exactly(spark):
    schema = "k int, runs array<struct<start:long,length:long,period:long>>"
    rows = [(0, []), (1, [(0, 24, 1), (30, 72, 3)]), (2, [(0, 30, 10), (50, 31, 10)]), (3, [(5, 48, 2), (5, 72, 3), (1, 24, 1)])]
    got = {r["k"]: r["b"] and tuple(r["b"]) for r in spark.createDataFrame(rows, schema).select("k", strongest(F.col("runs")).alias("b")).collect()}
    assert got == {0: None, 1: (0, 24, 1), 2: (50, 31, 10), 3: (5, 48, 2)}


def test_planted_periods(spark):
    import zlib

    texts = [prose(900 + i, 1 + 7 * i % 90) for i in range(200)] + [None, "", "  "]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(None, "x y")], "doc_id long, text string")
    for r in planted_periods(docs).collect():
        t = "x y" if r["doc_id"] is None else texts[r["doc_id"]]
        w = words(t)
        h = 1 if r["doc_id"] is None else zlib.crc32(str(r["doc_id"]).encode())
        if h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[a + (i - a) % p] if i >= a else w[i] for i in range(n)]
        assert words(r["text"]) == w


# Ranked search --------------------------------------------------------------

TERM = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_search(docs, items, k=50):
    bags = [(i, Counter(TERM.findall((t or "").translate(UP)))) for i, t in docs]
    n = sum(1 for _, b in bags if b)
    total = sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = Counter()
    for item, text in items:
        scores = []
        for i, b in bags:
            size = sum(b.values())
            score = 0
            for t in set(TERM.findall((text or "").translate(UP))):
                if b[t]:
                    w = math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1)))
                    m = 100 - 50 + (50 * size * n) // total
                    score += w * ((10**9 * b[t]) // (1000 * b[t] + 20 * m))
            if score > 0:
                scores.append((-score, i is None, i or 0, i))
        for rank, (s, _, _, i) in enumerate(sorted(scores)[:k], 1):
            out[(item, rank, i, -s)] += 1
    return out


@pytest.mark.parametrize("k", [1, 7, 50])
def test_search_equals_plain_ranking(spark, odd, k):
    docs = [(r["doc_id"], r["text"]) for r in odd.collect()]
    items = [(0, docs[0][1]), (1, docs[11][1]), (2, "word WORD é ab"), (3, ""), (4, None), (5, "nowhere-to be_found Xq"),
             (6, prose(50, 80)), (6, "size, kept"), (None, "x y one two")]
    queries = spark.createDataFrame([(i, t, "r") for i, t in items], "item_id long, text string, rank string").repartition(2)
    found = ranking.search(odd, queries, k)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    got = Counter(tuple(r) for r in found.collect())
    want = plain_search(docs, items, k)
    # Of item 6 there are two queries; ranks tie between them, so compare as multisets.
    assert got == want


def test_search_of_empty_tables(spark, odd, none):
    queries = spark.createDataFrame([(1, "word")], "item_id long, text string")
    assert ranking.search(none, queries).count() == 0
    assert ranking.search(odd, queries.limit(0)).count() == 0
    assert ranking.search(odd.where("text is null"), queries).count() == 0


@pytest.mark.parametrize("block,step", [(4, 8), (16, 64), (128, 256)])
def test_best_of_shard_prunes_without_loss(monkeypatch, block, step):
    """Small blocks and ranges; every floor; fewer blocks are unpacked than there are."""
    monkeypatch.setattr(ranking, "BLOCK", block)
    monkeypatch.setattr(ranking, "RANGE", step)
    rng = np.random.default_rng(5)
    vocabulary = [f"w{i}" for i in range(300)]
    share = 1 / np.arange(1, 301)
    texts = [" ".join(rng.choice(vocabulary, rng.integers(0, 120), p=share / share.sum())).encode() for _ in range(600)]
    index = ranking.index_of(texts)
    total, n = index["n_terms"], index["n_docs"]
    row = {c: v.tobytes() if isinstance(v, np.ndarray) else v for c, v in index.items()}
    row |= {"ids": pa.array(range(600)), "terms": pa.array(index["terms"], pa.binary()), "dfs": pa.array(index["dfs"])}
    df = dict(zip(index["terms"], index["dfs"].tolist()))
    place = {t: i for i, t in enumerate(index["terms"])}
    saved = 0
    for q in range(20):
        asked = list({t.encode() for t in rng.choice(vocabulary, 8, p=share / share.sum())} | {b"w250"})
        query = [(place[t], math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1)))) for t in asked if t in place]
        full = np.zeros(600, dtype=np.int64)
        for d, t in enumerate(texts):
            bag = Counter(t.split())
            for a, w in query:
                tf = bag[index["terms"][a]]
                if tf:
                    full[d] += w * int(ranking.gain(np.int64(tf), np.int64(sum(bag.values())), n, total))
        order = np.lexsort((np.arange(600), -full))
        for floor in (0, int(full[order[3]]), int(full[order[0]]) + 1):
            shard = ranking.Shard(row, n, total)
            places, scores = ranking.best_of_shard(shard, query, 5, floor)
            want = [(int(full[d]), int(d)) for d in order[:5] if full[d] >= max(floor, 1)]
            assert sorted(zip(scores.tolist(), places.tolist()), key=lambda x: (-x[0], x[1])) == want
            saved += sum(shard.blocks_of(t) for t, _ in query) - shard.unpacked
    assert saved > 0


def test_index_is_read_shard_by_shard(spark, monkeypatch):
    """A task that makes many shards writes a row group for each; lists packed in parts come back."""
    monkeypatch.setattr(ranking, "SHARD_DOCS", 20)
    monkeypatch.setattr(ranking, "GROUP_BYTES", 1)
    rows = [(i, " ".join(f"w{(i * j) % 61}" for j in range(i % 50))) for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    index = ranking.build_index(docs)
    footers = [pq.ParquetFile(f).metadata for f in glob.glob(index.kept_at.removeprefix("file:") + "/*.parquet")]
    assert [f.num_row_groups for f in footers if f.num_rows] == [5]
    assert index.agg(F.sum("n_terms")).first()[0] == sum(i % 50 for i in range(100))
    texts = [t.encode() for _, t in rows]
    whole = ranking.index_of(texts)
    monkeypatch.setattr(ranking, "CHUNK", 7)
    in_parts = ranking.index_of(texts)
    assert all(np.array_equal(whole[c], in_parts[c]) for c in whole)
    assert whole["block_byte"].dtype == np.int32


def test_packed_numbers_come_back():
    values = np.array([0, 1, 127, 128, 300, 16_383, 16_384, 2_097_152, 10**12], dtype=np.int64)
    data, begins = ranking.packed_numbers(values)
    assert ranking.unpacked_numbers(data).tolist() == values.tolist() and begins[-1] == len(data)
