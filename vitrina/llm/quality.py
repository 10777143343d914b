"""Host-level quality rules: a document answers for its own text and for its host."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from vitrina.llm.common import SPACE, group_key, keep, split_words
from vitrina.operators.lookups import attach

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5
# A host is rejected when its shrunk failure rate is above this share.
MAX_HOST_RATE = 0.5
# Bounds of the prior's weight, in documents.
PRIOR_WEIGHT = (1.0, 1_000_000.0)


def text_features(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words (all long).

    The text column goes. A null or empty text has zero everywhere. Windows are
    compared by the 64-bit hashes of their words, sorted once per text, so a very
    long text costs n log n; texts without a repeated window skip the sort.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    others = [F.col(f"`{c}`") for c in docs.columns if c != text]
    words = docs.select(*others, body.alias("_text"), split_words(body).alias("_words"))
    lines = F.filter(F.split("_text", "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "")
    hashed = words.select(
        *others,
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("_text", f"[^{SYMBOLS}]+", "")).cast("long").alias("n_symbols"),
        F.transform(F.array(lines), lambda x: F.size(x) - F.size(F.array_distinct(x)))[0]
        .cast("long")
        .alias("n_dup_lines"),
        F.transform("_words", lambda w: F.xxhash64(w)).alias("_hashes"),
    )
    features = [*others, "n_words", "word_chars", "n_symbols", "n_dup_lines"]
    last = (F.col("n_words") - F.lit(WINDOW)).cast("int")
    grams = F.when(
        last >= 0,
        F.transform(
            F.sequence(F.lit(0), F.greatest(last, F.lit(0))),
            lambda i: F.xxhash64(*[F.get("_hashes", i + F.lit(k)) for k in range(WINDOW)]),
        ),
    ).otherwise(F.array().cast("array<bigint>"))
    windows = hashed.select(*features, grams.alias("_grams"))
    repeats = F.size(F.array_distinct("_grams")) < F.size("_grams")
    by_hash = F.sort_array(F.transform("_grams", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    placed = windows.select(*features, F.when(repeats, by_hash).alias("_placed"))
    starts = F.when(
        F.col("_placed").isNotNull(),
        F.sort_array(
            F.filter(
                F.transform("_placed", lambda x, j: F.when(_twin(x, j), x["i"])),
                lambda i: i.isNotNull(),
            )
        ),
    )
    found = placed.select(*features, starts.alias("_starts"))
    step = F.transform(
        "_starts",
        lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get("_starts", k + 1) - x, F.lit(WINDOW))),
    )
    covered = F.aggregate(step, F.lit(0).cast("long"), lambda a, x: a + x)
    return found.select(*features, F.coalesce(covered, F.lit(0).cast("long")).alias("n_repeat_words"))


def _twin(x: Column, j: Column) -> Column:
    def same(other: Column) -> Column:
        return F.coalesce(F.get("_placed", other)["g"] == x["g"], F.lit(False))

    return same(j - 1) | same(j + 1)


def base_failed() -> Column:
    """The rule on a document's own text."""
    repeats = 100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")
    return (F.col("n_words") < MIN_WORDS) | repeats


def host_verdicts(
    judged: DataFrame, key: str, failed: str, max_rate: float = MAX_HOST_RATE, weight: str | None = None
) -> DataFrame:
    """One row per host: n, fails, rate (shrunk), host_ok.

    The hosts' rates share a beta prior fitted by moments over all hosts: its mean is
    the failure rate of all documents, its weight follows from how much the hosts'
    rates differ beyond chance. With one host, or rates that differ no more than by
    chance, the weight is the upper bound and every host has about the common rate.
    Only the fit's five sums over hosts (one row) reach the driver.
    """
    rows = F.lit(1).cast("long") if weight is None else F.col(weight)
    hosts = keep(
        judged.groupBy(key).agg(
            F.sum(rows).alias("n"),
            F.sum(rows * F.col(failed).cast("long")).alias("fails"),
        ),
        "hosts",
    )
    # Plain moments of the hosts' rates; integer sums first, so that reruns agree.
    sums = hosts.agg(
        F.sum("n").alias("n"), F.sum("fails").alias("fails"), F.count(F.lit(1)).alias("hosts")
    ).first()
    if not sums["n"]:
        return hosts.select(
            "*", F.lit(0.0).alias("rate"), F.lit(True).alias("host_ok")
        )
    mean = sums["fails"] / sums["n"]
    rate = F.col("fails") / F.col("n")
    spread = hosts.agg(
        F.sum(F.col("n") * (rate - F.lit(mean)) * (rate - F.lit(mean))).alias("between")
    ).first()["between"]
    noise = (sums["hosts"] - 1) * mean * (1 - mean) / sums["n"]
    variance = spread / sums["n"] - noise
    low, high = PRIOR_WEIGHT
    weight = mean * (1 - mean) / variance - 1 if variance > 0 else high
    weight = min(max(weight, low), high)
    shrunk = (F.col("fails") + F.lit(weight * mean)) / (F.col("n") + F.lit(weight))
    return hosts.select(
        "*", shrunk.alias("rate"), (shrunk <= F.lit(max_rate)).alias("host_ok")
    )


def host_rules(
    docs: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    host: str = "source",
    max_rate: float = MAX_HOST_RATE,
) -> DataFrame:
    """One row per row of ``docs``: id, the counts, base_failed, host_rate, kept.

    A null host is a host of its own. Other columns of ``docs`` are ignored. Repeated
    rows are judged one by one, each with the same outcome. An empty table gives an
    empty one. ``kept`` is false for a failed document and for all documents of a host
    whose shrunk rate is above ``max_rate``. Native functions only; a host with a large
    part of all rows is counted map-side, and its verdict is broadcast.
    """
    plain = docs.select(
        F.col(id_col).alias("_id"), F.col(text).alias("_body"), group_key(F.col(host)).alias("_host")
    )
    judged = keep(text_features(plain, "_body").withColumn("base_failed", base_failed()), "judged")
    hosts = host_verdicts(judged, "_host", "base_failed", max_rate)
    counts = hosts.select("_host", F.col("n").alias("_rows"))
    joined = attach(judged, hosts.select("_host", "rate", "host_ok"), "_host", counts)
    return joined.select(
        F.col("_id").alias(id_col),
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        F.col("rate").alias("host_rate"),
        (~F.col("base_failed") & F.col("host_ok")).alias("kept"),
    )


def keep_good(
    docs: DataFrame, text: str = "text", host: str = "source", max_rate: float = MAX_HOST_RATE
) -> DataFrame:
    """The rows of ``docs`` that ``host_rules`` keeps, with all their columns.

    The texts are not moved: their counts are taken where they are read, and only the
    rejected hosts are joined. Every row is judged by itself, whatever its id.
    """
    whole = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"),
        F.col(text).alias("_body"),
        group_key(F.col(host)).alias("_host"),
    )
    light = text_features(whole.select("_host", "_body"), "_body").select(
        "_host", base_failed().alias("base_failed")
    )
    outcomes = keep(light.groupBy("_host", "base_failed").agg(F.count(F.lit(1)).alias("_n")), "outcomes")
    hosts = host_verdicts(outcomes, "_host", "base_failed", max_rate, weight="_n")
    rejected = keep(hosts.where(~F.col("host_ok")).select("_host"), "rejected-hosts")
    # The row number keeps the optimizer from copying the counts' expressions into the scan.
    counted = text_features(whole, "_body").select(
        "_doc", "_host", base_failed().alias("_failed"), F.monotonically_increasing_id().alias("_row")
    )
    good = counted.where(~F.col("_failed") & (F.col("_row") >= 0))
    return good.join(rejected, "_host", "left_anti").select("_doc.*")
