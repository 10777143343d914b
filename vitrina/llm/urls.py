"""URL filters: host and path rules, and a character language-model ratio for the rest."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from vitrina.llm.common import keep

# Rules are (verdict, host, path); the longest that fits wins.
Rule = tuple[str, str, str]

# Symbols of the models. Digits share one, all characters not listed share the last;
# symbol 0 stands before the first character. With contexts of up to three symbols a
# model has at most N_SYMBOLS ** 4 (about two million) entries, whatever the data.
LETTERS = "abcdefghijklmnopqrstuvwxyz"
SIGNS = "/.-:?=&_%+"
DIGIT = 1 + len(LETTERS) + len(SIGNS)
OTHER = DIGIT + 1
N_SYMBOLS = OTHER + 1
ORDER = 3

FOLDS = 5
BINS = 1000
MAX_RATIO = 10.0


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    found = F.regexp_extract(url, "(?s)^.*?://([^/?#]*)", 1)
    upper = LETTERS.upper()
    return F.coalesce(F.translate(found, upper, LETTERS), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, "(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_fits(host: Column, path: Column, rule: Rule) -> Column:
    """A rule fits its host and all its subdomains, on paths that start with its path."""
    _, own, start = rule
    return ((host == own) | host.endswith("." + own)) & path.startswith(start)


def by_rules(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """Rule (host and path as one text) and its verdict, null where none fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1])):
        fits = rule_fits(host, path, rule)
        name = F.when(fits, F.lit(rule[1] + rule[2])).otherwise(name)
        verdict = F.when(fits, F.lit(rule[0])).otherwise(verdict)
    return name, verdict


def _symbols(text: Column) -> Column:
    """The text's symbols as numbers, after ORDER leading zeros and before a closing one."""
    known = LETTERS + SIGNS
    chars = F.split(F.regexp_replace(F.lower(text), "[0-9]", "0"), "")
    codes = F.transform(
        F.filter(chars, lambda c: c != ""),
        lambda c: F.when(c == "0", F.lit(DIGIT))
        .when(F.instr(F.lit(known), c) > 0, F.instr(F.lit(known), c))
        .otherwise(F.lit(OTHER)),
    )
    return F.concat(F.array(*[F.lit(0)] * ORDER), codes, F.array(F.lit(0)))


def _grams(symbols: Column) -> Column:
    """One number per character: it and the ORDER before it, in base N_SYMBOLS."""
    last = F.size(symbols) - (ORDER + 1)
    return F.transform(
        F.sequence(F.lit(0), last),
        lambda i: reduce(
            lambda a, k: a * N_SYMBOLS + F.get(symbols, i + k),
            range(1, ORDER + 1),
            F.get(symbols, i).cast("long"),
        ),
    )


def ratio_model(grams: DataFrame, classes: tuple[str, str] = ("yes", "no")) -> DataFrame:
    """Log-likelihood difference of every gram: columns gram, ratio.

    ``grams`` has gram and, per class, how often its training texts hold it. Per class
    the probability of a character is mixed over contexts of 0 to ORDER symbols: a
    context seen n times with t different successors gives weight n to its own
    frequencies and t to the next shorter context; the shortest backs off to a uniform
    choice. Every gram of the input table is scored, also one no class has seen.
    """
    tables = grams.select("gram", *classes)
    for k in range(ORDER + 1):
        # Grams of k context symbols and the character itself.
        size = N_SYMBOLS ** (k + 1)
        short = F.pmod("gram", F.lit(size)).cast("long")
        counts = tables.groupBy(short.alias("gram")).agg(*[F.sum(c).alias(c) for c in classes])
        context = F.floor(F.col("gram") / N_SYMBOLS).cast("long")
        around = counts.groupBy(context.alias("_context")).agg(
            *[F.sum(c).alias(f"_n_{c}") for c in classes],
            *[F.sum((F.col(c) > 0).cast("long")).alias(f"_t_{c}") for c in classes],
        )
        level = counts.withColumn("_context", context).join(around, "_context")
        if k:
            level = level.withColumn(
                "_short", F.pmod("gram", F.lit(N_SYMBOLS**k)).cast("long")
            ).join(
                scored.select(F.col("gram").alias("_short"), *[f"_p_{c}" for c in classes]), "_short"
            )
        base = {c: F.col(f"_p_{c}") if k else F.lit(1.0 / N_SYMBOLS) for c in classes}
        probability = {
            c: F.when(
                F.col(f"_n_{c}") > 0,
                (F.col(c) + F.col(f"_t_{c}") * base[c]) / (F.col(f"_n_{c}") + F.col(f"_t_{c}")),
            ).otherwise(base[c])
            for c in classes
        }
        scored = level.select("gram", *[probability[c].alias(f"_p_{c}") for c in classes])
    yes, no = classes
    return scored.select("gram", (F.log(f"_p_{yes}") - F.log(f"_p_{no}")).alias("ratio"))


def filter_urls(
    pages: DataFrame,
    rules: list[Rule],
    id_col: str = "page_id",
    url: str = "url",
) -> DataFrame:
    """One row per row of ``pages``: id, host, path, rule, ratio, verdict (allow or block).

    A url that a rule fits gets the rule's verdict. The models of accepted and rejected
    urls are counted on all urls that rules allow and block, but for one fold in five,
    chosen by the url's hash, which sets the limit: the mean log-likelihood difference
    per character with the best balanced accuracy, the middle one of equals. All other
    urls are allowed at or above it. A url whose lower-cased text has no rule of one
    kind to learn from is allowed; null or empty urls have empty host and path and are
    judged by the model as empty texts. Rows are judged one by one, so repeated rows
    agree; extra columns are ignored; an empty table gives an empty one. Native
    functions only; the model has a bound of N_SYMBOLS ** (ORDER + 1) rows.
    """
    link = F.col(url)
    host, path = url_host(link), url_path(link)
    rule, verdict = by_rules(F.col("host"), F.col("path"), rules)
    rows = pages.select(
        F.col(id_col).alias("_id"),
        F.coalesce(link, F.lit("")).alias("_url"),
        host.alias("host"),
        path.alias("path"),
    ).select("*", rule.alias("rule"), verdict.alias("_ruled"))
    fold = F.pmod(F.xxhash64("_url"), F.lit(FOLDS))
    symbols = rows.select(
        "_id", "host", "path", "rule", "_ruled",
        (fold == 0).alias("_held"),
        _symbols(F.regexp_replace("_url", "(?s)^.*?://", "")).alias("_symbols"),
    )
    judged = keep(symbols.select(
        "_id", "host", "path", "rule", "_ruled", "_held", _grams(F.col("_symbols")).alias("_grams")
    ).withColumn("_row", F.monotonically_increasing_id()), "urls")
    train = ~F.col("_held")
    counted = judged.select(
        F.explode("_grams").alias("gram"),
        (train & (F.coalesce("_ruled", F.lit("")) == "allow")).cast("long").alias("yes"),
        (train & (F.coalesce("_ruled", F.lit("")) == "block")).cast("long").alias("no"),
    ).groupBy("gram").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no"))
    model = keep(ratio_model(keep(counted, "grams")), "model")
    # At most N_SYMBOLS ** (ORDER + 1) rows of two numbers, whatever the data.
    scored = (
        judged.select("_row", F.explode("_grams").alias("gram"))
        .join(F.broadcast(model), "gram")
        .groupBy("_row")
        # Whole billionths, so that sums taken in another order agree.
        .agg(F.sum(F.round(F.col("ratio") * 1e9).cast("long")).alias("_sum"), F.count(F.lit(1)).alias("_n"))
    )
    ratios = keep(
        judged.drop("_grams")
        .join(scored, "_row", "left")
        .withColumn("ratio", F.col("_sum") / F.col("_n") / 1e9),
        "ratios",
    )
    limit = _best_limit(ratios)
    by_model = F.when(F.col("ratio") >= F.lit(limit), "allow").otherwise("block")
    return ratios.select(
        F.col("_id").alias(id_col), "host", "path", "rule", "ratio",
        F.coalesce("_ruled", by_model).alias("verdict"),
    )


def _best_limit(ratios: DataFrame) -> float:
    """The limit of best balanced accuracy on the held-out fold; only a histogram is gathered."""
    bin_ = F.floor((F.least(F.greatest("ratio", F.lit(-MAX_RATIO)), F.lit(MAX_RATIO)) + MAX_RATIO) * BINS)
    held = ratios.where(F.col("_held") & F.col("_ruled").isNotNull())
    # At most 2 * MAX_RATIO * BINS + 1 rows.
    bins = held.groupBy(bin_.alias("bin")).agg(
        F.sum((F.col("_ruled") == "allow").cast("long")).alias("yes"),
        F.sum((F.col("_ruled") == "block").cast("long")).alias("no"),
    ).collect()
    yes, no = sum(b["yes"] for b in bins), sum(b["no"] for b in bins)
    if not yes or not no:
        return -MAX_RATIO
    best, at = -1.0, []
    left_yes = left_no = 0
    ordered = sorted(bins, key=lambda b: b["bin"])
    for k, b in enumerate(ordered):
        # Limit below this bin: what lies lower is blocked.
        score = (yes - left_yes) / yes + left_no / no
        low = ordered[k - 1]["bin"] + 1 if k else b["bin"]
        if score > best + 1e-12:
            best, at = score, [(low, b["bin"])]
        elif score > best - 1e-12:
            at.append((low, b["bin"]))
        left_yes += b["yes"]
        left_no += b["no"]
    low, high = at[len(at) // 2]
    return (low + high) / 2 / BINS - MAX_RATIO
