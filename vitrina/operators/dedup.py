"""Duplicate removal by one key or by two."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from vitrina.functions.text import strip, text
from vitrina.operators.durable import discard, keep

# Links beyond which chains are shortened before they are doubled, and pairs for each splitter.
DIRECT = 250_000
SPLIT = 4


def with_keys(listings: DataFrame) -> DataFrame:
    """Add url_key (null without a link) and fallback_key (name, address, phone)."""
    link = strip(text(F.col("maps_url")))
    parts = [F.lower(strip(text(F.col(c)))) for c in ("nombre", "direccion", "telefono")]
    return listings.withColumns(
        {
            "url_key": F.when(link != "", F.substring_index(link, "?", 1)),
            "fallback_key": F.sha1(F.concat_ws("|", *parts)),
        }
    )


def first_per_key(df: DataFrame, key: str | list[str], *order: str | Column) -> DataFrame:
    """The first row of each key.

    ``row_number = 1`` lets Spark keep one row per key in every map task before
    the shuffle, so a key that holds most rows sends only a few.
    """
    key = [key] if isinstance(key, str) else key
    window = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_nth", F.row_number().over(window)).where("_nth = 1").drop("_nth")


def first_per_full_url(listings: DataFrame, *order: str) -> DataFrame:
    """Rows of the places search: the whole link, or name, address and phone."""
    return first_per_key(listings.withColumn("_key", full_url_key()), "_key", *order).drop("_key")


def full_url_key() -> Column:
    link = strip(text(F.col("maps_url")))
    other = F.lower(F.concat_ws("|", "nombre", "direccion", "telefono"))
    return F.when(link != "", link).otherwise(other)


def dedup_two_keys(
    df: DataFrame, seq: str = "seq", url_key: str = "url_key", row_key: str = "fallback_key"
) -> DataFrame:
    """Keep a row unless one of its keys belongs to an earlier kept row.

    ``seq`` is a unique long in arrival order. Only the first row of each pair of keys
    can be kept, so the work is on pairs. A round settles two kinds of open pairs. A pair
    that comes first for both its keys is kept. A pair with one earlier rival is kept
    just when the rival is not; such pairs form chains, which are followed to their ends
    by doubling, by way of ever fewer pairs where there are many. Pairs that share a key
    with a kept one are then dropped. Runs jobs while the plan is built: some per round.
    """
    # A row without a link is tied by its row key alone.
    own = F.coalesce(row_key, F.lit("\0"))
    first = F.when(F.col(url_key).isNull(), F.concat(F.lit("f"), own)).otherwise(
        F.concat(F.lit("u"), F.col(url_key))
    )
    still_open = keep(
        df.select(first.alias("a"), own.alias("b"), F.col(seq).alias("seq"))
        .groupBy("a", "b")
        .agg(F.min("seq").alias("seq")),
        "pairs",
    )
    kept = []
    while not still_open.isEmpty():
        ranked = keep(
            _first_two(still_open, "a").join(_first_two(still_open, "b"), "seq"), "ranked"
        )
        free = ranked.where("n_a = 1 and n_b = 1").select("seq", "a", "b")
        waiting = ranked.where("n_a + n_b = 3")
        chained = not waiting.isEmpty()
        if chained:
            won = keep(free.unionByName(_freed(ranked, free, waiting)), "kept")
        else:
            won = free
        rest = still_open.join(won.select("a"), "a", "left_anti")
        after = keep(rest.join(won.select("b"), "b", "left_anti"), "pairs")
        discard(still_open)
        kept.append(won.select("seq"))
        if chained:
            discard(ranked)
        still_open = after
    discard(still_open)
    if not kept:
        return df.limit(0)
    chosen = reduce(DataFrame.unionByName, kept).withColumnRenamed("seq", seq)
    return df.join(chosen, seq, "left_semi")


def _freed(ranked: DataFrame, free: DataFrame, waiting: DataFrame) -> DataFrame:
    """The waiting pairs that an even number of steps leads to a free one."""
    rival = F.when(F.col("n_a") == 2, F.col("least_a")).otherwise(F.col("least_b"))
    even = _chain_ends(waiting.select("seq", rival.alias("to"), F.lit(True).alias("odd"))).where("not odd")
    freed = even.join(free.select(F.col("seq").alias("to")), "to", "left_semi")
    return ranked.join(freed, "seq", "left_semi").select("seq", "a", "b")


def _first_two(pairs: DataFrame, key: str) -> DataFrame:
    """The two earliest pairs of each key with their rank and the key's least ``seq``.

    Spark keeps two rows per key in every map task before the shuffle.
    """
    ordered = Window.partitionBy(key).orderBy("seq")
    upto = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = pairs.select(
        "seq", key,
        F.row_number().over(ordered).alias(f"n_{key}"),
        F.min("seq").over(upto).alias(f"least_{key}"),
    )
    return ranked.where(F.col(f"n_{key}") <= 2)


def _chain_ends(links: DataFrame, level: int = 0) -> DataFrame:
    """Where the chain of rivals of each pair (seq, to) ends, and whether after an odd number of steps; kept.

    ``odd`` tells whether a link stands for an odd number of steps. Doubling moves all links as often as the
    longest chain asks for, so many links are first shortened to chains of splitters.
    """
    if links.count() > DIRECT:
        return _through_splitters(links, level)
    while True:
        stepped = keep(_stepped(links, links).withColumn("moved", F.col("_to").isNotNull()).drop("_to"), "chain")
        if hasattr(links, "kept_at"):
            discard(links)
        links = stepped
        if stepped.where("moved").isEmpty():
            return links


def _through_splitters(links: DataFrame, level: int) -> DataFrame:
    """The same by way of splitters, one pair in ``SPLIT`` by its hash.

    Doubling takes every link to the next splitter or the end of its chain. That is a few steps away
    however long the chain is, and a link that is there does not move again. The splitters' links are
    chains of their own, of which there are ``SPLIT`` times fewer.
    """

    def splits(seq: str) -> Column:
        return F.pmod(F.xxhash64(F.col(seq), F.lit(level)), F.lit(SPLIT)) == 0

    moving, there, kept = links.where(~splits("to")), [links.where(splits("to"))], []
    while True:
        others = reduce(DataFrame.unionByName, [*there, moving]).where(~splits("seq"))
        open_ = F.col("_to").isNotNull() & ~splits("_to")
        stepped = keep(_stepped(moving, others).withColumn("open", F.coalesce(open_, F.lit(False))).drop("_to"), "chain")
        kept.append(stepped)
        there.append(stepped.where("not open").drop("open"))
        moving = stepped.where("open").drop("open")
        if moving.isEmpty():
            break
    near = reduce(DataFrame.unionByName, there)
    ends = _chain_ends(near.where(splits("seq")), level + 1)
    whole = keep(_stepped(near, ends).drop("_to"), "chain")
    discard(ends, *kept)
    return whole


def _stepped(links: DataFrame, others: DataFrame) -> DataFrame:
    """Links led on by the others; ``_to`` is null where there was none to lead them."""
    ahead = others.select(F.col("seq").alias("to"), F.col("to").alias("_to"), F.col("odd").alias("_odd"))
    return links.join(ahead, "to", "left").select(
        "seq", F.coalesce("_to", "to").alias("to"), (F.col("odd") != F.coalesce("_odd", F.lit(False))).alias("odd"), "_to"
    )
