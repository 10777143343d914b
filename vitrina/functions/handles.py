"""Which search result is the business's own profile."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from vitrina import defaults
from vitrina.functions.page import profile_in, valid_handle
from vitrina.functions.text import let, text, word_text, words


def _literal_words(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def significant_words(name: Column) -> Column:
    """Words of three letters or more that are not generic, or all such words."""

    def telling(long_words: Column) -> Column:
        special = F.filter(long_words, lambda w: ~w.isin(*defaults.GENERIC_WORDS))
        return let(special, lambda s: F.when(F.size(s) > 0, s).otherwise(long_words))

    return let(F.filter(words(name), lambda w: F.length(w) >= 3), telling)


def _flat(words_text: Column) -> Column:
    return F.replace(words_text, F.lit(" "), F.lit(""))


def matches_business(name: Column, handle: Column, profile: Column) -> Column:
    """Any telling word of the name is part of the handle or the profile name."""
    hay = F.concat_ws(" ", _flat(word_text(handle)), word_text(profile))
    return let(
        F.struct(hay.alias("hay"), significant_words(name).alias("telling")),
        lambda v: F.exists(v["telling"], lambda w: F.contains(v["hay"], w)),
    )


def business(name: Column, town: Column) -> Column:
    """What candidates are compared with: telling words, allowed words, long words."""

    def all_words(v: Column) -> Column:
        both = F.concat(v["telling"], v["town"])
        return F.struct(
            v["telling"].alias("telling"),
            F.concat(both, _literal_words(defaults.HANDLE_FILLER)).alias("allowed"),
            F.filter(both, lambda w: F.length(w) >= 4).alias("long"),
        )

    return let(
        F.struct(significant_words(name).alias("telling"), words(town).alias("town")), all_words
    )


def candidate_score(shop: Column, handle: Column, profile: Column) -> Column:
    """Two points per telling word found; no points when the handle says more.

    A handle word says more when it has three letters, is neither a filler nor
    a word of the name or town, and holds none of their longer words.
    """

    def score(v: Column) -> Column:
        hits = F.size(
            F.filter(
                shop["telling"], lambda w: F.contains(v["handle"], w) | F.contains(v["profile"], w)
            )
        )
        surplus = F.exists(
            v["parts"],
            lambda p: (F.length(p) >= 3)
            & ~F.array_contains(shop["allowed"], p)
            & ~F.exists(shop["long"], lambda w: F.contains(p, w)),
        )
        return F.when(surplus, 0).otherwise(2 * hits)

    def compared(handle_words: Column) -> Column:
        return let(
            F.struct(
                _flat(handle_words).alias("handle"),
                _flat(word_text(profile)).alias("profile"),
                F.split(handle_words, "[^a-z]+").alias("parts"),
            ),
            score,
        )

    return let(word_text(handle), compared)


# Fixed value: the pattern of a profile title.
PROFILE_TITLE = r"^(.*?)\s*\(@([A-Za-z0-9_.]{1,30})\)"


def candidates(items: Column) -> Column:
    """Up to three (handle, profile) candidates per organic item, in item order."""

    def of_item(item: Column) -> Column:
        title = text(item["title"])
        foreign = F.lower(title).rlike("|".join(defaults.OTHER_NETWORKS))
        by_title = F.when(~foreign, F.regexp_extract(title, PROFILE_TITLE, 2)).otherwise("")

        def entry(handle: Column, profile: Column) -> Column:
            return F.struct(handle.alias("handle"), profile.alias("profile"))

        return F.array(
            entry(by_title, F.regexp_extract(title, PROFILE_TITLE, 1)),
            entry(profile_in(item["url"]), title),
            entry(profile_in(item["breadcrumb"]), title),
        )

    organic = F.filter(items, lambda it: it["type"] == "organic")
    return F.filter(F.flatten(F.transform(organic, of_item)), lambda c: valid_handle(c["handle"]))


def best_profile(items: Column, name: Column, town: Column) -> Column:
    """Handle of the best-scoring candidate, the first one on ties, or null.

    A response's items stay in their row: no explode, no shuffle.
    """

    def best(shop: Column) -> Column:
        scored = F.transform(
            candidates(items),
            lambda c, i: F.struct(
                candidate_score(shop, c["handle"], c["profile"]).alias("score"),
                (-i).alias("rank"),
                c["handle"].alias("handle"),
            ),
        )
        return F.array_max(F.filter(scored, lambda s: s["score"] > 0))["handle"]

    return F.when(F.size(items) > 0, let(business(name, town), best))
