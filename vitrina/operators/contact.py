"""Shop status, e-mail address and social handle from saved pages and searches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from vitrina import defaults
from vitrina.functions.handles import best_profile
from vitrina.functions.page import (
    first_email, first_handle, is_social, placeholder_email, platform, profile_link,
)
from vitrina.functions.text import strip, text, with_scheme, word_text
from vitrina.operators.dedup import first_per_key
from vitrina.operators.durable import keep
from vitrina.operators.lookups import attach
from vitrina.operators.usage import with_budget


def page_features(
    pages: DataFrame,
    signatures: Sequence[tuple[str, str]] = defaults.PLATFORM_SIGNATURES,
    cart_words: Sequence[str] = defaults.CART_WORDS,
) -> DataFrame:
    """url, plataforma, email, perfil of every page that was answered.

    Works on the scan: the HTML is reduced to three short values before any
    shuffle. ``pages`` has url and html, and optionally status.
    """
    if "status" in pages.columns:
        pages = pages.where(F.col("status").isNull() | (F.col("status") < 400))
    lowered = pages.where(F.col("html").isNotNull()).withColumn("_low", F.lower("html"))
    saved = [F.col("saved_at")] if "saved_at" in pages.columns else []
    return lowered.select(
        "url",
        *saved,
        platform(F.col("html"), F.col("_low"), signatures, cart_words).alias("plataforma"),
        first_email(F.col("html")).alias("email"),
        first_handle(F.col("html")).alias("perfil"),
    )


def one_per_url(features: DataFrame) -> DataFrame:
    """One row per url, for pages saved more than once.

    The newest copy counts if the table has ``saved_at``; among equals one that shows
    more comes before one that shows less.
    """
    newest = [F.col("saved_at").desc_nulls_last()] if "saved_at" in features.columns else []
    shown = [F.col(c).asc_nulls_last() for c in ("plataforma", "email", "perfil")]
    return first_per_key(features, "url", *newest, *shown).drop("saved_at")


def page_address(web: Column) -> Column:
    """The address a listing's page is saved under; null for none or a social profile."""
    address = with_scheme(strip(text(web)))
    return F.when((address != "") & ~is_social(address), address)


def with_page(
    listings: DataFrame, features: DataFrame, counts: DataFrame | None = None
) -> DataFrame:
    """Add es_tienda, tecnologia, email, email_source, page_error and perfil.

    The page belongs to the listing's web address after the scheme is added;
    social profiles are not looked at. ``features`` has one row per url;
    ``counts`` (url, _rows) saves counting the listings per page.
    """
    asked = listings.withColumn("url", page_address(F.col("web")))
    read = features.withColumn("_read", F.lit(True)).withColumnRenamed("email", "_email")
    joined = attach(asked, read, "url", counts)
    shop = F.when(F.col("_read"), F.when(F.col("plataforma").isNotNull(), "Sí").otherwise("No"))
    return joined.withColumns(
        {
            "es_tienda": F.coalesce(shop, F.lit("-")),
            "tecnologia": F.coalesce("plataforma", F.lit("-")),
            "page_error": F.col("url").isNotNull() & F.col("_read").isNull(),
            "email": F.coalesce("_email", placeholder_email(F.col("nombre"))),
            "email_source": F.when(F.col("_email").isNotNull(), "page").otherwise("placeholder"),
        }
    ).drop("url", "_read", "_email", "plataforma")


def search_key(name: Column, town: Column) -> Column:
    """Key of a paid search: folded words of name and town."""
    return F.concat_ws("|", F.trim(word_text(name)), F.trim(word_text(town)))


def latest_lookup(cache: DataFrame) -> DataFrame:
    """The newest entry of each key (key, url, ts)."""
    newest = cache.groupBy("key").agg(F.max_by("url", "ts").alias("url"), F.max("ts").alias("ts"))
    return newest.withColumn("url", F.coalesce("url", F.lit("")))


def cache_entries(searched: DataFrame, run_ts: int) -> DataFrame:
    """What a run adds to the cache: each paid search once, "" when nothing was found.

    ``searched`` is the output of with_budget with key, cost and the handle
    found; a search that cost nothing has failed and is tried again next time.
    """
    paid = searched.where((F.col("search_state") == "paid") & (F.col("cost") > 0))
    link = F.coalesce(profile_link(F.col("handle")), F.lit(""))
    return paid.select("key", link.alias("url"), F.lit(run_ts).cast("long").alias("ts"))


def resolve_handles(
    listings: DataFrame,
    cache: DataFrame,
    searches: DataFrame,
    max_usd: float = 1.0,
    seq: str = "seq",
) -> DataFrame:
    """Add instagram, instagram_fuente, search_state and what was searched: key, cost, handle.

    In turn: the handle of the listing's page (``perfil``), a cached search, and
    a saved search response (key, items, cost) as far as the budget reaches.
    search_state is page, cache, paid, repeat or refused; a repeat reads what an
    earlier row of the run has paid for. key, cost and handle are null for rows that
    made no search; with them the result goes to ``cache_entries`` and ``budget_report``.
    """
    keyed = listings.where(F.col("perfil").isNull()).select(
        seq,
        search_key(F.col("nombre"), F.col("municipio_origen")).alias("key"),
        "nombre",
        "municipio_origen",
    )
    hits = latest_lookup(cache).select("key", F.col("url").alias("_cached"))
    looked = keep(attach(keyed, hits, "key"), "looked")

    # Of a search saved more than once the paid response counts.
    responses = first_per_key(searches, "key", F.col("cost").desc())
    searched = attach(looked.where(F.col("_cached").isNull()), responses, "key").select(
        seq,
        "key",
        best_profile(F.col("items"), F.col("nombre"), F.col("municipio_origen")).alias("_found"),
        F.when(strip(text(F.col("nombre"))) == "", 0.0)
        .otherwise(F.coalesce("cost", F.lit(0.0)))
        .alias("cost"),
    )
    # Kept, as putting rows in order reads its input twice.
    spent = with_budget(keep(searched, "searched"), [], [seq], max_usd, key="key")
    answered = looked.where(F.col("_cached").isNotNull()).select(
        seq, F.col("_cached").alias("_url"), F.lit("cache").alias("search_state"),
        *[F.lit(None).cast(t).alias(c) for c, t in (("key", "string"), ("cost", "double"), ("handle", "string"))],
    ).unionByName(
        spent.select(
            seq,
            F.when(F.col("search_state") != "refused", profile_link(F.col("_found"))).alias("_url"),
            "search_state", "key", F.col("cost").cast("double").alias("cost"), F.col("_found").alias("handle"),
        )
    )
    joined = listings.join(answered, seq, "left")
    return joined.withColumns(
        {
            "instagram": F.coalesce("perfil", "_url", F.lit("")),
            "instagram_fuente": F.when(F.col("perfil").isNotNull(), "web")
            .when(F.coalesce("_url", F.lit("")) != "", "dataforseo")
            .otherwise("-"),
            "search_state": F.coalesce("search_state", F.lit("page")),
        }
    ).drop("_url")
