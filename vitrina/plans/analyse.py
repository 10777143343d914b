"""From a listing table to scored listings with contact details."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from vitrina import defaults
from vitrina.functions.geo import coordinates
from vitrina.functions.rules import maturity
from vitrina.functions.text import strip, text
from vitrina.operators.brands import (
    count_by_brand, names_brand, with_brand_key, with_store_count,
)
from vitrina.operators.contact import (
    cache_entries, one_per_url, page_address, resolve_handles, with_page,
)
from vitrina.operators.dedup import first_per_key, with_keys
from vitrina.operators.durable import keep
from vitrina.operators.lookups import key_counts
from vitrina.operators.runs import analysis_summary
from vitrina.operators.score import apply_existing_customer, score_listings
from vitrina.operators.towns import name_key, town_population
from vitrina.operators.usage import budget_report


def analyse(
    listings: DataFrame,
    features: DataFrame,
    towns: DataFrame,
    sites: Sequence[dict],
    brands: Sequence[str],
    weights: dict = defaults.WEIGHTS,
    avatars: Sequence[dict] = defaults.AVATARS,
    own_platform: str | None = None,
    keep_excluded: bool = False,
    seq: str = "seq",
) -> DataFrame:
    """Score every listing that is no excluded brand.

    ``listings`` has the listing columns and ``seq``; ``features`` comes from
    page_features; ``towns`` has name, population, pos.
    Shops per brand are counted over all listings, excluded ones included,
    so the brand filter comes after that count. ``keep_excluded`` leaves the
    excluded rows in, marked by ``excluded``, for the summary.
    """
    first = with_brand_key(keep(unique_listings(listings, seq), "unique"))
    # All counts come from the kept rows, not from the growing plan.
    per_town = key_counts(first.select(name_key(F.col("municipio_origen")).alias("_town")), ["_town"])
    per_page = key_counts(first.select(page_address(F.col("web")).alias("url")), ["url"])

    marked = with_store_count(first, count_by_brand(first)).drop("brand_key").withColumn(
        "excluded", names_brand(F.col("nombre"), brands)
    )
    if not keep_excluded:
        marked = marked.where(~F.col("excluded")).drop("excluded")
    placed = town_population(marked, towns, counts=per_town)
    read = with_page(placed, one_per_url(features), per_page)
    spot = coordinates(F.col("lat"), F.col("lon"), F.col("maps_url"))
    ready = read.withColumns(
        {
            "_spot": spot,
            "_lat": F.col("lat"),
            "_lon": F.col("lon"),
            "_tech": F.col("tecnologia"),
            "madurez": maturity(F.col("es_tienda"), strip(text(F.col("web")))),
        }
    ).withColumns(
        {
            "lat": F.col("_spot.lat"),
            "lon": F.col("_spot.lon"),
            "tecnologia": F.nullif(F.col("tecnologia"), F.lit("-")),
        }
    )
    scored = score_listings(ready, sites, weights, avatars)
    if own_platform:
        scored = apply_existing_customer(scored, own_platform)
    return scored.withColumns(
        {"lat": F.col("_lat"), "lon": F.col("_lon"), "tecnologia": F.col("_tech")}
    ).drop("_spot", "_lat", "_lon", "_tech")


def analyse_with_handles(
    scored: DataFrame,
    cache: DataFrame,
    searches: DataFrame,
    max_usd: float = 1.0,
    seq: str = "seq",
) -> DataFrame:
    """Add instagram and instagram_fuente to analysed listings."""
    scored = keep(scored, "scored")
    return resolve_handles(scored, cache, searches, max_usd, seq).drop(
        "perfil", "search_state", "key", "cost", "handle"
    )


def summarise_with_handles(
    scored: DataFrame,
    cache: DataFrame,
    searches: DataFrame,
    max_usd: float = 1.0,
    seq: str = "seq",
) -> DataFrame:
    """The counts of an analysis, with handles by where they come from.

    ``scored`` has excluded, es_tienda, page_error and perfil; excluded rows are counted as
    such and not searched for, so they cost nothing.
    """
    done = analyse_with_handles(scored.where(~F.col("excluded")), cache, searches, max_usd, seq)
    columns = ["excluded", "es_tienda", "page_error", "instagram_fuente"]
    left_out = scored.where("excluded").withColumn("instagram_fuente", F.lit("-"))
    return analysis_summary(done.select(*columns).unionByName(left_out.select(*columns)))


def resolve_and_account(
    scored: DataFrame,
    cache: DataFrame,
    searches: DataFrame,
    run_ts: int,
    max_usd: float = 1.0,
    seq: str = "seq",
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows with handles, the run's new cache rows, and its budget report.

    Append the cache rows (``ledgers.append_cache``) and the next run pays for none of
    these searches again.
    """
    resolved = keep(resolve_handles(keep(scored, "scored"), cache, searches, max_usd, seq), "resolved")
    made = resolved.where(F.col("cost").isNotNull())
    rows = resolved.drop("perfil", "key", "cost", "handle")
    return rows, cache_entries(made, run_ts), budget_report(made, [], [seq], max_usd)


def unique_listings(listings: DataFrame, seq: str = "seq") -> DataFrame:
    """The first table of an analysis: the listings without repeated name, address and phone."""
    unique = first_per_key(with_keys(listings), "fallback_key", seq)
    return unique.drop("url_key", "fallback_key")
