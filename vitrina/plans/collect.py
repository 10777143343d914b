"""From places and saved responses to a clean listing table."""

from __future__ import annotations

import time
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Observation, functions as F

from vitrina import defaults
from vitrina.functions.text import clean_rating, clean_text
from vitrina.operators.dedup import dedup_two_keys, first_per_full_url, first_per_key, with_keys
from vitrina.operators.durable import discard, keep
from vitrina.operators.grid import grid_cells
from vitrina.operators.ordering import first_n
from vitrina.operators.runs import require_name
from vitrina.operators.towns import search_targets, skip_processed
from vitrina.operators.usage import estimate_cost, monthly_usage
from vitrina.sources.ledgers import append_usage, read_usage
from vitrina.sources.listings import write_listings, write_run_metrics


def work_table(
    towns: DataFrame, outlines: DataFrame, category: str, done: DataFrame | None = None,
    zones: DataFrame | None = None,
) -> DataFrame:
    """Searches still to make: one row per target town and grid cell.

    ``outlines`` (place, box, edges) is matched by the target's city text; of an outline
    saved more than once one counts. ``towns_without_outline`` names the other towns.
    ``zones`` (place, lat, lon, zoom, cell_deg, as ``responses.zones`` gives them) are cells set
    by hand: a target whose city text they name is searched there and nowhere else, with or
    without an outline, and its cells are neither rounded nor held against the outline.
    """
    targets = _placed(towns, outlines, category, done)
    if zones is not None:
        by_hand = zones.select(F.col("place").alias("city"), "lat", "lon", "zoom", "cell_deg")
        chosen = targets.join(by_hand, "city")
        targets = targets.join(by_hand.select("city").distinct(), "city", "left_anti")
    boxed = targets.where("min_lat is not null")
    cells = grid_cells(boxed, defaults.CELL_DEGREES, defaults.START_ZOOM, "edges")
    if zones is None:
        return cells
    return cells.unionByName(chosen.select(*cells.columns))


def towns_without_outline(
    towns: DataFrame, outlines: DataFrame, category: str, done: DataFrame | None = None
) -> DataFrame:
    """name, city, source_query of the targets that no saved outline matches."""
    missing = _placed(towns, outlines, category, done).where("min_lat is null")
    return missing.select("name", "city", "source_query")


def _placed(
    towns: DataFrame, outlines: DataFrame, category: str, done: DataFrame | None
) -> DataFrame:
    targets = search_targets(towns, category)
    if done is not None:
        targets = skip_processed(targets, done)
    boxed = outlines.where("min_lat is not null")
    single = first_per_key(boxed, "place", "min_lat", "min_lon", F.to_json("edges"))
    return targets.select("name", "city", "source_query").join(
        single.withColumnRenamed("place", "city"), "city", "left"
    )


def clean_listings(listings: DataFrame) -> DataFrame:
    """White space and private-use signs out of the texts; rating as a number text."""
    texts = ["nombre", "telefono", "direccion", "web", "categoria"]
    cleaned = {c: clean_text(F.col(c)) for c in texts}
    return listings.withColumns(cleaned | {"rating": clean_rating(F.col("rating"))})


def collect_pages(listings: DataFrame, max_records: int = 0, seq: str = "seq") -> DataFrame:
    """Listings of detail pages: cleaned, named, without duplicates by either key."""
    # Kept, as de-duplication reads its rows twice and the pages are costly to read.
    named = keep(require_name(clean_listings(listings)), "named")
    unique = dedup_two_keys(with_keys(named), seq).drop("url_key", "fallback_key")
    return first_n(unique, max_records, seq)


def collect_places(listings: DataFrame, max_records: int = 0, seq: str = "seq") -> DataFrame:
    """Listings of the places search: without duplicates by full link."""
    return first_n(first_per_full_url(listings, seq), max_records, seq)


def collect_places_run(
    listings: DataFrame,
    requests: DataFrame,
    output: str,
    ledger: str,
    category: str,
    tier: str = "enterprise",
    max_records: int = 0,
    seq: str = "seq",
    now: datetime | None = None,
) -> DataFrame:
    """One whole run of the places search: its listings written to ``output``, and its metrics.

    The listings are read once: what comes in and what is left without duplicates is counted on
    the way to the table of unique rows (``Observation``), of which the first ``max_records``
    are written. ``requests`` has a row for each request of the run (source_query, answered);
    pages are those that were answered. The run's requests are added to the ``ledger``, and
    the quota is that of the month with them.

    Returns one row, also written as JSON beside the output: category, queries, requests, pages,
    results_raw, results_deduped (written rows), elapsed_s, tier, run_est_cost_usd, quota and
    retrieved_at_utc. ``now`` is the run's time, in UTC. Runs jobs; a run that failed before its
    metrics were written has added nothing to the ledger.
    """
    spark = listings.sparkSession
    began = time.monotonic()
    stamp = now or datetime.now(timezone.utc)
    raw, unique = Observation("raw"), Observation("unique")
    counted = listings.observe(raw, F.count(F.lit(1)).alias("n"))
    kept = keep(
        first_per_full_url(counted, seq).observe(unique, F.count(F.lit(1)).alias("n")), "unique"
    )
    write_listings(first_n(kept, max_records, seq), output)
    discard(kept)
    n_unique = unique.get["n"]
    written = min(n_unique, max_records) if max_records > 0 else n_unique
    asked = requests.agg(
        F.sort_array(F.collect_set("source_query")).alias("queries"), F.count(F.lit(1)).alias("requests"),
        F.count_if("answered").alias("pages"),
    )
    asked = keep(asked, "asked")
    month = stamp.strftime("%Y-%m")
    at = F.lit(stamp.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp")
    append_usage(asked.select(at.alias("run_ts"), "requests"), ledger)
    used = monthly_usage(read_usage(spark, ledger), tier).where(F.col("month") == month)
    block = F.struct("month", F.col("requests").alias("run_requests"), "month_requests", "free_cap", "remaining",
                     "within_free", "est_cost_usd")
    metrics = asked.crossJoin(used).select(
        F.lit(category).alias("category"), "queries", "requests", "pages",
        F.lit(raw.get["n"]).cast("long").alias("results_raw"), F.lit(written).cast("long").alias("results_deduped"),
        F.lit(round(time.monotonic() - began, 2)).alias("elapsed_s"), F.lit(tier).alias("tier"),
        estimate_cost(F.col("requests"), tier).alias("run_est_cost_usd"), block.alias("quota"),
        F.lit(stamp.strftime("%Y-%m-%dT%H:%M:%S+00:00")).alias("retrieved_at_utc"),
    )
    metrics = keep(metrics, "metrics")
    write_run_metrics(metrics.coalesce(1), f"{output}.metrics")
    return metrics
