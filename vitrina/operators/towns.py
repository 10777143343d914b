"""Towns by region: targets, look-ups, resume, grouping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from vitrina import defaults
from vitrina.functions.text import city_label, search_text, strip, text
from vitrina.operators.dedup import first_per_key
from vitrina.operators.lookups import attach
from vitrina.operators.ordering import numbered


def name_key(name: Column) -> Column:
    return F.nullif(F.lower(strip(text(name))), F.lit(""))


def town_population(
    listings: DataFrame,
    towns: DataFrame,
    town: str = "municipio_origen",
    counts: DataFrame | None = None,
) -> DataFrame:
    """Add poblacion: of the first town of that name in ``pos`` order, else 0.

    ``counts`` (_town, _rows) saves counting the listings per town.
    """
    first = first_per_key(towns.withColumn("_town", name_key(F.col("name"))), "_town", "pos")
    known = first.select("_town", F.col("population").alias("poblacion"))
    named = listings.withColumn("_town", name_key(F.col(town)))
    joined = attach(named, known, "_town", counts)
    return joined.withColumn("poblacion", F.coalesce("poblacion", F.lit(0))).drop("_town")


def regions(towns: DataFrame) -> DataFrame:
    return towns.select("region").distinct().orderBy("region")


def region_towns(towns: DataFrame, region: str, min_population: int) -> DataFrame:
    """Towns of a region from a population on, smallest first; unknown regions fail."""
    own = towns.where(F.col("region") == region)
    if own.isEmpty():
        raise KeyError(f"unknown region: {region}")
    return own.where(F.col("population") >= min_population).orderBy("population", "pos")


def search_targets(towns: DataFrame, category: str) -> DataFrame:
    """Label, location, city text and query of every town's search."""
    location = F.concat_ws(", ", "name", "province")
    return towns.withColumns(
        {
            "location": location,
            "city": city_label(F.col("name"), F.col("province")),
            "source_query": search_text(F.lit(category), location),
        }
    )


def pages_for(max_results: Column) -> Column:
    """Pages to ask for: all when there is no limit, else what the limit needs."""
    needed = F.ceil(max_results / defaults.RESULTS_PER_PAGE)
    most = F.lit(defaults.MAX_PAGES).cast("long")
    return F.when(max_results <= 0, most).otherwise(F.least(most, needed))


def skip_processed(targets: DataFrame, done: DataFrame, name: str = "name") -> DataFrame:
    """Targets whose town has no row in an earlier output (municipio_origen)."""
    seen = done.select(name_key(F.col("municipio_origen")).alias("_town")).where(
        F.col("_town").isNotNull()
    ).distinct()
    keyed = targets.withColumn("_town", name_key(F.col(name)))
    return keyed.join(seen, "_town", "left_anti").drop("_town")


def towns_by_region(towns: DataFrame) -> DataFrame:
    """Towns with their place in their region, most populous first.

    A flat table: a region may be of any size.
    """
    ranked = towns.withColumn("_down", -F.col("population"))
    return numbered(ranked, ["region"], ["_down", "pos"], "place").drop("_down")


def region_provinces(towns: DataFrame) -> DataFrame:
    return towns.select("region", "province").distinct()
