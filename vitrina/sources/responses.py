"""Saved responses: places, searches, outlines, zones."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from vitrina import defaults, model
from vitrina.operators.durable import keep
from vitrina.operators.ordering import with_order


def read_places(spark: SparkSession, path: str) -> DataFrame:
    """Listings of saved places responses, one JSON document per line, with ``seq``.

    ``seq`` follows the files' names, the lines of a file and the places of a line.
    """
    saved = spark.read.schema(model.PLACES_RESPONSE).json(path).withColumns(
        {
            "_file": F.col("_metadata.file_path"),
            "_block": F.col("_metadata.file_block_start"),
            "_line": F.monotonically_increasing_id(),
        }
    )
    return places_to_listings(saved, ["_file", "_block", "_line"])


def places_to_listings(saved: DataFrame, order: Sequence[str] = ()) -> DataFrame:
    """Explode responses (query, municipio_origen, retrieved_at_utc, places).

    With ``order``, columns that tell the responses apart and put them in order, the
    listings are numbered by ``seq`` in that order and by their place in the response.
    """
    # The outer form: with the other one the planner tests the parsed places for being there
    # below the parser, by parsing every response twice more.
    one = saved.select(
        *order, "query", "municipio_origen", "retrieved_at_utc",
        F.posexplode_outer("places").alias("_place", "place"),
    ).where("_place is not null")
    listings = one.select(
        *order, "_place",
        *map_place(
            F.col("place"), F.col("query"), F.col("municipio_origen"), F.col("retrieved_at_utc")
        ),
    )
    if order:
        # Kept, as putting rows in order reads them twice and responses are costly to parse.
        listings = with_order(keep(listings, "places"), *order, "_place")
    return listings.drop(*order, "_place")


def _filled(*values: Column) -> Column:
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in values], F.lit(""))


def _number_text(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit(""))


def map_place(place: Column, query: Column, town: Column, retrieved: Column) -> list[Column]:
    """The listing columns of one place; the national phone number comes first."""
    fields = {
        "nombre": _filled(place["displayName"]["text"]),
        "telefono": _filled(place["nationalPhoneNumber"], place["internationalPhoneNumber"]),
        "direccion": _filled(place["formattedAddress"]),
        "web": _filled(place["websiteUri"]),
        "rating": _number_text(place["rating"]),
        "categoria": _filled(place["primaryTypeDisplayName"]["text"]),
        "source_query": query,
        "retrieved_at_utc": retrieved,
        "maps_url": _filled(place["googleMapsUri"]),
        "municipio_origen": town,
        "lat": _number_text(place["location"]["latitude"]),
        "lon": _number_text(place["location"]["longitude"]),
    }
    return [fields[c].alias(c) for c in model.LISTING_COLUMNS]


def read_searches(spark: SparkSession, path: str) -> DataFrame:
    """nombre, municipio, items, cost of saved search responses."""
    return search_items(spark.read.schema(model.SEARCH_RESPONSE).json(path))


def search_items(saved: DataFrame) -> DataFrame:
    """First result of the first task; its own cost counts before the response's."""
    task = F.get("tasks", F.lit(0))
    own_cost = F.nullif(task["cost"], F.lit(0.0))
    empty = F.array().cast(f"array<{model.SEARCH_ITEM}>")
    return saved.select(
        "nombre",
        "municipio",
        F.coalesce(F.get(task["result"], F.lit(0))["items"], empty).alias("items"),
        F.coalesce(own_cost, F.col("cost"), F.lit(0.0)).alias("cost"),
    )


def read_outlines(spark: SparkSession, path: str) -> DataFrame:
    """place, display_name, box and edges of saved geocoder responses."""
    return outlines(spark.read.schema(model.OUTLINE_RESPONSE).json(path))


def outlines(saved: DataFrame) -> DataFrame:
    """min_lat, max_lat, min_lon, max_lon and the outline's edges (null without one).

    The box comes as texts in the order south, north, west, east. Coordinates
    stay JSON text up to here, as their nesting depends on the kind of shape.
    """
    box = [F.get("boundingbox", F.lit(i)).try_cast("double") for i in range(4)]
    shape = F.col("geojson.coordinates")
    kind = F.col("geojson.type")
    rings = F.when(
        kind == "MultiPolygon",
        F.flatten(F.from_json(shape, "array<array<array<array<double>>>>")),
    ).when(kind == "Polygon", F.from_json(shape, "array<array<array<double>>>"))
    return saved.select(
        "place",
        "display_name",
        box[0].alias("min_lat"),
        box[1].alias("max_lat"),
        box[2].alias("min_lon"),
        box[3].alias("max_lon"),
        ring_edges(rings).alias("edges"),
    )


def ring_edges(rings: Column) -> Column:
    """Edges of closed rings of [lon, lat] points."""

    def of_ring(ring: Column) -> Column:
        steps = F.sequence(F.lit(0), F.size(ring) - 2)
        return F.transform(
            steps,
            lambda i: F.struct(
                F.get(F.get(ring, i), F.lit(0)).alias("x1"),
                F.get(F.get(ring, i), F.lit(1)).alias("y1"),
                F.get(F.get(ring, i + 1), F.lit(0)).alias("x2"),
                F.get(F.get(ring, i + 1), F.lit(1)).alias("y2"),
            ),
        )

    usable = F.filter(rings, lambda r: F.size(r) >= 2)
    return F.flatten(F.transform(usable, of_ring))


def zones(df: DataFrame, column: str) -> DataFrame:
    """lat, lon, zoom, cell_deg of zone lists given as JSON text."""
    own = [c for c in df.columns if c != column]
    listed = df.select(*own, F.explode(F.from_json(column, model.ZONES)).alias("z"))
    return listed.select(
        *own,
        "z.lat",
        "z.lon",
        F.coalesce("z.zoom", F.lit(defaults.START_ZOOM)).alias("zoom"),
        F.lit(defaults.CELL_DEGREES).alias("cell_deg"),
    )
