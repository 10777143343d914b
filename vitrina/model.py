"""Schemas of the tables the operators read and write."""

from pyspark.sql import types as T

LISTING_COLUMNS = [
    "nombre", "telefono", "direccion", "web", "rating", "categoria",
    "source_query", "retrieved_at_utc", "maps_url", "municipio_origen", "lat", "lon",
]
LISTING = T.StructType([T.StructField(c, T.StringType()) for c in LISTING_COLUMNS])

# Columns of the listing that the analysis output leaves out.
ANALYSIS_DROPPED = ["rating", "source_query", "retrieved_at_utc", "maps_url", "lat", "lon"]

_TEXT = "struct<text:string>"
PLACE = (
    f"displayName {_TEXT}, formattedAddress string, nationalPhoneNumber string, "
    "internationalPhoneNumber string, websiteUri string, rating double, "
    f"primaryTypeDisplayName {_TEXT}, googleMapsUri string, "
    "location struct<latitude:double, longitude:double>"
)
PLACES_RESPONSE = (
    "query string, municipio_origen string, retrieved_at_utc string, "
    "places array<struct<" + PLACE.replace(" struct", ":struct").replace(" string", ":string")
    .replace(" double", ":double") + ">>, nextPageToken string"
)

SEARCH_ITEM = "struct<type:string, title:string, url:string, breadcrumb:string>"
SEARCH_RESPONSE = (
    "nombre string, municipio string, cost double, "
    f"tasks array<struct<cost:double, result:array<struct<items:array<{SEARCH_ITEM}>>>>>"
)

OUTLINE_RESPONSE = (
    "place string, display_name string, boundingbox array<string>, "
    "geojson struct<type:string, coordinates:string>"
)
ZONES = "array<struct<lat:double, lon:double, zoom:int>>"

TOWN_FILE = (
    "map<string, struct<provincias:array<string>, "
    "municipios:array<struct<nombre:string, provincia:string, poblacion:int>>>>"
)

RUN_HISTORY = (
    "job_id string, city string, category string, started_at string, status string, "
    "valid_count long, output string, params map<string,string>, pid long"
)
LOOKUP_CACHE = "key string, url string, ts long"
USAGE_LEDGER = "run_ts timestamp, requests long"
LOG_LINES = "run string, line_no long, line string"
