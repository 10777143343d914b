"""Distances, coordinates in map links, and outline tests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

EARTH_KM = 6371.0


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    north = F.sin(F.radians(lat2 - lat1) / 2)
    east = F.sin(F.radians(lon2 - lon1) / 2)
    a = north * north + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * east * east
    km = F.lit(2 * EARTH_KM) * F.asin(F.sqrt(F.least(F.lit(1.0), a)))
    return F.when(lat1.isNotNull() & lon1.isNotNull() & lat2.isNotNull() & lon2.isNotNull(), km)


def coordinates(lat_text: Column, lon_text: Column, maps_url: Column) -> Column:
    """struct(lat, lon): the two columns when both are numbers, else the link.

    Both numbers always come from the same place.
    """

    def pair(lat: Column, lon: Column) -> Column:
        lat, lon = lat.try_cast("double"), lon.try_cast("double")
        return F.when(
            lat.isNotNull() & lon.isNotNull(), F.struct(lat.alias("lat"), lon.alias("lon"))
        )

    def link(pattern: str) -> Column:
        url = F.coalesce(maps_url, F.lit(""))
        return pair(F.regexp_extract(url, pattern, 1), F.regexp_extract(url, pattern, 2))

    plain = r"\A\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*\z"
    return F.coalesce(
        F.when(lat_text.rlike(plain) & lon_text.rlike(plain), pair(lat_text, lon_text)),
        link(r"!3d(-?\d+\.\d+)!4d(-?\d+\.\d+)"),
        link(r"@(-?\d+\.\d+),(-?\d+\.\d+)"),
    )


def crossings(edges: Column, lat: Column) -> Column:
    """Longitudes where the outline's edges cross one parallel.

    ``edges`` is array<struct<x1, y1, x2, y2>> over all rings and parts.
    """
    cut = F.filter(edges, lambda e: (e["y1"] > lat) != (e["y2"] > lat))
    return F.transform(
        cut,
        lambda e: e["x1"] + (lat - e["y1"]) * (e["x2"] - e["x1"]) / (e["y2"] - e["y1"]),
    )


def inside(cuts: Column, lon: Column) -> Column:
    """A point is inside when an odd number of crossings lies east of it."""
    return F.size(F.filter(cuts, lambda x: lon < x)) % 2 == 1


def literal_edges(rings: Sequence[Sequence[tuple[float, float]]]) -> Column:
    """Edges of rings given as lists of (lon, lat), open or closed."""
    edges = []
    for ring in rings:
        points = list(ring)
        if points[0] != points[-1]:
            points.append(points[0])
        for (x1, y1), (x2, y2) in zip(points, points[1:]):
            edges.append(
                F.struct(
                    F.lit(float(x1)).alias("x1"),
                    F.lit(float(y1)).alias("y1"),
                    F.lit(float(x2)).alias("x2"),
                    F.lit(float(y2)).alias("y2"),
                )
            )
    return F.array(*edges)
