"""The closest of a list or a table of reference sites."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from vitrina.functions.geo import EARTH_KM, haversine_km
from vitrina.operators.durable import keep
from vitrina.operators.lookups import attach

# Degrees around the sites for which candidates are prepared; listings further
# away are compared with all sites.
MARGIN = 2.0
# Smallest cell, and the number of cells beyond which cells grow instead.
CELL = 0.25
MAX_CELLS = 20_000

_SITE = "struct<pos:int, site:string, lat:double, lon:double>"


def with_nearest_site(
    df: DataFrame, sites: Sequence[dict], lat: str = "lat", lon: str = "lon"
) -> DataFrame:
    """Add km and site: the closest site, the first of equally close ones.

    Null without coordinates. Sites come from a configuration list. For every
    cell around them only the sites that can be the closest to some point of
    the cell are compared. The cells are at most ``MAX_CELLS`` rows, which are
    broadcast, and the listings are not shuffled.
    """
    if not sites:
        return df.withColumns({"km": F.lit(None).cast("double"), "site": F.lit(None).cast("string")})
    named = [(i, s["ciudad"], float(s["lat"]), float(s["lon"])) for i, s in enumerate(sites)]
    size, rows = _candidates(named)
    cells = df.sparkSession.createDataFrame(
        rows, f"_cell_lat long, _cell_lon long, _near array<{_SITE}>"
    )
    all_sites = F.array(
        *[
            F.struct(*[F.lit(v).alias(n) for v, n in zip(s, ("pos", "site", "lat", "lon"))])
            for s in named
        ]
    )
    placed = df.withColumns(
        {
            "_cell_lat": F.floor(F.col(lat) / size),
            "_cell_lon": F.floor(F.col(lon) / size),
            "_cos": F.cos(F.radians(lat)),
        }
    ).join(F.broadcast(cells), ["_cell_lat", "_cell_lon"], "left")

    def measured(s: Column) -> Column:
        north = F.sin(F.radians(s["lat"] - F.col(lat)) / 2)
        east = F.sin(F.radians(s["lon"] - F.col(lon)) / 2)
        a = north * north + F.col("_cos") * F.cos(F.radians(s["lat"])) * east * east
        km = F.lit(2 * EARTH_KM) * F.asin(F.sqrt(F.least(F.lit(1.0), a)))
        return F.struct(km.alias("km"), s["pos"].alias("pos"), s["site"].alias("site"))

    located = F.col(lat).isNotNull() & F.col(lon).isNotNull()
    closest = F.array_min(F.transform(F.coalesce("_near", all_sites), measured))
    best = placed.withColumn("_best", F.when(located, closest))
    return best.select(
        *df.columns, F.col("_best.km").alias("km"), F.col("_best.site").alias("site")
    )


def _km(lat1, lon1, lat2, lon2):
    lat1, lon1, lat2, lon2 = (np.radians(v) for v in (lat1, lon1, lat2, lon2))
    a = (
        np.sin((lat2 - lat1) / 2) ** 2
        + np.cos(lat1) * np.cos(lat2) * np.sin((lon2 - lon1) / 2) ** 2
    )
    return 2 * EARTH_KM * np.arcsin(np.sqrt(np.minimum(1.0, a)))


def _candidates(sites: list[tuple]) -> tuple[float, list[tuple]]:
    """Cell size, and per cell the sites that may be the closest to a point in it.

    No point is further from the cell's centre than its radius, so the closest
    site of any point is at most two radii further from the centre than the
    centre's own closest site.
    """
    lats, lons = np.array([s[2] for s in sites]), np.array([s[3] for s in sites])
    south, north = max(-90.0, lats.min() - MARGIN), min(90.0, lats.max() + MARGIN)
    west, east = max(-180.0, lons.min() - MARGIN), min(180.0, lons.max() + MARGIN)
    size = max(CELL, float(np.sqrt((north - south) * (east - west) / MAX_CELLS)))

    columns = np.arange(int(west // size), int(east // size) + 1)
    rows = []
    for y in range(int(south // size), int(north // size) + 1):
        centre = (y + 0.5) * size
        edge = min(abs(y * size), abs((y + 1) * size))  # the wider side of the cell
        radius = 1.01 * max(
            float(_km(centre, 0.0, corner, size / 2))
            for corner in (y * size, (y + 1) * size, edge)
        )
        km = _km(centre, (columns[:, None] + 0.5) * size, lats[None, :], lons[None, :])
        near = km <= km.min(axis=1, keepdims=True) + 2 * radius
        rows += [
            (y, int(x), [sites[i] for i in np.flatnonzero(found)])
            for x, found in zip(columns, near)
        ]
    return size, rows


# Sides of the cubes around the unit sphere's points are 2 ** -level.
FINEST = 20
# Sites that a place is compared with at once; beyond that its cubes are split.
AT_ONCE = 64
_CUBE = ["_level", "_cx", "_cy", "_cz"]


def nearest_in_table(
    points: DataFrame, sites: DataFrame, lat: str = "lat", lon: str = "lon"
) -> DataFrame:
    """Add km and site: the closest row of a table of sites, of equally close ones that of least ``pos``.

    ``sites`` has pos (unique), site, lat, lon and may be as large as the points. Both sides are
    places on the unit sphere, so neither the poles nor the 180th meridian are special. Only
    distinct places take part, so a place with very many points or sites counts once. The
    smallest cube around a place that holds a site bounds how far the closest is; of the
    cubes of twice that side around it those within the bound are looked at. A place whose cubes hold more
    than ``AT_ONCE`` sites goes on with their parts of half the side, which bound it more tightly, down to some
    six metres; all others meet the sites of their cubes. So neither a dense group of sites nor an empty
    region makes places meet many sites.

    Null without coordinates; without sites all are null. Rows of equal coordinates stay rows
    of their own. Runs a job for each step while the plan is built.
    """
    where = ["_lat", "_lon"]
    located = F.col(lat).isNotNull() & F.col(lon).isNotNull()
    placed = points.withColumns({"_lat": F.when(located, F.col(lat).cast("double")),
                                 "_lon": F.when(located, F.col(lon).cast("double"))})
    own = sites.where("lat is not null and lon is not null").select(
        F.col("lat").cast("double").alias("_lat"), F.col("lon").cast("double").alias("_lon"), "pos", "site"
    )
    known = keep(_on_sphere(own.groupBy(*where).agg(F.min(F.struct("pos", "site")).alias("_site"))), "sites")
    if known.isEmpty():
        return points.withColumns({"km": F.lit(None).cast("double"), "site": F.lit(None).cast("string")})
    finite = known.where(_finite())
    levels = F.explode(F.array(*[F.struct(*_cube(v)) for v in range(FINEST + 1)]))
    cubes = keep(
        finite.select(levels.alias("c")).select("c.*").groupBy(*_CUBE).agg(F.count(F.lit(1)).alias("_n")), "cubes"
    )
    places = _on_sphere(placed.where(located).select(*where).distinct())
    places = keep(places.withColumn("_place", F.monotonically_increasing_id()), "places")
    found = _closest(_around(places.where(_finite()), cubes, levels), cubes, finite)
    # No distance from or to a place that is no number; all are as far.
    least = known.agg(F.min("_site").alias("_least"))
    far = F.struct(F.lit(float("nan")).alias("km"), F.col("_least.pos").alias("pos"), F.col("_least.site").alias("site"))
    best = places.join(found, "_place", "left").crossJoin(F.broadcast(least)).select(
        *where, F.coalesce("_best", far).alias("_best")
    )
    # Kept, as the join with the rows asks for its size.
    joined = attach(placed, keep(best, "nearest"), where)
    return joined.select(
        *points.columns, F.col("_best.km").alias("km"), F.col("_best.site").cast("string").alias("site")
    )


def _on_sphere(places: DataFrame) -> DataFrame:
    phi, theta = F.radians("_lat"), F.radians("_lon")
    return places.withColumns(
        {"_x": F.cos(phi) * F.cos(theta), "_y": F.cos(phi) * F.sin(theta), "_z": F.sin(phi)}
    )


def _finite() -> Column:
    return ~(F.isnan("_x") | F.isnan("_y") | F.isnan("_z"))


def _cube(level: int) -> list[Column]:
    number = [F.floor(F.col(c) * float(2**level)).alias(n) for c, n in zip(("_x", "_y", "_z"), _CUBE[1:])]
    return [F.lit(level).alias("_level"), *number]


def _distances() -> tuple[Column, Column]:
    """The least and the greatest distance of the place's point from a point of the cube."""
    side = F.pow(F.lit(2.0), -F.col("_level"))
    least, most = F.lit(0.0), F.lit(0.0)
    for c, n in zip(("_x", "_y", "_z"), _CUBE[1:]):
        low, high = F.col(n) * side - F.col(c), (F.col(n) + 1) * side - F.col(c)
        out = F.greatest(low, -high, F.lit(0.0))
        reach = F.greatest(F.abs(low), F.abs(high))
        least, most = least + out * out, most + reach * reach
    return F.sqrt(least), F.sqrt(most)


def _around(places: DataFrame, cubes: DataFrame, levels: Column) -> DataFrame:
    """A row for each place and cube that holds sites and may hold the closest.

    The cubes have twice the side of the smallest around the place that holds a site.
    """
    each = places.select("_place", levels.alias("c")).select("_place", "c.*")
    own = each.join(cubes, _CUBE).groupBy("_place").agg(F.max("_level").alias("_own"))
    # Cubes of side 2: those around any place make up the whole sphere.
    level = F.coalesce("_own", F.lit(0)) - 1
    shifts = F.array(*[F.struct(*[F.lit(d).alias(a) for d, a in zip((x, y, z), "abc")])
                       for x in (-1, 0, 1) for y in (-1, 0, 1) for z in (-1, 0, 1)])
    scaled = places.join(own, "_place", "left").withColumn("_level", level).withColumn("_d", F.explode(shifts))
    scale = F.pow(F.lit(2.0), F.col("_level"))
    placed = scaled.select(
        "_place", "_lat", "_lon", "_x", "_y", "_z", "_level",
        *[(F.floor(F.col(c) * scale) + F.col(f"_d.{a}")).alias(n) for c, a, n in zip(("_x", "_y", "_z"), "abc", _CUBE[1:])],
        F.when(F.col("_own").isNotNull(), F.sqrt(F.lit(3.0)) * F.pow(F.lit(2.0), -F.col("_own"))).otherwise(2.0).alias("_reach"),
    )
    near = placed.where(_distances()[0] <= F.col("_reach") * 1.000001 + 1e-12).drop("_reach")
    return near.join(_with_top(cubes), _CUBE)


def _with_top(cubes: DataFrame) -> DataFrame:
    top = cubes.where("_level = 0").groupBy(
        F.lit(-1).alias("_level"), *[F.floor(F.col(n) / 2).alias(n) for n in _CUBE[1:]]
    ).agg(F.sum("_n").alias("_n"))
    return cubes.unionByName(top)


def _closest(around: DataFrame, cubes: DataFrame, known: DataFrame) -> DataFrame:
    """_place and _best, the closest of the sites in the cubes of each place."""
    one = Window.partitionBy("_place")
    met, open_ = [], around
    while True:
        least, most = _distances()
        # Some site is no further than the far corner of the nearest such cube.
        bounded = open_.withColumns({"_least": least, "_bound": F.min(most).over(one)})
        near = bounded.where(F.col("_least") <= F.col("_bound") * 1.000001 + 1e-12).drop("_least", "_bound")
        near = keep(near.withColumn("_sum", F.sum("_n").over(one)), "near")
        last = (F.col("_sum") <= AT_ONCE) | (F.col("_level") == FINEST)
        met.append(near.where(last))
        more = near.where(~last)
        if more.isEmpty():
            break
        parts = cubes.select(
            (F.col("_level") - 1).alias("_level"), *[F.floor(F.col(n) / 2).alias(n) for n in _CUBE[1:]],
            *[F.col(n).alias(f"_part{n}") for n in _CUBE[1:]], F.col("_n").alias("_part_n"),
        )
        open_ = more.join(parts, _CUBE).select(
            "_place", "_lat", "_lon", "_x", "_y", "_z", (F.col("_level") + 1).alias("_level"),
            *[F.col(f"_part{n}").alias(n) for n in _CUBE[1:]], F.col("_part_n").alias("_n"),
        )
    pairs = reduce(DataFrame.unionByName, met)
    each = F.explode(F.array(*[F.struct(*_cube(v)) for v in range(-1, FINEST + 1)]))
    entered = known.select(
        each.alias("c"), F.struct(F.col("_lat").alias("lat"), F.col("_lon").alias("lon"), "_site").alias("_s")
    ).select("c.*", "_s")
    km = haversine_km(F.col("_lat"), F.col("_lon"), F.col("_s.lat"), F.col("_s.lon"))
    best = F.min(F.struct(km.alias("km"), F.col("_s._site.pos").alias("pos"), F.col("_s._site.site").alias("site")))
    return pairs.select("_place", "_lat", "_lon", *_CUBE).join(entered, _CUBE).groupBy("_place").agg(best.alias("_best"))
