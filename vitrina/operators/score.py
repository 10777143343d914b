"""The commercial score of a listing, with its explanation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from vitrina import defaults
from vitrina.functions.rules import avatar_hits, band, best_avatar, maturity_points, tier
from vitrina.operators.nearest import with_nearest_site


def score_listings(
    df: DataFrame,
    sites: Sequence[dict],
    weights: dict = defaults.WEIGHTS,
    avatars: Sequence[dict] = defaults.AVATARS,
) -> DataFrame:
    """Add puntuacion, prioridad, prioridad_etiqueta, justificacion and breakdown.

    Needs lat, lon (double or null), poblacion, num_tiendas, madurez and
    tecnologia (null when unknown). The rules are column expressions of the row
    and the sites are broadcast: scoring adds no shuffle.
    """
    rules = weights["criterios"]
    population = F.coalesce("poblacion", F.lit(0)).cast("int")
    # A shop without a count, or with none, is one shop to the band but none to the avatars.
    counted = F.coalesce("num_tiendas", F.lit(0)).cast("int")
    stores = F.when(counted == 0, 1).otherwise(counted)
    found = (
        with_nearest_site(df, sites)
        .withColumnsRenamed({"km": "_km", "site": "_site"})
        .withColumns({"_pop": population, "_n": stores, "_raw_n": counted})
    )
    judged = found.withColumns(
        {
            "_d": band(F.col("_km"), rules["distancia_eci"]["bandas"], "min_km", "max_km"),
            "_p": band(F.col("_pop"), rules["poblacion_municipio"]["bandas"]),
            "_t": band(F.col("_n"), rules["num_tiendas"]["bandas"]),
            "_m": maturity_points(F.col("madurez"), F.col("tecnologia"), rules["madurez_digital"]),
            "_hits": avatar_hits(
                F.col("_pop"),
                F.col("_km"),
                F.col("_raw_n"),
                F.col("madurez") == "ecommerce_funcional",
                avatars,
            ),
        }
    ).withColumn(
        "_a", best_avatar(F.col("_hits"), avatars, rules["encaje_avatar"]["valores"])
    )
    located = F.col("_km").isNotNull()
    km_shown = F.bround("_km", 1)
    distance_points = F.when(located, F.col("_d.puntos")).otherwise(F.lit(0))
    total = (
        distance_points
        + F.col("_p.puntos")
        + F.col("_t.puntos")
        + F.col("_m.puntos")
        + F.col("_a.puntos")
    )
    summed = judged.withColumn("puntuacion", total)
    reached = summed.withColumn("_tier", tier(F.col("puntuacion"), weights["tramos_prioridad"]))
    return reached.withColumns(
        {
            "prioridad": F.col("_tier.id"),
            "prioridad_etiqueta": F.col("_tier.etiqueta"),
            "justificacion": _explain(located, km_shown),
            "breakdown": F.struct(
                F.struct(
                    distance_points.alias("puntos"),
                    km_shown.alias("valor_km"),
                    F.when(located, F.col("_d.etiqueta"))
                    .otherwise("sin coordenadas")
                    .alias("etiqueta"),
                    F.col("_site").alias("eci"),
                ).alias("distancia_eci"),
                _part("_p", "_pop").alias("poblacion"),
                _part("_t", "_n").alias("num_tiendas"),
                _part("_m", "madurez").alias("madurez_digital"),
                F.struct(
                    F.col("_a.puntos").alias("puntos"),
                    F.col("_a.id").alias("valor_avatar_id"),
                    F.col("_a.etiqueta").alias("etiqueta"),
                ).alias("avatar"),
            ),
        }
    ).drop("_pop", "_n", "_raw_n", "_km", "_site", "_d", "_p", "_t", "_m", "_hits", "_a", "_tier")


def _part(rule: str, value: str) -> Column:
    return F.struct(
        F.col(f"{rule}.puntos").alias("puntos"),
        F.col(value).alias("valor"),
        F.col(f"{rule}.etiqueta").alias("etiqueta"),
    )


def _explain(located: Column, km_shown: Column) -> Column:
    distance = F.format_string(
        "ECI %s a %.1fkm [%s=%dpts]", "_site", km_shown, "_d.etiqueta", "_d.puntos"
    )
    return F.concat_ws(
        "; ",
        F.when(located, distance).otherwise("sin coordenadas (0pts dist)"),
        F.format_string("pob %,d [%s=%dpts]", "_pop", "_p.etiqueta", "_p.puntos"),
        F.format_string("%d tiendas [%s=%dpts]", "_n", "_t.etiqueta", "_t.puntos"),
        F.format_string("madurez=%s [%dpts]", "_m.etiqueta", "_m.puntos"),
        F.format_string("%s [%dpts]", "_a.etiqueta", "_a.puntos"),
    )


def apply_existing_customer(df: DataFrame, own_platform: str) -> DataFrame:
    """A shop on the vendor's own platform is a customer already: no points."""
    theirs = F.coalesce(F.col("tecnologia") == own_platform, F.lit(False))
    told = F.concat(
        F.lit(f"Ya cliente (web hecha con {own_platform}) — sin serlo sería "), F.col("prioridad")
    )
    return df.withColumns(
        {
            "justificacion": F.when(theirs, told).otherwise(F.col("justificacion")),
            "prioridad": F.when(theirs, "Ya cliente").otherwise(F.col("prioridad")),
            "puntuacion": F.when(theirs, 0).otherwise(F.col("puntuacion")),
        }
    )
