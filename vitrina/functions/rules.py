"""Band, tier, maturity, avatar and category rules as CASE expressions.

Rules come from configuration lists. The order of a list decides which rule
applies first, so each rule set becomes one CASE in that order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from vitrina import defaults


def first_match(tests: Sequence[tuple[Column, Column]], otherwise: Column) -> Column:
    chain = None
    for test, result in tests:
        chain = (F if chain is None else chain).when(test, result)
    return otherwise if chain is None else chain.otherwise(otherwise)


def band(value: Column, bands: Sequence[dict], low: str = "min", high: str = "max") -> Column:
    """struct(puntos, etiqueta) of the first band that holds the value.

    Both ends belong to a band, so neighbouring bands may share an edge.
    """

    return first_match(
        [
            ((value >= b[low]) & (value <= b[high]), _scored(int(b["puntos"]), b["etiqueta"]))
            for b in bands
        ],
        _scored(0, "fuera de banda"),
    )


def _scored(points: int, label: str) -> Column:
    return F.struct(F.lit(points).alias("puntos"), F.lit(label).alias("etiqueta"))


def tier(points: Column, tiers: Sequence[dict]) -> Column:
    """struct(id, etiqueta) of the highest tier reached."""
    def named(identifier: str, label: str) -> Column:
        return F.struct(F.lit(identifier).alias("id"), F.lit(label).alias("etiqueta"))

    ranked = sorted(tiers, key=lambda t: -int(t["min_puntos"]))
    return first_match(
        [(points >= int(t["min_puntos"]), named(t["id"], t["etiqueta"])) for t in ranked],
        named("P4", "Prioridad mínima"),
    )


def maturity(shop: Column, web: Column) -> Column:
    return (
        F.when(shop == "Sí", "ecommerce_funcional")
        .when(web != "", "solo_redes_sociales")
        .otherwise("sin_presencia")
    )


def maturity_points(level: Column, technology: Column, criterion: dict) -> Column:
    """struct(puntos, etiqueta): a technology's own value counts for shops only."""
    by_technology = criterion.get("por_tecnologia") or {}
    shop = level == "ecommerce_funcional"
    tests = [
        (shop & (technology == name), _scored(int(points), f"ecommerce_funcional ({name})"))
        for name, points in by_technology.items()
    ]
    tests += [
        (level == name, _scored(int(points), name)) for name, points in criterion["valores"].items()
    ]
    return first_match(tests, F.struct(F.lit(0).alias("puntos"), level.alias("etiqueta")))


def avatar_hits(
    population: Column, km: Column, stores: Column, shop: Column, avatars: Sequence[dict]
) -> Column:
    """struct(a0, a1, …): how many rules of each avatar are met.

    ``km`` is null without coordinates, which meets no distance range.
    """

    def within(value: Column, bounds: Sequence[float]) -> Column:
        return F.coalesce(value.between(bounds[0], bounds[1]), F.lit(False)).cast("int")

    hits = []
    for i, a in enumerate(avatars):
        rules = a["criterios"]
        met = (
            within(population, rules["poblacion_municipio"])
            + within(km, rules["distancia_eci_km"])
            + within(stores, rules["num_tiendas"])
        )
        if rules.get("ecommerce_requerido", False):
            met = met + shop.cast("int")
        hits.append(met.alias(f"a{i}"))
    return F.struct(*hits)


def best_avatar(hits: Column, avatars: Sequence[dict], points: dict) -> Column:
    """struct(puntos, etiqueta, id) of the best avatar, the first one on ties."""

    def fit(kind: str, worth: int, a: dict) -> Column:
        return F.struct(
            F.lit(worth).alias("puntos"),
            F.lit(f"encaje {kind} con Avatar {a['id']} ({a['nombre']})").alias("etiqueta"),
            F.lit(int(a["id"])).alias("id"),
        )

    clear, partial = int(points["encaje_claro"]), int(points["encaje_parcial"])
    tests = []
    # Most points first; avatars worth the same keep their list order.
    for worth in sorted({clear, partial} - {0}, reverse=True):
        for i, a in enumerate(avatars):
            needed = 4 if a["criterios"].get("ecommerce_requerido", False) else 3
            enough = int(a.get("encaje_parcial_si_cumple_n", 2))
            met = hits[f"a{i}"]
            if worth == clear:
                tests.append((met == needed, fit("claro", worth, a)))
            if worth == partial:
                nearly = (met >= enough) & (met != needed)
                tests.append((nearly, fit("parcial", worth, a)))
    return first_match(
        tests,
        F.struct(
            F.lit(0).alias("puntos"),
            F.lit("no encaja con ningún avatar").alias("etiqueta"),
            F.lit(None).cast("int").alias("id"),
        ),
    )


def guess_type(
    category: Column, stems: Sequence[tuple[str, str]] = defaults.CATEGORY_STEMS
) -> Column:
    """Place type of the first stem found in a category text, or null."""
    low = F.lower(category)
    return first_match(
        [(F.contains(low, F.lit(stem)), F.lit(kind)) for stem, kind in stems],
        F.lit(None).cast("string"),
    )
