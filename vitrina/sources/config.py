"""Rule files, read again for every run.

They are small documents written by hand, so they become Python values that
the operators turn into expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from vitrina import model


def _read(spark: SparkSession, path: str, schema: str):
    return spark.read.schema(schema).option("multiLine", True).json(path).first()


def load_brands(spark: SparkSession, path: str) -> list[str]:
    row = _read(spark, path, "brands array<string>")
    return list(row["brands"] or [])


def load_sites(spark: SparkSession, path: str) -> list[dict]:
    row = _read(spark, path, "centros array<struct<ciudad:string,nombre:string,lat:double,lon:double>>")
    return [site.asDict() for site in row["centros"]]


def load_weights(spark: SparkSession, path: str) -> dict:
    band = "array<struct<{0}:double,{1}:double,puntos:int,etiqueta:string>>"
    km, plain = band.format("min_km", "max_km"), band.format("min", "max")
    row = _read(
        spark,
        path,
        f"criterios struct<distancia_eci:struct<bandas:{km}>,"
        f"poblacion_municipio:struct<bandas:{plain}>,num_tiendas:struct<bandas:{plain}>,"
        "madurez_digital:struct<valores:map<string,int>,por_tecnologia:map<string,int>>,"
        "encaje_avatar:struct<valores:map<string,int>>>,"
        "tramos_prioridad array<struct<id:string,min_puntos:int,etiqueta:string>>",
    )
    return row.asDict(recursive=True)


def load_avatars(spark: SparkSession, path: str) -> list[dict]:
    row = _read(
        spark,
        path,
        "avatares array<struct<id:int,nombre:string,criterios:struct<"
        "poblacion_municipio:array<double>,distancia_eci_km:array<double>,"
        "num_tiendas:array<double>,ecommerce_requerido:boolean>,encaje_parcial_si_cumple_n:int>>",
    )
    avatars = [a.asDict(recursive=True) for a in row["avatares"]]
    for a in avatars:  # a missing entry takes the rule's own default
        if a["encaje_parcial_si_cumple_n"] is None:
            del a["encaje_parcial_si_cumple_n"]
    return avatars


def load_pricing(spark: SparkSession, path: str) -> dict:
    paid = "struct<`from`:long,`to`:long,rate_per_1000:double>"
    row = _read(
        spark, path,
        f"text_search map<string,struct<free_per_month:long,first_paid_band:{paid}>>",
    )
    return row.asDict(recursive=True)


def read_towns(spark: SparkSession, path: str) -> DataFrame:
    """region, province, name, population, pos of a town file."""
    return towns_from_json(spark.read.text(path, wholetext=True), "value")


def towns_from_json(df: DataFrame, column: str) -> DataFrame:
    """Flat towns of documents in the town file's layout, ``pos`` in file order."""
    regions = df.select(
        F.explode(F.map_entries(F.from_json(column, model.TOWN_FILE))).alias("r")
    ).select(F.col("r.key").alias("region"), F.col("r.value.municipios").alias("towns"))
    listed = regions.withColumn("_region_pos", F.monotonically_increasing_id())
    return listed.select(
        "region", "_region_pos", F.posexplode("towns").alias("_pos", "t")
    ).select(
        "region",
        F.col("t.provincia").alias("province"),
        F.col("t.nombre").alias("name"),
        F.coalesce("t.poblacion", F.lit(0)).alias("population"),
        F.struct("_region_pos", "_pos").alias("pos"),
    )
