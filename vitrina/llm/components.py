"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from vitrina.llm.common import discard, keep


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """One row per linked node: node, component (the smallest node reachable).

    Large-star and small-star steps in turn: every step hangs nodes on the least node
    they know, until only stars around the least nodes are left, in about log n steps.
    Least neighbours are aggregated map-side and kept, so that the join with a node of
    very many links is a plain one that Spark can split.
    """
    def strict(df: DataFrame) -> DataFrame:
        return df.where("u != v").select(
            F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
        ).distinct()

    edges = keep(strict(links.select(F.col(a).alias("u"), F.col(b).alias("v"))), "links")
    while not _only_stars(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = keep(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = keep(
            strict(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))),
            "links",
        )
        down = keep(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(down, "u")
        after = keep(
            strict(small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
                small.select("u", F.col("m").alias("v"))
            )),
            "links",
        )
        discard(edges, least, large, down)
        edges = after
    # Stars: every node but the centres occurs once on the left.
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def _only_stars(edges: DataFrame) -> bool:
    """Whether no node has two lesser neighbours, or both a lesser and a greater one."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionByName(
        edges.select(F.col("v").alias("node"), F.lit(0).alias("down"), F.lit(1).alias("up"))
    )
    mixed = ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
    return mixed.where("down + up > 1 and down > 0").isEmpty()
