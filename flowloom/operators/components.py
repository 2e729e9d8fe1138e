"""Connected components by alternating large-star and small-star rounds (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.session import cut_lineage


def connected_components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, root) for every node with an edge; root is the smallest node of its component.

    Rounds move edges towards the smallest neighbour, with map-side minima, so a node with very many edges
    is never gathered in one place. Every round is checkpointed; rounds grow with the logarithm of the
    component size.
    """
    a, b = F.col(u), F.col(v)
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u != v").distinct()
    e = cut_lineage(e)
    while not _is_stars(e):
        e = cut_lineage(_small_star(_large_star(e)))
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )


def _is_stars(e: DataFrame) -> bool:
    """Whether every node either points to exactly one root or is a root."""
    roles = e.select(F.col("u").alias("n"), F.lit(1).alias("out"), F.lit(0).alias("into")).unionByName(
        e.select(F.col("v").alias("n"), F.lit(0).alias("out"), F.lit(1).alias("into"))
    )
    per = roles.groupBy("n").agg(F.sum("out").alias("o"), F.sum("into").alias("i"))
    return per.where((F.col("o") > 1) | ((F.col("o") > 0) & (F.col("i") > 0))).isEmpty()


def _large_star(e: DataFrame) -> DataFrame:
    both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()


def _small_star(e: DataFrame) -> DataFrame:
    low = e.groupBy("u").agg(F.min("v").alias("m"))
    moved = e.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(low.select("u", F.col("m").alias("v"))).where("u != v").distinct()
