"""Pair and triplet similarity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.functions import similarity as S


def flow_similarity(pairs: DataFrame, a: str = "a", b: str = "b", temperature: float = 0.1, prefix: str = "") -> DataFrame:
    """Add sim_cosine, sim_jaro_winkler, sim_wasserstein and similarity (their fusion) for two array columns.

    Only Jaro-Winkler leaves the JVM, in Arrow batches of the two trimmed arrays.
    """
    cos, jw, ws = f"{prefix}sim_cosine", f"{prefix}sim_jaro_winkler", f"{prefix}sim_wasserstein"
    trimmed = pairs.withColumn("_z", S.drop_joint_padding(F.col(a), F.col(b)))
    trimmed = trimmed.withColumns({"_x": F.col("_z.x"), "_y": F.col("_z.y")}).drop("_z")
    scored = trimmed.withColumns(
        {
            jw: S.jaro_winkler(F.col("_x"), F.col("_y")),
            cos: S.cosine(F.col("_x"), F.col("_y")),
            ws: S.wasserstein_sim(F.col("_x"), F.col("_y")),
        }
    ).drop("_x", "_y")
    return scored.withColumn(f"{prefix}similarity", S.fused(F.array(cos, jw, ws), temperature))


def triplet_similarity(triplets: DataFrame, delta: float = 0.75, temperature: float = 0.1) -> DataFrame:
    """Add p1 and p2: whether (anchor, s1) and (anchor, s2) are more similar than ``delta``."""
    one = flow_similarity(triplets, "anchor", "s1", temperature, "s1_")
    two = flow_similarity(one, "anchor", "s2", temperature, "s2_")
    return two.withColumns({"p1": F.col("s1_similarity") > delta, "p2": F.col("s2_similarity") > delta})
