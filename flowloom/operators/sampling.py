"""Exact samples, splits and triplets, reproducible from a seed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.operators.ranking import HOT_ROWS, first_by_hash, hash_order, ranked


def exact_sample(df: DataFrame, id_col: str, n: int, seed: int = 42) -> DataFrame:
    """Exactly min(n, rows) rows without replacement."""
    return first_by_hash(df, id_col, F.lit(n), seed).where("_in").drop("_in")


def train_test_split(
    df: DataFrame, id_col: str, train: float = 0.7, seed: int = 42, exact: bool = True
) -> tuple[DataFrame, DataFrame]:
    """Train and test rows. Exact: floor(train * rows) train rows; otherwise a hash-threshold split, one narrow pass."""
    if exact:
        flagged = first_by_hash(df, id_col, F.floor(F.col("_total") * F.lit(train)), seed)
    else:
        share = F.conv(F.substring("_h", 1, 8), 16, 10).cast("double") / F.lit(float(16**8))
        flagged = hash_order(df, id_col, seed).withColumn("_in", share < train).drop("_h")
    return flagged.where("_in").drop("_in"), flagged.where(~F.col("_in")).drop("_in")


def server_groups(df: DataFrame, group_cols: list[str], more_than: int = 2, malicious: bool = False) -> DataFrame:
    """Rows of groups with more than ``more_than`` rows, optionally only groups with a malicious one (``y = 1``)."""
    tests = [F.count(F.lit(1)).alias("_n")] + ([F.max("y").alias("_y")] if malicious else [])
    kept = df.groupBy(*group_cols).agg(*tests).where(F.col("_n") > more_than)
    if malicious:
        kept = kept.where(F.col("_y") == 1)
    return df.join(kept.select(*group_cols), group_cols, "left_semi")


def sample_triplets(
    df: DataFrame, group_cols: list[str], id_col: str, seed: int = 42, min_group: int = 1, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """One (anchor, s1, s2) per row, partners drawn from the anchor's group.

    A group is put in md5 order and closed to a ring; partners are the next two on it: (x, x, x) for one row,
    (a, b, b) for two, three distinct rows otherwise. Every row then serves three anchors, so the partners are
    found by one shuffle on (group, position), which is even however large a group is.
    """
    slim = df.select(*group_cols, F.col(id_col).alias("_id"))
    pos = ranked(hash_order(slim, "_id", seed), group_cols, ["_h", "_id"], hot_rows=hot_rows).drop("_h")
    sizes = slim.groupBy(*group_cols).agg(F.count(F.lit(1)).alias("_n"))
    if min_group > 1:
        sizes = sizes.where(F.col("_n") >= min_group)
    p, n = F.col("pos"), F.col("_n")
    second = F.when(n == 2, 1).otherwise(2)
    roles = F.array(
        F.struct(p.alias("at"), F.lit(0).alias("role")),
        F.struct(F.pmod(p - 1, n).alias("at"), F.lit(1).alias("role")),
        F.struct(F.pmod(p - second, n).alias("at"), F.lit(2).alias("role")),
    )
    served = pos.join(sizes, group_cols).select(*group_cols, "_id", F.inline(roles))
    pick = lambda r: F.max(F.when(F.col("role") == r, F.col("_id")))
    return served.groupBy(*group_cols, "at").agg(
        pick(0).alias("anchor_id"), pick(1).alias("s1_id"), pick(2).alias("s2_id")
    ).drop("at")


def gather_triplets(triplets: DataFrame, features: DataFrame, id_col: str, value_col: str) -> DataFrame:
    """Attach the three feature vectors by three equi-joins on the row id, which is unique and so free of skew."""
    out = triplets
    for role, name in (("anchor_id", "anchor"), ("s1_id", "s1"), ("s2_id", "s2")):
        out = out.join(features.select(F.col(id_col).alias(role), F.col(value_col).alias(name)), role)
    return out


def group_offsets(df: DataFrame, group_cols: list[str], order: list[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Global row index (groups laid end to end in key order), group offset and index inside the group."""
    numbered = ranked(df, [], group_cols + order, name="global_idx", hot_rows=hot_rows)
    starts = numbered.groupBy(*group_cols).agg(F.min("global_idx").alias("group_offset"))
    return numbered.join(starts, group_cols).withColumn("intra_idx", F.col("global_idx") - F.col("group_offset"))
