"""Positions, lags and samples that stay exact and parallel when one group holds most of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowloom.session import broadcast_if_small, cut_lineage

HOT_ROWS = 1_000_000


def ranked(df: DataFrame, keys: list[str], order: list[str], name: str = "pos", hot_rows: int = HOT_ROWS) -> DataFrame:
    """Add the 0-based position inside each group. ``order`` must leave no ties.

    Groups of at most ``hot_rows`` rows are numbered by a window. Larger ones go through a range shuffle on
    (group, order), which splits them over many tasks, and per-task offsets. The size check is an aggregate
    over the key columns; give this operator a stored table rather than a long lineage.
    """
    sizes = df.groupBy(*keys).count().where(F.col("count") > hot_rows)
    hot = cut_lineage(sizes.select(*keys) if keys else sizes)
    if hot.isEmpty():
        return _window_positions(df, keys, order, name)
    if not keys:
        return range_positions(df, keys, order, name)
    hot = broadcast_if_small(hot)
    return _window_positions(df.join(hot, keys, "left_anti"), keys, order, name).unionByName(
        range_positions(df.join(hot, keys, "left_semi"), keys, order, name)
    )


def _window_positions(df: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    return df.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order)).cast("bigint") - 1)


def range_positions(df: DataFrame, keys: list[str], order: list[str], name: str = "pos") -> DataFrame:
    """Positions from one global range sort.

    The sorted rows are checkpointed before the offsets are counted: range bounds come from a sample, so
    both uses must read the same partitions.
    """
    by = keys + order
    rows = cut_lineage(
        df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_m", F.monotonically_increasing_id())
    ).withColumn("_pid", F.shiftright("_m", 33))
    runs = rows.groupBy(*keys, "_pid").agg(F.min("_m").alias("_m0"), F.count(F.lit(1)).alias("_n"))
    earlier = W.partitionBy(*keys).orderBy("_pid").rowsBetween(W.unboundedPreceding, -1)
    runs = runs.select(
        *keys, "_pid", (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_m0")).alias("_base")
    )
    return rows.join(runs, keys + ["_pid"]).withColumn(name, F.col("_m") + F.col("_base")).drop("_m", "_pid", "_base")


def lagged(df: DataFrame, keys: list[str], value: Column, name: str, pos: str = "pos", rows: int = HOT_ROWS) -> DataFrame:
    """Value of the row one position earlier. Windows cover ``rows`` positions; block edges come from a small join."""
    blocked = df.withColumns({"_blk": F.floor(F.col(pos) / rows), "_v": value})
    w = W.partitionBy(*keys, "_blk").orderBy(pos)
    edges = blocked.where(F.col(pos) % rows == rows - 1).select(
        *keys, (F.col("_blk") + 1).alias("_blk"), F.col("_v").alias("_edge")
    )
    out = blocked.withColumn(name, F.lag("_v").over(w)).join(edges, keys + ["_blk"], "left")
    return out.withColumn(name, F.coalesce(F.col(name), F.when(F.col(pos) % rows == 0, F.col("_edge")))).drop(
        "_blk", "_v", "_edge"
    )


def hash_order(df: DataFrame, id_col: str, seed: int, name: str = "_h") -> DataFrame:
    return df.withColumn(name, F.md5(F.concat(F.lit(f"{seed}|"), F.col(id_col).cast("string"))))


def first_by_hash(df: DataFrame, id_col: str, count: Column, seed: int, name: str = "_in", digits: int = 4, small: int = 100_000) -> DataFrame:
    """Flag exactly ``count`` rows, the first in md5(seed, id) order. ``count`` may use ``_total``, the row count.

    A radix select finds the last row that is in: a histogram over the next hash digits (at most 16**digits rows) names
    the bucket of the cut, and so on inside it until it holds at most ``small`` rows, which are put in order. The flag is
    then a comparison with that row, without a shuffle. Only rows of one and the same id, which all have one place, are
    numbered if the cut falls among them.
    """
    rows = hash_order(df, id_col, seed)
    keyed = rows.select("_h", F.col(id_col).alias("_id"))
    prefix, before, want = "", 0, None
    while True:
        inside = keyed.where(F.startswith("_h", F.lit(prefix))) if prefix else keyed
        hist = inside.groupBy(F.substring("_h", len(prefix) + 1, digits).alias("_b")).agg(F.count(F.lit(1)).alias("_n"))
        hist = hist.withColumn("_upto", F.sum("_n").over(W.orderBy("_b").rowsBetween(W.unboundedPreceding, 0)))
        hist = hist.withColumn("_total", F.sum("_n").over(W.partitionBy())).withColumn("_want", count.cast("bigint") if want is None else F.lit(want))
        need = F.col("_want") - before
        cut = hist.where((F.col("_upto") >= need) & (F.col("_upto") - F.col("_n") < need)).first()
        if cut is None:  # nothing or everything is in
            head = hist.first()
            return rows.withColumn(name, F.lit(head is not None and head["_want"] > 0)).drop("_h")
        want, before, prefix = cut["_want"], before + cut["_upto"] - cut["_n"], prefix + cut["_b"]
        if cut["_n"] <= small or len(prefix) >= 32:
            break
    last = keyed.where(F.startswith("_h", F.lit(prefix)))
    if cut["_n"] > small:  # one hash: rows of one id
        edge = last.first()
    else:
        edge = last.orderBy("_h", "_id").limit(want - before).agg(F.max(F.struct("_h", "_id")).alias("e")).first()["e"]
    kind = df.schema[id_col].dataType
    place, edge_place = F.struct("_h", F.col(id_col)), F.struct(F.lit(edge["_h"]), F.lit(edge["_id"]).cast(kind))
    seen = last.agg(F.count_if(F.struct("_h", "_id") < edge_place).alias("less"), F.count_if(F.struct("_h", "_id") == edge_place).alias("same")).first()
    spare = want - before - seen["less"]
    if spare >= seen["same"]:
        return rows.withColumn(name, place <= edge_place).drop("_h")
    ties = rows.where(place == edge_place).withColumn(name, F.row_number().over(W.orderBy("_h")) <= spare)
    return rows.where(~(place == edge_place)).withColumn(name, place < edge_place).unionByName(ties).drop("_h")
