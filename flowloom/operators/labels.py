"""Attack-window labels, binary targets, label numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.functions.net import clock_on_day, local_time
from flowloom.operators.ranking import ranked
from flowloom.schemas import BENIGN, LOCAL_HOURS
from flowloom.session import broadcast_if_small, cut_lineage


def window_lists(windows: DataFrame) -> DataFrame:
    """Per day and directed address pair, the attack windows in order, as one array."""
    pairs = windows.select(
        "day", "ord", "label",
        clock_on_day(F.col("day"), F.col("start")).alias("w_start"),
        clock_on_day(F.col("day"), F.col("end")).alias("w_end"),
        F.explode("att").alias("a"), "vic",
    ).withColumn("v", F.explode("vic"))
    both = F.array(
        F.struct(F.col("a").alias("srcip"), F.col("v").alias("dstip")),
        F.struct(F.col("v").alias("srcip"), F.col("a").alias("dstip")),
    )
    directed = pairs.select("day", "ord", "label", "w_start", "w_end", F.inline(both)).distinct()
    return directed.groupBy("day", "srcip", "dstip").agg(
        F.sort_array(F.collect_list(F.struct("ord", "w_start", "w_end", "label"))).alias("_windows")
    )


def label_flows(
    flows: DataFrame, windows: DataFrame, default: str = BENIGN, offset_hours: int = LOCAL_HOURS, strict: bool = False
) -> DataFrame:
    """Label each flow by the last attack window that has its endpoints and contains it whole.

    The windows are a small rule table: their pairs are counted and broadcast, and the flows are not
    shuffled. Works on batch and streaming flows. ``strict`` fails on a day without windows.
    """
    lists = broadcast_if_small(window_lists(windows))
    timed = flows.withColumns(
        {
            "local_start": local_time(F.col("pktts_start"), offset_hours),
            "local_end": local_time(F.col("pktts_end"), offset_hours),
        }
    )
    joined = timed.join(lists, ["day", "srcip", "dstip"], "left")
    start, end = F.col("local_start"), F.col("local_end")
    hits = F.filter("_windows", lambda w: (start >= w["w_start"]) & (end <= w["w_end"]))
    out = joined.withColumn("label", F.coalesce(F.try_element_at(hits, F.lit(-1))["label"], F.lit(default)))
    if strict:
        days = broadcast_if_small(windows.select("day", F.lit(True).alias("_known")).distinct())
        out = out.join(days, "day", "left").withColumn(
            "label", F.when(F.col("_known"), F.col("label")).otherwise(F.raise_error(F.concat(F.lit("no windows for "), "day")))
        ).drop("_known")
    return out.drop("_windows")


def binary_target(df: DataFrame, benign: str = BENIGN) -> DataFrame:
    return df.withColumn("y", (F.col("label") != benign).cast("int"))


def encode_labels(df: DataFrame, col: str) -> tuple[DataFrame, DataFrame]:
    """Number the sorted distinct labels from 0; returns the table with ``label_num`` and the mapping. A null label keeps its row, with a null number.

    The distinct labels are stored, so that numbering and counting them does not read the table again, and broadcast if
    they are few: a shuffle by label would bring most of the table to a few tasks.
    """
    labels = cut_lineage(df.select(col).where(F.col(col).isNotNull()).distinct())
    mapping = ranked(labels, [], [col], name="label_num")
    return df.join(broadcast_if_small(mapping), col, "left"), mapping
