"""Packet-level operators: protocol filter, per-file limit, canonical two-way key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.functions.net import ip_number
from flowloom.schemas import TCP, UDP


def only_tcp_udp(packets: DataFrame) -> DataFrame:
    """Keep TCP and UDP; UDP carries no teardown flags."""
    return packets.where(F.col("proto").isin(TCP, UDP)).withColumn(
        "flags", F.when(F.col("proto") == UDP, F.lit(0)).otherwise(F.col("flags")).cast("int")
    )


def first_packets(packets: DataFrame, n: int) -> DataFrame:
    """The first ``n`` captured packets of every file. ``pkt_idx`` counts undecodable packets too."""
    return packets.where(F.col("pkt_idx") < n)


def canonical_key(packets: DataFrame, ip_order: str = "numeric") -> DataFrame:
    """Add srcip, dstip, srcport, dstport (smaller endpoint first) and dir (+1 as captured, -1 swapped).

    ``ip_order`` compares addresses as 32-bit numbers or as text.
    """
    if ip_order == "numeric":
        src, dst = ip_number(F.col("src_ip")), ip_number(F.col("dst_ip"))
    elif ip_order == "text":
        src, dst = F.col("src_ip"), F.col("dst_ip")
    else:
        raise ValueError("ip_order is 'numeric' or 'text'")
    forward = F.struct(src.alias("ip"), F.col("src_port").alias("port")) <= F.struct(
        dst.alias("ip"), F.col("dst_port").alias("port")
    )
    keyed = packets.withColumn("_fwd", forward)
    fwd = F.col("_fwd")
    return keyed.withColumns(
        {
            "srcip": F.when(fwd, F.col("src_ip")).otherwise(F.col("dst_ip")),
            "dstip": F.when(fwd, F.col("dst_ip")).otherwise(F.col("src_ip")),
            "srcport": F.when(fwd, F.col("src_port")).otherwise(F.col("dst_port")),
            "dstport": F.when(fwd, F.col("dst_port")).otherwise(F.col("src_port")),
            "dir": F.when(fwd, F.lit(1)).otherwise(F.lit(-1)).cast("tinyint"),
        }
    ).drop("_fwd")
