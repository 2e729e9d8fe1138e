"""Packets exported as text fields: length, addresses, TCP ports, UDP ports; quoted, no header."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.schemas import TCP, UDP

FIELDS = "size int, src_ip string, dst_ip string, tcp_src int, tcp_dst int, udp_src int, udp_dst int"


def read_packet_csv(spark: SparkSession, path: str) -> DataFrame:
    """src_file, size, addresses, ports (TCP's, else UDP's) and the protocol that had them."""
    raw = (
        spark.read.schema(FIELDS).option("quote", '"').option("recursiveFileLookup", "true").csv(path)
        .select("*", F.col("_metadata.file_path").alias("src_file"))
    )
    return raw.select(
        "src_file", "size", "src_ip", "dst_ip",
        F.coalesce("tcp_src", "udp_src").alias("src_port"),
        F.coalesce("tcp_dst", "udp_dst").alias("dst_port"),
        F.when(F.col("tcp_src").isNotNull(), TCP).when(F.col("udp_src").isNotNull(), UDP).cast("smallint").alias("proto"),
    )
