"""Packet, sequence and vector views over the given tables, and the stored stages built from them."""

from __future__ import annotations

from datetime import datetime

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.operators.cluster import cluster_by_group
from flowloom.operators.embed import Weights, score_then_cluster
from flowloom.operators.features import build_features
from flowloom.operators.flows import assemble_flows
from flowloom.operators.labels import binary_target, label_flows
from flowloom.schemas import ATTACK_WINDOW_ROWS, LOCAL_HOURS, attack_windows
from flowloom.session import scratch_path
from flowloom.sources.store import materialise, with_day

DAY = "Thursday-15-02-2018"
SRC_FILE = f"{DAY}/pcap/events.pcap"
GRAPH_SIZE = 500

# Attack windows that fit the packets view: the second overlaps the first.
WINDOW_ROWS = [
    (DAY, 1, ["18.219.0.0", "18.219.0.10", "18.219.0.20", "18.219.0.50", "18.219.0.100"],
     ["172.31.70.0", "172.31.70.10", "172.31.70.20"], "9:26", "10:09", "burst"),
    (DAY, 2, ["18.219.0.0"], ["172.31.70.0"], "9:37", "9:38", "burst-late"),
    (DAY, 3, ["18.219.0.1"], ["172.31.70.1"], "9:06", "9:30", "slow"),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One packet per event: users are clients, every tenth sends all its traffic in a burst."""
    e = table(spark, sf_dir, "events").selectExpr(
        "event_id AS pkt_idx",
        "CAST(timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', CAST(ts AS timestamp_ntz)) AS DOUBLE)"
        " / (CASE WHEN user_id % 10 = 0 THEN 24000e6D ELSE 240e6D END)"
        " + (CASE WHEN user_id % 10 = 0 THEN 1800D ELSE 0D END) + 1518700000D AS ts",
        "concat('18.219.', user_id div 250, '.', user_id % 250) AS cip",
        "CAST(40000 + user_id % 20000 AS INT) AS cport",
        "CASE WHEN user_id % 10 < 3 THEN concat('172.31.', 70 + user_id div 150, '.', user_id % 50)"
        " ELSE concat('172.31.69.', user_id % 3) END AS sip",
        "element_at(array(80, 443, 21, 22, 53), CAST(user_id % 5 AS INT) + 1) AS sport",
        "CAST(60 + floor(value * 3) AS INT) AS size",
        "event_type",
        "event_id % 2 AS rev",
    )
    return e.selectExpr(
        f"'{SRC_FILE}' AS src_file",
        "pkt_idx",
        "ts",
        "if(rev = 0, cip, sip) AS src_ip",
        "if(rev = 0, sip, cip) AS dst_ip",
        "if(rev = 0, cport, sport) AS src_port",
        "if(rev = 0, sport, cport) AS dst_port",
        "CAST(if(sport = 53, 17, 6) AS SMALLINT) AS proto",
        "CASE WHEN sport = 53 THEN 0 WHEN event_type = 'signup' THEN 2 WHEN event_type = 'error' THEN 4"
        " WHEN event_type = 'purchase' THEN 17 WHEN event_type = 'click' THEN 16 ELSE 24 END AS flags",
        "size",
    )


# Capture files of the packets by thirds: two of one day, one of the next.
DAY_FILES = [f"{DAY}/pcap/one.pcap", f"{DAY}/pcap/two.pcap", "Friday-16-02-2018/pcap/one.pcap"]


def packets_of_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packets view dealt to three capture files on two days."""
    p = packets(spark, sf_dir)
    third = F.floor(F.col("pkt_idx") * len(DAY_FILES) / p.count()).cast("int")
    return p.withColumn("src_file", F.array(*map(F.lit, DAY_FILES))[third])


def window_starts() -> list[tuple[int, str, list[str], list[str], int]]:
    """(number, day, attackers, victims, start as epoch seconds) of the real attack windows."""
    out = []
    for n, (day, _, att, vic, start, _, _) in enumerate(ATTACK_WINDOW_ROWS):
        at = datetime.strptime(f"{day.split('-', 1)[1]} {start} +0000", "%d-%m-%Y %H:%M %z")
        out.append((n, day, att, vic, int(at.timestamp()) - LOCAL_HOURS * 3600))
    return out


def day_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One flow per event, on the days of all attack windows: around a window, between its attackers and victims."""
    w = F.broadcast(spark.createDataFrame(window_starts(), "n bigint, day string, att array<string>, vic array<string>, at bigint"))
    e = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % len(ATTACK_WINDOW_ROWS)).alias("n")).join(w, "n")
    one = "element_at({0}, CAST(event_id div 22 % size({0}) AS INT) + 1)"
    start = F.expr("CAST(at - 600 + event_id * 37 % 7200 AS DOUBLE)")
    return e.select(
        F.concat(F.lit("e"), "event_id").alias("flow_id"), "day", F.expr(f"if(event_id % 2 = 0, {one.format('att')}, {one.format('vic')})").alias("srcip"),
        F.expr(f"if(event_id % 2 = 0, {one.format('vic')}, {one.format('att')})").alias("dstip"), start.alias("pktts_start"),
        (start + F.col("event_id") % 300).alias("pktts_end"),
    )


def stage(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A stored stage of the flow job, written once per session and data set."""
    path = scratch_path(spark, f"{sf_dir.strip('/').replace('/', '_')}/{name}")
    built = _STAGES.get((path,))
    if built is None:
        built = _STAGES[(path,)] = materialise(_BUILD[name](spark, sf_dir), path)
    return built


def _flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_day(assemble_flows(packets(spark, sf_dir)))


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    windows = attack_windows(spark, WINDOW_ROWS)
    return binary_target(label_flows(stage(spark, sf_dir, "flows"), windows))


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build_features(_labelled(spark, sf_dir))  # the labels are one broadcast join: storing them first costs more


def _clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = stage(spark, sf_dir, "features")
    c = cluster_by_group(f, ["server_ip", "server_port"], "flow_id", "f_signed", ["src_file", "emit_at"])
    return c.drop("f_size", "f_dir", "f_signed", "eff_len")  # no later step reads them


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_then_cluster(stage(spark, sf_dir, "features"), mlp_weights())


def mlp_weights() -> Weights:
    """Fixed weights w = (((31 layer + 17 out + 7 in) mod 11) - 5) / 20 for the shape 32-16-8-16-32, no biases."""
    out = []
    for layer, (n_out, n_in) in enumerate([(16, 32), (8, 16), (16, 8), (32, 16)]):
        o, i = np.meshgrid(np.arange(n_out), np.arange(n_in), indexing="ij")
        out.append(((((layer * 31 + o * 17 + i * 7) % 11) - 5) / 20, np.zeros(n_out)))
    return out


def _sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order's line items as a packet sequence: quantity is the size, ship date the time."""
    li = table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey AS seq_id", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
        "CAST(l_shipdate AS DATE) AS l_shipdate", "l_returnflag",
    )
    item = F.struct(
        "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate",
        F.expr("CAST(if(l_returnflag = 'A', 1, -1) AS TINYINT)").alias("dir"),
    )
    got = li.groupBy("seq_id").agg(F.sort_array(F.collect_list(item)).alias("_i"))
    return got.select(
        "seq_id",
        F.transform("_i", lambda x: x["l_quantity"].cast("int")).alias("sizes"),
        F.transform("_i", lambda x: (F.unix_date(x["l_shipdate"]) * 86400).cast("double")).alias("times"),
        F.transform("_i", lambda x: x["dir"]).alias("dirs"),
    )


_STAGES: dict[tuple, DataFrame] = {}
_BUILD = {
    "flows": _flows, "labelled": _labelled, "features": _features, "clusters": _clusters, "scored": _scored, "sequences": _sequences,
}
