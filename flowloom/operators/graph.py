"""Flow graphs: windows of consecutive flows, addresses as nodes, flows as edges."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowloom.operators.ranking import HOT_ROWS, ranked
from flowloom.session import spread

ORDER = ["src_file", "emit_at"]


def graph_windows(flows: DataFrame, graph_size: int = 10_000, hot_rows: int = HOT_ROWS) -> DataFrame:
    """graph_id: consecutive flows in emission order, ``graph_size`` to a graph; the last may be short."""
    numbered = ranked(flows, [], ORDER, name="seq", hot_rows=hot_rows)
    return numbered.withColumn("graph_id", F.floor(F.col("seq") / graph_size))


def flow_graph(windowed: DataFrame, feat: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of flows with a graph_id. Nodes count from 0 by first appearance, source before destination.

    All windows and joins are inside one graph, which holds at most ``graph_size`` flows.
    """
    ends = windowed.select(
        "graph_id",
        F.inline(F.array(
            F.struct(F.col("srcip").alias("ip"), (F.col("seq") * 2).alias("at")),
            F.struct(F.col("dstip").alias("ip"), (F.col("seq") * 2 + 1).alias("at")),
        )),
    )
    first = ends.groupBy("graph_id", "ip").agg(F.min("at").alias("at"))
    number = F.row_number().over(W.partitionBy("graph_id").orderBy("at")).cast("bigint") - 1
    nodes = first.withColumn("node_id", number).select("graph_id", "node_id", "ip")
    edges = windowed.select("graph_id", "flow_id", "srcip", "dstip", F.col(feat).alias("feat"))
    for end, name in (("srcip", "src_node"), ("dstip", "dst_node")):
        edges = edges.join(nodes.select("graph_id", F.col("ip").alias(end), F.col("node_id").alias(name)), ["graph_id", end])
    return nodes, edges.select("graph_id", "flow_id", "src_node", "dst_node", "feat")


def edge_context(edges: DataFrame, width: int, hops: int = 2) -> DataFrame:
    """Edge vectors [source state, destination state, edge], L2-normalised.

    A node's first state is the mean of its edges' vectors; every further hop is the mean, over its edges, of
    the state at the other end. A graph has a bounded number of edges, so it is dealt to one task whole, once, and all
    hops are sums over arrays there.
    """

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        feat = np.vstack(pdf["feat"].to_numpy()).astype(np.float64)[:, :width]
        _, ends = np.unique(np.concatenate([pdf["src_node"], pdf["dst_node"]]), return_inverse=True)
        src, dst = ends[: len(pdf)], ends[len(pdf) :]
        degree = np.bincount(ends)[:, None]

        def means(at_src: np.ndarray, at_dst: np.ndarray) -> np.ndarray:
            both = np.concatenate([at_src, at_dst])
            return np.stack([np.bincount(ends, both[:, i], len(degree)) for i in range(width)], 1) / degree

        state = means(feat, feat)
        for _ in range(hops - 1):
            state = means(state[dst], state[src])
        joined = np.concatenate([state[src], state[dst], feat], axis=1)
        size = np.maximum(np.sqrt((joined**2).sum(1, keepdims=True)), 1e-8)
        return pdf.assign(context=list(joined / size))

    schema = T.StructType([*edges.schema.fields, T.StructField("context", T.ArrayType(T.DoubleType()))])
    return spread(edges, "graph_id").groupBy("graph_id").applyInPandas(one, schema)
