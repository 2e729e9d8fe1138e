"""Flow embeddings: raw channels, network scoring, fitted linear embeddings."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.functions.arrays import l2_normalise
from flowloom.operators.cluster import cluster_by_group

Weights = list[tuple[np.ndarray, np.ndarray]]


def _apply(df: DataFrame, col: str, out: str, step) -> DataFrame:
    """Add ``out``: a matrix function of ``col``, one Arrow batch at a time."""

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series(list(step(np.vstack(s.to_numpy()).astype(np.float64)))) if len(s) else s

    return df.withColumn(out, run(F.col(col)))


def mlp_score(df: DataFrame, col: str, weights: Weights, out: str = "score") -> DataFrame:
    """Feed-forward ReLU network; no activation after the last layer. The weights are a few thousand numbers."""

    def forward(x: np.ndarray) -> np.ndarray:
        for i, (w, b) in enumerate(weights):
            x = x @ w.T + b
            if i < len(weights) - 1:
                x = np.maximum(x, 0.0)
        return x

    return _apply(df, col, out, forward)


@dataclass
class LinearEmbedding:
    """Projection on the leading principal axes, and back."""

    mean: np.ndarray
    axes: np.ndarray

    def encode(self, df: DataFrame, col: str, out: str = "latent") -> DataFrame:
        mean, axes = self.mean, self.axes
        return _apply(df, col, out, lambda x: (x - mean) @ axes)

    def reconstruct(self, df: DataFrame, col: str, out: str = "rebuilt") -> DataFrame:
        mean, axes = self.mean, self.axes
        return _apply(df, col, out, lambda x: (x - mean) @ axes @ axes.T + mean)


def fit_linear_embedding(df: DataFrame, col: str, k: int = 8) -> LinearEmbedding:
    """Fit by Spark's distributed PCA. Only the mean and the (width x k) axes come to the driver.

    The sign of an axis is free; it is set so that its largest loading is positive.
    """
    width = df.select(F.size(col)).first()[0]
    mean = np.array(df.agg(*[F.avg(F.col(col)[i].cast("double")) for i in range(width)]).first(), dtype=float)
    axes = PCA(k=k, inputCol="_v", outputCol="_p").fit(df.select(array_to_vector(F.col(col)).alias("_v"))).pc.toArray()
    lead = np.abs(axes).argmax(axis=0)
    return LinearEmbedding(mean, axes * np.where(axes[lead, np.arange(k)] < 0, -1.0, 1.0))


def pca_project(df: DataFrame, col: str, k: int = 2, out: str = "pca") -> DataFrame:
    """Centred projection on the first ``k`` principal axes."""
    return fit_linear_embedding(df, col, k).encode(df, col, out)


def embed_flows(df: DataFrame, method: str = "raw", col: str = "f_signed", weights: Weights | None = None, k: int = 8) -> DataFrame:
    """(flow_id, vec) by ``raw``, ``unit`` (L2-normalised), ``mlp`` or ``linear``."""
    rows = df.select("flow_id", col)
    if method == "raw":
        return rows.select("flow_id", F.col(col).cast("array<double>").alias("vec"))
    if method == "unit":
        return rows.select("flow_id", l2_normalise(F.col(col)).alias("vec"))
    if method == "mlp":
        return mlp_score(rows, col, weights, "vec").select("flow_id", "vec")
    if method == "linear":
        return fit_linear_embedding(rows, col, k).encode(rows, col, "vec").select("flow_id", "vec")
    raise ValueError(f"unknown method {method}")


def score_then_cluster(
    features: DataFrame, weights: Weights, group_cols: tuple[str, ...] = ("server_ip", "server_port"), col: str = "f_signed",
    order_cols: tuple[str, ...] = ("src_file", "emit_at"), eps: float = 0.1, min_samples: int = 2,
) -> DataFrame:
    """Feature rows with the network's reconstruction ``f_scored`` (float32) and the ``cluster_id`` that it gets inside its group."""
    scored = mlp_score(features, col, weights, "f_scored").withColumn("f_scored", F.col("f_scored").cast("array<float>"))
    return cluster_by_group(scored, list(group_cols), "flow_id", "f_scored", list(order_cols), eps, min_samples)
