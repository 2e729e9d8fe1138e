"""What the operators on embeddings share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def finite_vectors(df: DataFrame, vec: str) -> DataFrame:
    """Rows whose vector is there, without null or non-finite entries; null arrays are out."""
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return df.where(F.col(vec).isNotNull() & ~F.coalesce(bad, F.lit(False)))
