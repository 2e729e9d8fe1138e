"""Flow-statistics tables: cleaning, feature lists, union."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NUMERIC = {"tinyint", "smallint", "int", "bigint", "float", "double"}


def clean_stats(df: DataFrame, drop: tuple[str, ...] = ("Label", "Timestamp"), fill: float = -1) -> DataFrame:
    """Drop text columns; null, NaN and infinities in numeric columns become ``fill``."""
    def clean(name: str, kind: str):
        c = F.col(f"`{name}`")
        if kind not in NUMERIC:
            return c
        bad = c.isNull()
        if kind in ("float", "double"):
            bad = bad | F.isnan(c) | (F.abs(c) == float("inf"))
        return F.when(bad, F.lit(fill).cast(kind)).otherwise(c).alias(name)

    return df.select(*[clean(n, k) for n, k in df.dtypes if n not in drop])


def disable(df: DataFrame, names: list[str]) -> DataFrame:
    """All columns but the named ones, in order; an unknown name is an error."""
    unknown = [n for n in names if n not in df.columns]
    if unknown:
        raise ValueError(f"no such feature: {unknown}")
    return df.drop(*names)


def union_stats(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)
