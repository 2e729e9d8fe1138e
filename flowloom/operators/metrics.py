"""Classification metrics as aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def binary_metrics(df: DataFrame, y: str = "y", p: str = "pred") -> DataFrame:
    """Accuracy, precision, recall, F1 of class 1; 0 on an empty denominator."""
    yes = lambda c: F.sum(F.when(c, 1).otherwise(0))
    counts = df.agg(
        F.count(F.lit(1)).alias("n"),
        yes(F.col(y) == F.col(p)).alias("hit"),
        yes((F.col(y) == 1) & (F.col(p) == 1)).alias("tp"),
        yes(F.col(p) == 1).alias("pp"),
        yes(F.col(y) == 1).alias("ap"),
    )
    tp, pp, ap = F.col("tp"), F.col("pp"), F.col("ap")
    return counts.select(
        _ratio(F.col("hit"), F.col("n")).alias("accuracy"),
        _ratio(tp, pp).alias("precision"),
        _ratio(tp, ap).alias("recall"),
        _ratio(2 * tp, pp + ap).alias("f1"),
    )


def macro_metrics(df: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """Accuracy and class-averaged precision, recall, F1 over every class in truth or prediction."""
    confusion = df.groupBy(F.col(y).alias("y"), F.col(p).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    hit = F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0)
    sides = confusion.select(
        F.inline(
            F.array(
                F.struct(F.col("y").alias("cls"), F.col("n").alias("ap"), F.lit(0).cast("bigint").alias("pp"), hit.alias("tp")),
                F.struct(F.col("p").alias("cls"), F.lit(0).cast("bigint").alias("ap"), F.col("n").alias("pp"), F.lit(0).cast("bigint").alias("tp")),
            )
        )
    )
    per = sides.groupBy("cls").agg(F.sum("ap").alias("ap"), F.sum("pp").alias("pp"), F.sum("tp").alias("tp"))
    tp, pp, ap = F.col("tp"), F.col("pp"), F.col("ap")
    return per.agg(
        _ratio(F.sum("tp"), F.sum("ap")).alias("accuracy"),
        F.avg(_ratio(tp, pp)).alias("precision"),
        F.avg(_ratio(tp, ap)).alias("recall"),
        F.avg(_ratio(2 * tp, pp + ap)).alias("f1"),
    )
