"""Size sequences with labels: ``X.data`` holds one sequence per line, ``X.label`` one character per line of it."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowloom.session import spread
from flowloom.sources.files import list_files, open_file

LABEL_RANGE = 1 << 20


def _place(path: Column) -> list[Column]:
    """Folder and stem of a file: its partner stands in the same folder."""
    plain = F.regexp_replace(path, r"^file:/+", "/")
    return [F.regexp_extract(plain, r"^(.*/)[^/]*$", 1).alias("folder"), F.regexp_extract(plain, r"([^/.]+)\.[^/]*$", 1).alias("stem")]


def _numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(folder, stem, line_no, value). Lines are counted inside each file split, then splits are laid end to end."""
    lines = spark.read.option("pathGlobFilter", "*.data").option("recursiveFileLookup", "true").text(path).select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("split_at"),
        F.monotonically_increasing_id().alias("_m"),
    )
    earlier = W.partitionBy("file").orderBy("split_at").rowsBetween(W.unboundedPreceding, -1)
    bases = lines.groupBy("file", "split_at").agg(F.count(F.lit(1)).alias("_n")).select(
        "file", "split_at", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base")
    )
    inside = F.row_number().over(W.partitionBy("file", "split_at").orderBy("_m")) - 1
    return lines.withColumn("_i", inside).join(bases, ["file", "split_at"]).select(
        *_place(F.col("file")), (F.col("_i") + F.col("_base")).alias("line_no"), "value"
    )


def _label_characters(spark: SparkSession, path: str) -> DataFrame:
    """(folder, stem, line_no, label) from byte ranges of the stripped label text."""
    files = list_files(spark, path, "*.label")
    starts = F.sequence(F.lit(0).cast("bigint"), F.col("length"), F.lit(LABEL_RANGE).cast("bigint"))
    ranges = spread(files.select("path", F.explode(starts).alias("start")), "path", "start")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples():
                with open_file(r.path) as f:
                    lead = 0
                    while head := f.read(1 << 12):
                        lead += len(head) - len(head.lstrip())
                        if head.strip():
                            break
                    f.seek(lead + r.start)
                    text = f.read(LABEL_RANGE).decode("latin-1")
                yield pd.DataFrame({"path": r.path, "line_no": range(r.start, r.start + len(text)), "label": list(text)})

    out = ranges.mapInPandas(read, "path string, line_no bigint, label string")
    return out.select(*_place(F.col("path")), "line_no", F.col("label").try_cast("int").alias("label"))


def read_sequences(spark: SparkSession, data_dir: str, min_items: int = 4) -> DataFrame:
    """folder, stem, line_no, items, label of every line with at least ``min_items`` numbers, over all files of a folder.

    Labels are a byte each in their files and a row each once read: by the files' size Spark would broadcast them, so the join is told not to.
    """
    items = F.split(F.trim("value"), " ")
    lines = _numbered_lines(spark, data_dir).where(F.size(items) >= min_items).select(
        "folder", "stem", "line_no", F.transform(items, lambda x: x.try_cast("int")).alias("items")
    )
    return lines.join(_label_characters(spark, data_dir).hint("merge"), ["folder", "stem", "line_no"])
