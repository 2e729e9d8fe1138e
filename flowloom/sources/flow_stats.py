"""Flow-statistics files: 80 named columns in two header dialects."""

from __future__ import annotations

import csv
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.functions.arrays import bind
from flowloom.schemas import STATS_FIELDS
from flowloom.session import broadcast_if_small, cut_lineage, spread
from flowloom.sources.files import list_files, open_text

#: Longest header line that is looked for.
HEADER_BYTES = 1 << 16


def read_flow_stats(spark: SparkSession, paths: str | list[str], dialect: str = "A") -> DataFrame:
    """The 80 fields, typed, under their dialect A names, from one path or the union of several.

    Every file is read by its own header, so the files of a folder may differ in order and extra columns. Header
    lines repeated inside a file and lines with too many fields for their file are dropped; short lines are filled
    with nulls. An empty file has no rows. Files may be compressed. The driver learns the distinct headers, not the files.
    """
    column = {"A": 0, "B": 1}[dialect]
    tables = [_read_folder(spark, p, column) for p in ([paths] if isinstance(paths, str) else paths)]
    return reduce(DataFrame.unionByName, tables)


def _read_folder(spark: SparkSession, path: str, column: int) -> DataFrame:
    files = cut_lineage(_headers(spark, path))
    kinds = [(r.header, r.path) for r in files.groupBy("header").agg(F.min("path").alias("path")).orderBy("header").collect()]
    places = {h: _places(next(csv.reader([h])), column, p) for h, p in kinds}
    if not places:
        return spark.createDataFrame([], ", ".join(f"`{f[0]}` {f[2]}" for f in STATS_FIELDS))
    if len(places) == 1:
        return _read(spark, path, *next(iter(places.values())))
    return _read_mixed(spark, path, files, places)


def _places(header: list[str], column: int, path: str) -> tuple[list[int], int]:
    """Position of every field in a header, and the header's width."""
    missing = [f[column] for f in STATS_FIELDS if f[column] not in header]
    if missing:
        raise ValueError(f"columns not in file {path}: {missing}")
    return [header.index(f[column]) for f in STATS_FIELDS], len(header)


def _headers(spark: SparkSession, path: str) -> DataFrame:
    """(path, first line) of every file that has one; only the first bytes of each are read."""

    def first_lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            lines = []
            for p in pdf["path"]:
                with open_text(p) as f:
                    lines.append(f.read(HEADER_BYTES).split(b"\n", 1)[0].decode("utf-8-sig").rstrip("\r"))
            yield pd.DataFrame({"path": pdf["path"], "header": lines})

    files = list_files(spark, path).where(~F.col("path").rlike("/[._][^/]*$")).select("path")
    return spread(files, "path").mapInPandas(first_lines, "path string, header string").where("header != ''")


def _read(spark: SparkSession, path: str, places: list[int], width: int) -> DataFrame:
    """Files that share one header."""
    fields = F.from_csv("value", ", ".join(f"c{i} string" for i in range(width)) + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    fits = lambda f: f["_bad"].isNull() | (F.size(F.split("value", ",")) < width)
    parsed = bind(fields, lambda f: F.when(fits(f), F.array(*[f[f"c{i}"] for i in range(width)])))
    lines = _lines(spark, path).where(F.btrim("value", F.lit(" \t")) != "")
    return _picked(lines, parsed, lambda k: F.get("_cells", F.lit(places[k])), F.lit(width))


def _read_mixed(spark: SparkSession, path: str, files: DataFrame, places: dict[str, tuple[list[int], int]]) -> DataFrame:
    """Files of several headers in one scan: each line's fields are picked by the positions of its file's header."""
    known = spark.createDataFrame([(h, at, width) for h, (at, width) in places.items()], "header string, _at array<int>, _width int")
    of_file = files.join(F.broadcast(known), "header").select(F.col("path").alias("_path"), "_at", "_width")
    lines = _lines(spark, path).join(broadcast_if_small(of_file), "_path")
    most = max(width for _, width in places.values()) + 1
    fields = F.from_csv("value", ", ".join(f"c{i} string" for i in range(most)), {"mode": "PERMISSIVE"})
    cells = bind(fields, lambda f: F.array(*[f[f"c{i}"] for i in range(most)]))
    parsed = F.when(F.get(cells, F.col("_width")).isNull(), cells)
    return _picked(lines.where("value != ''"), parsed, lambda k: F.get("_cells", F.get("_at", F.lit(k))), F.col("_width"))


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, file): a line ends at a line feed, a carriage return or both, and holds neither."""
    return spark.read.option("recursiveFileLookup", "true").text(path).select("value", F.col("_metadata.file_path").alias("_path"))


def _picked(lines: DataFrame, parsed: Column, at: Callable[[int], Column], width: Column) -> DataFrame:
    """The fields of lines that are no header and fit: ``parsed``, null where they do not fit, if quoted.

    Other lines are cut at their commas, which takes a fraction of a parser's time; no projection names all the cells.
    A line is cut once: the cells come from a generator, below which the filter on their number is not pushed. The parser,
    which generated code does not hold, has a projection of its own, so that cells are not copied from step to step.
    """
    quoted = F.contains("value", F.lit('"'))
    rows = lines.where(~F.contains("value", F.lit("Dst"))).withColumn("_quoted", quoted)
    rows = rows.withColumn("_parsed", F.when(F.col("_quoted"), parsed))
    cells = F.when(F.col("_quoted"), F.col("_parsed")).otherwise(F.split("value", ","))
    rows = rows.select("*", F.explode(F.array(cells)).alias("_cells"))
    rows = rows.where(F.when(F.col("_quoted"), F.col("_cells").isNotNull()).otherwise(F.size("_cells") <= width))

    def field(k: int, kind: str) -> Column:
        cell = at(k)
        return F.when(cell != "", cell) if kind == "string" else cell.try_cast(kind)

    return rows.select(*[field(k, f[2]).alias(f[0]) for k, f in enumerate(STATS_FIELDS)])
