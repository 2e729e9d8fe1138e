"""Listing files with Spark and opening byte ranges of them inside tasks, on any file system."""

from __future__ import annotations

import os
import zlib

from pyarrow import NativeFile
from pyarrow.fs import FileSystem, LocalFileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def list_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """(path, length) of every file below ``path``; contents are not read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path).select("path", "length")


def _place(path: str) -> tuple[FileSystem, str]:
    """File system and inner path of a Hadoop-style path (``file:/x``, ``hdfs://...``, ``s3a://...``) or a plain local path."""
    if path.startswith("file:"):
        path = "/" + path[len("file:"):].lstrip("/")
    if path.startswith("/"):
        return LocalFileSystem(), path
    return FileSystem.from_uri(path.replace("s3a://", "s3://", 1))


def open_file(path: str) -> NativeFile:
    """A seekable file to read."""
    fs, inner = _place(path)
    return fs.open_input_file(inner)


def open_text(path: str) -> NativeFile:
    """A file to read from its beginning, unpacked where its name ends in .gz, .bz2, .lz4 or .zst."""
    fs, inner = _place(path)
    return fs.open_input_stream(inner)


def write_file(path: str, data: bytes) -> None:
    """Writes a whole file, with its folder, from inside a task; a second attempt writes the same file again."""
    fs, inner = _place(path)
    fs.create_dir(os.path.dirname(inner), recursive=True)
    with fs.open_output_stream(inner) as f:
        f.write(data)


class GzipWriter:
    """A new .gz file, with its folder, that a task writes piece by piece; a second attempt writes the same file again."""

    def __init__(self, path: str, level: int) -> None:
        fs, inner = _place(path)
        fs.create_dir(os.path.dirname(inner), recursive=True)
        self._out = fs.open_output_stream(inner, compression=None)
        self._pack = zlib.compressobj(level, wbits=31)

    def write(self, data) -> None:
        self._out.write(self._pack.compress(data))

    def close(self) -> None:
        self._out.write(self._pack.flush())
        self._out.close()
