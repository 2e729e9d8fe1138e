"""Stored tables: flows by day, cluster JSON, materialise-once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CLUSTER_COLUMNS = (
    "flow_id string, src_file string, emit_at bigint, server_ip string, server_port int, client_ip string, "
    "client_port int, cluster_id bigint, y int, f_time array<float>"
)


def with_day(df: DataFrame, file_col: str = "src_file") -> DataFrame:
    """Day directory (``Weekday-dd-mm-yyyy``) of the capture file and its date."""
    day = F.regexp_extract(F.col(file_col), r"([A-Z][a-z]+day-\d{2}-\d{2}-\d{4})/", 1)
    parts = F.split(day, "-")
    date = F.make_date(parts[3].cast("int"), parts[2].cast("int"), parts[1].cast("int"))
    return df.withColumns({"day": day, "capture_date": F.when(day != "", date)})


def write_flows(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Parquet (snappy), one directory per day."""
    df.write.mode(mode).partitionBy("day").option("compression", "snappy").parquet(path)


def read_flows(spark: SparkSession, path: str, day: str | None = None) -> DataFrame:
    """Flows of all days, or of one; the day is a partition filter."""
    df = spark.read.parquet(path)
    return df if day is None else df.where(F.col("day") == day)


def write_parts(parts: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Packet parts of the flow table in ``path``, beside it: every packet of every flow."""
    write_flows(parts, f"{path}_parts", mode)


def read_parts(spark: SparkSession, path: str, day: str | None = None) -> DataFrame:
    """Packet parts stored beside the flow table in ``path``, of all days or of one."""
    return read_flows(spark, f"{path}_parts", day)


def write_by_server(df: DataFrame, table: str, path: str, buckets: int, keys: tuple[str, ...] = ("server_ip", "server_port")) -> DataFrame:
    """Stores rows in ``buckets`` buckets of their server, sorted by it, as an external table in ``path``; returns the table.

    What groups or joins by server then needs no shuffle: profiles, clusters, triplets.
    """
    df.write.mode("overwrite").bucketBy(buckets, *keys).sortBy(*keys).option("path", path).saveAsTable(table)
    return df.sparkSession.table(table)


def exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def materialise(df: DataFrame, path: str, reprocess: bool = False) -> DataFrame:
    """Write the table unless a finished copy is there, and read it back."""
    spark = df.sparkSession
    if reprocess or not exists(spark, f"{path}/_SUCCESS"):
        df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def write_clusters_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One JSON object per flow and line, so that a busy server spans many lines and files."""
    line = F.to_json(F.struct(*[c for c in df.columns]))
    df.select(line.alias("value")).write.mode(mode).text(path)


def read_clusters_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CLUSTER_COLUMNS).json(path)
