"""Flow features: endpoints by role and the three fixed-width channels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.functions import arrays as A
from flowloom.functions import views as V
from flowloom.schemas import WIDTH


def assign_client_server(flows: DataFrame) -> DataFrame:
    """The lower port is the server; on equal ports the destination is."""
    src_serves = F.col("srcport") < F.col("dstport")
    return flows.withColumns(
        {
            "server_ip": F.when(src_serves, F.col("srcip")).otherwise(F.col("dstip")),
            "server_port": F.when(src_serves, F.col("srcport")).otherwise(F.col("dstport")),
            "client_ip": F.when(src_serves, F.col("dstip")).otherwise(F.col("srcip")),
            "client_port": F.when(src_serves, F.col("dstport")).otherwise(F.col("srcport")),
        }
    )


def time_channel(flows: DataFrame, n: int = WIDTH, time_dtype: str = "float32", origin: Column | None = None) -> DataFrame:
    """Add f_time: quantised gaps plus the flow's start offset in all ``n`` entries.

    The origin is the earliest packet of the whole table, a one-value scalar subquery, unless given.
    """
    kind = {"float32": "float", "float64": "double"}[time_dtype]
    origin = flows.agg(F.min("pktts_start")).scalar() if origin is None else origin
    placed = flows.withColumn("_offset", A.start_offset(F.col("pktts")[0], origin, kind))
    gaps = A.gap_channel(F.col("pktts"), n, time_dtype=kind)
    return placed.withColumn("f_time", A.shift(gaps, F.col("_offset"))).drop("_offset")


def size_and_direction(flows: DataFrame, n: int = WIDTH, backward: float = 0.5) -> DataFrame:
    return flows.withColumns(
        {
            "f_size": A.size_channel(A.pad_clip(F.col("pktsize"), n, 1)),
            "f_dir": A.direction_channel(A.pad_clip(F.col("pktdirs"), n, 0), backward),
            "eff_len": A.effective_len(F.col("pktdirs"), n),
        }
    )


def build_features(flows: DataFrame, n: int = WIDTH, time_dtype: str = "float32", origin: Column | None = None) -> DataFrame:
    """One row per flow: roles, the size, direction and time channels, effective length, target."""
    one = flows
    full = time_channel(size_and_direction(assign_client_server(one), n), n, time_dtype, origin)
    full = full.withColumn("f_signed", A.signed_size(F.col("f_size"), F.col("f_dir")))
    return full.select(
        "flow_id", "src_file", "emit_at", "srcip", "dstip", "n_pkts", "server_ip", "server_port", "client_ip", "client_port",
        "f_size", "f_dir", "f_time", "f_signed", "eff_len", *(["y"] if "y" in flows.columns else []),
    )


def view_mask(df: DataFrame, rate: float = 0.3, seed: int = 42, value: float = -0.1, id_col: str = "flow_id") -> DataFrame:
    p = V.drawn_positions(F.col(id_col), F.col("eff_len"), "mask", rate, seed)
    return df.withColumn("v_mask", V.masked(F.col("f_size"), p, value))


def view_reorder(df: DataFrame, rate: float = 0.3, seed: int = 42, id_col: str = "flow_id") -> DataFrame:
    p = V.drawn_positions(F.col(id_col), F.col("eff_len"), "reorder", rate, seed)
    return df.withColumn("v_reorder", V.reordered(F.col("f_size"), p))


def view_missing(df: DataFrame, rate: float = 0.3, seed: int = 42, id_col: str = "flow_id") -> DataFrame:
    p = V.drawn_positions(F.col(id_col), F.col("eff_len"), "missing", rate, seed)
    return df.withColumn("v_missing", V.missing(F.col("f_size"), p))


def view_duplicate(df: DataFrame, rate: float = 0.3, seed: int = 42, id_col: str = "flow_id") -> DataFrame:
    p = V.drawn_positions(F.col(id_col), F.col("eff_len"), "duplicate", rate, seed)
    return df.withColumn("v_duplicate", V.duplicated(F.col("f_size"), F.col("eff_len"), p))


def build_views(df: DataFrame, rate: float = 0.3, seed: int = 42, id_col: str = "flow_id") -> DataFrame:
    """All four views, in a narrow projection."""
    out = view_mask(df, rate, seed, id_col=id_col)
    out = view_reorder(out, rate, seed, id_col)
    out = view_duplicate(out, rate, seed, id_col)
    return view_missing(out, rate, seed, id_col)
