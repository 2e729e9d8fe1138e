"""Server profiles, client behaviour and the verdict rules, on clustered flows.

Input rows are ``clustered_flows``: flow_id, src_file, emit_at, server_ip, server_port, client_ip, cluster_id,
y, f_time. Client order is the whole time vector, then the server's first appearance, then emission order.
``by`` names extra leading keys, such as the day, when one job covers several independent data sets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.functions.arrays import differences
from flowloom.operators.ranking import HOT_ROWS, lagged, ranked
from flowloom.schemas import DEFAULT_PARAMS
from flowloom.session import broadcast_if_small, cut_lineage

SERVER = ["server_ip", "server_port"]
# Entropies are compared with a margin that hides last-bit differences: two equal halves are exactly 1.
MARGIN = 1e-9
ONE_BIT = 1.0


def client_of(flows: DataFrame) -> DataFrame:
    """Client of a clustered row: the endpoint that is not the server, compared as a whole address."""
    return flows.withColumn(
        "client_ip", F.when(F.col("srcip") == F.col("server_ip"), F.col("dstip")).otherwise(F.col("srcip"))
    )


def server_profile(clusters: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Flows, distinct clients, distinct cluster ids (noise counts as one) and any malicious flow, per server.

    Counted first per (server, client, cluster), which shrinks a busy server map-side before its totals.
    """
    keys = (by or []) + SERVER
    fine = clusters.groupBy(*keys, "client_ip", "cluster_id").agg(
        F.count(F.lit(1)).alias("_n"), F.max("y").alias("_y")
    )
    return fine.groupBy(*keys).agg(
        F.sum("_n").alias("n_flows"),
        F.count_distinct("client_ip").alias("n_clients"),
        F.count_distinct("cluster_id").alias("n_clusters"),
        F.max("_y").alias("malicious"),
    )


def with_params(df: DataFrame, params: DataFrame | dict | None) -> DataFrame:
    """Add the rule parameters: one set for all rows, or by ``day`` from a (small, counted) table, with defaults."""
    if isinstance(params, DataFrame):
        joined = df.join(broadcast_if_small(params), "day", "left")
        return joined.withColumns({p: F.coalesce(F.col(p), F.lit(v)) for p, v in DEFAULT_PARAMS.items()})
    return df.withColumns({p: F.lit(v) for p, v in {**DEFAULT_PARAMS, **(params or {})}.items()})


def benign_servers(profile: DataFrame, params: DataFrame | dict | None = None) -> DataFrame:
    """Add ``benign``: many clients and clusters, or few clients and few flows."""
    popular = (F.col("n_clients") > F.col("clientiplent")) & (F.col("n_clusters") >= F.col("flowidlenmin"))
    quiet = (F.col("n_clients") <= F.col("clientiplent")) & (F.col("n_flows") <= F.col("serdatalistmax"))
    return with_params(profile, params).withColumn("benign", popular | quiet).drop(*DEFAULT_PARAMS)


def entropy(df: DataFrame, group_cols: list[str], value_col: str, base: float = 2, name: str = "entropy") -> DataFrame:
    """Shannon entropy of the values of each group, from (ln n - sum(c ln c) / n) over the value counts c."""
    counts = df.groupBy(*group_cols, value_col).agg(F.count(F.lit(1)).alias("_c"))
    n, s = F.sum("_c"), F.sum(F.col("_c") * F.ln(F.col("_c")))
    return counts.groupBy(*group_cols).agg(F.greatest((F.ln(n) - s / n) / F.ln(F.lit(float(base))), F.lit(0.0)).alias(name))


def client_order(
    clusters: DataFrame, by: list[str] | None = None, keys: list[str] | None = None, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Add pos, the flow's 0-based place in the order of its client (or of ``keys``)."""
    by = by or []
    seen = clusters.groupBy(*by, *SERVER).agg(F.min(F.struct("src_file", "emit_at")).alias("_seen"))
    rows = clusters.join(seen, by + SERVER)
    order = ["f_time", "_seen", "src_file", "emit_at"]
    return ranked(rows, by + (keys or ["client_ip"]), order, hot_rows=hot_rows).drop("_seen")


def interflow_gap(ordered: DataFrame, by: list[str] | None = None) -> DataFrame:
    """dt: first time entry minus that of the client's previous flow (0 before the first)."""
    head = F.col("f_time")[0].cast("double")
    out = lagged(ordered, (by or []) + ["client_ip"], head, "_prev")
    return out.withColumn("dt", head - F.coalesce(F.col("_prev"), F.lit(0.0))).drop("_prev")


def count_windows(ordered: DataFrame, winsize: Column | int) -> DataFrame:
    """win: tumbling windows of ``winsize`` flows along the client order; the last may be short."""
    size = winsize if isinstance(winsize, Column) else F.lit(winsize)
    return ordered.withColumn("win", F.floor(F.col("pos") / size))


def client_gates(
    clusters: DataFrame, benign: DataFrame, params: DataFrame | dict | None = None, by: list[str] | None = None
) -> DataFrame:
    """The first rule, in order, that clears a client of all suspicion, or 'scan'.

    Flows are counted per (client, server) first, so the benign flags meet that small table and not the flows.
    """
    by = by or []
    pairs = clusters.groupBy(*by, "client_ip", *SERVER).agg(F.count(F.lit(1)).alias("_n"))
    flagged = pairs.join(benign.select(*by, *SERVER, "benign"), by + SERVER, "left")
    per_client = flagged.groupBy(*by, "client_ip").agg(
        F.sum("_n").alias("n_flows"),
        F.count(F.lit(1)).alias("n_servers"),
        F.max(F.when(F.col("benign"), 0).otherwise(1)).alias("_suspect"),
    )
    gate = (
        F.when(F.col("_suspect") == 0, "all_benign")
        .when(F.col("n_flows") == 1, "one_flow")
        .when(F.col("n_servers") == F.col("n_flows"), "all_distinct")
        .when(F.col("n_servers") > F.col("lenseridsetmin"), "many_servers")
        .when(F.col("n_flows") < F.col("winsize"), "short")
        .otherwise("scan")
    )
    return with_params(per_client, params).withColumn("gate", gate).drop("_suspect", *DEFAULT_PARAMS)


def classify(clusters: DataFrame, params: DataFrame | dict | None = None, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Verdict per flow. ``params`` is one parameter set, or a table by ``day`` for clusters that carry a day.

    Cleared clients get 0 at once. Only flows of scanned clients are put in order, cut into count windows and
    measured; a window is suspicious when neither its servers nor its gaps vary.
    """
    by = ["day"] if isinstance(params, DataFrame) else []
    win = by + ["client_ip", "win"]
    # only these columns are carried through the checkpoints
    clusters = clusters.select(*by, "client_ip", *SERVER, "flow_id", "cluster_id", "y", "f_time", "src_file", "emit_at")
    benign = benign_servers(server_profile(clusters, by), params)
    gates = cut_lineage(client_gates(clusters, benign, params, by).select(*by, "client_ip", "gate"))
    gated = clusters.join(gates, by + ["client_ip"])
    scanned = cut_lineage(gated.where(F.col("gate") == "scan"))
    ordered = interflow_gap(client_order(scanned, by, hot_rows=hot_rows), by)
    measured = cut_lineage(count_windows(with_params(ordered, params), F.col("winsize")))
    ids = entropy(measured.withColumn("_server", F.struct(*SERVER)), win, "_server", name="id_entropy")
    gaps = entropy(measured, win, "dt", name="dt_entropy")
    varied = (F.col("id_entropy") > ONE_BIT + MARGIN) | (F.col("dt_entropy") > F.col("tss_entro_t") + MARGIN)
    found = measured.join(ids.join(gaps, win), win).withColumn("pred", F.when(varied, 0).otherwise(1))
    cols = by + ["client_ip", "flow_id", "gate", "y", "pos", "win", "id_entropy", "dt_entropy", "pred"]
    cleared = gated.where(F.col("gate") != "scan").withColumn("pred", F.lit(0))
    return found.select(*cols).unionByName(
        cleared.select(*by, "client_ip", "flow_id", "gate", "y", "pred"), allowMissingColumns=True
    )


def client_sequences(clusters: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Each client's ordered (cluster, label) steps inside a server, one row per step.

    Left out: servers where every client has exactly one flow, and servers without a malicious flow.
    """
    kept = server_profile(clusters).where((F.col("n_flows") > F.col("n_clients")) & (F.col("malicious") == 1))
    rows = cut_lineage(clusters.join(kept.select(*SERVER), SERVER, "left_semi"))
    return client_order(rows, keys=SERVER + ["client_ip"], hot_rows=hot_rows)


def client_timeline(clusters: DataFrame, limit: int | None = None, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Flows of every client with a malicious flow: gap to the previous flow, gaps inside the flow.

    All of them, or the first ``limit`` of each client where the caller asks for that.
    """
    bad = clusters.groupBy("client_ip").agg(F.max("y").alias("_y")).where(F.col("_y") == 1).select("client_ip")
    rows = cut_lineage(clusters.join(bad, "client_ip", "left_semi"))
    ordered = client_order(rows, hot_rows=hot_rows)
    timed = interflow_gap(ordered if limit is None else ordered.where(F.col("pos") < limit))
    return timed.withColumn("step_diffs", differences(F.col("f_time")))


def vector_sort(df: DataFrame, vec: str, ties: list[str]) -> DataFrame:
    """Global order by a whole vector, entry by entry (a range shuffle)."""
    return df.orderBy(vec, *ties)
