"""The registered queries: each reads the given tables and returns plain columns for comparison.

Arrays are compared as text of whole numbers: integers as they are, floats in millionths.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.functions import arrays as A
from flowloom.functions import net
from flowloom.operators import behaviour as B
from flowloom.operators import cluster, embed, features, flows, graph, labels, metrics, packets, quality, sampling
from flowloom.operators import similarity, stats
from flowloom.operators.ranking import ranked
from flowloom.plans import fixtures as fx
from flowloom.plans.fixtures import packets as packet_view
from flowloom.plans.fixtures import stage, table
from flowloom.plans.written import (
    by_server, capture_days_dir, capture_dir, clusters_json_dir, flow_dir, mixed_stats_dir, packet_csv_dir, part_dir, sequence_dir, stats_dir,
    view_name,
)
from flowloom.schemas import attack_windows, day_params
from flowloom.sources.flow_stats import read_flow_stats
from flowloom.sources.packet_csv import read_packet_csv
from flowloom.sources.pcap import read_pcap
from flowloom.sources.sequences import read_sequences
from flowloom.sources.store import read_clusters_json, read_flows, read_parts, with_day

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
MULTI_DAYS = [
    "Friday-16-02-2018", "Friday-23-02-2018", "Thursday-15-02-2018", "Tuesday-20-02-2018",
    "Wednesday-14-02-2018", "Wednesday-21-02-2018", "Friday-02-03-2018",
]


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def whole(x: Column, scale: float = 1e6) -> Column:
    """Nearest whole number of ``x * scale`` as bigint."""
    return F.floor(x.cast("double") * scale + 0.5).cast("bigint")


def text(a: Column, scale: float | None = 1e6) -> Column:
    one = (lambda x: whole(x, scale)) if scale else (lambda x: x.cast("bigint"))
    return F.array_join(F.transform(a, lambda x: one(x).cast("string")), ",")


def big(*names: str) -> list[Column]:
    return [F.col(n).cast("bigint").alias(n) for n in names]


# ---- packets and flows --------------------------------------------------------------------------------

@query
def canonical_key(spark, sf):
    p = packets.canonical_key(packet_view(spark, sf))
    return p.select("pkt_idx", "srcip", "dstip", *big("srcport", "dstport", "dir"))


@query
def canonical_key_text(spark, sf):
    p = packets.canonical_key(packet_view(spark, sf), ip_order="text")
    return p.select("pkt_idx", "srcip", "dstip", *big("srcport", "dstport", "dir"))


@query
def proto_filter(spark, sf):
    mixed = packet_view(spark, sf).withColumn("proto", F.when(F.col("pkt_idx") % 7 == 0, 1).otherwise(F.col("proto")))
    return packets.only_tcp_udp(mixed).select("pkt_idx", *big("proto", "flags"))


@query
def packet_limit(spark, sf):
    return packets.first_packets(packet_view(spark, sf), 500).select("pkt_idx", *big("size"))


def _flow_rows(f: DataFrame) -> DataFrame:
    return f.select(
        "flow_id", "srcip", "dstip", *big("srcport", "dstport", "proto", "part", "n_pkts"),
        text(F.col("pktsize"), None).alias("sizes"), text(F.col("pktts")).alias("times"),
        text(F.col("pktdirs"), None).alias("dirs"), *big("emit_at"),
    )


@query
def flow_assembly(spark, sf):
    return _flow_rows(flows.assemble_flows(packet_view(spark, sf)))


@query
def flow_group(spark, sf):
    return _flow_rows(flows.group_flows(packet_view(spark, sf)))


@query
def flow_assembly_parts(spark, sf):
    """Every packet of every flow, in parts of the usual size."""
    return _flow_rows(flows.assemble_parts(packet_view(spark, sf)))


@query
def flow_group_parts(spark, sf):
    """Every packet of every conversation, in parts of the usual size."""
    return _flow_rows(flows.group_parts(packet_view(spark, sf)))


@query
def flow_group_long(spark, sf):
    """Conversations above a cap of 4 packets, over blocks of 50: one row per flow, with its first packets."""
    return _flow_rows(flows.group_flows(packet_view(spark, sf), max_pkts=4, block=50))


@query
def flow_parts_long(spark, sf):
    """The same conversations as packet parts."""
    p = flows.group_parts(packet_view(spark, sf), max_pkts=4, block=50)
    return p.select("flow_id", *big("part", "n_pkts"), text(F.col("pktsize"), None).alias("sizes"))


@query
def flow_extent(spark, sf):
    e = flows.flow_extent(stage(spark, sf, "flows"))
    return e.select("flow_id", whole(F.col("pktts_start")).alias("start_us"), whole(F.col("pktts_end")).alias("end_us"))


@query
def multi_packet(spark, sf):
    return flows.multi_packet(stage(spark, sf, "flows")).select("flow_id", *big("n_pkts"))


@query
def client_server(spark, sf):
    f = features.assign_client_server(stage(spark, sf, "flows"))
    return f.select("flow_id", "server_ip", "client_ip", *big("server_port", "client_port"))


@query
def flow_roundtrip(spark, sf):
    return _flow_rows(read_flows(spark, flow_dir(spark, sf), fx.DAY))


@query
def flow_roundtrip_parts(spark, sf):
    return _flow_rows(read_parts(spark, part_dir(spark, sf), fx.DAY))


@query
def day_partitions(spark, sf):
    d = with_day(packet_view(spark, sf))
    return d.groupBy("day", F.col("capture_date").cast("string").alias("capture_date")).agg(F.count(F.lit(1)).alias("n"))


@query
def flow_assembly_days(spark, sf):
    """Flows of three files on two days, stored by day, read one day at a time, with their place in the order of all files."""
    path = capture_days_dir(spark, sf)
    days = spark.read.parquet(path).select("day").distinct()
    names = [r.day for r in days.collect()]  # the partition folders
    flows = read_flows(spark, path, names[0])
    for day in names[1:]:
        flows = flows.unionByName(read_flows(spark, path, day))
    order = ranked(flows.select("src_file", "emit_at"), [], ["src_file", "emit_at"], name="place")
    return flows.join(order, ["src_file", "emit_at"]).select(
        "flow_id", "day", *big("n_pkts", "place"), whole(F.col("pktts_start")).alias("start_us"), whole(F.col("pktts_end")).alias("end_us")
    )


@query
def day_files(spark, sf):
    """Capture files by day: what dataset discovery finds."""
    d = with_day(fx.packets_of_days(spark, sf))
    return d.groupBy("day", F.col("capture_date").cast("string").alias("capture_date"), "src_file").agg(F.count(F.lit(1)).alias("n"))


# ---- labels -------------------------------------------------------------------------------------------

@query
def attack_label(spark, sf):
    return labels.label_flows(stage(spark, sf, "flows"), attack_windows(spark, fx.WINDOW_ROWS)).select("flow_id", "label")


@query
def attack_label_days(spark, sf):
    """The real attack windows, over all their days in one job."""
    return labels.label_flows(fx.day_flows(spark, sf), attack_windows(spark), strict=True).select("flow_id", "day", "label")


@query
def binary_target(spark, sf):
    return labels.binary_target(stage(spark, sf, "labelled")).groupBy("label", *big("y")).agg(F.count(F.lit(1)).alias("n"))


@query
def label_encode(spark, sf):
    coded, _ = labels.encode_labels(stage(spark, sf, "labelled"), "label")
    return coded.select("flow_id", "label", "label_num")


@query
def local_time(spark, sf):
    f = stage(spark, sf, "flows")
    fmt = lambda c: F.date_format(net.local_time(F.col(c)), "yyyy-MM-dd HH:mm:ss.SSSSSS")
    return f.select("flow_id", fmt("pktts_start").alias("local_start"), fmt("pktts_end").alias("local_end"))


# ---- features -----------------------------------------------------------------------------------------

@query
def pad_clip(spark, sf):
    f = stage(spark, sf, "flows")
    return f.select(
        "flow_id", text(A.pad_clip(F.col("pktsize"), 32, 1), None).alias("sizes"),
        text(A.pad_clip(F.col("pktdirs"), 32, 0), None).alias("dirs"),
    )


def _feature(name: str):
    def run(spark, sf):
        return features.build_features(stage(spark, sf, "labelled")).select("flow_id", text(F.col(name)).alias("v"))

    return run


QUERIES["size_channel"] = _feature("f_size")
QUERIES["direction_channel"] = _feature("f_dir")
QUERIES["signed_size"] = _feature("f_signed")
QUERIES["time_channel"] = _feature("f_time")


@query
def time_channel_float64(spark, sf):
    f = features.time_channel(stage(spark, sf, "flows"), time_dtype="float64")
    return f.select("flow_id", text(F.col("f_time")).alias("v"))


@query
def gap_channel(spark, sf):
    f = stage(spark, sf, "flows")
    relative = F.transform("pktts", lambda t: t - 1518700000.0)
    return f.select(
        "flow_id", text(A.gap_channel(F.col("pktts"))).alias("epoch_gaps"), text(A.gap_channel(relative)).alias("small_gaps")
    )


@query
def effective_len(spark, sf):
    return stage(spark, sf, "features").select("flow_id", *big("eff_len"))


def _view(build, name: str):
    def run(spark, sf):
        return build(stage(spark, sf, "features")).select("flow_id", text(F.col(name)).alias("v"))

    return run


QUERIES["view_mask"] = _view(features.view_mask, "v_mask")
QUERIES["view_reorder"] = _view(features.view_reorder, "v_reorder")
QUERIES["view_missing"] = _view(features.view_missing, "v_missing")
QUERIES["view_duplicate"] = _view(features.view_duplicate, "v_duplicate")


# ---- samples and triplets -----------------------------------------------------------------------------

@query
def exact_sample(spark, sf):
    return sampling.exact_sample(stage(spark, sf, "features").select("flow_id"), "flow_id", 1000)


@query
def train_test_split(spark, sf):
    a, b = sampling.train_test_split(stage(spark, sf, "features").select("flow_id"), "flow_id")
    return a.withColumn("part", F.lit("train")).unionByName(b.withColumn("part", F.lit("test")))


def _multi(spark, sf):
    return stage(spark, sf, "features").where("n_pkts > 1")


@query
def triplets_server(spark, sf):
    return sampling.sample_triplets(_multi(spark, sf), ["server_ip", "server_port"], "flow_id").select(
        "server_ip", *big("server_port"), "anchor_id", "s1_id", "s2_id"
    )


@query
def triplets_service(spark, sf):
    return sampling.sample_triplets(_multi(spark, sf), ["server_port"], "flow_id").select(
        *big("server_port"), "anchor_id", "s1_id", "s2_id"
    )


@query
def triplets_big_groups(spark, sf):
    f = stage(spark, sf, "features")
    return sampling.sample_triplets(f, ["server_ip", "client_ip"], "flow_id", min_group=3).select(
        "server_ip", "client_ip", "anchor_id", "s1_id", "s2_id"
    )


def _gathered(spark, sf):
    f = _multi(spark, sf)
    return sampling.gather_triplets(sampling.sample_triplets(f, ["server_ip", "server_port"], "flow_id"), f, "flow_id", "f_size")


@query
def triplet_features(spark, sf):
    return _gathered(spark, sf).select(
        "anchor_id", text(F.col("anchor")).alias("anchor"), text(F.col("s1")).alias("s1"), text(F.col("s2")).alias("s2")
    )


@query
def group_offsets(spark, sf):
    f = stage(spark, sf, "features")
    g = sampling.group_offsets(f, ["server_ip", "server_port"], ["emit_at"])
    return g.select("flow_id", *big("global_idx", "group_offset", "intra_idx"))


@query
def server_groups(spark, sf):
    f = stage(spark, sf, "features")
    return sampling.server_groups(f, ["server_ip", "server_port"], 2, malicious=True).select("flow_id")


@query
def server_groups_stored(spark, sf):
    """The same from a table bucketed by server: neither the counts nor the join shuffle rows."""
    return sampling.server_groups(by_server(spark, sf), ["server_ip", "server_port"], 2, malicious=True).select("flow_id")


# ---- clusters and behaviour ---------------------------------------------------------------------------

@query
def eps_neighbours(spark, sf):
    n = cluster.eps_neighbours(stage(spark, sf, "features"), ["server_ip", "server_port"], "flow_id", "f_signed", 0.1)
    return n.select("flow_id", *big("n_neighbours"))


@query
def server_clusters(spark, sf):
    f = stage(spark, sf, "features")
    c = cluster.cluster_by_group(f, ["server_ip", "server_port"], "flow_id", "f_signed", ["src_file", "emit_at"])
    return c.select("flow_id", "server_ip", *big("server_port", "cluster_id"))


@query
def clusters_json(spark, sf):
    c = read_clusters_json(spark, clusters_json_dir(spark, sf))
    return c.select("flow_id", "server_ip", "client_ip", *big("server_port", "cluster_id", "y"), text(F.col("f_time")).alias("f_time"))


@query
def dbscan(spark, sf):
    e = table(spark, sf, "embeddings")
    out = None
    for m in (2, 3, 5):
        c = cluster.cluster_by_group(e, ["label"], "vec_id", "embedding", ["vec_id"], eps=1.2, min_samples=m)
        c = c.select("vec_id", *big("label", "cluster_id"), F.lit(m).cast("bigint").alias("min_samples"))
        out = c if out is None else out.unionByName(c)
    return out


@query
def dbscan_blocks(spark, sf):
    """The same with boxes of 40 points at most, so that every group is cut, into boxes or, where that wins nothing, blocks."""
    e = table(spark, sf, "embeddings")
    c = cluster.cluster_by_group(e, ["label"], "vec_id", "embedding", ["vec_id"], eps=1.2, min_samples=3, leaf=40)
    return c.select("vec_id", *big("label", "cluster_id"))


@query
def dbscan_flows(spark, sf):
    f = sampling.server_groups(stage(spark, sf, "features"), ["server_ip", "server_port"], 2, malicious=True)
    f = f.withColumn("scope", F.lit(0))
    c = cluster.cluster_by_group(f, ["scope"], "flow_id", "f_signed", ["src_file", "emit_at"], eps=1e-4, min_samples=5)
    return c.select("flow_id", *big("cluster_id"))


@query
def server_profile(spark, sf):
    p = B.server_profile(stage(spark, sf, "clusters"))
    return p.select("server_ip", *big("server_port", "n_flows", "n_clients", "n_clusters", "malicious"))


@query
def benign_servers(spark, sf):
    b = B.benign_servers(B.server_profile(stage(spark, sf, "clusters")))
    return b.select("server_ip", *big("server_port"), F.col("benign").cast("bigint").alias("benign"))


@query
def client_recovery(spark, sf):
    return B.client_of(stage(spark, sf, "features").drop("client_ip")).select("flow_id", "client_ip")


@query
def entropy(spark, sf):
    e = B.entropy(stage(spark, sf, "clusters"), ["server_ip", "server_port"], "cluster_id")
    return e.select("server_ip", *big("server_port"), whole(F.col("entropy")).alias("entropy_u"))


@query
def client_gates(spark, sf):
    c = stage(spark, sf, "clusters")
    g = B.client_gates(c, B.benign_servers(B.server_profile(c)))
    return g.select("client_ip", "gate", *big("n_flows", "n_servers"))


@query
def client_gates_mixed(spark, sf):
    """Flows dealt out to many pseudo-clients, with limits that reach every gate."""
    c = stage(spark, sf, "clusters").withColumn("client_ip", F.substring(F.md5("flow_id"), 1, 3))
    params = {"clientiplent": 60, "flowidlenmin": 9, "lenseridsetmin": 1, "winsize": 3}
    g = B.client_gates(c, B.benign_servers(B.server_profile(c), params), params)
    return g.select("client_ip", "gate", *big("n_flows", "n_servers"))


@query
def interflow_gap(spark, sf):
    g = B.interflow_gap(B.client_order(stage(spark, sf, "clusters")))
    return g.select("flow_id", *big("pos"), whole(F.col("dt")).alias("dt_u"))


@query
def count_windows(spark, sf):
    return B.count_windows(B.client_order(stage(spark, sf, "clusters")), 4).select("flow_id", *big("pos", "win"))


def _verdict_rows(v: DataFrame) -> DataFrame:
    return v.select(
        "flow_id", "client_ip", "gate", *big("pos", "win", "pred", "y"),
        whole(F.col("id_entropy")).alias("id_entropy_u"), whole(F.col("dt_entropy")).alias("dt_entropy_u"),
    )


@query
def verdicts(spark, sf):
    return _verdict_rows(B.classify(stage(spark, sf, "clusters")))


def _by_day(spark, sf):
    octet = F.split("client_ip", r"\.")[3].cast("int")
    day = F.array(*[F.lit(d) for d in MULTI_DAYS])[octet % len(MULTI_DAYS)]
    return stage(spark, sf, "clusters").withColumn("day", day)


@query
def verdict_by_day(spark, sf):
    v = B.classify(_by_day(spark, sf), day_params(spark))
    return _verdict_rows(v).join(_by_day(spark, sf).select("flow_id", "day"), "flow_id")


@query
def metrics_binary(spark, sf):
    m = metrics.binary_metrics(B.classify(stage(spark, sf, "clusters")))
    return m.select(*[whole(F.col(c), 1e9).alias(c) for c in m.columns])


@query
def metrics_macro(spark, sf):
    e = table(spark, sf, "embeddings").select(
        F.col("label").alias("y"),
        ((F.col("label") + F.when(F.col("vec_id") % 3 == 0, 1).otherwise(0)) % 10).alias("p"),
    )
    m = metrics.macro_metrics(e)
    return m.select(*[whole(F.col(c), 1e9).alias(c) for c in m.columns])


@query
def client_sequences(spark, sf):
    s = B.client_sequences(stage(spark, sf, "clusters"))
    return s.select("server_ip", "client_ip", *big("server_port", "pos", "cluster_id", "y"), "flow_id")


@query
def client_timeline(spark, sf):
    t = B.client_timeline(stage(spark, sf, "clusters"))
    return t.select(
        "client_ip", "flow_id", "server_ip", *big("server_port", "pos", "cluster_id", "y"),
        whole(F.col("dt")).alias("dt_u"), text(F.col("step_diffs")).alias("step_diffs"),
    )


@query
def vector_sort(spark, sf):
    s = B.vector_sort(stage(spark, sf, "features"), "f_time", ["emit_at"])
    from flowloom.operators.ranking import range_positions

    return range_positions(s, [], ["f_time", "emit_at"]).select("flow_id", *big("pos"))


@query
def intraflow_diff(spark, sf):
    return stage(spark, sf, "features").select("flow_id", text(A.differences(F.col("f_time"))).alias("v"))


# ---- similarity, quality, embedding -------------------------------------------------------------------

def _sequence_pairs(spark, sf) -> DataFrame:
    """Each sequence with the next one by id."""
    s = stage(spark, sf, "sequences").select("seq_id", A.pad_clip(F.col("sizes"), 32, 0).alias("v"))
    from flowloom.operators.ranking import ranked

    n = ranked(s, [], ["seq_id"])
    nxt = n.select((F.col("pos") - 1).alias("pos"), F.col("seq_id").alias("next_id"), F.col("v").alias("b"))
    return n.withColumnRenamed("v", "a").join(nxt, "pos").select("seq_id", "next_id", "a", "b")


def _similar(spark, sf):
    return similarity.flow_similarity(_sequence_pairs(spark, sf))


@query
def sim_cosine(spark, sf):
    return _similar(spark, sf).select("seq_id", "next_id", whole(F.col("sim_cosine")).alias("sim_u"))


@query
def sim_jaro_winkler(spark, sf):
    return _similar(spark, sf).select("seq_id", "next_id", whole(F.col("sim_jaro_winkler")).alias("sim_u"))


@query
def sim_wasserstein(spark, sf):
    return _similar(spark, sf).select("seq_id", "next_id", whole(F.col("sim_wasserstein")).alias("sim_u"))


@query
def flow_similarity(spark, sf):
    return _similar(spark, sf).select("seq_id", "next_id", whole(F.col("similarity")).alias("sim_u"))


@query
def triplet_similarity(spark, sf):
    t = similarity.triplet_similarity(_gathered(spark, sf))
    return t.select(
        "anchor_id", "s1_id", "s2_id", whole(F.col("s1_similarity")).alias("s1_u"), whole(F.col("s2_similarity")).alias("s2_u"),
        F.col("p1").cast("bigint").alias("p1"), F.col("p2").cast("bigint").alias("p2"),
    )


def _views_of(spark, sf) -> DataFrame:
    """Vector 2k beside vector 2k+1, sixteen pairs to a batch; a vector without a partner stands beside itself."""
    e = table(spark, sf, "embeddings").withColumn("k", F.floor(F.col("vec_id") / 2))
    i = e.where("vec_id % 2 = 0").select("k", F.col("embedding").alias("z_i"))
    j = e.where("vec_id % 2 = 1").select("k", F.col("embedding").alias("z_j"))
    both = i.join(j, "k", "full").withColumn("batch_id", F.floor(F.col("k") / 16))
    return both.withColumns({"z_i": F.coalesce("z_i", "z_j"), "z_j": F.coalesce("z_j", "z_i")})


@query
def l2_normalise(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", text(A.l2_normalise(F.col("embedding"))).alias("v"))


@query
def mse(spark, sf):
    return quality.mse(_views_of(spark, sf), "z_i", "z_j").select(whole(F.col("mse"), 1e9).alias("mse_n"))


@query
def masked_mse(spark, sf):
    f = features.build_views(stage(spark, sf, "features"))
    both = [
        quality.masked_mse(f, v, "f_size", reduction=r).select(F.lit(f"{v}/{r}").alias("case"), whole(F.col("masked_mse"), 1e9).alias("mse_n"))
        for v in ("v_mask", "v_missing") for r in ("mean", "sum")
    ]
    return stats.union_stats(both)


@query
def nt_xent(spark, sf):
    n = quality.nt_xent(_views_of(spark, sf), "z_i", "z_j", "batch_id", "k", temperature=0.1)
    return n.select(F.col("batch").alias("batch_id"), whole(F.col("nt_xent")).alias("loss_u"), *big("n_rows"))


@query
def triplet_margin(spark, sf):
    e = table(spark, sf, "embeddings")
    t = sampling.gather_triplets(sampling.sample_triplets(e, ["label"], "vec_id"), e, "vec_id", "embedding")
    t = t.withColumns({"p1": F.col("anchor_id") % 2 == 0, "p2": F.col("anchor_id") % 3 == 0})
    rows = quality.triplet_margin(t, "none")
    each = rows.select("anchor_id", whole(F.col("margin"), 1e9).alias("margin_n"))
    mean = quality.triplet_margin(t).select(F.lit(-1).cast("bigint").alias("anchor_id"), whole(F.col("margin"), 1e9).alias("margin_n"))
    return each.unionByName(mean)


@query
def mlp_score(spark, sf):
    s = embed.mlp_score(stage(spark, sf, "features"), "f_signed", fx.mlp_weights())
    return s.select("flow_id", text(F.col("score")).alias("v"))


@query
def scored_clusters(spark, sf):
    """Clusters of the network's reconstructions."""
    return stage(spark, sf, "scored").select("flow_id", "server_ip", *big("server_port", "cluster_id"))


@query
def scored_verdicts(spark, sf):
    return _verdict_rows(B.classify(stage(spark, sf, "scored")))


@query
def embed_mlp(spark, sf):
    e = embed.embed_flows(stage(spark, sf, "features"), "mlp", weights=fx.mlp_weights())
    return e.select("flow_id", text(F.col("vec")).alias("v"))


@query
def embed_flows(spark, sf):
    return embed.embed_flows(stage(spark, sf, "features")).select("flow_id", text(F.col("vec")).alias("v"))


@query
def embed_unit(spark, sf):
    return embed.embed_flows(stage(spark, sf, "features"), "unit").select("flow_id", text(F.col("vec")).alias("v"))


@query
def pca2(spark, sf):
    p = embed.pca_project(table(spark, sf, "embeddings"), "embedding", 2)
    return p.select("vec_id", F.round(F.col("pca")[0], 6).alias("x"), F.round(F.col("pca")[1], 6).alias("y"))


@query
def linear_embedding(spark, sf):
    f = stage(spark, sf, "features")
    m = embed.fit_linear_embedding(f, "f_signed", 8)
    out = m.reconstruct(m.encode(f, "f_signed"), "f_signed")
    error = A.squared_distance(F.col("f_signed"), F.col("rebuilt"))
    return out.select("flow_id", F.round(F.col("latent")[0], 6).alias("first_axis"), F.round(error, 6).alias("error"))


def _axis_variances(latents: DataFrame, col: str, k: int) -> DataFrame:
    one = latents.agg(*[F.var_samp(F.col(col)[i]).alias(f"v{i}") for i in range(k)])
    return one.select(F.inline(F.array(*[F.struct(F.lit(i).cast("bigint").alias("axis"), whole(F.col(f"v{i}"), 1e5).alias("variance")) for i in range(k)])))


@query
def pca_variance(spark, sf):
    """What the two leading principal axes capture."""
    return _axis_variances(embed.pca_project(table(spark, sf, "embeddings"), "embedding", 2), "pca", 2)


@query
def linear_variance(spark, sf):
    """What the fitted axes of the flow embedding capture."""
    f = stage(spark, sf, "features")
    return _axis_variances(embed.fit_linear_embedding(f, "f_signed", 4).encode(f, "f_signed"), "latent", 4)


# ---- graph --------------------------------------------------------------------------------------------

def _windowed(spark, sf):
    return graph.graph_windows(_multi(spark, sf), fx.GRAPH_SIZE)


@query
def graph_windows(spark, sf):
    return _windowed(spark, sf).select("flow_id", *big("seq", "graph_id"))


@query
def flow_graph(spark, sf):
    nodes, edges = graph.flow_graph(_windowed(spark, sf), "f_size")
    n = nodes.select(F.lit("node").alias("kind"), *big("graph_id"), F.col("ip").alias("name"), F.col("node_id").alias("a"), F.lit(-1).cast("bigint").alias("b"))
    e = edges.select(F.lit("edge").alias("kind"), *big("graph_id"), F.col("flow_id").alias("name"), F.col("src_node").alias("a"), F.col("dst_node").alias("b"))
    return n.unionByName(e)


@query
def edge_context(spark, sf):
    _, edges = graph.flow_graph(_windowed(spark, sf), "f_size")
    return graph.edge_context(edges, 32).select("flow_id", text(F.col("context")).alias("v"))


@query
def triplets_window(spark, sf):
    """Triplets inside a server's flows of one graph window."""
    return sampling.sample_triplets(_windowed(spark, sf), ["graph_id", "server_ip", "server_port"], "flow_id").select(
        *big("graph_id"), "server_ip", *big("server_port"), "anchor_id", "s1_id", "s2_id"
    )


# ---- statistics tables and files ----------------------------------------------------------------------

def _numbers(spark, sf) -> DataFrame:
    """Numeric line-item columns with nulls, NaN and infinities put in."""
    li = table(spark, sf, "lineitem")
    pk = F.col("l_partkey")
    return li.select(
        "l_orderkey", *big("l_linenumber"),
        F.when(pk % 7 == 0, F.lit(None)).when(pk % 11 == 0, float("inf")).otherwise(F.col("l_quantity")).alias("l_quantity"),
        F.when(pk % 13 == 0, float("-inf")).when(pk % 5 == 0, float("nan")).otherwise(F.col("l_extendedprice")).alias("l_extendedprice"),
        F.when(pk % 3 == 0, F.lit(None)).otherwise(F.col("l_suppkey")).alias("l_suppkey"),
        F.col("l_returnflag").alias("Label"), F.col("l_shipdate").cast("string").alias("Timestamp"),
    )


@query
def clean_stats(spark, sf):
    c = stats.clean_stats(_numbers(spark, sf))
    return c.select("l_orderkey", "l_linenumber", "l_suppkey", whole(F.col("l_quantity"), 100).alias("qty"), whole(F.col("l_extendedprice"), 100).alias("price"))


@query
def feature_disable(spark, sf):
    return stats.disable(table(spark, sf, "lineitem").select("l_orderkey", *big("l_linenumber"), "l_tax", "l_discount", "l_suppkey"), ["l_tax", "l_discount"])


@query
def packets_from_pcap(spark, sf):
    p = read_pcap(spark, capture_dir(spark, sf), range_bytes=64 << 10)
    name = F.regexp_extract("src_file", r"part-(\d+)\.", 1).cast("bigint").alias("file_no")
    ips = [view_name(F.col(c)).alias(c) for c in ("src_ip", "dst_ip")]
    return p.select(name, "pkt_idx", whole(F.col("ts")).alias("ts_us"), *ips, *big("src_port", "dst_port", "proto", "flags", "size"))


@query
def packets_from_csv(spark, sf):
    p = read_packet_csv(spark, packet_csv_dir(spark, sf))
    return p.select(*big("size"), "src_ip", "dst_ip", *big("src_port", "dst_port", "proto"))


def _stats_rows(s: DataFrame) -> DataFrame:
    return s.select(
        F.col("Dst Port").alias("dst_port"), F.col("Flow Duration").alias("duration"), F.col("Tot Fwd Pkts").alias("fwd"),
        whole(F.col("Fwd Pkt Len Mean"), 100).alias("mean_c"), F.col("Idle Min").isNull().cast("bigint").alias("no_idle"),
        (F.col("Flow Byts/s") == float("inf")).cast("bigint").alias("endless"), F.col("Timestamp").alias("stamp"), F.col("Label").alias("label"),
    )


@query
def stats_csv(spark, sf):
    return _stats_rows(read_flow_stats(spark, stats_dir(spark, sf, "A"), "A"))


@query
def stats_csv_b(spark, sf):
    return _stats_rows(read_flow_stats(spark, stats_dir(spark, sf, "B"), "B"))


@query
def stats_union(spark, sf):
    both = stats.union_stats(
        [read_flow_stats(spark, stats_dir(spark, sf, "A"), "A"), read_flow_stats(spark, stats_dir(spark, sf, "B"), "B")]
    )
    return _stats_rows(both).groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum("duration").alias("duration"), F.sum("mean_c").alias("mean_c"))


@query
def stats_mixed(spark, sf):
    """Folders whose files differ in header, in both dialects."""
    both = stats.union_stats([read_flow_stats(spark, mixed_stats_dir(spark, sf, d), d) for d in ("A", "B")])
    return _stats_rows(both).groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum("duration").alias("duration"), F.sum("mean_c").alias("mean_c"))


@query
def stats_dataset(spark, sf):
    """The numeric table of a statistics folder: label numbers, cleaned values, features switched off."""
    coded, _ = labels.encode_labels(read_flow_stats(spark, mixed_stats_dir(spark, sf, "A"), "A"), "Label")
    clean = stats.disable(stats.clean_stats(coded), ["Protocol", "Fwd Pkt Len Mean"])
    return clean.groupBy(*big("label_num")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("Dst Port").alias("ports"), whole(F.sum("Flow Byts/s"), 1).alias("bytes"),
        whole(F.sum("Idle Min"), 100).alias("idle_c"), F.lit(len(clean.columns)).cast("bigint").alias("width"),
    )


@query
def labelled_sequences(spark, sf):
    s = read_sequences(spark, sequence_dir(spark, sf))
    return s.select(
        F.col("items")[0].cast("bigint").alias("seq_id"), text(F.slice("items", F.lit(2), F.size("items")), None).alias("items"), *big("label")
    )
