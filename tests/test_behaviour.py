"""Gates, entropies, verdicts and metrics on hand-made clusters."""

import math
import random

import pytest
from pyspark.sql import functions as F

from flowloom.operators import behaviour as B
from flowloom.operators.metrics import binary_metrics, macro_metrics

ROW = (
    "flow_id string, src_file string, emit_at bigint, server_ip string, server_port int, client_ip string, "
    "cluster_id bigint, y int, f_time array<float>"
)


def clusters(spark, steps):
    """steps: (client, server, cluster, y, head of the time vector)."""
    rows = [(f"f{i}", "a", i, s, 80, c, k, y, [float(t)] + [0.0] * 31) for i, (c, s, k, y, t) in enumerate(steps)]
    return spark.createDataFrame(rows, ROW)


def test_gates_in_order(spark):
    df = clusters(spark, [
        ("one", "s1", 0, 0, 1),
        ("distinct", "s1", 0, 0, 1), ("distinct", "s2", 0, 0, 2),
        ("many", "s1", 0, 0, 1), ("many", "s1", 0, 0, 2), ("many", "s2", 0, 0, 3),
        ("short", "s1", 0, 0, 1), ("short", "s1", 0, 0, 2), ("short", "s1", 0, 0, 3),
        *[("scan", "s1", 0, 0, t) for t in range(4)],
        ("calm", "quiet", 0, 0, 1), ("calm", "quiet", 0, 0, 2),
    ])
    benign = B.benign_servers(B.server_profile(df), {"clientiplent": 9}).withColumn("benign", F.col("server_ip") == "quiet")
    got = {r.client_ip: r.gate for r in B.client_gates(df, benign).collect()}
    assert got == {
        "one": "one_flow", "distinct": "all_distinct", "many": "many_servers", "short": "short", "scan": "scan", "calm": "all_benign",
    }


def test_entropy(spark):
    df = spark.createDataFrame([("a", 1)] * 3 + [("b", 1), ("b", 2)] + [("c", i) for i in range(4)], "g string, v int")
    got = {r.g: r.entropy for r in B.entropy(df, ["g"], "v").collect()}
    assert got == pytest.approx({"a": 0.0, "b": 1.0, "c": 2.0}, abs=1e-12)


def test_one_bit_windows_stay_suspicious(spark):
    """Two gaps, half and half, measure exactly one bit, which does not exceed the limit."""
    df = clusters(spark, [("x", "s1", 0, 1, t) for t in (1, 2, 4, 5)])
    assert [r.pred for r in B.classify(df).collect()] == [1] * 4
    spread = clusters(spark, [("x", "s1", 0, 1, t) for t in (1, 3, 7, 15)])
    assert [r.pred for r in B.classify(spread).collect()] == [0] * 4


def test_hot_client_path_gives_the_same_verdicts(spark):
    rnd = random.Random(1)
    steps = [(rnd.choice(["hot", "hot", "c1", "c2"]), "s1", rnd.randrange(3), rnd.randrange(2), rnd.randrange(5)) for _ in range(200)]
    df = clusters(spark, steps)
    plain = {tuple(r) for r in B.classify(df).collect()}
    assert {tuple(r) for r in B.classify(df, hot_rows=10).collect()} == plain and len(plain) == 200


def test_client_sequences_skip_servers(spark):
    df = clusters(spark, [("a", "s1", 0, 1, 2), ("a", "s1", 1, 0, 1), ("b", "s2", 0, 1, 1), ("c", "s3", 0, 0, 1), ("c", "s3", 0, 0, 2)])
    rows = B.client_sequences(df).orderBy("pos").collect()
    assert [(r.server_ip, r.cluster_id, r.y) for r in rows] == [("s1", 1, 0), ("s1", 0, 1)]
    timeline = B.client_timeline(df, limit=1).orderBy("client_ip").collect()
    assert [(r.client_ip, r.flow_id, r.dt) for r in timeline] == [("a", "f1", 1.0), ("b", "f2", 1.0)]


def test_metrics(spark):
    df = spark.createDataFrame([(1, 1), (1, 0), (0, 1), (0, 0), (2, 0)], "y int, pred int")
    b = binary_metrics(df).first()
    assert (b.accuracy, b.precision, b.recall, b.f1) == (0.4, 0.5, 0.5, 0.5)
    m = macro_metrics(df, "y", "pred").first()
    assert m.accuracy == 0.4 and math.isclose(m.precision, (1 / 3 + 0.5 + 0) / 3) and math.isclose(m.recall, 1 / 3)
