"""Labels, feature channels, views and embeddings on small tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowloom.functions import arrays as A
from flowloom.functions import views as V
from flowloom.operators.embed import fit_linear_embedding, mlp_score
from flowloom.operators.features import assign_client_server
from flowloom.operators.labels import encode_labels, label_flows
from flowloom.operators.quality import nt_xent
from flowloom.schemas import ATTACK_WINDOW_ROWS, attack_windows


def value(spark, col, **cols):
    df = spark.range(1).select(*[F.lit(v).alias(k) if not isinstance(v, list) else F.array(*map(F.lit, v)).alias(k) for k, v in cols.items()])
    return df.select(col.alias("x")).first().x


def test_fixed_windows():
    assert len(ATTACK_WINDOW_ROWS) == 22 and sum(len(r[2]) * len(r[3]) for r in ATTACK_WINDOW_ROWS) == 164


def test_last_window_wins_and_bounds_are_inclusive(spark):
    day = "Thursday-15-02-2018"
    windows = attack_windows(spark, [(day, 1, ["a"], ["v"], "9:00", "10:00", "first"), (day, 2, ["a"], ["v"], "9:30", "9:40", "second")])
    base = 1518652800 + 4 * 3600  # local midnight
    at = lambda h, m: float(base + h * 3600 + m * 60)
    rows = [
        ("in", "a", "v", at(9, 0), at(10, 0)), ("both", "v", "a", at(9, 30), at(9, 40)), ("late", "a", "v", at(9, 50), at(10, 1)),
        ("other", "a", "x", at(9, 1), at(9, 2)),
    ]
    flows = spark.createDataFrame(rows, "flow_id string, srcip string, dstip string, pktts_start double, pktts_end double").withColumn("day", F.lit(day))
    assert {r.flow_id: r.label for r in label_flows(flows, windows).collect()} == {"in": "first", "both": "second", "late": "Benign", "other": "Benign"}
    with pytest.raises(Exception):
        label_flows(flows.withColumn("day", F.lit("Sunday-01-01-2017")), windows, strict=True).collect()
    coded, mapping = encode_labels(label_flows(flows, windows), "label")
    assert {r.label: r.label_num for r in mapping.collect()} == {"Benign": 0, "first": 1, "second": 2}


def test_labels_are_numbered_from_one_more_reading(spark):
    """Numbering reads the table once, the join once again, and does not shuffle it: rows of one label are most of a table."""
    seen = spark.sparkContext.accumulator(0)

    def counting(batches):
        for pdf in batches:
            seen.add(len(pdf))
            yield pdf

    rows = [(i, None if i % 50 == 3 else "rare" if i % 50 == 7 else "often") for i in range(400)]
    df = spark.createDataFrame(rows, "i int, kind string").mapInPandas(counting, "i int, kind string")
    coded, mapping = encode_labels(df, "kind")
    assert sorted((r.i, r.kind, r.label_num) for r in coded.collect()) == [(i, k, {"often": 0, "rare": 1}.get(k)) for i, k in rows]
    assert seen.value == 2 * len(rows)
    assert {r.kind: r.label_num for r in mapping.collect()} == {"often": 0, "rare": 1} and seen.value == 2 * len(rows)
    plan = coded._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    none, _ = encode_labels(spark.createDataFrame([(1, None)], "i int, kind string"), "kind")
    assert [(r.i, r.kind, r.label_num) for r in none.collect()] == [(1, None, None)]


def test_port_tie_makes_destination_the_server(spark):
    df = spark.createDataFrame([("a", "b", 5, 5), ("a", "b", 4, 5)], "srcip string, dstip string, srcport int, dstport int")
    assert [r.server_ip for r in assign_client_server(df).collect()] == ["b", "a"]


def test_single_precision_times(spark):
    ts = [1518700000.0, 1518700063.0, 1518700163.0]
    gaps = value(spark, A.gap_channel(F.col("t"), 4), t=ts)
    assert set(gaps) <= {0.0, 1.0}
    small = value(spark, A.gap_channel(F.col("t"), 4), t=[0.0, 0.05, 0.35, 100.0])
    assert np.allclose(small, [0.0, 0.03, 1.0, 0.0])


def test_views(spark):
    size = [float(i) for i in range(1, 33)]
    masked = value(spark, V.masked(F.col("s").cast("array<float>"), F.col("p")), s=size, p=[0, 5])
    assert [i for i, x in enumerate(masked) if x < 0] == [0, 5]
    wide = [float(i) for i in range(1, 41)]
    assert len(value(spark, V.missing(F.col("s").cast("array<float>"), F.col("p")), s=wide, p=[0, 5])) == 40
    assert value(spark, V.duplicated(F.col("s").cast("array<float>"), F.lit(38), F.col("p")), s=wide, p=[0, 5])[-3:] == [38.0, 1.0, 6.0]
    swapped = value(spark, V.reordered(F.col("s").cast("array<float>"), F.col("p")), s=size, p=[0, 3, 4])
    assert swapped[:6] == [2.0, 1.0, 5.0, 3.0, 4.0, 6.0]
    twice = value(spark, V.reordered(F.col("s").cast("array<float>"), F.col("p")), s=size, p=[0, 1])
    assert twice[:3] == [1.0, 2.0, 3.0]
    gone = value(spark, V.missing(F.col("s").cast("array<float>"), F.col("p")), s=size, p=[1])
    assert gone[:3] == [1.0, 3.0, 4.0] and gone[31] == 0.0
    dup = value(spark, V.duplicated(F.col("s").cast("array<float>"), F.lit(3), F.col("p")), s=size, p=[1])
    assert dup[:5] == [1.0, 2.0, 3.0, 2.0, 0.0]
    for n, k in ((1, 1), (3, 1), (7, 2), (32, 9)):
        drawn = value(spark, V.drawn_positions(F.lit("id"), F.col("n"), "t"), n=n)
        assert len(set(drawn)) == k and all(0 <= d < n for d in drawn)


def test_linear_embedding(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(80, 2)) @ rng.normal(size=(2, 6)) + 3
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id int, v array<double>")
    model = fit_linear_embedding(df, "v", 2)
    out = model.reconstruct(model.encode(df, "v"), "v").orderBy("id").collect()
    assert np.allclose([r.rebuilt for r in out], x)
    assert np.allclose(np.mean([r.latent for r in out], axis=0), 0)
    scored = mlp_score(df, "v", [(np.eye(6), -np.ones(6)), (2 * np.eye(6), np.zeros(6))]).orderBy("id").collect()
    assert np.allclose([r.score for r in scored], 2 * np.maximum(x - 1, 0))


def test_nt_xent_in_chunks(spark):
    rng = np.random.default_rng(1)
    zi, zj = rng.normal(size=(12, 4)), rng.normal(size=(12, 4))
    df = spark.createDataFrame([(0, i, zi[i].tolist(), zj[i].tolist()) for i in range(12)], "b int, id int, i array<double>, j array<double>")
    z = np.vstack([zi, zj])
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    s = z @ z.T / 0.1
    positive = np.concatenate([np.diag(s, 12), np.diag(s, -12)])
    np.fill_diagonal(s, -np.inf)
    expected = (np.log(np.exp(s).sum(axis=1)) - positive).mean()
    for chunk in (1024, 5):
        got = nt_xent(df, "i", "j", "b", "id", 0.1, chunk=chunk).first()
        assert got.n_rows == 24 and np.isclose(got.nt_xent, expected)


def test_nt_xent_rows_grow_by_the_power_of_one_and_a_half(spark, monkeypatch):
    from flowloom.operators import quality

    deal, sent = quality.dealt_pairs, []

    def counted(rows):
        out = deal(rows)
        sent.append(out.count())
        return out

    monkeypatch.setattr(quality, "dealt_pairs", counted)
    for n in (400, 1600):
        rng = np.random.default_rng(n)
        rows = [(0, i, rng.normal(size=4).tolist(), rng.normal(size=4).tolist()) for i in range(n)]
        df = spark.createDataFrame(rows, "b int, id int, i array<double>, j array<double>")
        wide, narrow = (nt_xent(df, "i", "j", "b", "id", 0.1, chunk=c).first() for c in (1 << 20, 8))
        assert np.isclose(wide.nt_xent, narrow.nt_xent) and wide.n_rows == narrow.n_rows == 2 * n
    assert sent[3] <= 8 * sent[1] * 1.05 and sent[2] == 4 * sent[0]
