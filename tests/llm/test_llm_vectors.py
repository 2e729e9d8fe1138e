"""Hard negatives and whitening against plain versions."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowloom.llm.hard_negatives import Bucket, hard_negatives
from flowloom.llm.vectors import finite_vectors
from flowloom.llm.whitening import WIDE, fit_whitening, refined_eigen, whiten_embeddings


def brute_negatives(rows, is_anchor, k=5, m=10):
    rows = sorted({(i, lab, tuple(v)) for i, lab, v in rows if None not in (i, lab, v) and None not in v})
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for i, lab, v in rows:
        if not is_anchor(i):
            continue
        others = sorted((-dot(v, w), j, other) for j, other, w in rows if j != i)
        for ps, p, _ in [(s, j, o) for s, j, o in others if o == lab][:k]:
            good = [(s, j) for s, j, o in others if o != lab and 30 * -ps <= 100 * -s <= 90 * -ps]
            out += [(i, p, r + 1, j, -ps, -s) for r, (s, j) in enumerate(good[:m])]
    return sorted(out)


@pytest.mark.parametrize("seed,parts", [(0, 4 << 20), (1, 60), (2, 200)])
def test_negatives(spark, seed, parts):
    rnd, rows = random.Random(seed), []
    centre = [[rnd.randint(-200, 200) for _ in range(6)] for _ in range(8)]
    for i in range(300):
        c = rnd.choice(centre) if rnd.random() < 0.7 else centre[0]
        scale = rnd.choice([1, 1, 0.3, 0])
        rows.append((i, rnd.choice([0, 1, 1, 1, 2]), [int(scale * (x + rnd.randint(-30, 30))) for x in c][: rnd.choice([6, 6, 6, 4])]))
    rows += [rows[10], rows[40], (None, 1, [1, 2]), (1000, None, [1, 2]), (1010, 1, None), (1020, 1, [1, None]), (1030, 7, [1, 1]), (1040, 0, []), (20, 2, [5, 5])]
    df = spark.createDataFrame(rows, "vec_id bigint, label int, vec array<bigint>").withColumn("part", F.lit(1))
    got = sorted(tuple(r) for r in hard_negatives(df, F.col("vec_id") % 10 == 0, part_values=parts).collect())
    expected = brute_negatives(rows, lambda i: i % 10 == 0)
    assert len(expected) > 500 and got == expected


def test_coordinates_prune_and_lose_nothing():
    rng = np.random.default_rng(1)
    x = rng.integers(-100, 100, (400, 8)).astype(float)
    length = np.sqrt((x**2).sum(1))
    b = Bucket(x, np.arange(400), np.zeros(400, np.int64), length)
    q = x[:30]
    low = 0.8 * length[:30] * length.max()
    live, scores = b.scores(q, length[:30], low)
    full = x @ q.T
    cut = 0
    for c, a in enumerate(live):
        assert ((scores[:, c] > -(1 << 61)) | (full[:, a] < low[a])).all()
        cut += (scores[:, c] < -(1 << 61)).sum()
    assert cut > 0.5 * scores.size


def test_negatives_of_little(spark):
    empty = spark.createDataFrame([], "vec_id bigint, label int, vec array<bigint>")
    assert hard_negatives(empty, F.col("vec_id") % 100 == 0).count() == 0
    one = spark.createDataFrame([(0, 1, [1]), (1, 1, [2]), (100, 2, [-3])], "vec_id bigint, label int, vec array<bigint>")
    assert hard_negatives(one, F.col("vec_id") % 100 == 0).count() == 0


def matrix(values, seed=0):
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(len(values), len(values))))[0].astype(WIDE)
    for _ in range(3):
        q = q @ (WIDE(1.5) * np.eye(len(values), dtype=WIDE) - WIDE(0.5) * (q.T @ q))
    return (q * np.array(values, WIDE)) @ q.T


@pytest.mark.parametrize("values", [
    np.linspace(1, 50, 40), [5, 4, 3, 2, 1e-9, 0], [7] * 6 + [1], [1 + k * 1e-10 for k in range(8)] + [3, 9],
    [1, 1 + 1e-13, 1 + 2e-13, 2, 2 + 1e-7, 2 + 2e-7, 1e6], [0, 0, 0], [4],
])
def test_refined_eigenvectors(values):
    a = matrix(np.array(values, float))
    a = (a + a.T) / 2
    got, x = refined_eigen(a)
    assert np.abs(x.T @ x - np.eye(len(values))).max() < 1e-16
    assert np.abs(a @ x - x * got).max() <= 1e-16 * max(np.abs(a).max(), 1e-300) * len(values)
    assert np.abs(got - np.sort(np.array(values, WIDE))[::-1]).max() <= 1e-15 * max(values)


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, component int")


def test_whitening(spark):
    rng = np.random.default_rng(4)
    rows = [(i, (rng.normal(size=12) * np.linspace(0.3, 2, 12) + 3).astype(np.float32).tolist(), 5) for i in range(500)]
    rows += [rows[3], (900, None, 1), (901, [1.0, None], 1), (902, [float("nan")] * 12, 1), (903, [float("inf")] * 12, 1), (904, [0.5] * 4, 1), (905, [], 1), (None, [1.0] * 12, 2)]
    df = vectors(spark, rows).repartition(5)
    got = whiten_embeddings(df.withColumnRenamed("component", "n"), ("vec_id", "n")).toPandas()
    good = [r for r in rows if r[1] is not None and all(v is not None and math.isfinite(v) for v in r[1])]
    x = np.array([[math.floor(1024 * v) + 100000 for v in r[1]] + [100000] * (12 - len(r[1])) for r in good], dtype=object)
    n, s = len(good), x.sum(0)
    assert len(got) == 8 * n and set(got.columns[1::6]) and got.iloc[:, 3].eq(n).all()
    exact = sorted(int(((n * r - s) ** 2).sum()) for r in x)
    assert sorted(int(v) for v in got.deviation[got.component == 1]) == exact
    y = x.astype(float) - np.array([float(v) / n for v in s])
    e, v = np.linalg.eigh(y.T @ y / n)
    assert got.identity_error.max() <= 1e-4 and got.identity_error.nunique() == 1
    for k in range(8):
        mine = got[got.component == k + 1]
        assert abs(mine.explained.iloc[0] / (e[-1 - k] / e.sum()) - 1) < 1e-9
        w = np.sort(np.abs(y @ v[:, -1 - k] / math.sqrt(e[-1 - k])))
        assert np.allclose(np.sort(np.abs(mine.whitened)), w, atol=1e-8)


def test_whitening_of_little(spark):
    assert whiten_embeddings(vectors(spark, [])).count() == 0
    assert whiten_embeddings(vectors(spark, [(1, None, 0)])).count() == 0
    one = whiten_embeddings(vectors(spark, [(1, [0.5, 2.0], 0)])).collect()
    assert [(r.component, r.whitened, r.explained, int(r.deviation)) for r in one] == [(1, None, None, 0), (2, None, None, 0)]
    large = spark.createDataFrame([(1, [1e30, 1.0]), (2, [-1e30, 2.0]), (3, [1e18, 0.0])], "vec_id bigint, embedding array<double>")
    model = fit_whitening(large)
    assert model.n == 3 and model.values[0] > 1e30 and len(whiten_embeddings(large).collect()) == 6
    assert finite_vectors(large, "embedding").count() == 3
