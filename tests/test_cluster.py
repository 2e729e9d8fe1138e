"""Clustering and neighbour counts against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowloom.operators.cluster import _back, _met, cluster_by_group, eps_neighbours, leaves
from flowloom.operators.components import connected_components


def brute(rows, eps, need):
    out = {}
    for g in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == g), key=lambda r: r[3])
        v = np.array([r[2] for r in mine], dtype=np.float32).astype(float)
        near = [[j for j in range(len(v)) if ((v[i] - v[j]) ** 2).sum() <= eps * eps] for i in range(len(v))]
        core = [len(n) >= need for n in near]
        label, count = [-1] * len(v), 0
        for i in range(len(v)):
            if core[i] and label[i] < 0:
                label[i], todo = count, [i]
                while todo:
                    for b in near[todo.pop()]:
                        if core[b] and label[b] < 0:
                            label[b] = count
                            todo.append(b)
                count += 1
        for i, r in enumerate(mine):
            touching = [label[b] for b in near[i] if core[b]]
            out[r[1]] = (label[i] if core[i] else min(touching, default=-1), len(near[i]) - 1)
    return out


# a leaf above every group compares it whole; small ones force cuts, dense boxes and pairs of blocks
@pytest.mark.parametrize(
    "seed,dims,eps,need,leaf",
    [(0, 2, 0.1, 2, 4096), (1, 2, 0.1, 4, 4096), (2, 32, 0.1, 2, 4096), (3, 1, 0.02, 3, 4096),
     (4, 2, 0.1, 2, 20), (5, 2, 0.1, 4, 30), (6, 32, 0.1, 3, 40), (7, 1, 0.02, 3, 12)],
)
def test_against_brute_force(spark, seed, dims, eps, need, leaf):
    rnd, rows = random.Random(seed), []
    for i in range(150):
        v = [rnd.choice([0, 0.3, 0.9]) + rnd.gauss(0, 0.08 if dims < 5 else 0.02) for _ in range(min(dims, 3))]
        v = [round(x, 1) for x in v] if rnd.random() < 0.3 else v
        rows.append((rnd.choice(["a", "a", None]), f"f{i}", v + [0.0] * (dims - len(v)), (i * 7919) % 1009))
    df = spark.createDataFrame(rows, "g string, id string, v array<float>, o int")
    expected = brute(rows, eps, need)
    got = cluster_by_group(df, ["g"], "id", "v", ["o"], eps, need, leaf)
    assert {r.id: r.cluster_id for r in got.collect()} == {k: v[0] for k, v in expected.items()}
    counts = eps_neighbours(df, ["g"], "id", "v", eps, leaf)
    assert {r.id: r.n_neighbours for r in counts.collect()} == {k: v[1] for k, v in expected.items()}


@pytest.mark.parametrize("dims,need", [(2, 2), (3, 4)])
def test_small_blocks_against_brute_force(spark, dims, need):
    """Boxes of many blocks: trees that only other blocks join, and counts that only the whole box gives."""
    rng = np.random.default_rng(dims)
    v = np.round(np.concatenate([rng.uniform(0, 0.9, (150, dims)), rng.normal(0.3, 0.03, (90, dims))]), 3)
    rows = [("a", f"f{i}", x.tolist(), i * 7919 % 1009) for i, x in enumerate(v)]
    df = spark.createDataFrame(rows, "g string, id string, v array<float>, o int")
    expected = brute(rows, 0.1, need)
    got = cluster_by_group(df, ["g"], "id", "v", ["o"], 0.1, need, leaf=50, block=12)
    assert {r.id: r.cluster_id for r in got.collect()} == {k: v[0] for k, v in expected.items()}
    counts = eps_neighbours(df, ["g"], "id", "v", 0.1, leaf=50, block=12)
    assert {r.id: r.n_neighbours for r in counts.collect()} == {k: v[1] for k, v in expected.items()}


def test_large_groups_fall_apart_at_gaps(spark):
    """Patterns more than eps apart on some axis are boxes of their own that lend no points."""
    rng = np.random.default_rng(1)
    v = rng.choice([0.0, 0.25, 0.5], (2000, 2)) + rng.uniform(0, 0.13, (2000, 2))
    rows = [(0, 2000, i, x.tolist(), 1) for i, x in enumerate(v)]
    boxes = leaves(spark.createDataFrame(rows, "gno bigint, n bigint, pno bigint, vec array<double>, w bigint"), 0.1, 400)
    assert boxes.count() == 2000 and boxes.select("leaf").distinct().count() == 9 and boxes.where("own AND whole").count() == 2000


@pytest.mark.parametrize("spread", [1.0, 2.0])
def test_candidates_per_point_stay_flat(spark, spread):
    """Four times the points, on the same or four times the area: a point still meets about as many others."""
    met = []
    for n in (4000, 16000):
        side = 20.0 * (n / 4000) ** (0.5 if spread > 1 else 0)
        rng = np.random.default_rng(3)
        rows = [(0, n, i, rng.uniform(0, side, 2).tolist(), 1) for i in range(n)]
        boxes = leaves(spark.createDataFrame(rows, "gno bigint, n bigint, pno bigint, vec array<double>, w bigint"), 0.1, 256)
        per = boxes.groupBy("leaf").agg(F.count("*").alias("all"), F.count_if("own").alias("own"))
        got = per.agg(F.sum(F.col("all") * F.col("own")).alias("met"), F.max("all").alias("most")).first()
        assert boxes.where("own").count() == n and got.most <= 1024
        met.append(got.met / n)
    assert met[1] < 1.5 * met[0]


def test_rows_find_their_points_by_a_hash(spark):
    """Whole vectors are compared but not sorted by; zeros of both signs and NaN are the equal values that they are to a group."""
    rows = [(None, 1, [0.0, 1.0]), (None, 2, [-0.0, 1.0]), ("a", 3, [0.0, 1.0]), ("a", 4, [5.0, 5.0]), (None, 5, None)]
    rows += [("n", 6, [float("nan"), 1.0]), ("n", 7, [-float("nan"), 1.0])]
    df = spark.createDataFrame(rows, "g string, id int, v array<float>")
    known = df.where("v IS NOT NULL").groupBy("g", F.transform("v", lambda x: x.cast("double")).alias("_vec")).agg(F.count("*").alias("n"))
    out = _back(df, known, ["g"], "v", "left")
    assert {r.id: r.n for r in out.collect()} == {1: 2, 2: 2, 3: 1, 4: 1, 5: None, 6: 2, 7: 2}
    plan = _back(df.hint("merge"), known, ["g"], "v", "left")._jdf.queryExecution().sparkPlan().toString()
    join = next(line for line in plan.splitlines() if "Join" in line)
    assert "SortMergeJoin" in join and "transform" not in join.split("LeftOuter")[0].replace("xxhash64(transform", "")


def test_null_vectors_are_noise(spark):
    df = spark.createDataFrame([("a", 1, [0.0]), ("a", 2, [0.0]), ("a", 3, None)], "g string, id int, v array<double>")
    assert {r.id: r.cluster_id for r in cluster_by_group(df, ["g"], "id", "v", ["id"]).collect()} == {1: 0, 2: 0, 3: -1}


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "u bigint, v bigint")
    roots = {r.node: r.root for r in connected_components(edges).collect()}
    assert roots == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


def test_one_comparison_gives_counts_and_trees(spark):
    """Blocks of a cut box are compared once: what a point meets there, and the trees of the points that are core by it."""
    rng = np.random.default_rng(5)
    v = np.round(rng.uniform(0, 1, (60, 2)), 2)
    weights = rng.integers(1, 3, 60).tolist()
    rows = [("b", i, x, w, True, False, False) for i, (x, w) in enumerate(zip(v.tolist(), weights))]
    box = spark.createDataFrame(rows, "leaf string, pno bigint, vec array<double>, w bigint, own boolean, dense boolean, whole boolean")
    near = ((v[:, None] - v[None]) ** 2).sum(2) <= 0.15**2
    met = _met(box, 0.15, 2, 60).collect()
    assert {r.u: (r.v, r.whole) for r in met if r.kind == 2} == {i: (int(near[i] @ weights), 1) for i in range(60)}
    root = {r.v: r.u for r in met if r.kind == 0}
    core = [i for i in range(60) if near[i] @ weights >= 2]
    assert sorted(root) == core
    assert all((root[a] == root[b]) or not near[a, b] for a in core for b in core)
    assert all(root[root[a]] == root[a] <= a for a in core)
