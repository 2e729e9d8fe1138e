"""Positions, lags, samples and triplets, with hot groups forced onto the range-shuffle path."""

from pyspark.sql import functions as F

from flowloom.operators import ranking
from flowloom.operators.ranking import lagged, ranked
from flowloom.operators.sampling import exact_sample, group_offsets, sample_triplets, train_test_split


def table(spark, n=300):
    """Two thirds of all rows in group 0."""
    return spark.range(n).select(
        F.when(F.col("id") % 3 > 0, 0).otherwise(F.col("id") % 7 + 1).alias("g"), "id", ((F.col("id") * 7919) % 31).alias("v")
    )


def test_hot_and_cold_paths_agree(spark):
    df = table(spark)
    cold = {r.id: r.pos for r in ranked(df, ["g"], ["v", "id"]).collect()}
    hot = {r.id: r.pos for r in ranked(df, ["g"], ["v", "id"], hot_rows=20).collect()}
    assert hot == cold and len(hot) == 300
    everything = [r.pos for r in ranked(df, [], ["v", "id"], hot_rows=20).orderBy("v", "id").collect()]
    assert everything == list(range(300))


def test_lag_across_blocks(spark):
    pos = ranked(table(spark), ["g"], ["v", "id"])
    one = {r.id: r.p for r in lagged(pos, ["g"], F.col("id"), "p").collect()}
    two = {r.id: r.p for r in lagged(pos, ["g"], F.col("id"), "p", rows=7).collect()}
    assert one == two and sum(p is None for p in one.values()) == 8


def test_exact_sizes(spark):
    df = table(spark)
    assert exact_sample(df, "id", 100).count() == 100
    assert exact_sample(df, "id", 1000).count() == 300
    train, test = train_test_split(df, "id")
    assert (train.count(), test.count()) == (210, 90)
    assert train.join(test, "id").count() == 0
    a, b = train_test_split(df, "id", exact=False)
    assert a.count() + b.count() == 300


def test_a_cut_among_equal_digits(spark, monkeypatch):
    """Hashes that share their first digits: the select goes on inside the bucket."""
    whole = ranking.hash_order

    def alike(df, id_col, seed, name="_h"):
        return whole(df, id_col, seed, name).withColumn(name, F.concat(F.lit("abcd0123"), F.substring(name, 1, 24)))

    monkeypatch.setattr(ranking, "hash_order", alike)
    df = table(spark)
    flags = {n: {r.id for r in ranking.first_by_hash(df, "id", F.lit(n), 42, digits=2, small=5).where("_in").collect()} for n in (0, 1, 7, 150, 299, 300, 900)}
    order = [r.id for r in alike(df, "id", 42).orderBy("_h").collect()]
    assert flags == {n: set(order[:n]) for n in flags}
    same = spark.createDataFrame([(1,)] * 40 + [(2,)] * 3, "id int")
    assert ranking.first_by_hash(same, "id", F.lit(17), 42, small=5).where("_in").count() == 17


def test_triplets(spark):
    df = spark.createDataFrame([("one", 1), ("two", 2), ("two", 3)] + [("many", i) for i in range(10, 40)], "g string, id bigint")
    rows = sample_triplets(df, ["g"], "id", hot_rows=5).collect()
    assert sorted(r.anchor_id for r in rows) == [1, 2, 3] + list(range(10, 40))
    by = {r.anchor_id: (r.s1_id, r.s2_id) for r in rows}
    assert by[1] == (1, 1) and by[2] == (3, 3) and by[3] == (2, 2)
    assert all(len({r.anchor_id, r.s1_id, r.s2_id}) == 3 for r in rows if r.g == "many")
    assert {r.anchor_id for r in sample_triplets(df, ["g"], "id", min_group=3).collect()} == set(range(10, 40))


def test_group_offsets(spark):
    rows = group_offsets(table(spark), ["g"], ["id"], hot_rows=20).orderBy("g", "id").collect()
    assert [r.global_idx for r in rows] == list(range(300))
    assert all(r.intra_idx == r.global_idx - r.group_offset for r in rows)
