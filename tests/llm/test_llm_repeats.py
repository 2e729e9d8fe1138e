"""Substring dedup against a version that looks at every window."""

import random

import pytest
from brute import without_repeats

from flowloom.llm.substring_dedup import WINDOW, remove_repeats


def texts(seed):
    """Rows with shared passages of lengths around the threshold, copies, periodic texts, nulls and repeated rows."""
    rnd = random.Random(seed)
    word = lambda: rnd.choice("abcdefgh") * rnd.randint(1, 3)
    passages = [[word() for _ in range(n)] for n in (49, 50, 51, 70, 130)]
    rows = []
    for doc in range(60):
        w = [word() for _ in range(rnd.choice([0, 3, 30, 80]))]
        for _ in range(rnd.randint(0, 3)):
            p = list(rnd.choice(passages))
            if rnd.random() < 0.3:
                p[rnd.randrange(len(p))] = "changed"
            w += p + [word() for _ in range(rnd.choice([0, 1, 20]))]
        rows.append((doc, rnd.choice([" ", "  ", "\n", "\t \n"]).join(w)))
    rows += [(100, "ab " * 300), (101, "ab " * 120 + "x " + "ab " * 60), (102, "é ü " * 90), (99, "é ü " * 70), (103, None), (104, ""), (105, " \n ")]
    return rows + [rows[7], (None, rows[9][1]), (rows[9][0], rows[11][1]), (-5, " ".join(passages[-1]))]


@pytest.mark.parametrize("seed,group", [(0, 1024), (1, 2), (2, 8)])
def test_against_every_window(spark, seed, group):
    rows = texts(seed)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in remove_repeats(df, group=group).collect()), key=repr)
    expected = sorted(((doc, *x) for (doc, _), x in zip(rows, without_repeats(rows))), key=repr)
    assert sum(e[2] for e in expected) > 1000
    assert got == expected


def test_long_text_and_other_columns(spark):
    rnd = random.Random(5)
    long = " ".join(f"w{rnd.randrange(10**6)}" for _ in range(200_000))
    cut = " ".join(long.split()[150_000:150_080])
    df = spark.createDataFrame([(2, "before " + cut + " after", 7), (1, long, 8)], "doc_id bigint, text string, seed int")
    got = {r.doc_id: r for r in remove_repeats(df.withColumnRenamed("seed", "spans"), ("doc_id", "spans")).collect()}
    assert (got[2].kept_text, got[2].n_removed, got[2].spans) == ("before after", 80, 7)
    assert (got[1].kept_text, got[1].n_removed) == (long, 0)


def test_empty_and_missing(spark):
    assert remove_repeats(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
    same = " ".join(map(str, range(WINDOW)))
    rows = remove_repeats(spark.createDataFrame([(None, same), (None, same), (3, same), (3, same + " ")], "doc_id bigint, text string")).collect()
    assert [r.n_removed for r in rows] == [0, 0, 0, 0]
