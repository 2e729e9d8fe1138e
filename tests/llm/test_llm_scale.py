"""Large benchmarks, removed spans, groups of near copies, and strings on which plain sums collide."""

import base64
import random
import re
import time

import pyarrow as pa
import pytest
from brute import ascii_lower
from pyspark.sql import functions as F

from flowloom.llm import grouped, minhash_join
from flowloom.llm.decontaminate import benchmark_hits, remove_contamination
from flowloom.llm.minhash_join import near_duplicates, shingle_sets
from flowloom.llm.quality_rules import apply_rules
from flowloom.llm.sharding import assign_shards
from flowloom.llm.secret_scan import confirmed_spans, der_end
from flowloom.llm.url_filter import judge_urls, segment_words

ITEM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def hit_words(text, items, width=10):
    """Numbers of the words of ``text`` inside a window of an item."""
    words = ITEM.findall(ascii_lower(text or ""))
    out = set()
    for item in items:
        w = ITEM.findall(ascii_lower(item or ""))
        size = min(width, len(w))
        windows = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if w else set()
        for i in range(len(words) - size + 1):
            if tuple(words[i : i + size]) in windows:
                out |= set(range(i, i + size))
    return out


def mixed(seed):
    rnd = random.Random(seed)
    word = lambda: rnd.choice(["Ab", "c", "é", "d1", "E"])
    items = [" ".join(word() for _ in range(n)) for n in (1, 2, 3, 5, 12, 12, 30)] + [None, "", "!?"]
    docs = [rnd.choice(["", "- ", "é "]) + "".join(word() + rnd.choice([" ", ", ", "\n", "--"]) for _ in range(rnd.randint(0, 60))) for _ in range(40)]
    return items[seed % 3 :], docs + [None, "", "...", docs[3]]


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_spans_are_removed_in_both_ways(spark, seed):
    items, docs = mixed(seed)
    bench = spark.createDataFrame(list(enumerate(items)), "item_id int, text string")
    rows = spark.createDataFrame([(i, t, 1) for i, t in enumerate(docs)], "spans int, text string, at int")
    expected = {}
    for i, t in enumerate(docs):
        hit = hit_words(t, items)
        ends = [m.end() for m in ITEM.finditer(ascii_lower(t or ""))]
        pieces, tail = [t[a:b] for a, b in zip([0, *ends], ends)], (t or "")[max(ends, default=0) :]
        expected[i] = "".join(p for k, p in enumerate(pieces) if k not in hit) + tail if hit else t
    got = {r.spans: r.text for r in remove_contamination(rows, bench, remove="spans").collect()}
    assert got == expected
    kept = {r.spans for r in remove_contamination(rows, bench).collect()}
    assert kept == {i for i, t in enumerate(docs) if not hit_words(t, items)}
    ids = rows.select(F.col("spans").alias("doc_id"), "text")
    ways = [sorted(map(tuple, benchmark_hits(ids, bench, whole=w, entries=64).select("doc_id", "at", "size").distinct().collect())) for w in (True, False)]
    assert ways[0] == ways[1]


def test_a_million_windows(spark):
    text = F.concat_ws(" ", *[F.concat(F.lit("w"), F.pmod(F.xxhash64("id", F.lit(k)), F.lit(5000)).cast("string")) for k in range(20)])
    bench = spark.range(100_000).select(F.col("id").alias("item_id"), text.alias("text"))
    some = [r.text for r in bench.where("item_id IN (7, 99999)").orderBy("item_id").collect()]
    docs = [(1, "x " + some[0] + " y"), (2, " ".join(some[1].split()[3:15]).upper()), (3, " ".join(some[1].split()[3:12])), (4, "w1 w2 w3 " * 20)]
    hits = benchmark_hits(spark.createDataFrame(docs, "doc_id int, text string"), bench)
    assert sorted((r.doc_id, r["at"]) for r in hits.select("doc_id", "at").distinct().collect()) == [(1, k) for k in range(2, 13)] + [(2, k) for k in (1, 2, 3)]


def near_copies(n):
    base = [f"word{i}" for i in range(300)]
    return [(i, " ".join(base[:k] + [f"own{i}"] + base[k + 1 :])) for i, k in ((i, i * 37 % 300) for i in range(n))]


def test_rows_grow_with_the_group(spark, monkeypatch):
    monkeypatch.setattr(minhash_join, "BUCKET_BLOCK", 20)
    monkeypatch.setattr(minhash_join, "SHINGLE_BLOCK", 20 * 296)
    plain, seen = grouped.map_groups, []

    def counted(df, *args):
        seen.append(df.count())
        return plain(df, *args)

    monkeypatch.setattr(grouped, "map_groups", counted)
    met = []
    for n in (150, 600):
        seen.clear()
        got = near_duplicates(spark.createDataFrame(near_copies(n), "doc_id bigint, text string")).collect()
        assert {r.component_id for r in got} == {0} and len(got) == n
        met.append(sum(seen))
    assert met[1] <= 4.5 * met[0]


def thue_morse(n):
    x = "a"
    for _ in range(n):
        x += x.translate(str.maketrans("ab", "ba"))
    return x, x.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("n", [10, 11, 12])
def test_words_on_which_sums_collide(spark, n):
    x, y = thue_morse(n)
    sets, lead = shingle_sets(pa.array([x, y]))
    assert lead.tolist() == [0, 1, 2] and sets[0] != sets[1]
    rows = spark.createDataFrame([(1, f"{x}\n{y}"), (2, f"{x}\n{x}")], "doc_id bigint, text string")
    assert {r.doc_id: r.n_dup_lines for r in apply_rules(rows, ["doc_id"]).collect()} == {1: 0, 2: 1}


@pytest.mark.parametrize("piece", [b"\x30\x83\x0f\xff\xff\x02\x01\x00" + b"\x30\x00" * 8, b"\x30\x82\x7f\xff\x02\x01\x00", b"openssh-key-v1\0" + b"\0\0\0\0" * 4])
def test_crafted_runs_take_linear_time(piece):
    text = base64.b64encode(piece * (7_500_000 // len(piece))).decode()
    start = time.perf_counter()
    confirmed_spans(text)
    assert len(text) > 9_000_000 and time.perf_counter() - start < 20


def tlv(tag, body):
    size = bytes([len(body)]) if len(body) < 128 else b"\x82" + len(body).to_bytes(2, "big")
    return bytes([tag]) + size + body


def test_encrypted_keys_are_confirmed():
    pbes2 = tlv(0x30, tlv(0x06, bytes.fromhex("2a864886f70d01050d")) + tlv(0x30, b"\x05\x00"))
    key = tlv(0x30, pbes2 + tlv(0x04, bytes(range(200))))
    digest = tlv(0x30, tlv(0x30, tlv(0x06, bytes.fromhex("608648016503040201")) + b"\x05\x00") + tlv(0x04, bytes(32)))
    assert der_end(key) == len(key) and der_end(digest) is None
    text = "key: " + base64.b64encode(key).decode() + " end"
    assert [(k, a) for a, k, _ in confirmed_spans(text)] == [(3, 5)]


def test_long_names(spark):
    word = "ab" * 50_000
    words = spark.createDataFrame([(word,), ("abcx",)], "word string")
    counts = spark.createDataFrame([("ab", 50), ("abcx", 2), ("b" * 300, 1)], "word string, n bigint")
    start = time.perf_counter()
    got = {r.word: r.parts for r in segment_words(words, counts).collect()}
    assert "".join(got[word]) == word and got["abcx"] == ["abcx"]
    rules = spark.createDataFrame([("net", "/", "block")], "host string, path string, verdict string")
    urls = [(1, "http://" + "a." * 50_000 + "net/x", "<p>ab</p>"), (2, "http://x.org/" + word, None), (None, None, None)]
    judged = judge_urls(spark.createDataFrame(urls, "page_id int, url string, html string"), rules).collect()
    assert {r.page_id: r.rule for r in judged} == {1: "net/", 2: None, None: None}
    assert time.perf_counter() - start < 120


def test_one_key_is_parted(spark):
    rows = [(i if i % 3 else 7, "x" * 50, f"s{i % 2}") for i in range(600)] + [(None, "y" * 90, "s2")] * 40 + [(5000, "z" * 3000, "s2")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(4)
    for key in ("doc_id", "source"):
        got = assign_shards(docs, 1000, key).collect()
        by = {}
        for r in got:
            by.setdefault(r.shard, []).append(r.n_bytes)
        assert len(got) == len(rows) and all(sum(v) <= 1000 or len(v) == 1 for v in by.values())
        assert all(len(r.shard) == r.depth for r in got)
        names = sorted(by)
        assert not any(b.startswith(a) for a, b in zip(names, names[1:]))
