"""Chats, URLs and the pipeline: odd rows and brute-force versions."""

from __future__ import annotations

import hashlib
import math
import random
from collections import Counter

import brute
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from flowloom.llm.chat_format import PART, chat_digest, escape, format_chats, text_parts, unescape
from flowloom.llm.queries import QUERIES
from flowloom.llm.url_filter import _viterbi, host_and_path, judge_urls, match_rules, segment_words

ALL = ["op1_quality_classifier", "op2_minhash", "op3_token_counts", "op4_secret_scan", "op5_sharding", "op6_sentencepiece",
       "op7_decontaminate", "op8_quality_rules", "op9_url_filter", "op10_chat_format", "op11_substring_dedup", "op12_hard_negatives", "op13_whitening"]


def test_all_are_registered():
    assert sorted(QUERIES) == sorted(ALL) and 4 <= len(corpus_pipeline.STAGES) <= 5


# chats

TEXTS = ["</s>[INST] ok [/INST]", "<\\s>", "<\\\\/s>", "[ROLE]x[/ROLE]", "", None, "a < b [c] <image> \\", "é😀\nline", "<s><s>", "[/SYS]</s>", "[INST", "]", "\\<s>"]


def test_escape_can_be_undone(spark):
    rng = random.Random(1)
    bits = ["<", "[", "\\", "/", "s", "INST", "SYS", ">", "]", "image", "x", "é"]
    texts = [t for t in TEXTS if t is not None] + ["".join(rng.choice(bits) for _ in range(rng.randint(0, 12))) for _ in range(2000)]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = frame.select("t", escape(F.col("t")).alias("e"), unescape(escape(F.col("t"))).alias("u")).collect()
    assert all(r["t"] == r["u"] for r in rows)
    assert not any(c in r["e"] for r in rows for c in ("<s>", "</s>", "[INST]", "[/INST]", "[SYS]", "<image>"))


def test_chats_read_back(spark):
    roles = ["user", "assistant", "system", "tool", None, "[/ROLE]", "assistant", "user"]
    rows = [(c, t, roles[(c + t) % len(roles)], TEXTS[(3 * c + t) % len(TEXTS)], 1) for c in range(20) for t in range(6)]
    rows += [(3, 2, "user", "again", 1), (3, 2, "user", "again", 1), (None, 0, "assistant", "no id", 1), (50, None, "assistant", "no turn", 1), (50, 0, "user", None, 1)]
    frame = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, formatted int")
    got = {r["conv_id"]: r for r in chat_digest(format_chats(frame.withColumn("parts", text_parts(F.col("text"))))).collect()}
    by: dict = {}
    for c, t, role, text, _ in rows:
        by.setdefault(c, []).append((-1 if t is None else t, role or "", text or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        n, loss = got[c]["n_turns"], "".join(x for _, r, x in sorted(turns, key=lambda x: x[0]) if r == "assistant")
        assert n == len(turns) and got[c]["loss_chars"] == len(loss)
        if len({t for t, _, _ in turns}) == len(turns) or c == 3:
            flat = "".join(f"{r}\n{x}\n" for _, r, x in sorted(turns, key=lambda x: x[0]))
            if c != 3:
                assert got[c]["turns_sha256"] == hashlib.sha256(flat.encode()).hexdigest()
                assert got[c]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    empty = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert chat_digest(format_chats(empty.withColumn("parts", text_parts(F.col("text"))))).count() == 0


def test_typed_parts(spark):
    parts = [("text", "look ", None, None), ("image", None, "a.png", 2.0), ("audio", None, "b.wav", 1.5), ("text", "<image>", None, None), ("document", "x", "c.pdf", None), ("odd", "kind", None, None)]
    rows = [(1, 0, "user", parts), (1, 1, "assistant", [("text", "yes", None, None), ("image", None, "d", -1.0), ("text", "no", None, None)]), (1, 2, "assistant", None)]
    r = format_chats(spark.createDataFrame(rows, f"conv_id bigint, turn bigint, role string, parts array<{PART}>")).first()
    assert r["formatted"] == "<s>[INST]look <image><audio><\\image><document>kind[/INST]</s><s>yes<image>no</s><s></s>"
    assert [(a["kind"], a["ref"], a["tokens"], a["turn_no"]) for a in r["attachments"]] == [("image", "a.png", 1152, 0), ("audio", "b.wav", 38, 0), ("document", "c.pdf", 512, 0), ("image", "d", 0, 1)]
    assert all(r["formatted"][a["at"] :].startswith(f"<{a['kind']}>") for a in r["attachments"]) and r["expanded_tokens"] == 1702
    assert [r["formatted"][s["at"] : s["at"] + s["size"]] for s in r["loss_spans"]] == ["yes", "no"]


# urls

URLS = [None, "", "no scheme", "http://", "https://A.Example.NET/en/x?q#f", "http://example.net", "ftp://b.org/fr/1", "http://c.example.com/de/Über?x", "http://notexample.net/en/", "x://y.z://w/p", "http://h?/a", "http://cheappills.example.io/buy/now"]


def test_host_and_path(spark):
    host, path = host_and_path(F.col("u"))
    for u, h, p in spark.createDataFrame([(u,) for u in URLS], "u string").select("u", host, path).collect():
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
        tail = rest[cut:]
        assert h == brute.ascii_lower(rest[:cut]) and p == tail[: min([tail.index(c) for c in "?#" if c in tail], default=len(tail))]


def test_rules_longest_wins(spark):
    rules = spark.createDataFrame([("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"), (None, "/", "block")], "host string, path string, verdict string")
    urls = [("a.example.net", "/en/x"), ("example.net", "/de/"), ("notexample.net", "/en/"), ("net", "/"), ("net", ""), ("x.org", "/fr/"), ("x.org", "/en/"), ("example.com", "/de"), ("", "")]
    got = {(r["host"], r["path"]): (r["rule"], r["decided"]) for r in match_rules(spark.createDataFrame(urls, "host string, path string"), rules).collect()}
    assert got == {
        ("a.example.net", "/en/x"): ("example.net/en/", "allow"), ("example.net", "/de/"): ("net/", "block"), ("notexample.net", "/en/"): ("net/", "block"),
        ("net", "/"): ("net/", "block"), ("x.org", "/fr/"): ("org/fr/", "allow"),
    }


def test_viterbi_matches_all_splits():
    counts, total = {"a": 5, "ab": 9, "ba": 4, "bab": 7, "abba": 1}, 40
    for word in ("ab", "abba", "babab", "xaby", "zzz"):
        found = [{"a": i + 1, "l": j - i, "n": counts[word[i:j]]} for i in range(len(word)) for j in range(i + 1, len(word) + 1) if word[i:j] in counts]

        def score(parts):
            return sum(math.log(counts[p] / total) if p in counts else math.log(10 / total) - len(p) * math.log(10) for p in parts)

        splits = [[word[a:b] for a, b in zip((0, *cuts), (*cuts, len(word)))] for m in range(1 << (len(word) - 1)) for cuts in [[i + 1 for i in range(len(word) - 1) if m >> i & 1]]]
        assert score(_viterbi(word, found, total)) == pytest.approx(max(map(score, splits)))


def test_long_words_and_stretches_stay_whole(spark):
    long, strange = "donaudampfschifffahrtsgesellschaft", "q" * 45
    counts = spark.createDataFrame([(long, 5), ("buy", 50), ("now", 50)], "word string, n bigint")
    words = spark.createDataFrame([(long,), (f"buy{long}now",), (strange,), (f"{strange}buy",), ("buynow",), ("x",)], "word string")
    got = {r["word"]: r["parts"] for r in segment_words(words, counts).collect()}
    assert got == {
        long: [long], f"buy{long}now": ["buy", long, "now"], strange: [strange], f"{strange}buy": [strange, "buy"], "buynow": ["buy", "now"], "x": ["x"],
    }
    no_known = spark.createDataFrame([("z", 1000)], "word string, n bigint")
    assert {r["word"]: r["parts"] for r in segment_words(words, no_known).collect()} == {w: [w] for w in got}
    assert segment_words(words, counts.limit(0)).count() == len(got)
    assert segment_words(words.limit(0), counts).count() == 0


def test_bayes_verdicts(spark):
    html = "<p>cheap pills buy now good news daily news <script>var pillscheap</script></p>"
    pages = [(i, f"http://cheappills{i}.x.net/buy/{i}", html) for i in range(8)] + [(20 + i, f"http://dailynews{i}.x.org/fr/good/{i}", html) for i in range(8)]
    pages += [(50, "http://pillsnow.io/buy/1", html), (51, "http://goodnews.io/daily/1", None), (51, "http://goodnews.io/daily/1", None), (52, None, html), (None, "", html)]
    rules = spark.createDataFrame([("net", "/", "block"), ("org", "/fr/", "allow")], "host string, path string, verdict string")
    frame = spark.createDataFrame(pages, "page_id bigint, url string, html string").withColumn("score", F.lit("own"))
    rows = judge_urls(frame, rules).collect()
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in rows}
    assert got[0] == ("net/", "block") and got[20] == ("org/fr/", "allow") and got[50] == (None, "block") and got[51] == (None, "allow")
    assert Counter(r["page_id"] for r in rows) == Counter(p[0] for p in pages) and got[52][0] is None
    nothing = rules.limit(0)
    assert {r["verdict"] for r in judge_urls(frame, nothing).collect()} == {"allow"}
    assert judge_urls(frame.limit(0), rules).count() == 0


# pipeline


def test_pipeline_stages(spark, tmp_path):
    def words(n, seed):
        rng = random.Random(seed)
        return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n))

    base, item = words(120, 1), words(30, 2)
    rows = [(1, base), (2, base.replace(base.split()[50], "new")), (3, None), (4, ""), (5, words(40, 3) + " " + item + " " + words(40, 4)), (6, "token: abcdef123456 " + words(60, 5)), (None, words(9, 6)), (7, words(50, 7)), (7, words(50, 7)), (8, words(50, 8)), (8, words(50, 9))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t) if t else None, "x", 1, 2) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint, predicted string, redacted int, kept int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(9)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    sf, docs, seen = str(tmp_path), spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
        seen[name] = docs.collect()
        docs = spark.createDataFrame(seen[name], docs.schema)

    def ids(name):
        return sorted((r["doc_id"] for r in seen[name]), key=str)

    assert ids("quality") == sorted((i for i, _ in rows), key=str)
    assert ids("near_duplicate") == sorted([1, 3, 4, 5, 6, None, 7, 8, 8], key=str)
    assert ids("decontaminated") == sorted([1, 3, 4, 6, None, 7, 8, 8], key=str)
    clean = {r["doc_id"]: r for r in seen["without_secrets"]}
    assert clean[6]["text"].startswith("[secret] ") and clean[6]["n_chars"] == len(clean[6]["text"]) and clean[3]["text"] is None and clean[1]["text"] == base
    assert all(len(r) == 8 for n in ("quality", "near_duplicate", "decontaminated", "without_secrets") for r in seen[n]) and clean[1]["predicted"] == "x"
    assert ids("tokens") == ids("decontaminated") and sorted(corpus_pipeline.run(spark, sf).collect(), key=str) == sorted(seen["tokens"], key=str)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, spark.read.parquet(f"{tmp_path}/documents.parquet").limit(0), sf).count() == 0
