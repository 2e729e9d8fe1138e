"""Operators on documents: odd rows, brute-force versions, exact round trips, held-out accuracy."""

from __future__ import annotations

import base64
import hashlib
import json
import random
import time
import zlib

import brute
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from flowloom.llm import quality_net, quality_rules, secret_scan
from flowloom.llm.decontaminate import drop_contaminated, find_contamination
from flowloom.llm.minhash_join import chunk_keys, chunks_for, max_errors, near_duplicates
from flowloom.llm.sentencepiece_bpe import PieceModel, encode_texts
from flowloom.llm.sharding import assign_shards, write_shards
from flowloom.llm.text import Flat
from flowloom.llm.token_counts import attribute, count_tokens

PIECES = public_tokenizers.path("piece_bpe_32k.model")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score string, kept string, _row string, n_words int"


def words(n: int, seed: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def odd_rows():
    base = words(120, 1)
    near = base.replace(base.split()[60], "changed", 1)
    texts = [
        (0, None), (1, ""), (2, " \n\t "), (3, "one two"), (3, "one two"), (4, "ONE  two"), (5, base), (6, near), (7, base.upper()),
        (8, "é ü 漢字 😀 \x00 ſ"), (9, words(30_000, 2)), (10, "a" * 5000), (None, base), (None, None), (11, words(9, 3)), (12, base),
        (5, words(40, 4)), (13, "|" * 70), (14, "x\n" * 60), (15, "\n".join([words(12, 5)] * 9)),
    ]
    return [(i, t, "en", "s", len(t) if t else None, "a", "b", "c", 7) for i, t in texts]


@pytest.fixture(scope="module")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# quality network


def test_quality_net_learns_and_holds_out(spark):
    rng = random.Random(5)
    good = [words(rng.randint(3, 200), i) + "." for i in range(300)]
    bad = [" ".join(w + rng.choice(["$$$", "%%%"]) for w in words(60, 1000 + i).split()) for i in range(60)]
    bad += [" ".join([words(1, 2000 + i)] * 60) for i in range(60)]
    docs = [(i, t) for i, t in enumerate(good + bad)]
    labels = [(i, int(i < len(good)), 0) for i, _ in docs]
    frame, known = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    net = quality_net.fit_on_labels(frame, known)
    out = quality_net.score_quality(frame, net, ["doc_id"]).withColumn("held", quality_net.held_out(F.col("doc_id"))).collect()
    assert all(r["held"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in out)
    held = [r for r in out if r["held"]]
    assert np.mean([r["predicted"] == int(r["doc_id"] < len(good)) for r in held]) > 0.95
    assert all(r["predicted"] == int(r["score"] >= 0.3) for r in out)


def test_quality_net_covers_the_whole_text():
    net = quality_net.fresh_net()
    long = words(4000, 8)
    for at in (0, len(long) // 2, len(long)):
        changed = long[:at] + " $$$$%%%%&&&& " * 4 + long[at:]
        assert quality_net.scores(net, pa.array([changed]))[0] != quality_net.scores(net, pa.array([long]))[0]


def test_quality_net_gradient():
    net, texts, y = quality_net.fresh_net(), pa.array(["abc def ghi jkl", "zz zz zz zz zz zz", ""]), np.array([1, 0, 1], np.float32)
    for p in net.params():
        p[...] = p.astype(np.float32)
    grads = quality_net._gradient(net, texts, y)

    def loss():
        p = np.clip(quality_net.scores(net, texts), 1e-9, 1 - 1e-9)
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p)) + 0.5e-4 * sum((x.astype(np.float64) ** 2).sum() for x in (net.embed, net.filters, net.out))

    for p, g in zip(net.params(), grads):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        keep = p[at]
        p[at] = keep + 1e-2
        up = loss()
        p[at] = keep - 1e-2
        down = loss()
        p[at] = keep
        assert (up - down) / 2e-2 == pytest.approx(g[at], rel=0.08, abs=2e-4)


def test_quality_net_odd_rows(spark, odd, empty):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    one = spark.createDataFrame([(5, 1, 0), (None, 0, 0), (6, None, 1)], "doc_id bigint, quality int, toxic int")
    for labels in (none, one):
        net = quality_net.fit_on_labels(odd, labels)
        rows = quality_net.score_quality(odd, net, ["doc_id"]).collect()
        assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert quality_net.score_quality(empty, quality_net.fit_on_labels(empty, none), ["doc_id"]).count() == 0


def test_quality_net_passes_over_large_texts(spark, monkeypatch):
    fitted = []
    monkeypatch.setattr(quality_net, "fit", lambda texts, marks: fitted.append(sorted(texts)))
    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 5]
    for large in ids[:6]:  # one of them comes early in hash order
        docs = spark.createDataFrame([(i, "x" * 2000 if i == large else f"text {i}") for i in ids], "doc_id bigint, text string")
        labels = spark.createDataFrame([(i, 1, 0) for i in ids], "doc_id bigint, quality int, toxic int")
        quality_net.fit_on_labels(docs, labels, max_bytes=1900)
        assert fitted[-1] == sorted(f"text {i}" for i in ids if i != large)
    with pytest.raises(ValueError):
        quality_net.fit_on_labels(docs, labels, max_bytes=3)


def test_quality_net_counts_ids_once(spark, monkeypatch):
    fitted = []
    monkeypatch.setattr(quality_net, "fit", lambda texts, marks: fitted.append(len(texts)))
    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5]
    docs = spark.createDataFrame([(i, f"text {i}") for i in ids], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, 1, 0) for i in ids for _ in range(20)], "doc_id bigint, quality int, toxic int")
    quality_net.fit_on_labels(docs, labels, max_rows=100)
    assert fitted == [100]


# near duplicates


def test_signature_distance_is_guaranteed():
    rng = np.random.default_rng(3)
    for percent in (80, 85, 90):
        m = chunks_for(percent)
        for _ in range(200):
            a = rng.integers(0, 1 << 16, (1, 5 * m), dtype=np.uint16)
            b = a.copy()
            at = rng.choice(5 * m, max_errors(m), replace=False)
            b[0, at] ^= rng.integers(1, 1 << 16, len(at), dtype=np.uint16)
            assert set(chunk_keys(a)[0]) & set(chunk_keys(b)[0])
    with pytest.raises(ValueError):
        chunks_for(50)


@pytest.mark.parametrize("blocks", [(2048, 1 << 17), (8, 400)])
def test_near_duplicates_match_all_pairs(spark, monkeypatch, blocks):
    monkeypatch.setattr("flowloom.llm.minhash_join.BUCKET_BLOCK", blocks[0])
    monkeypatch.setattr("flowloom.llm.minhash_join.SHINGLE_BLOCK", blocks[1])
    rng, docs = random.Random(9), []
    for g in range(3):
        group = [words(90, 50 + g).split()]
        for _ in range(40):
            copy = list(rng.choice(group))
            for _ in range(rng.choice([0, 1, 1, 2, 6])):
                copy[rng.randrange(len(copy))] = words(1, rng.randrange(10**6))
            group.append(copy)
        docs += [" ".join(c) for c in group]
    docs += [words(rng.randint(1, 60), 700 + i) for i in range(40)]
    rng.shuffle(docs)
    for percent in (80, 85):
        got = {r[0]: tuple(r)[1:] for r in near_duplicates(spark.createDataFrame(list(enumerate(docs)), "doc_id bigint, text string"), percent).collect()}
        assert got == brute.components(list(enumerate(docs)), percent)


def test_near_duplicates_odd_rows(odd, empty):
    rows = near_duplicates(odd).collect()
    got = {}
    for r in rows:
        got.setdefault(r["doc_id"], []).append((r["n_shingles"], r["component_id"], r["kept"]))
    assert got[0] == got[0] and got[0] == [(0, 0, True)] and got[1] == [(0, 1, True)] and got[2] == [(0, 2, True)]
    assert got[3] == [(1, 3, True)] * 2 and got[4] == [(1, 3, False)]
    assert got[6][0][1] == 5 and got[7][0][1] == 5 and got[12][0][1] == 5 and sorted(got[5])[0][1:] == (5, True)
    assert len(got[None]) == 2 and all(c is None and k for _, c, k in got[None])
    assert len(rows) == odd.count() and near_duplicates(empty).count() == 0


# decontamination


def test_decontamination_odd_rows(spark, odd, empty, odd_rows):
    items = [(1, odd_rows[6][1]), (1, None), (2, ""), (3, "One-two"), (None, odd_rows[14][1]), (10, words(120, 1)), (4, "nowhere to be found")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = [tuple(r) for r in find_contamination(odd, bench).collect()]
    want = brute.contamination([r[:2] for r in odd_rows], items)
    assert sorted(got, key=str) == sorted(want, key=str)
    clean = drop_contaminated(odd, bench)
    assert clean.columns == odd.columns
    assert sorted(str(r["doc_id"]) for r in clean.collect()) == sorted(str(w[0]) for w in want if not w[5])
    nothing = spark.createDataFrame([], "item_id bigint, text string")
    assert find_contamination(odd, nothing).where("contaminated").count() == 0 and find_contamination(empty, bench).count() == 0
    assert drop_contaminated(odd, nothing).count() == odd.count()


def test_decontamination_without_broadcast(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    want = sorted(find_contamination(docs, bench).collect())
    monkeypatch.setattr("flowloom.llm.decontaminate.BROADCAST_WINDOWS", 0)
    assert sorted(find_contamination(docs, bench).collect()) == want and any(r["contaminated"] for r in want)


# secrets


def _der(tag: int, body: bytes) -> bytes:
    n = len(body)
    return bytes([tag]) + (bytes([n]) if n < 128 else bytes([0x82, n >> 8, n & 255])) + body


RSA = _der(0x30, _der(2, b"\0") + b"".join(_der(2, bytes([1]) + bytes(range(k, k + 60))) for k in range(8)))
EC = _der(0x30, _der(2, b"\1") + _der(4, bytes(range(32))))
PKCS8 = _der(0x30, _der(2, b"\0") + _der(0x30, _der(6, b"\x2a\x86\x48")) + _der(4, RSA))
OPENSSH = b"openssh-key-v1\0" + b"".join(len(x).to_bytes(4, "big") + x for x in (b"none", b"none", b"")) + (1).to_bytes(4, "big") + (8).to_bytes(4, "big") + b"12345678"


def _token(header: dict, payload: str) -> str:
    return base64.urlsafe_b64encode(json.dumps(header).encode()).decode().rstrip("=") + "." + base64.urlsafe_b64encode(payload.encode()).decode().rstrip("=") + ".c2ln"


@pytest.mark.parametrize("raw,kind", [(RSA, "der"), (EC, "der"), (PKCS8, "der"), (OPENSSH, "openssh"), (RSA[:-1], None), (bytes(60), None)])
def test_decoded_keys(raw, kind):
    for text in (base64.b64encode(raw).decode(), "\n".join(base64.b64encode(raw).decode()[i : i + 64] for i in range(0, 4 * len(raw), 64)).strip(), raw.hex()):
        found = secret_scan.confirmed_spans(f"é key {text} end")
        assert {secret_scan.KINDS[k] for _, k, _ in found} == ({kind} if kind else set())
        assert all((a, b) == (6, 6 + len(text)) for a, _, b in found)


ED25519 = _der(0x30, _der(2, b"\0") + _der(0x30, _der(6, b"\x2b\x65\x70")) + _der(4, _der(4, bytes(range(200, 232)))))
P256 = _der(0x30, _der(2, b"\0") + _der(0x30, _der(6, b"\x2a\x86\x48")) + _der(4, bytes(range(125))))  # 141 bytes: no padding


def _found(text: str) -> list[str]:
    return [text[a:b] for a, _, b in secret_scan.confirmed_spans(text)]


@pytest.mark.parametrize("raw", [ED25519, P256, RSA, EC, PKCS8, OPENSSH])
def test_keys_end_where_their_length_says(raw):
    key = base64.b64encode(raw).decode()
    for text in (f"{key}\nThe next", f"{key}\nThe\nnext\nline", f"The\n{key}\nThe next", f"{key}\r\nA"):
        assert _found(text) == [key]
    for many in (f"{key}\n{key}", f"{key}\n{key}\nword\n{key}\nThe"):
        assert _found(many) == [key] * many.count(key)
    wrapped = "\n".join(key[i : i + 64] for i in range(0, len(key), 64))
    assert _found(f"{wrapped}\n{wrapped}\nThe next") == [wrapped] * 2
    assert secret_scan.redact(f"a\n{key}\nThe next", secret_scan.confirmed_spans(f"a\n{key}\nThe next")) == "a\n[secret]\nThe next"


def _wraps(chars: str, width: int, between: str) -> str:
    return between.join(chars[i : i + width] for i in range(0, len(chars), width))


@pytest.mark.parametrize("raw,kind", [(ED25519, "der"), (P256, "der"), (RSA, "der"), (OPENSSH, "openssh")])
@pytest.mark.parametrize("width", [1, 7, 16, 60, 64, 76])
def test_wrapped_keys(raw, kind, width):
    joins = ["\n", "\r\n", "\n    ", "\n\t", "\\n", "\\r\\n", "\\\\n", "\n> ", "\n> > ", "\n# ", '\\n"\n  "', '" +\n  "', "\\\n"]
    for code, more in ((base64.b64encode, []), (base64.urlsafe_b64encode, []), (bytes.hex, [":", " ", ", 0x", "\\x", ":\n    "])):
        chars = code(raw) if code is bytes.hex else code(raw).decode()
        for between in joins + more:
            if code is bytes.hex and between in (", 0x", "\\x") and width % 2:
                continue  # such marks stand between bytes
            for given in (chars, chars.upper()) if code is bytes.hex else (chars.rstrip("="),):
                key = _wraps(given, width, between)
                for lead, trail in (("x: ", "."), ("KEY-----" + between, between + "-----END"), ("", between + "The next")):
                    text = lead + key + trail
                    assert [(secret_scan.KINDS[k], text[a:b]) for a, k, b in secret_scan.confirmed_spans(text)] == [(kind, key)], text


def test_wrapped_keys_are_redacted(spark):
    texts = [_wraps(base64.b64encode(ED25519).decode(), 16, "\n  "), _wraps(P256.hex(), 2, ":"), '{"a": "' + r"-\n" + base64.b64encode(ED25519).decode() + '"}']
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["redacted"] for r in secret_scan.scan_secrets(docs, ["doc_id"], with_text=True).collect()}
    assert got == {0: "[secret]", 1: "[secret]", 2: '{"a": "' + r"-\n" + '[secret]"}'}


def test_odd_separators_take_linear_time():
    for text in ("M" + "\\" * 200_000, "M" + '" ' * 200_000, "3" + "\\x" * 200_000, "MA\n" * 100_000, "30 " * 100_000, "MC4CAQAw\n" * 30_000):
        began = time.perf_counter()
        assert secret_scan.confirmed_spans(text) == [] and time.perf_counter() - began < 5


def test_no_key_without_its_structure():
    assert len(ED25519) % 3 == 0 and len(P256) % 3 == 0
    for raw in (ED25519[:-1], P256[:-1], bytes(48), b"\x30\x84\xff\xff\xff\xff" + bytes(60), b"\x30\x80" + bytes(60)):
        assert _found(base64.b64encode(raw).decode()) == []
    assert _found("MAIL " * 20 + "\n" + "MAIL\nof\nlines\n" * 20) == []


def test_signed_tokens():
    good = _token({"alg": "HS256", "typ": "JWT"}, '{"sub": 1}')
    assert [secret_scan.KINDS[k] for _, k, _ in secret_scan.confirmed_spans(f"bearer {good}, and")] == ["jwt"]
    for bad in (_token({"typ": "JWT"}, '{"sub": 1}'), _token({"alg": "HS256"}, "no json"), "eyJhbGciOiJIUzI1NiJ9x.abc.def"):
        assert secret_scan.confirmed_spans(bad) == []


def test_secret_patterns_match_brute():
    rng = random.Random(2)
    bits = ["password", "Passwd", "SECRET", "token", "api_key", "apikey", "=", ":", " ", '"', "'", "abcdef", "AKIA", "A" * 16, "0123456789abcdef", "é", "\n", "ſecret", "-", "K"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 14))) for _ in range(3000)]
    runs = secret_scan.with_runs(Flat(pa.array(texts)))
    for text, run in zip(texts, runs.tolist()):
        assert secret_scan.base_spans(text, run) == brute.base_spans(text)


def test_secrets_odd_rows(odd, empty):
    rows = secret_scan.scan_secrets(odd, ["doc_id"], with_text=True).collect()
    assert len(rows) == odd.count() and secret_scan.scan_secrets(empty, ["doc_id"]).count() == 0
    nothing = hashlib.sha256(b"").hexdigest()
    assert all(r["base_sha256"] == nothing and r["spans"] == "" for r in rows if r["doc_id"] != 10)
    assert [r["n_hex"] for r in rows if r["doc_id"] == 10] == [1] and [r["redacted"] for r in rows if r["doc_id"] == 10] == ["[secret]"]
    assert {r["redacted"] for r in rows if r["doc_id"] == 0} == {None}
    assert secret_scan.redact("abcdef", [(1, 0, 3), (2, 2, 4), (5, 0, 6)]) == "a[secret]e[secret]"


# sentencepiece


def test_pieces_match_the_library(odd_rows):
    import sentencepiece

    lib, model, rng = sentencepiece.SentencePieceProcessor(model_file=PIECES), PieceModel(PIECES), random.Random(4)
    bits = ["a", "b", "th", "▁", " ", "  ", "é", "é", "\x00", "\n", "😀", "汉", "0", "<s>", "<0x41>", "　", "ﷺ"]
    texts = [t for _, t, *_ in odd_rows] + ["".join(rng.choice(bits) for _ in range(rng.randint(0, 50))) for _ in range(800)]
    texts += ["".join(rng.choice("abth12é") for _ in range(400)) for _ in range(20)] + [" " * 400, "\n" * 300, "é汉" * 200]
    ids, first = model.encode(pa.array(texts, pa.string()))
    got = [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:])]
    assert got == [lib.encode(t or "") for t in texts]
    assert [t.decode() for t in model.decode(ids, first)] == [lib.decode(i) for i in got]
    free = [rng.choices(range(400), k=rng.randint(0, 12)) for _ in range(800)]
    flat, at = np.array([i for x in free for i in x]), np.concatenate([[0], np.cumsum([len(x) for x in free])])
    assert [t.decode() for t in model.decode(flat, at)] == [lib.decode(x) for x in free]


def test_encode_odd_rows(odd, empty):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rows = encode_texts(odd, PIECES, ["doc_id", "text"], with_ids=True).collect()
    assert len(rows) == odd.count() and encode_texts(empty, PIECES, ["doc_id"]).count() == 0
    for r in rows:
        ids = lib.encode(r["text"] or "", add_bos=True, add_eos=True)
        assert r["ids"] == ids and r["n_tokens"] == len(ids) and r["decoded"] == lib.decode(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(lib.decode(ids).encode()).hexdigest()


# quality rules


def test_rules_match_brute_and_order_does_not_matter(odd, empty, odd_rows):
    texts = [t for _, t, *_ in odd_rows] + ["a b c a b c d", "A!! B!! C!! " * 30, "x | y | z | " * 40]
    want = [brute.rule_counts(t) for t in texts]
    for rules in (list(quality_rules.RULES), list(quality_rules.RULES)[::-1]):
        got = quality_rules.judge(pa.array(texts, pa.string()), rules)
        assert [tuple(int(got[k][i]) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) for i in range(len(texts))] == [w[:5] for w in want]
        assert got["base_failed"].tolist() == [w[5] for w in want]
        kept = got["kept"].tolist()
        assert not kept[-1] and not kept[-2] and kept[6]
    assert quality_rules.apply_rules(odd, ["doc_id"]).count() == odd.count() and quality_rules.apply_rules(empty, ["doc_id"]).count() == 0
    assert {r.name for r in quality_rules.order_rules([])} == {r.name for r in quality_rules.RULES}


def test_cheap_selective_rules_go_first():
    import time

    slow = quality_rules.Rule("slow", lambda t, c: (time.sleep(0.01), c["n_words"] > 0)[1])
    quick = quality_rules.Rule("quick", lambda t, c: c["n_words"] > 0)
    never = quality_rules.Rule("never", lambda t, c: c["n_words"] < 0)
    assert [r.name for r in quality_rules.order_rules(["a b"] * 20, (never, slow, quick))] == ["quick", "slow", "never"]


# token counts and shards


def test_token_attribution_matches_brute():
    rng = random.Random(6)
    for _ in range(300):
        lengths = [rng.randint(1, 4) for _ in range(rng.randint(1, 12))]
        total = sum(lengths)
        cuts = sorted(rng.sample(range(total + 1), min(total + 1, rng.randint(2, 5))))
        spans = list(zip(cuts, cuts[1:]))
        for rule in ("first", "split"):
            n, cross = attribute(np.cumsum(lengths), np.array([a for a, _ in spans]), np.array([b for _, b in spans]), rule)
            want = brute.attribution(lengths, spans, rule)
            assert n.tolist() == pytest.approx([w[0] for w in want]) and cross.tolist() == [w[1] for w in want]


def test_token_counts_add_up(spark, odd, empty):
    import tiktoken  # noqa: F401
    from flowloom.llm.token_counts import load_encoding

    encoding, _ = load_encoding(RANKS, public_tokenizers.PATTERN)
    sections = "from_json('[{\"name\": \"head\", \"start\": 0, \"end\": 7}, {\"name\": \"tail\", \"start\": 9, \"end\": 1000000}, null]', 'array<struct<name:string,start:bigint,end:bigint>>')"
    for rule in ("first", "split"):
        for given in (None, "sections"):
            frame = odd.withColumn("sections", F.expr(sections)).withColumn("key", F.monotonically_increasing_id())
            rows = count_tokens(frame.withColumn("doc_id", F.col("key")), RANKS, public_tokenizers.PATTERN, rule, given).collect()
            texts = {r["key"]: r["text"] for r in frame.collect()}
            assert {r["doc_id"] for r in rows} == set(texts)
            for key, text in texts.items():
                mine = [r for r in rows if r["doc_id"] == key]
                n = len(encoding.encode_ordinary(text or ""))
                assert {r["text_tokens"] for r in mine} == {n} and sum(r["n_tokens"] for r in mine) == pytest.approx(n)
    assert count_tokens(empty, RANKS, public_tokenizers.PATTERN).count() == 0


def test_shards_keep_their_limit(spark, odd, empty, tmp_path):
    docs = spark.createDataFrame([(i, "x" * (i % 50)) for i in range(2000)] + [(5000, "y" * 3000)] + [(6000, "z" * 300)] * 5, "doc_id bigint, text string")
    rows = assign_shards(docs, 1000).collect()
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r)
    assert len(rows) == docs.count() and all(len(s) == m[0]["depth"] for s, m in by.items())
    for shard, members in by.items():
        assert sum(r["n_bytes"] for r in members) <= 1000 or len({r["doc_id"] for r in members}) == 1
        assert shard == "" or sum(r["n_bytes"] for r in rows if r["shard"].startswith(shard[:-1])) > 1000  # it had to split
    assert not any(a != b and b.startswith(a) for a in by for b in by)
    got = assign_shards(odd.withColumn("depth", F.lit("mine")), 1 << 20)
    assert got.count() == odd.count() and {r["shard"] for r in got.collect()} == {""} and assign_shards(empty, 10).count() == 0
    write_shards(docs, str(tmp_path / "shards"), 1000)
    assert spark.read.parquet(str(tmp_path / "shards")).count() == docs.count()
