"""Files written by the tests themselves, read back."""

import gzip
import re
import struct
from datetime import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from flowloom.functions.similarity import jaro_winkler_batch
from flowloom.operators.stats import clean_stats, disable
from flowloom.plans.written import _frame, mixed_stats_dir, stats_dir
from flowloom.schemas import STATS_FIELDS
from flowloom.sources.files import list_files
from flowloom.sources.flow_stats import read_flow_stats
from flowloom.sources.packet_csv import read_packet_csv
from flowloom.sources.pcap import read_pcap
from flowloom.sources.sequences import read_sequences
from flowloom.sources.store import materialise, read_flows, with_day, write_flows

FRAMES = [
    _frame("10.0.0.1", "10.0.0.2", 1234, 80, 6, 2, 60),
    bytes(12) + b"\x08\x06" + bytes(28),
    _frame("10.0.0.2", "10.0.0.1", 53, 999, 17, 0, 80),
    _frame("10.0.0.1", "10.0.0.2", 1234, 80, 6, 16, 60)[:40],
    bytes(12) + b"\x81\x00\x00\x05" + _frame("10.0.0.3", "10.0.0.4", 7, 8, 6, 24, 60)[12:],
]


def classic(order="<"):
    out = struct.pack(order + "IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1)
    for i, f in enumerate(FRAMES):
        out += struct.pack(order + "IIII", 100 + i, 250000, len(f), len(f)) + f
    return out


def next_generation():
    def block(kind, body):
        size = 12 + len(body) + (-len(body) % 4)
        return struct.pack("<II", kind, size) + body + bytes(-len(body) % 4) + struct.pack("<I", size)

    out = block(0x0A0D0D0A, struct.pack("<IHHq", 0x1A2B3C4D, 1, 0, -1)) + block(1, struct.pack("<HHI", 1, 0, 0))
    for i, f in enumerate(FRAMES):
        ticks = (100 + i) * 10**6 + 250000
        out += block(6, struct.pack("<IIIII", 0, ticks >> 32, ticks & 0xFFFFFFFF, len(f), len(f)) + f)
    return out


@pytest.mark.parametrize("content", [classic("<"), classic(">"), next_generation()])
def test_captures(spark, tmp_path, content):
    day = tmp_path / "Friday-16-02-2018" / "pcap"
    day.mkdir(parents=True)
    (day / "x.pcap").write_bytes(content)
    (day / "notes.txt").write_text("not a capture")
    (day / "cut.pcap").write_bytes(classic()[:50])
    df = with_day(read_pcap(spark, str(tmp_path), range_bytes=100))
    rows = sorted(r for r in df.collect() if r.src_file.endswith("x.pcap"))
    assert [(r.pkt_idx, r.ts, r.src_ip, r.src_port, r.dst_port, r.proto, r.flags, r.size) for r in rows] == [
        (0, 100.25, "10.0.0.1", 1234, 80, 6, 2, 60),
        (2, 102.25, "10.0.0.2", 53, 999, 17, 0, 80),
        (4, 104.25, "10.0.0.3", 7, 8, 6, 24, 64),
    ]
    assert {str(r.capture_date) for r in rows} == {"2018-02-16"}
    assert read_pcap(spark, str(day / "x.pcap"), max_packets=2).count() == 1


def test_packet_csv(spark, tmp_path):
    (tmp_path / "p.csv").write_text('"60","1.1.1.1","2.2.2.2","80","1234","",""\n"70","1.1.1.1","2.2.2.2","","","53","99"\n')
    rows = read_packet_csv(spark, str(tmp_path)).orderBy("size").collect()
    assert [(r["size"], r.src_port, r.dst_port, r.proto) for r in rows] == [(60, 80, 1234, 6), (70, 53, 99, 17)]


@pytest.mark.parametrize("dialect", ["A", "B"])
def test_flow_stats(spark, tmp_path, dialect):
    names = [f[0 if dialect == "A" else 1] for f in STATS_FIELDS]
    header = ",".join(["Extra"] + names)
    row = lambda label: ",".join(["x", *("Infinity" if f[2] == "double" else "3" for f in STATS_FIELDS[:-1]), label])
    short = ",".join(["x", "5", "6"])
    (tmp_path / "s.csv").write_text("\n".join([header, row("a"), header, row("b"), row("c") + ",1,2", short]) + "\n")
    df = read_flow_stats(spark, str(tmp_path / "s.csv"), dialect)
    assert [t for _, t in df.dtypes] == [f[2] for f in STATS_FIELDS] and df.columns == [f[0] for f in STATS_FIELDS]
    assert sorted(str(r.Label) for r in df.collect()) == ["None", "a", "b"]
    clean = clean_stats(df)
    assert "Label" not in clean.columns and clean.where("`Flow Byts/s` = -1").count() == 3
    assert disable(clean, ["Protocol"]).columns == [c for c in clean.columns if c != "Protocol"]
    with pytest.raises(ValueError):
        disable(clean, ["nope"])


def test_sequences(spark, tmp_path):
    (tmp_path / "x.data").write_text("1 2 3\n1 2 3 4\n9 8 7 6 5\n")
    (tmp_path / "x.label").write_text("\n010\n")
    rows = sorted(read_sequences(spark, str(tmp_path)).collect(), key=lambda r: r.line_no)
    assert [(r.stem, r.line_no, r["items"], r.label) for r in rows] == [("x", 1, [1, 2, 3, 4], 1), ("x", 2, [9, 8, 7, 6, 5], 0)]


def test_equal_stems_in_two_folders(spark, tmp_path):
    for folder, label in (("x", "0"), ("y", "1")):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "k.data").write_text("1 2 3 4\n")
        (tmp_path / folder / "k.label").write_text(f"   \n{label}\n")
    rows = read_sequences(spark, str(tmp_path)).collect()
    assert sorted((r.folder[-2:], r.label) for r in rows) == [("x/", 0), ("y/", 1)]


def test_labels_are_not_broadcast(spark, tmp_path):
    """A label is a byte in its file and a row once read: the file's size says nothing about the rows."""
    (tmp_path / "x.data").write_text("1 2 3 4\n" * 50)
    (tmp_path / "x.label").write_text("01" * 25 + "\n")
    df = read_sequences(spark, str(tmp_path))
    assert df.count() == 50 and df.where("label = line_no % 2").count() == 50
    joins = [line for line in df._jdf.queryExecution().sparkPlan().toString().splitlines() if "Join [folder" in line]
    assert len(joins) == 1 and "SortMergeJoin" in joins[0]


def test_statistics_files_each_have_their_own_header(spark, tmp_path):
    names = [f[0] for f in STATS_FIELDS]
    values = {n: str(i) for i, n in enumerate(names)} | {"Timestamp": "t", "Label": "own", "Extra": "e"}
    headers = {"plain": names, "reversed": names[::-1], "wider": ["Extra", "Extra", "Extra", *names], "empty": None}
    for name, header in headers.items():
        lines = [",".join(header), ",".join(values[n] for n in header), ",".join(header)] if header else []
        (tmp_path / f"{name}.csv").write_text("".join(x + "\r\n" for x in lines))
    rows = read_flow_stats(spark, str(tmp_path)).collect()
    assert len(rows) == 3 and len(set(rows)) == 1 and rows[0]["Dst Port"] == 0 and rows[0]["Label"] == "own" and rows[0]["Protocol"] == 1


def test_compressed_and_quoted_statistics_files(spark, tmp_path):
    names = [f[0] for f in STATS_FIELDS]
    plain = ["5"] * (len(names) - 1)
    lines = [names, plain + ["a"], names, plain + ['"b,c"'], plain + ["d", "1"], plain + ['"e"', "1"], plain[:3], plain + [""], plain + ['""']]
    (tmp_path / "s.csv.gz").write_bytes(gzip.compress("".join(",".join(x) + "\n" for x in lines).encode()))
    rows = read_flow_stats(spark, str(tmp_path)).collect()
    assert sorted(str(r.Label) for r in rows) == ["None", "None", "None", "a", "b,c"] and {r["Dst Port"] for r in rows} == {5}
    # a second header: the folder is read file by file
    (tmp_path / "t.csv.gz").write_bytes(gzip.compress((",".join(names[::-1]) + "\n" + ",".join(['"f,g"', *plain]) + "\n").encode()))
    rows = read_flow_stats(spark, str(tmp_path)).collect()
    assert sorted(str(r.Label) for r in rows) == ["None", "None", "None", "a", "b,c", "f,g"]


def test_statistics_lines_are_written_small(spark, tmp_path):
    """A statistics folder takes less room than its lines do as text, and no file is more than a task's work."""
    li = [(i, i * 7, i * 3, i % 7, float(i % 50), i * 1.25, 0.05, 0.02, "A", datetime(1996, 1, 1)) for i in range(3000)]
    cols = "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_shipdate timestamp"
    spark.createDataFrame(li, cols).coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    for folder in (stats_dir(spark, str(tmp_path), "A"), mixed_stats_dir(spark, str(tmp_path), "B")):
        files = [f for f in list_files(spark, folder).collect() if "/part-" in f.path]
        text = spark.read.option("recursiveFileLookup", "true").text(folder).agg(F.sum(F.length("value") + 1)).first()[0]
        assert text > 3000 * 160 and sum(f.length for f in files) * 5 < text
    assert read_flow_stats(spark, stats_dir(spark, str(tmp_path), "A"), "A").count() == 3000


def test_statistics_lines_are_cut_once(spark, tmp_path):
    names = [f[0] for f in STATS_FIELDS]
    (tmp_path / "a.csv").write_text(",".join(names) + "\n" + ",".join(["1"] * len(names)) + "\r" + ",".join(["2"] * len(names)) + "\r\n")
    for file, count in ((None, 2), ("b.csv", 3)):  # one header; two of them
        if file:
            (tmp_path / file).write_text(",".join(names[::-1]) + "\n" + ",".join(["3"] * len(names)) + "\n")
        df = read_flow_stats(spark, str(tmp_path)).select("Dst Port", "Label")
        assert sorted(map(tuple, df.collect())) == [(i + 1, str(i + 1)) for i in range(count)]
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("ELSE split(value") == 1 and not re.search(r"size\(split\([^)]*\), false\) <=", plan)


def test_statistics_folders_hold_all_fields_of_all_line_items(spark, tmp_path, monkeypatch):
    """Line numbers below 0, null or large, null cells, and no rows at all; the table is read once, whatever its headers, and files hold at most ``LINES`` lines."""
    from flowloom.plans import written

    monkeypatch.setattr(written, "LINES", 30)
    cols = "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_shipdate timestamp"
    li = [
        (i, i * 7, i * 3, [None, -130, -60, -1, 0, 7, 99, 10**6][i % 8], float(i % 50), i * 1.25, 0.05, 0.02 if i % 3 else None, "A" if i % 5 else None, datetime(1996, 1, 1) if i % 11 else None)
        for i in range(400)
    ]
    seen = spark.sparkContext.accumulator(0)

    def counting(batches):
        for pdf in batches:
            seen.add(len(pdf))
            yield pdf

    monkeypatch.setattr(written, "table", lambda spark, sf, name: spark.createDataFrame(li, cols).mapInPandas(counting, cols) if "full" in sf else spark.createDataFrame([], cols))
    rem = lambda a, b: a - b * int(a / b)
    want = []
    for _, part, supp, no, quantity, price, discount, tax, flag, day in li:
        row = {f[0]: None if no is None else rem(no + i, 50) for i, f in enumerate(STATS_FIELDS)}
        row |= {"Dst Port": supp % 65536, "Flow Duration": round(price * 100), "Tot Fwd Pkts": int(quantity), "Fwd Pkt Len Mean": discount, "Idle Min": tax if part % 4 else None}
        row |= {"Flow Byts/s": quantity if part % 9 else float("inf"), "Timestamp": day and day.strftime("%d/%m/%Y %H:%M:%S"), "Label": flag and f"flag {flag}"}
        want.append(tuple(float(row[n]) if kind == "double" and row[n] is not None else row[n] for n, _, kind in STATS_FIELDS))
    for name, folder, kinds in (("mixed", mixed_stats_dir, 3), ("plain", stats_dir, 1)):
        before = seen.value
        path = folder(spark, str(tmp_path / f"full_{name}"), "A")
        assert seen.value - before == len(li)
        files = [f.path.removeprefix("file:") for f in list_files(spark, path).collect() if "/part-" in f.path]
        lines = [gzip.open(f, "rt").read().splitlines() for f in files]
        assert len({x[0] for x in lines}) == kinds and max(map(len, lines)) == 31
        assert sum(len(x) - 1 for x in lines) == len(li) + (2 if kinds == 1 else 0)
        assert sorted(map(str, map(tuple, read_flow_stats(spark, path).collect()))) == sorted(map(str, want))
        assert read_flow_stats(spark, folder(spark, str(tmp_path / f"no_{name}"), "A")).count() == 0


def test_captures_are_decoded_by_many_tasks(spark, tmp_path):
    from pyspark.sql import functions as F

    for i in range(40):
        (tmp_path / f"{i}.pcap").write_bytes(classic())
    df = read_pcap(spark, str(tmp_path))
    used = df.select(F.spark_partition_id().alias("p")).distinct().count()
    assert used >= spark.sparkContext.defaultParallelism - 1 and df.count() == 120


def test_store(spark, tmp_path):
    df = spark.createDataFrame([("d1", 1), ("d2", 2)], "day string, n int")
    write_flows(df, str(tmp_path / "flows"))
    assert read_flows(spark, str(tmp_path / "flows"), "d2").first().n == 2
    path = str(tmp_path / "once")
    materialise(df, path)
    assert materialise(df.limit(1), path).count() == 2
    assert materialise(df.where("n = 1"), path, reprocess=True).count() == 1


def test_jaro_winkler_known_values():
    import pandas as pd

    words = [("martha", "marhta", 0.9611), ("dixon", "dicksonx", 0.8133), ("abc", "xyz", 0.0), ("a", "a", 1.0)]
    code = lambda w: [float(ord(c)) for c in w]
    got = jaro_winkler_batch(pd.Series([code(a) for a, _, _ in words]), pd.Series([code(b) for _, b, _ in words]))
    assert np.allclose(got, [w[2] for w in words], atol=1e-4)


def test_jaro_winkler_ways_agree():
    """Long lists go one by one, in a batch with short ones; both ways give the same values."""
    from flowloom.functions import similarity as S

    rng = np.random.default_rng(2)
    pairs = [(rng.integers(0, 4, rng.integers(0, 60)).astype(float), rng.integers(0, 4, rng.integers(0, 60)).astype(float)) for _ in range(200)]
    left, right = pd.Series([a for a, _ in pairs]), pd.Series([b for _, b in pairs])
    each = [S._long_row(a, b) if len(a) or len(b) else 1.0 for a, b in pairs]
    assert np.allclose(jaro_winkler_batch(left, right), each)
    left.loc[len(left)] = right.loc[len(right)] = np.arange(10_000) % 977.0
    got = jaro_winkler_batch(left, right)
    assert got[-1] == 1.0 and np.allclose(got[:-1], each)


def test_value_lists_are_laid_out_once():
    """A batch is one array of values: classes of rows are cut out of it, short ones padded, and single rows are views."""
    from flowloom.functions.similarity import _Lists

    lists = _Lists(pd.Series([np.array([1, 2, 3]), [], [4.0], np.array([5, None], object)]))
    padded, length = lists.padded(np.array([2, 0, 1]))
    assert length.tolist() == [1, 3, 0] and np.isnan(padded).tolist() == [[False, True, True], [False] * 3, [True] * 3]
    assert np.nan_to_num(padded).tolist() == [[4, 0, 0], [1, 2, 3], [0, 0, 0]]
    assert lists.one(0).tolist() == [1, 2, 3] and lists.one(0).base is lists.values and np.isnan(lists.one(3)[1])


def test_tables_stored_by_server_need_no_shuffle(spark, tmp_path):
    from flowloom.operators.sampling import server_groups
    from flowloom.sources.store import write_by_server

    rows = [(f"s{i % 7}", i % 3, f"c{i % 5}", f"f{i}", i % 4, int(i % 11 == 0)) for i in range(300)]
    df = spark.createDataFrame(rows, "server_ip string, server_port int, client_ip string, flow_id string, cluster_id bigint, y int")
    stored = write_by_server(df, "by_server_test", str(tmp_path / "t"), 4)
    large = server_groups(stored, ["server_ip", "server_port"], 14, malicious=True)
    plan = large._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "SelectedBucketsCount: 4" in plan.replace(" out of 4", "")
    assert 0 < large.count() < 300
    assert sorted(map(tuple, large.collect())) == sorted(map(tuple, server_groups(df, ["server_ip", "server_port"], 14, malicious=True).collect()))
    spark.sql("DROP TABLE by_server_test")


def test_addresses_of_many_users_fit_a_capture(spark):
    """The packets view counts on beyond 255 in the third place; a capture holds such an address, and its name comes back."""
    from pyspark.sql import functions as F

    from flowloom.plans.written import _address, _frame, view_name

    names = ["18.219.0.0", "18.219.359.249", "18.219.9000.7", "172.31.69.2", "172.31.669.49", "172.31.5000.0"]
    numbers = [_address(n) for n in names]
    assert len(set(numbers)) == len(names) and len(_frame(names[1], names[4], 40000, 80, 6, 16, 60)) == 60
    ips = [".".join(str(n >> s & 255) for s in (24, 16, 8, 0)) for n in numbers]
    rows = spark.createDataFrame([(i, ip) for i, ip in enumerate(ips)], "i int, ip string").withColumn("name", view_name(F.col("ip")))
    assert [r.name for r in rows.orderBy("i").collect()] == names
