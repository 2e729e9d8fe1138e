"""Flow assembly against a packet-by-packet state machine, in both plans, and the single rules."""

import random

import pytest

from flowloom.operators.flows import LEFTOVER, assemble_flows, assemble_parts, flow_extent, group_flows, group_parts, multi_packet
from flowloom.operators.packets import canonical_key, first_packets
from flowloom.schemas import PACKETS

A, B = ("10.0.0.1", 40000), ("10.0.0.2", 80)


def packet(i, t, flags=16, proto=6, a=A, b=B, file="f"):
    return (file, i, float(t), a[0], b[0], a[1], b[1], proto, flags, 60 + i)


def sequential(packets, cap, tcp=300, udp=120):
    """(flow_id, emit_at, sizes, times, dirs) one packet at a time."""
    out = []
    for name in sorted({p[0] for p in packets}):
        live = {}

        def emit(key, at):
            f = live.pop(key)
            out.append((f"{name}#{f['first']}", at, f["sizes"], f["times"], f["dirs"]))

        for _, i, t, sip, dip, sp, dp, proto, flags, size in sorted(p for p in packets if p[0] == name):
            number = [tuple(map(int, x.split("."))) for x in (sip, dip)]
            forward = (number[0], sp) <= (number[1], dp)
            key = (sip, dip, sp, dp, proto) if forward else (dip, sip, dp, sp, proto)
            if key in live and t - live[key]["times"][-1] > (tcp if proto == 6 else udp):
                emit(key, 2 * i)
            f = live.setdefault(key, {"first": i, "sizes": [], "times": [], "dirs": [], "fin": False})
            f["sizes"].append(size), f["times"].append(t), f["dirs"].append(1 if forward else -1)
            if proto == 6:
                over = bool(flags & 4) or (not flags & 1 and f["fin"] and bool(flags & 16))
                f["fin"] = f["fin"] or bool(flags & 1 and not flags & 4)
                if over or len(f["sizes"]) >= cap:
                    emit(key, 2 * i + 1)
        for key in list(live):
            emit(key, LEFTOVER + live[key]["first"])
    return sorted(out)


def whole_flows(df):
    """Parts put back together."""
    joined = {}
    for r in sorted(df.collect(), key=lambda r: (r.flow_id, r.part)):
        f = joined.setdefault(r.flow_id, (r.flow_id, r.emit_at, [], [], []))
        f[2].extend(r.pktsize), f[3].extend(r.pktts), f[4].extend(r.pktdirs)
        f_total = r.n_pkts
        assert f_total >= len(f[2])
    return sorted(joined.values())


def lengths(spark, packets, **kw):
    df = assemble_parts(spark.createDataFrame(packets, PACKETS), **kw)
    return [len(f[2]) for f in sorted(whole_flows(df), key=lambda f: int(f[0].split("#")[1]))]


@pytest.mark.parametrize("seed,cap,block", [(1, 10_000, 1 << 20), (2, 3, 10), (3, 2, 50), (4, 5, 3)])
def test_matches_state_machine(spark, seed, cap, block):
    rnd, packets = random.Random(seed), []
    for file in "ab":
        t = 0.0
        for i in range(300):
            t += rnd.choice([0, 1, 1, 100, 121, 301, -5]) if rnd.random() < 0.3 else rnd.random()
            k = rnd.choice([0, 0, 0, 0, 1, 2])
            proto = 17 if k == 1 else 6
            flags = rnd.choices([0, 1, 16, 17, 4, 2], [3, 4, 6, 1, 0.3, 1])[0] if proto == 6 else 16
            ends = [(f"9.0.0.{k}", 40000 + k), ("10.0.0.1", 80)]
            rnd.shuffle(ends)
            packets.append(packet(i, t, flags, proto, *ends, file))
    got = whole_flows(assemble_parts(spark.createDataFrame(packets, PACKETS), max_pkts=cap, block=block))
    assert got == sequential(packets, cap)
    assert sum(len(f[2]) for f in got) == len(packets)


@pytest.mark.parametrize("proto,gap,flows", [(17, 119, 1), (17, 120, 1), (17, 121, 2), (6, 299, 1), (6, 300, 1), (6, 301, 2)])
def test_idle_limit_is_strict(spark, proto, gap, flows):
    assert len(lengths(spark, [packet(0, 0, 24, proto), packet(1, gap, 24, proto)])) == flows


@pytest.mark.parametrize(
    "flags,expected",
    [
        ([4, 24], [1, 1]),
        ([1, 16, 24], [2, 1]),
        ([1, 17, 16, 24], [3, 1]),
        ([1, 2, 16, 24], [3, 1]),
        ([16, 1, 24, 24], [3, 1]),
        ([1, 20, 24], [2, 1]),
    ],
)
def test_teardown(spark, flags, expected):
    assert lengths(spark, [packet(i, i, f) for i, f in enumerate(flags)]) == expected
    assert lengths(spark, [packet(i, i, f, 17) for i, f in enumerate(flags)]) == [len(flags)]


def test_length_cap_forgets_fin(spark):
    """The cap falls between FIN and ACK: the ACK closes nothing."""
    packets = [packet(i, i, 24) for i in range(3)] + [packet(3, 3, 1), packet(4, 4, 16), packet(5, 5, 24)]
    assert lengths(spark, packets, max_pkts=4, block=2) == [4, 2]


@pytest.mark.parametrize("cycle", [[1, 2, 2, 16], [1, 2, 16, 2, 2]])
def test_many_overruled_closes_take_few_jobs(spark, monkeypatch, cycle):
    """Teardowns that the cap overrules one after the other: the number of checkpoints does not grow with them."""
    from flowloom.operators import flows

    calls = []
    cut = flows.cut_lineage
    monkeypatch.setattr(flows, "cut_lineage", lambda df: calls.append(1) or cut(df))
    packets = [packet(i, i, cycle[i % len(cycle)]) for i in range(len(cycle) * 400)]
    for block in (100, 1 << 20):
        calls.clear()
        got = whole_flows(assemble_parts(spark.createDataFrame(packets, PACKETS), max_pkts=3, block=block))
        assert got == sequential(packets, 3) and len(calls) <= 14


def test_begins_of_many_blocks(spark):
    """The scan over block tables against one walk along them."""
    import random

    from flowloom.operators.flows import _block_begins

    rnd, cap, tables = random.Random(3), 5, []
    for segment, blocks in ((0, 4096), (1, 1), (2, 9)):
        tables += [(segment, b, 3, [rnd.choice([-1, -1, 10 * b + rnd.randrange(10)]) for _ in range(cap)]) for b in range(blocks)]
    df = spark.createDataFrame(tables, "_seg_rn bigint, blk bigint, begin bigint, table array<bigint>").repartition(4)
    got = {(r["_seg_rn"], r.blk): r.begin for r in _block_begins(df, ["_seg_rn"], "_seg_rn bigint, blk bigint", cap).collect()}
    expected, at = {}, None
    for segment, b, begin, table in tables:
        at = begin if b == 0 else at
        expected[segment, b] = at
        at = table[at % cap] if table[at % cap] >= 0 else at
    assert got == expected


def test_real_cap_tcp_only(spark):
    packets = [packet(i, i * 0.001, 24) for i in range(10_001)]
    assert lengths(spark, packets) == [10_000, 1]
    udp = spark.createDataFrame([packet(i, i * 0.001, 0, 17) for i in range(10_001)], PACKETS)
    df = assemble_parts(udp)
    rows = sorted(df.collect(), key=lambda r: r.part)
    assert [(r.part, len(r.pktsize), r.n_pkts) for r in rows] == [(0, 10_000, 10_001), (1, 1, 10_001)]
    assert flow_extent(df).first().pktts_end == 10.0
    one = assemble_flows(udp).collect()
    assert [(r.part, len(r.pktsize), r.n_pkts, r.pktts_end) for r in one] == [(0, 10_000, 10_001, 10.0)]
    assert multi_packet(assemble_flows(udp)).count() == 1


def test_flows_stay_in_their_file(spark):
    assert len(lengths(spark, [packet(0, 0, file="a"), packet(1, 1, file="b")])) == 2


def test_capture_order_not_time_order(spark):
    assert lengths(spark, [packet(0, 1000), packet(1, 0), packet(2, 301)]) == [2, 1]


def test_key_order_numeric_and_text(spark):
    df = spark.createDataFrame([packet(0, 0, a=("9.0.0.1", 5), b=("10.0.0.1", 5))], PACKETS)
    assert canonical_key(df).first().srcip == "9.0.0.1"
    row = canonical_key(df, "text").first()
    assert (row.srcip, row["dir"]) == ("10.0.0.1", -1)


def test_group_flows_in_parts(spark):
    df = spark.createDataFrame([packet(i, i) for i in range(10)], PACKETS)
    for block in (3, 1 << 20):
        parts = sorted(group_parts(df, max_pkts=4, block=block).collect(), key=lambda r: r.part)
        assert [(r.part, len(r.pktsize), r.n_pkts) for r in parts] == [(0, 4, 10), (1, 4, 10), (2, 2, 10)]
        flows = group_flows(df, max_pkts=4, block=block).collect()
        assert [(r.part, r.pktts, r.n_pkts, r.pktts_end) for r in flows] == [(0, [0.0, 1.0, 2.0, 3.0], 10, 9.0)]
    assert first_packets(df, 3).count() == 3


def test_registered_parts_hold_every_packet(spark, monkeypatch, tmp_path):
    """10,001 packets of one UDP conversation: all of them in the registered part queries and in the store."""
    from flowloom.plans import oracles, queries
    from flowloom.sources.store import read_parts, with_day, write_parts

    udp = spark.createDataFrame([packet(i, i * 0.001, 0, 17, file="Friday-02-03-2018/x") for i in range(10_001)], PACKETS)
    monkeypatch.setattr(queries, "packet_view", lambda *_: udp)
    for name in ("flow_assembly_parts", "flow_group_parts"):
        rows = queries.QUERIES[name](spark, "").collect()
        assert sorted((r.part, len(r.sizes.split(","))) for r in rows) == [(0, 10_000), (1, 1)] and name in oracles.ORACLES
    write_parts(with_day(assemble_parts(udp)).drop("capture_date"), str(tmp_path / "flows"))
    got = read_parts(spark, str(tmp_path / "flows"), "Friday-02-03-2018").collect()
    assert sorted((r.part, len(r.pktsize)) for r in got) == [(0, 10_000), (1, 1)]
