"""Packets to two-way flows.

``assemble_flows`` cuts a conversation on an idle gap, on RST, on the first bare ACK after FIN, and (TCP)
at ``max_pkts`` packets, in capture order inside one file. Two plans share the work:

* conversations shorter than ``max_pkts`` (nearly all): one shuffle on (file, conversation), then windows
  that share that partitioning and sort, then the grouping on the same partitioning;
* long conversations, one of which may hold a large part of all packets: capture order is cut into blocks
  of ``block`` packets, every window runs inside one block, and a small per-block summary carries the
  state across blocks. No task ever holds more than one block of one conversation.

The flow table has one row per flow. Its arrays hold the first ``max_pkts`` packets, which are all but for UDP, where
no cap cuts a flow; counts and extent are those of the whole flow. ``assemble_parts`` and ``group_parts`` give the
packets beyond too, as rows ``part`` 1, 2, ... that repeat the flow-level columns.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowloom.operators.packets import canonical_key, only_tcp_udp
from flowloom.schemas import ACK, FIN, MAX_PACKETS, RST, TCP, TCP_IDLE, UDP_IDLE
from flowloom.session import broadcast_if_small, cut_lineage

KEY = ["src_file", "srcip", "dstip", "srcport", "dstport", "proto"]
BLOCK = 1 << 20
# Flows still open at the end of a file come out after all others, by first packet.
LEFTOVER = 1 << 60
# Block tables that one task composes.
FAN = 8

FLOW_COLUMNS = [
    "flow_id", "src_file", "srcip", "dstip", "srcport", "dstport", "proto", "part", "n_pkts",
    "pktsize", "pktts", "pktdirs", "pktts_start", "pktts_end", "emit_at",
]


def _teardown_class() -> Column:
    """R, F or A for a TCP packet (in this order of precedence), null otherwise."""
    flags = F.col("flags")
    kind = (
        F.when(flags.bitwiseAND(RST) != 0, "R").when(flags.bitwiseAND(FIN) != 0, "F").when(flags.bitwiseAND(ACK) != 0, "A")
    )
    return F.when(F.col("proto") == TCP, kind)


def _new_segment(prev_ts: Column, prev_cls: Column, tcp_timeout: float, udp_timeout: float) -> Column:
    """A packet that cannot belong to the flow before it: first of its key, after a gap, or after RST."""
    limit = F.when(F.col("proto") == TCP, F.lit(float(tcp_timeout))).otherwise(F.lit(float(udp_timeout)))
    return prev_ts.isNull() | (F.col("ts") - prev_ts > limit) | F.coalesce(prev_cls == "R", F.lit(False))


def _arrays(rows: DataFrame, by: list[str], *extra: Column) -> DataFrame:
    """Collect packets of one bounded group into parallel arrays in capture order."""
    got = rows.groupBy(*by).agg(
        F.sort_array(F.collect_list(F.struct("pkt_idx", "ts", "size", "dir"))).alias("_p"), *extra
    )
    return got.withColumns(
        {
            "pktsize": F.col("_p.size").cast("array<int>"),
            "pktts": F.col("_p.ts"),
            "pktdirs": F.col("_p.dir"),
        }
    )


def _flow_id(first_idx: Column) -> Column:
    return F.concat(F.col("src_file"), F.lit("#"), first_idx.cast("string"))


def assemble_flows(packets: DataFrame, **options) -> DataFrame:
    """Flows of every capture file, one row each, with the arrays of the first part; ``options`` as for ``assemble_parts``."""
    return first_part(assemble_parts(packets, **options))


def assemble_parts(
    packets: DataFrame,
    tcp_timeout: float = TCP_IDLE,
    udp_timeout: float = UDP_IDLE,
    max_pkts: int = MAX_PACKETS,
    block: int = BLOCK,
    ip_order: str = "numeric",
) -> DataFrame:
    """Packet parts of the flows of every capture file, with idle, teardown and length cuts.

    Counts packets per conversation first (an aggregate over the key columns alone) to learn which
    conversations are long. With none, the plan has a single shuffle of the packets.
    """
    rows = canonical_key(only_tcp_udp(packets), ip_order).select(
        *KEY, "pkt_idx", "ts", "size", "dir", _teardown_class().alias("cls")
    )
    long_keys = cut_lineage(rows.groupBy(*KEY).count().where(F.col("count") >= max_pkts).select(*KEY))
    if long_keys.isEmpty():
        return _short_conversations(rows, tcp_timeout, udp_timeout)
    long_keys = broadcast_if_small(long_keys)
    return _short_conversations(rows.join(long_keys, KEY, "left_anti"), tcp_timeout, udp_timeout).unionByName(
        _long_conversations(rows.join(long_keys, KEY, "left_semi"), tcp_timeout, udp_timeout, max_pkts, block)
    )


def _short_conversations(rows: DataFrame, tcp_timeout: float, udp_timeout: float) -> DataFrame:
    w = W.partitionBy(*KEY).orderBy("pkt_idx")
    seen, before = w.rowsBetween(W.unboundedPreceding, 0), w.rowsBetween(W.unboundedPreceding, -1)
    idx, cls = F.col("pkt_idx"), F.col("cls")
    mark = F.when(cls.isin("F", "A"), F.struct(idx.alias("idx"), cls.alias("cls")))
    marked = rows.withColumns(
        {
            "_pts": F.lag("ts").over(w),
            "_pcls": F.lag("cls").over(w),
            "_mark": F.last(mark, ignorenulls=True).over(before),
            "_next": F.lead("pkt_idx").over(w),
        }
    ).withColumn("_hard", _new_segment(F.col("_pts"), F.col("_pcls"), tcp_timeout, udp_timeout))
    marked = marked.withColumn("_seg", F.last(F.when(F.col("_hard"), idx), ignorenulls=True).over(seen))
    marked = marked.withColumn(
        "_close",
        F.coalesce((cls == "A") & (F.col("_mark.cls") == "F") & (F.col("_mark.idx") >= F.col("_seg")), F.lit(False)),
    )
    marked = marked.withColumn("_new", F.col("_hard") | F.coalesce(F.lag("_close").over(w), F.lit(False)))
    marked = marked.withColumn("_start", F.last(F.when(F.col("_new"), idx), ignorenulls=True).over(seen))
    closed = F.col("_close") | F.coalesce(cls == "R", F.lit(False))
    emit = (
        F.when(closed, idx * 2 + 1).when(F.col("_next").isNotNull(), F.col("_next") * 2).otherwise(F.col("_start") + LEFTOVER)
    )
    flows = _arrays(
        marked.withColumn("_emit", emit),
        KEY + ["_start"],
        F.max("_emit").alias("emit_at"),
        F.min("ts").alias("pktts_start"),
        F.max("ts").alias("pktts_end"),
        F.count(F.lit(1)).alias("n_pkts"),
    )
    return flows.withColumns({"flow_id": _flow_id(F.col("_start")), "part": F.lit(0).cast("bigint")}).select(*FLOW_COLUMNS)


def _running(rows: DataFrame, key: list[str], carried: dict[str, Column], inclusive: bool = True) -> DataFrame:
    """Running last non-null value of each expression along pkt_idx, for keys too long for one window.

    The window covers one block; the last value of every earlier block arrives through a summary with
    one row per (key, block).
    """
    w = W.partitionBy(*key, "blk").orderBy("pkt_idx").rowsBetween(W.unboundedPreceding, 0 if inclusive else -1)
    lasts = rows.groupBy(*key, "blk").agg(
        *[F.max(F.when(e.isNotNull(), F.struct("pkt_idx", e.alias("v")))).alias(n) for n, e in carried.items()]
    )
    over = W.partitionBy(*key).orderBy("blk").rowsBetween(W.unboundedPreceding, -1)
    carry = lasts.select(
        *key, "blk", *[F.last(F.col(n), ignorenulls=True).over(over)["v"].alias(f"_c_{n}") for n in carried]
    )
    inside = rows.withColumns({n: F.last(e, ignorenulls=True).over(w) for n, e in carried.items()})
    joined = inside.join(carry, key + ["blk"], "left")
    return joined.withColumns({n: F.coalesce(F.col(n), F.col(f"_c_{n}")) for n in carried}).drop(
        *[f"_c_{n}" for n in carried]
    )


def _neighbours(rows: DataFrame, key: list[str]) -> DataFrame:
    """Previous packet (_pts, _pcls), next index (_next) and position in the key (_rn), across blocks."""
    w = W.partitionBy(*key, "blk").orderBy("pkt_idx")
    ends = rows.groupBy(*key, "blk").agg(
        F.max(F.struct("pkt_idx", "ts", "cls")).alias("tail"),
        F.min("pkt_idx").alias("head"),
        F.count(F.lit(1)).alias("n"),
    )
    along = W.partitionBy(*key).orderBy("blk")
    ends = ends.select(
        *key,
        "blk",
        F.lag("tail").over(along).alias("_tail"),
        F.lead("head").over(along).alias("_head"),
        F.coalesce(F.sum("n").over(along.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_n"),
    )
    inside = rows.withColumns(
        {
            "_prev": F.lag(F.struct("ts", "cls")).over(w),
            "_next": F.lead("pkt_idx").over(w),
            "_rn": F.row_number().over(w),
        }
    ).join(ends, key + ["blk"], "left")
    return inside.withColumns(
        {
            "_pts": F.coalesce(F.col("_prev.ts"), F.when(F.col("_prev").isNull(), F.col("_tail.ts"))),
            "_pcls": F.when(F.col("_prev").isNull(), F.col("_tail.cls")).otherwise(F.col("_prev.cls")),
            "_next": F.coalesce(F.col("_next"), F.col("_head")),
            "_rn": F.col("_rn") + F.col("_n") - 1,
        }
    ).drop("_prev", "_tail", "_head", "_n")


def _overruled_closes(rows: DataFrame, key: list[str], max_pkts: int) -> DataFrame | None:
    """Teardowns that do not happen because the length cap cut the flow between its last FIN and that ACK.

    The cap forgets the FIN, so the flow runs on, and where its next cut falls depends on where it began, modulo the
    cap. Only closes of segments with at least one such case are looked at. Each block of closes is folded into a table
    "begin modulo cap -> begin after the block", the tables of a segment are composed by a scan over its blocks, and each
    block is gone through once more from its known begin.
    """
    closes = rows.where("_close").select(
        *key, "_seg_rn", "blk", "pkt_idx", "_rn", F.col("_mark.rn").alias("fin_rn"), F.col("_start0.rn").alias("begin")
    )
    cut = F.pmod(F.col("_rn") - F.col("begin"), F.lit(max_pkts)) < F.col("_rn") - F.col("fin_rn")
    segments = cut_lineage(closes.where(cut).select(*key, "_seg_rn").distinct())
    if segments.isEmpty():
        return None
    state = cut_lineage(closes.join(segments, key + ["_seg_rn"], "left_semi"))
    segment = key + ["_seg_rn"]
    kinds = ", ".join(f"{c} {state.schema[c].dataType.simpleString()}" for c in segment + ["blk"])

    def fold(names: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        table = np.full(max_pkts, -1, np.int64)  # -1: the begin passes through
        for rn, fin in pdf.sort_values("_rn", ascending=False)[["_rn", "fin_rn"]].itertuples(index=False):
            if rn - fin < max_pkts:
                follows = table[(rn + 1) % max_pkts]
                closing = np.ones(max_pkts, bool)
                closing[np.arange(fin + 1, rn + 1) % max_pkts] = False
                table[closing] = rn + 1 if follows < 0 else follows
        return pd.DataFrame([[*names, pdf.loc[pdf["_rn"].idxmin(), "begin"], table]], columns=[*segment, "blk", "begin", "table"])

    def replay(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_rn")
        begin, void = int(pdf["block_begin"].iloc[0]), []
        for rn, fin in pdf[["_rn", "fin_rn"]].itertuples(index=False):
            void.append((rn - begin) % max_pkts < rn - fin)
            begin = begin if void[-1] else rn + 1
        return pdf.loc[void, [*key, "pkt_idx"]].assign(_void=True)

    tables = state.groupBy(*segment, "blk").applyInPandas(fold, f"{kinds}, begin bigint, table array<bigint>")
    begins = _block_begins(cut_lineage(tables), segment, kinds, max_pkts).withColumnRenamed("begin", "block_begin")
    known = state.join(begins, segment + ["blk"])
    out = ", ".join(f"{c} {state.schema[c].dataType.simpleString()}" for c in key + ["pkt_idx"])
    return known.groupBy(*segment, "blk").applyInPandas(replay, f"{out}, _void boolean")


def _block_begins(tables: DataFrame, segment: list[str], kinds: str, max_pkts: int) -> DataFrame:
    """Where the flow that is open at the start of each block began: (segment, blk, begin).

    A scan in rounds: going up, the tables of ``FAN`` neighbouring blocks are composed to one; going down, the begin of a
    run of blocks gives those of its parts. A task holds at most ``FAN`` tables, and the rounds grow with the logarithm of
    the number of blocks.
    """

    def after(table: np.ndarray, begin: int) -> int:
        to = int(table[begin % max_pkts])
        return to if to >= 0 else begin

    def compose(names: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("blk")
        first, *later = pdf["table"]
        whole = np.array(first)
        for table in later:
            table = np.asarray(table)
            follows = table[np.where(whole >= 0, whole, np.arange(max_pkts)) % max_pkts]
            whole = np.where(follows >= 0, follows, whole)
        return pd.DataFrame([[*names, pdf["begin"].iloc[0], whole]], columns=[*segment, "blk", "begin", "table"])

    def spread_begin(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("blk")
        begins, begin = [], int(pdf["run_begin"].iloc[0])
        for table in pdf["table"]:
            begins.append(begin)
            begin = after(np.asarray(table), begin)
        return pdf[[*segment, "blk"]].assign(begin=begins)

    levels, run = [tables], (F.floor(F.col("blk") / FAN)).cast("bigint")
    while not levels[-1].groupBy(*segment).count().where("count > 1").isEmpty():
        up = levels[-1].withColumn("_run", run).groupBy(*segment, "_run").applyInPandas(compose, f"{kinds}, begin bigint, table array<bigint>")
        levels.append(cut_lineage(up))
    begins = levels.pop().select(*segment, "blk", "begin")
    while levels:
        known = begins.withColumnsRenamed({"blk": "_run", "begin": "run_begin"})
        below = levels.pop().withColumn("_run", run).join(known, segment + ["_run"])
        begins = cut_lineage(below.groupBy(*segment, "_run").applyInPandas(spread_begin, f"{kinds}, begin bigint"))
    return begins


def _long_conversations(
    rows: DataFrame, tcp_timeout: float, udp_timeout: float, max_pkts: int, block: int
) -> DataFrame:
    idx, cls, rn = F.col("pkt_idx"), F.col("cls"), F.col("_rn")
    at = lambda: F.struct(idx.alias("idx"), rn.alias("rn"))
    r = _neighbours(rows.withColumn("blk", F.floor(idx / block)), KEY)
    r = r.withColumn("_hard", _new_segment(F.col("_pts"), F.col("_pcls"), tcp_timeout, udp_timeout))
    r = _running(r, KEY, {"_seg_rn": F.when(F.col("_hard"), rn)})
    mark = F.when(cls.isin("F", "A"), F.struct(rn.alias("rn"), cls.alias("cls")))
    r = _running(r, KEY, {"_mark": mark}, inclusive=False)
    fin_open = (F.col("_mark.cls") == "F") & (F.col("_mark.rn") >= F.col("_seg_rn"))
    r = r.withColumn("_close", F.coalesce((cls == "A") & fin_open, F.lit(False)))

    def starts(r: DataFrame, name: str) -> DataFrame:
        r = _running(r, KEY, {"_pclose": F.col("_close")}, inclusive=False)
        new = F.col("_hard") | F.coalesce(F.col("_pclose"), F.lit(False))
        return _running(r.withColumn("_new", new), KEY, {name: F.when(F.col("_new"), at())}).drop("_pclose", "_new")

    r = cut_lineage(starts(r, "_start0"))
    void = _overruled_closes(r, KEY, max_pkts)
    if void is None:
        r = r.withColumnRenamed("_start0", "_start")
    else:
        r = r.join(void, KEY + ["pkt_idx"], "left").withColumn("_close", F.col("_close") & F.col("_void").isNull())
        r = cut_lineage(starts(r.drop("_void", "_start0"), "_start"))
    pos = rn - F.col("_start.rn")
    is_tcp = F.col("proto") == TCP
    r = r.withColumns({"_piece": F.floor(pos / max_pkts), "_begin": F.col("_start.rn")})
    r = r.withColumn("_cap", F.when(is_tcp, F.col("_piece")).otherwise(F.lit(0)).cast("bigint"))
    full = is_tcp & (F.pmod(pos, F.lit(max_pkts)) == max_pkts - 1)
    closed = F.col("_close") | F.coalesce(cls == "R", F.lit(False)) | full
    r = r.withColumn("_emit", F.when(closed, idx * 2 + 1).when(F.col("_next").isNotNull(), F.col("_next") * 2))
    flow, piece = KEY + ["_begin", "_cap"], KEY + ["_begin", "_cap", "_piece"]
    whole = r.groupBy(*flow).agg(
        F.min("pkt_idx").alias("_first"),
        F.count(F.lit(1)).alias("n_pkts"),
        F.min("ts").alias("pktts_start"),
        F.max("ts").alias("pktts_end"),
        F.max_by("_emit", "pkt_idx").alias("_emit"),
    )
    whole = whole.withColumn("emit_at", F.coalesce(F.col("_emit"), F.col("_first") + LEFTOVER)).drop("_emit")
    out = _arrays(r, piece).join(whole, flow)
    part = F.when(is_tcp, F.lit(0)).otherwise(F.col("_piece")).cast("bigint")
    return out.withColumns({"flow_id": _flow_id(F.col("_first")), "part": part}).select(*FLOW_COLUMNS)


def group_flows(packets: DataFrame, **options) -> DataFrame:
    """One flow per conversation and file, no cuts; ``options`` as for ``group_parts``.

    The arrays are those of the first part, ``max_pkts`` packets at most; counts and extent are those of the whole
    flow. ``group_parts`` has the packets beyond.
    """
    return first_part(group_parts(packets, **options))


def group_parts(packets: DataFrame, ip_order: str = "text", max_pkts: int = MAX_PACKETS, block: int = BLOCK) -> DataFrame:
    """Packet parts, of ``max_pkts`` packets each, of the conversations of every file.

    Conversations longer than that are counted first; their places come from a count per block of capture order, so
    that no window holds more than a block.
    """
    rows = canonical_key(packets.where(F.col("proto").isin(6, 17)), ip_order)
    extent = [F.min("pkt_idx").alias("_first"), F.min("ts").alias("pktts_start"), F.max("ts").alias("pktts_end"), F.count(F.lit(1)).alias("n_pkts")]
    long_keys = cut_lineage(rows.groupBy(*KEY).count().where(F.col("count") > max_pkts).select(*KEY))
    if long_keys.isEmpty():
        parts = _arrays(rows, KEY, *extent).withColumn("part", F.lit(0).cast("bigint"))
    else:
        long_keys = broadcast_if_small(long_keys)
        short = _arrays(rows.join(long_keys, KEY, "left_anti"), KEY, *extent).withColumn("part", F.lit(0).cast("bigint"))
        long = rows.join(long_keys, KEY, "left_semi").withColumn("_block", F.floor(F.col("pkt_idx") / block))
        counts = long.groupBy(*KEY, "_block").count()
        earlier = W.partitionBy(*KEY).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
        counts = counts.select(*KEY, "_block", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("_before"))
        inside = F.row_number().over(W.partitionBy(*KEY, "_block").orderBy("pkt_idx")) - 1
        placed = long.withColumn("_inside", inside).join(counts, KEY + ["_block"])
        placed = placed.withColumn("part", F.floor((F.col("_inside") + F.col("_before")) / max_pkts))
        parts = short.unionByName(_arrays(placed, KEY + ["part"]).join(long.groupBy(*KEY).agg(*extent), KEY))
    return parts.withColumns(
        {"flow_id": _flow_id(F.col("_first")), "emit_at": F.col("_first") + LEFTOVER}
    ).select(*FLOW_COLUMNS)


def flow_extent(flows: DataFrame) -> DataFrame:
    """Earliest and latest packet time of every flow, from flows or their parts."""
    return flows.groupBy("flow_id").agg(F.min("pktts_start").alias("pktts_start"), F.max("pktts_end").alias("pktts_end"))


def first_part(parts: DataFrame) -> DataFrame:
    """One row per flow: its first packets and the flow-level columns."""
    return parts.where(F.col("part") == 0)


def multi_packet(flows: DataFrame, more_than: int = 1) -> DataFrame:
    """Flows with more than ``more_than`` packets, tested on the stored count so that a scan can push it."""
    return flows.where(F.col("n_pkts") > more_than)
