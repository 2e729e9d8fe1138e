"""Flow assembly, features, idle sessions and labels on a packet stream.

Packets need ``ts_event``, a timestamp of ``ts``, as event time (``with_event_time`` adds it). Inside a micro-batch a
conversation's packets are put in capture order; across batches they are taken as they come, so results equal the
batch operator when batches arrive in capture order. Packets behind the watermark are not dropped: the state machine
itself tells them apart and passes them on as late rows (``late_packets``), so flows and late packets together are all
packets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from flowloom.operators.features import build_features
from flowloom.operators.flows import KEY, LEFTOVER, first_part
from flowloom.operators.labels import label_flows
from flowloom.operators.packets import canonical_key, only_tcp_udp
from flowloom.schemas import ACK, FIN, MAX_PACKETS, RST, TCP, TCP_IDLE, UDP_IDLE

OUT = (
    "flow_id string, src_file string, srcip string, dstip string, srcport int, dstport int, proto smallint, "
    "part bigint, n_pkts bigint, pktsize array<int>, pktts array<double>, pktdirs array<tinyint>, "
    "pktts_start double, pktts_end double, emit_at bigint, late_idx bigint"
)
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Packets of an open flow that are kept in its one state value; more go to a list that is only added to.
INLINE = 128
_OUT_ROW = Row(*[c.split()[0] for c in OUT.split(", ")])


def with_event_time(packets: DataFrame, watermark: str = "10 minutes") -> DataFrame:
    event = F.timestamp_micros(F.round(F.col("ts") * 1e6).cast("bigint"))
    return packets.withColumn("ts_event", event).withWatermark("ts_event", watermark)


class _Open:
    """An open flow: number of its first packet, last time, whether a FIN is pending, packets, extent, and those held."""

    def __init__(self, first: int, ts: float):
        self.first, self.last, self.fin, self.part, self.n, self.lo, self.hi = first, ts, False, 0, 0, ts, ts
        self.head: list[tuple] = []  # of the first part
        self.tail: list[tuple] = []  # of the part that is being filled beyond it
        self.kept = {"head": 0, "tail": 0}  # packets that the list states hold already


class FlowBuilder(StatefulProcessor):
    """Open flow of one conversation: one state value with its first packets, and lists for what a long flow has beyond.

    A flow comes out once, when it ends, with its first ``max_pkts`` packets and its whole count and extent. TCP is cut
    at ``max_pkts``; what a longer UDP flow has beyond comes out as parts 1, 2, ... as they fill, whose count and extent
    are those of the part. So at most two parts' packets are held. ``emit_at`` is the order of the batch operator: by the
    packet that closes a flow, or the next one of its conversation; a flow that a timer closes comes after all others of
    its file, by its first packet. Cuts are looked up in sorted arrays, so the work per flow, not per packet, is Python.
    """

    def __init__(self, tcp_timeout: float, udp_timeout: float, max_pkts: int):
        self.limits = {True: float(tcp_timeout), False: float(udp_timeout)}
        self.max_pkts = max_pkts

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        packets = "ts double, size int, dir int"
        self.flow = handle.getValueState(
            "flow", "first_idx bigint, last_ts double, fin boolean, part bigint, n bigint, lo double, hi double, timer boolean, inline boolean, "
            "ts array<double>, size array<int>, dir array<int>"
        )
        self.lists = {"head": handle.getListState("head", packets), "tail": handle.getListState("tail", packets)}

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        packets = sorted((r.pkt_idx, r.ts, r.size, r.dir, r.flags) for r in rows)
        mark = timerValues.getCurrentWatermarkInMs()
        late = [p for p in packets if p[1] * 1000 < mark]
        for idx, ts, size, way, _ in late:
            yield self._row(key, None, 0, [(ts, size, way)], 1, ts, ts, None, idx)
        if late:
            packets = [p for p in packets if p[1] * 1000 >= mark]
        if packets:
            yield from self._grow(key, packets)

    def _grow(self, key, packets: list[tuple]) -> Iterator[Row]:
        tcp = key[KEY.index("proto")] == TCP
        idx, ts, size, way, flags = zip(*packets)
        flow, timer = self._load()
        began = flow
        times, marks = np.array(ts), np.array(flags)
        none = np.zeros(0, np.int64)
        gaps = np.flatnonzero(np.diff(times, prepend=flow.last if flow else times[0]) > self.limits[tcp])
        resets = np.flatnonzero(marks & RST) if tcp else none
        fins = np.flatnonzero(marks & FIN) if tcp else none
        acks = np.flatnonzero((marks & ACK != 0) & (marks & FIN == 0)) if tcp else none
        count = len(packets)

        def after(places: np.ndarray, at: int) -> int:
            k = int(np.searchsorted(places, at))
            return int(places[k]) if k < len(places) else count

        at = 0
        while at < count:
            if flow is not None and after(gaps, at) == at:
                yield from self._ended(key, flow, idx[at] * 2)
                flow = None
            if flow is None:
                flow = _Open(idx[at], ts[at])
            fin = at - 1 if flow.fin else after(fins, at)
            full = at + self.max_pkts - flow.n - 1 if tcp else count
            close = min(after(resets, at), after(acks, fin + 1) if fin < count else count, full)
            stop = min(close + 1, after(gaps, at + 1), count)
            for a in range(at, stop):
                if len(flow.tail) + flow.kept["tail"] >= self.max_pkts:
                    yield self._part(key, flow, self._packets(flow, "tail"))
                    flow.part += 1
                    flow.tail, flow.kept["tail"] = [], 0
                    self.lists["tail"].clear()
                (flow.head if flow.n < self.max_pkts else flow.tail).append((ts[a], size[a], way[a]))
                flow.n += 1
            flow.last, flow.lo, flow.hi = ts[stop - 1], min(flow.lo, *ts[at:stop]), max(flow.hi, *ts[at:stop])
            flow.fin = flow.fin or after(fins, at) < stop
            if close < stop:
                yield from self._ended(key, flow, idx[close] * 2 + 1)
                flow = None
            at = stop
        self._store(flow, began is not None, timer, tcp)

    def _load(self) -> tuple[_Open | None, bool]:
        """The open flow, if any, and whether a timer is set."""
        got = self.flow.get()
        if got is None:
            return None, False
        first, last, fin, part, n, lo, hi, timer, inline, ts, size, way = got
        if first is None:
            return None, timer
        flow = _Open(first, last)
        flow.fin, flow.part, flow.n, flow.lo, flow.hi = fin, part, n, lo, hi
        if inline:
            flow.head = list(zip(ts, size, way))
        else:
            flow.kept = {"head": min(n, self.max_pkts), "tail": max(n - self.max_pkts - part * self.max_pkts, 0)}
        return flow, timer

    def _store(self, flow: _Open | None, was_open: bool, timer: bool, tcp: bool) -> None:
        if flow is None:
            if timer:  # the timer that is set finds nothing
                self.flow.update((None, None, None, None, None, None, None, True, True, None, None, None))
            elif was_open:
                self.flow.clear()
            return
        inline = not flow.kept["head"] and flow.n <= min(INLINE, self.max_pkts)
        packets = list(zip(*flow.head)) if inline else [[], [], []]
        if not inline:
            for name in ("head", "tail"):
                if getattr(flow, name):
                    self.lists[name].appendList(getattr(flow, name))
        self.flow.update((flow.first, flow.last, flow.fin, flow.part, flow.n, flow.lo, flow.hi, True, inline, *map(list, packets)))
        if not timer:
            self.handle.registerTimer(int((flow.last + self.limits[tcp]) * 1000) + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        flow, _ = self._load()
        if flow is None:
            self.flow.clear()
            return
        tcp = key[KEY.index("proto")] == TCP
        due = int((flow.last + self.limits[tcp]) * 1000) + 1
        if due > timerValues.getCurrentWatermarkInMs():  # packets have come since it was set
            self.handle.registerTimer(due)
            return
        yield from self._ended(key, flow, flow.first + LEFTOVER)
        self.flow.clear()

    def _packets(self, flow: _Open, name: str) -> list[tuple]:
        kept = [tuple(r) for r in self.lists[name].get()] if flow.kept[name] else []
        return kept + getattr(flow, name)

    def _ended(self, key, flow: _Open, emit_at: int) -> Iterator[Row]:
        """The flow and, if it has one, its last part."""
        tail = self._packets(flow, "tail")
        yield self._row(key, flow.first, 0, self._packets(flow, "head"), flow.n, flow.lo, flow.hi, emit_at)
        if tail:
            yield self._part(key, flow, tail)
        for name, held in flow.kept.items():
            if held:
                self.lists[name].clear()

    def _part(self, key, flow: _Open, packets: list[tuple]) -> Row:
        times = [p[0] for p in packets]
        return self._row(key, flow.first, flow.part + 1, packets, len(packets), min(times), max(times), None)

    @staticmethod
    def _row(key, first, part, packets, n, lo, hi, emit_at, late=None) -> Row:
        ts, size, way = (list(c) for c in zip(*packets))
        flow_id = None if first is None else f"{key[0]}#{first}"
        return _OUT_ROW(flow_id, *key, part, n, size, ts, way, lo, hi, emit_at, late)

    def close(self) -> None:
        pass


def stream_packets_and_flows(
    packet_stream: DataFrame, watermark: str = "10 minutes", tcp_timeout: float = TCP_IDLE, udp_timeout: float = UDP_IDLE,
    max_pkts: int = MAX_PACKETS, ip_order: str = "numeric",
) -> DataFrame:
    """Finished flows, parts of long UDP flows, and late packets of a stream, by keyed state with event-time timers (append mode).

    A late packet is a row with ``late_idx``, its number, and no ``flow_id``. Use ``finished_flows``, ``first_part`` and
    ``late_packets`` to tell the rows apart, on the stream or, to write several tables from one run, in ``foreachBatch``.
    The session needs the RocksDB state store (``spark.sql.streaming.stateStore.providerClass``).
    """
    rows = with_event_time(canonical_key(only_tcp_udp(packet_stream), ip_order), watermark)
    # without the event-time column the engine has nothing to drop late rows by; its watermark still drives the timers
    rows = rows.select(*KEY, "pkt_idx", "ts", "size", "dir", "flags")
    return rows.groupBy(*KEY).transformWithState(FlowBuilder(tcp_timeout, udp_timeout, max_pkts), OUT, "append", "eventTime")


def late_packets(rows: DataFrame) -> DataFrame:
    """The packets behind the watermark, one row each."""
    return rows.where(F.col("late_idx").isNotNull()).select(
        *KEY, F.col("late_idx").alias("pkt_idx"), F.col("pktts")[0].alias("ts"), F.col("pktsize")[0].alias("size"), F.col("pktdirs")[0].alias("dir")
    )


def finished_flows(rows: DataFrame, parts: bool = False) -> DataFrame:
    """Flows, one row each, or with ``parts`` also the packet parts of long UDP flows."""
    flows = rows.where(F.col("late_idx").isNull()).drop("late_idx")
    return flows if parts else first_part(flows)


def stream_flows(packet_stream: DataFrame, watermark: str = "10 minutes", parts: bool = False, **options) -> DataFrame:
    """Finished flows of a packet stream; ``options`` as for ``stream_packets_and_flows``."""
    return finished_flows(stream_packets_and_flows(packet_stream, watermark, **options), parts)


def stream_features(flow_stream: DataFrame, origin: float, **options) -> DataFrame:
    """Feature rows of a stream of finished flows, without state: ``origin`` is the capture's start, which a batch takes from its table."""
    return build_features(flow_stream, origin=F.lit(float(origin)), **options)


def stream_sessions(
    packet_stream: DataFrame, watermark: str = "10 minutes", tcp_timeout: int = TCP_IDLE, udp_timeout: int = UDP_IDLE,
    ip_order: str = "numeric",
) -> DataFrame:
    """Conversations split by the idle rule alone, in event-time order, with native session windows."""
    rows = with_event_time(canonical_key(only_tcp_udp(packet_stream), ip_order), watermark)
    gap = F.when(F.col("proto") == TCP, f"{tcp_timeout} seconds").otherwise(f"{udp_timeout} seconds")
    return rows.groupBy(*KEY, F.session_window("ts_event", gap).alias("session")).agg(
        F.count(F.lit(1)).alias("n_pkts"), F.sum("size").alias("bytes"), F.min("ts").alias("pktts_start"), F.max("ts").alias("pktts_end")
    ).drop("session")


def stream_labels(flow_stream: DataFrame, windows: DataFrame) -> DataFrame:
    """Attack-window labels on a flow stream: a stream-static broadcast join, no state."""
    return label_flows(flow_stream, windows)
