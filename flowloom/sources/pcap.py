"""Packets from capture files.

Two narrow jobs. The first walks the record headers of each file and cuts it into byte ranges that start on a
packet; the second, after spreading the ranges evenly, decodes them. One very large capture is therefore
decoded by many tasks, and no task holds more than a range.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.schemas import PACKETS, TCP, UDP
from flowloom.session import spread
from flowloom.sources.files import list_files, open_file

RANGE_BYTES = 64 << 20
BLOCK_BYTES = 4 << 20
BATCH_ROWS = 20_000

# ---- fixed values: file formats ----
CLASSIC_MAGIC = {b"\xd4\xc3\xb2\xa1": "<", b"\xa1\xb2\xc3\xd4": ">"}
NG_SECTION = b"\x0a\x0d\x0d\x0a"
NG_BYTE_ORDER = {b"\x4d\x3c\x2b\x1a": "<", b"\x1a\x2b\x3c\x4d": ">"}
NG_INTERFACE, NG_PACKET_OLD, NG_PACKET = 1, 2, 6
NG_TSRESOL, NG_TSOFFSET = 9, 14
ETHERTYPE_IPV4, ETHERTYPE_VLAN = 0x0800, (0x8100, 0x88A8, 0x9100)
# ---- end of fixed values ----

PACKET_NAMES = [c.split()[0] for c in PACKETS.split(", ")]
RANGES = "path string, kind string, endian string, start bigint, stop bigint, first_idx bigint, clocks string"


class Blocks:
    """Reads at any place of a file through one large block: walking headers costs a request per block, not per header."""

    def __init__(self, f, size: int = BLOCK_BYTES):
        self.f, self.size, self.start, self.data = f, size, 0, b""

    def at(self, place: int, n: int) -> bytes:
        if not self.start <= place <= place + n <= self.start + len(self.data):
            self.f.seek(place)
            self.start, self.data = place, self.f.read(max(n, self.size))
        return self.data[place - self.start : place - self.start + n]


def _walk_classic(f: Blocks, endian: str) -> Iterator[tuple[int, str]]:
    """Offsets of packet records (with no extra state) in a classic file."""
    at = 24
    while len(head := f.at(at, 16)) == 16:
        yield at, ""
        at += 16 + struct.unpack(endian + "I", head[8:12])[0]


def _clock(options: bytes, endian: str) -> str:
    """Ticks per second and offset of an interface, as text."""
    ticks, offset, at = 10**6, 0, 0
    while at + 4 <= len(options):
        code, size = struct.unpack_from(endian + "HH", options, at)
        value = options[at + 4 : at + 4 + size]
        if code == 0:
            break
        if code == NG_TSRESOL and size == 1:
            ticks = 2 ** (value[0] & 0x7F) if value[0] & 0x80 else 10 ** value[0]
        elif code == NG_TSOFFSET and size == 8:
            offset = struct.unpack(endian + "q", value)[0]
        at += 4 + size + (-size % 4)
    return f"{ticks}:{offset}"


def _walk_ng(f: Blocks, endian: str) -> Iterator[tuple[int, str]]:
    """Offsets of packet blocks with the clocks of the interfaces described before them."""
    at, clocks = 0, []
    while len(head := f.at(at, 12)) == 12:
        if head[:4] == NG_SECTION:
            endian, clocks = NG_BYTE_ORDER.get(head[8:12], endian), []
        kind, size = struct.unpack(endian + "II", head[:8])
        if size < 12:
            return
        if kind == NG_INTERFACE:
            clocks.append(_clock(f.at(at + 16, size - 20), endian))
        elif kind in (NG_PACKET, NG_PACKET_OLD):
            yield at, endian + ",".join(clocks)
        at += size


def _ranges(path: str, length: int, limit: int | None, range_bytes: int) -> Iterator[tuple]:
    with open_file(path) as opened:
        f = Blocks(opened)
        magic = f.at(0, 12)
        if magic[:4] in CLASSIC_MAGIC:
            kind, endian = "classic", CLASSIC_MAGIC[magic[:4]]
            walk = _walk_classic(f, endian)
        elif magic[:4] == NG_SECTION and magic[8:12] in NG_BYTE_ORDER:
            kind, endian = "ng", NG_BYTE_ORDER[magic[8:12]]
            walk = _walk_ng(f, endian)
        else:
            return
        begin, first, state = None, 0, ""
        for idx, (at, seen) in enumerate(walk):
            if limit is not None and idx >= limit:
                length = at
                break
            if begin is None:
                begin, first, state = at, idx, seen
            elif at - begin >= range_bytes or seen != state:
                yield path, kind, state[:1] or endian, begin, at, first, state[1:]
                begin, first, state = at, idx, seen
        if begin is not None:
            yield path, kind, state[:1] or endian, begin, length, first, state[1:]


def _records(data: bytes, kind: str, endian: str, clocks: str) -> Iterator[tuple[float, int, int]]:
    """(time, place, size) of the frame of every record of a range."""
    at = 0
    if kind == "classic":
        header = struct.Struct(endian + "IIII")
        while at + 16 <= len(data):
            sec, usec, size, _ = header.unpack_from(data, at)
            yield sec + usec / 1e6, at + 16, min(size, len(data) - at - 16)
            at += 16 + size
        return
    rates = [tuple(map(int, c.split(":"))) for c in clocks.split(",") if c]
    while at + 28 <= len(data):
        kind_no, size = struct.unpack_from(endian + "II", data, at)
        if size < 12:
            return
        if kind_no in (NG_PACKET, NG_PACKET_OLD):
            iface = struct.unpack_from(endian + ("I" if kind_no == NG_PACKET else "H"), data, at + 8)[0]
            high, low, cap = struct.unpack_from(endian + "III", data, at + 12)
            ticks, offset = rates[iface] if iface < len(rates) else (10**6, 0)
            yield offset + ((high << 32) | low) / ticks, at + 28, min(cap, len(data) - at - 28)
        at += size


def _addresses(raw: np.ndarray, at: np.ndarray) -> list[str]:
    number = (raw[at].astype(np.int64) << 24) | (raw[at + 1].astype(np.int64) << 16) | (raw[at + 2].astype(np.int64) << 8) | raw[at + 3]
    each, which = np.unique(number, return_inverse=True)
    names = np.array([f"{n >> 24}.{n >> 16 & 255}.{n >> 8 & 255}.{n & 255}" for n in each.tolist()], object)
    return names[which]


def _endpoints(data: bytes, place: np.ndarray, size: np.ndarray) -> dict[str, np.ndarray]:
    """Header fields of all frames at once; ``keep`` lists the frames that are TCP or UDP over IPv4 over Ethernet."""
    raw = np.frombuffer(data, np.uint8)

    def byte(at: np.ndarray) -> np.ndarray:
        return raw[np.minimum(at, len(raw) - 1)].astype(np.int64)

    def pair(at: np.ndarray) -> np.ndarray:
        return (byte(at) << 8) | byte(at + 1)

    end, at = place + size, place + 14
    ok, kind = size >= 34, pair(place + 12)
    while (tagged := ok & np.isin(kind, ETHERTYPE_VLAN) & (end >= at + 4)).any():
        kind = np.where(tagged, pair(at + 2), kind)
        at = np.where(tagged, at + 4, at)
    ok &= (kind == ETHERTYPE_IPV4) & (end >= at + 20) & (byte(at) >> 4 == 4)
    proto, head = byte(at + 9), (byte(at) & 15) * 4
    ok &= (head >= 20) & (pair(at + 6) & 0x1FFF == 0)
    top = at + head
    tcp = ok & (proto == TCP) & (end >= top + 20) & (byte(top + 12) >> 4 >= 5)
    keep = np.flatnonzero(tcp | (ok & (proto == UDP) & (end >= top + 8)))
    at, top = at[keep], top[keep]
    return {
        "keep": keep, "src_ip": _addresses(raw, at + 12), "dst_ip": _addresses(raw, at + 16), "src_port": pair(top), "dst_port": pair(top + 2),
        "proto": proto[keep], "flags": np.where(tcp[keep], byte(top + 13), 0),
    }


def _packets(path: str, first: int, data: bytes, kind: str, endian: str, clocks: str) -> Iterator[pd.DataFrame]:
    """Packets of a range, ``BATCH_ROWS`` records at a time."""
    records = _records(data, kind, endian, clocks)
    while rows := list(islice(records, BATCH_ROWS)):
        ts, place, size = zip(*rows)
        place, size = np.array(place, np.int64), np.array(size, np.int64)
        found = _endpoints(data, place, size)
        keep = found.pop("keep")
        yield pd.DataFrame({"src_file": path, "pkt_idx": first + keep, "ts": np.array(ts)[keep], **found, "size": size[keep]})[PACKET_NAMES]
        first += len(rows)


def read_pcap(
    spark: SparkSession, path: str, max_packets: int | None = None, range_bytes: int = RANGE_BYTES
) -> DataFrame:
    """Packets of all classic (microsecond) and next-generation captures below ``path``; other files yield nothing.

    Frames that are not TCP or UDP over IPv4 are skipped but counted in ``pkt_idx``. ``max_packets`` keeps the
    first packets of each file.
    """

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in RANGES.split(", ")]
        for files in batches:
            for file in files.itertuples():
                yield pd.DataFrame(list(_ranges(file.path, file.length, max_packets, range_bytes)), columns=names)

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for ranges in batches:
            for r in ranges.itertuples():
                with open_file(r.path) as f:
                    f.seek(r.start)
                    data = f.read(r.stop - r.start)
                yield from _packets(r.path, r.first_idx, data, r.kind, r.endian, r.clocks)

    # an explicit number of partitions: the range rows are a few bytes, which adaptive execution would put into one
    ranges = spread(list_files(spark, path), "path").mapInPandas(index, RANGES)
    return spread(ranges, "path", "start").mapInPandas(decode, PACKETS)
