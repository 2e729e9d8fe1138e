"""Files in the formats the sources read, written by Spark from the given tables, once per session and data set."""

from __future__ import annotations

import struct
from collections.abc import Iterator, Sequence
from itertools import groupby

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.operators.flows import assemble_flows, assemble_parts
from flowloom.plans.fixtures import packets, packets_of_days, stage, table
from flowloom.schemas import STATS_FIELDS
from flowloom.session import scratch_path
from flowloom.sources.files import GzipWriter, write_file
from flowloom.sources.store import exists, with_day, write_by_server, write_clusters_json, write_flows, write_parts

PER_FILE = 2000
#: Lines of a compressed statistics file, and how hard it is packed: at the usual level, 6, writing takes twice the time.
LINES, LEVEL = 200_000, 3


def _once(spark: SparkSession, sf_dir: str, name: str, write) -> str:
    path = scratch_path(spark, f"{sf_dir.strip('/').replace('/', '_')}/{name}")
    if not exists(spark, f"{path}.done"):
        write(path)
        spark.range(1).write.mode("overwrite").parquet(f"{path}.done")
    return path


def flow_dir(spark: SparkSession, sf_dir: str) -> str:
    return _once(spark, sf_dir, "flow_table", lambda p: write_flows(stage(spark, sf_dir, "flows").drop("capture_date"), p))


def capture_days_dir(spark: SparkSession, sf_dir: str) -> str:
    """Flow table of the three capture files, one folder per day."""
    flows = lambda: with_day(assemble_flows(packets_of_days(spark, sf_dir))).drop("capture_date")
    return _once(spark, sf_dir, "flow_table_of_days", lambda p: write_flows(flows(), p))


def by_server(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clusters stage as a table bucketed by server."""
    name = "clusters_" + sf_dir.strip("/").replace("/", "_").replace(".", "_").replace("-", "_").replace(":", "")
    path = scratch_path(spark, f"{sf_dir.strip('/').replace('/', '_')}/by_server")
    if not spark.catalog.tableExists(name):
        write_by_server(stage(spark, sf_dir, "clusters"), name, path, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return spark.table(name)


def part_dir(spark: SparkSession, sf_dir: str) -> str:
    """Flow table path beside which the packet parts are."""
    parts = lambda: with_day(assemble_parts(packets(spark, sf_dir))).drop("capture_date")
    return _once(spark, sf_dir, "flow_table_of_parts", lambda p: write_parts(parts(), p))


def clusters_json_dir(spark: SparkSession, sf_dir: str) -> str:
    cols = ["flow_id", "src_file", "emit_at", "server_ip", "server_port", "client_ip", "client_port", "cluster_id", "y", "f_time"]
    return _once(spark, sf_dir, "clusters_json", lambda p: write_clusters_json(stage(spark, sf_dir, "clusters").select(*cols), p))


#: Where the packets view's clients and servers begin. It counts on in the third place, beyond 255 for many users.
CLIENTS, SERVERS = (18 << 24) + (219 << 16), (172 << 24) + (31 << 16)


def _address(name: str) -> int:
    """The 32-bit address of a name of the packets view; a third place beyond 255 carries into the second."""
    a, b, c, d = map(int, name.split("."))
    return (a << 24) + (b << 16) + (c << 8) + d


def view_name(ip: Column) -> Column:
    """The packets view's name of an address as a capture has it: the carry of ``_address`` undone."""
    part = F.split(ip, r"\.")
    number = sum((part[i].cast("bigint") * (1 << (24 - 8 * i)) for i in range(4)), F.lit(0))
    base = F.when(number >= SERVERS, F.lit(SERVERS)).otherwise(F.lit(CLIENTS))
    named = F.concat_ws(".", F.when(number >= SERVERS, "172.31").otherwise("18.219"), F.floor((number - base) / 256).cast("string"), part[3])
    return F.when(number >= CLIENTS, named).otherwise(ip)


def _frame(src: str, dst: str, sport: int, dport: int, proto: int, flags: int, size: int) -> bytes:
    ips = struct.pack(">II", _address(src), _address(dst))
    if proto == 6:
        top = struct.pack(">HHIIBBHHH", sport, dport, 0, 0, 0x50, flags, 0, 0, 0)
    else:
        top = struct.pack(">HHHH", sport, dport, max(size - 34, 8), 0)
    ip = struct.pack(">BBHHHBBH", 0x45, 0, size - 14, 0, 0, 64, proto, 0) + ips
    return (bytes(12) + b"\x08\x00" + ip + top).ljust(size, b"\x00")


def capture_dir(spark: SparkSession, sf_dir: str) -> str:
    """The packets view as capture files of ``PER_FILE`` packets; one frame before each is not IP."""

    def write(path: str) -> None:
        def one(pdf: pd.DataFrame) -> pd.DataFrame:
            no = int(pdf["file_no"].iloc[0])
            out = [struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1)]
            out.append(struct.pack("<IIII", 0, 0, 42, 42) + bytes(12) + b"\x08\x06" + bytes(28))
            for r in pdf.sort_values("pkt_idx").itertuples():
                frame = _frame(r.src_ip, r.dst_ip, r.src_port, r.dst_port, r.proto, r.flags, r.size)
                out.append(struct.pack("<IIII", r.ts_us // 10**6, r.ts_us % 10**6, len(frame), len(frame)) + frame)
            write_file(f"{path}/part-{no}.pcap", b"".join(out))
            return pd.DataFrame({"file_no": [no], "n": [len(pdf)]})

        p = packets(spark, sf_dir).withColumn("file_no", F.floor(F.col("pkt_idx") / PER_FILE))
        p = p.withColumn("ts_us", F.floor(F.col("ts") * 1e6 + 0.5).cast("bigint"))
        p.groupBy("file_no").applyInPandas(one, "file_no bigint, n bigint").write.mode("overwrite").parquet(f"{path}.files")

    return _once(spark, sf_dir, "captures", write)


def packet_csv_dir(spark: SparkSession, sf_dir: str) -> str:
    def write(path: str) -> None:
        tcp = F.col("proto") == 6
        cols = [F.col("size"), F.col("src_ip"), F.col("dst_ip")] + [
            F.when(test, F.col(c)) for test in (tcp, ~tcp) for c in ("src_port", "dst_port")
        ]
        text = [F.coalesce(c.cast("string"), F.lit("")).alias(f"c{i}") for i, c in enumerate(cols)]
        packets(spark, sf_dir).select(*text).write.mode("overwrite").option("quoteAll", "true").option("emptyValue", "").csv(path)

    return _once(spark, sf_dir, "packet_csv", write)


def stats_rows(spark: SparkSession, sf_dir: str, kinds: Sequence[tuple[bool, int]]) -> DataFrame:
    """Line items in the shape of a flow-statistics table: ``kind``, one of ``kinds`` by the first eight fields, and ``line``, the 80 fields.

    A kind says whether its fields stand in reverse, and how many columns of ``x`` stand in front. Fields that count on from
    the line number are runs, and a run's text is looked up by its first number: 80 expressions in one projection make
    a method that the JVM does not compile, and a loop over the fields is not compiled either.
    """
    li = table(spark, sf_dir, "lineitem")
    cents = F.floor(F.col("l_extendedprice") * 100 + 0.5).cast("bigint")
    given = {
        "Dst Port": F.col("l_suppkey") % 65536,
        "Flow Duration": cents,
        "Tot Fwd Pkts": F.col("l_quantity").cast("bigint"),
        "Fwd Pkt Len Mean": F.col("l_discount"),
        "Idle Min": F.when(F.col("l_partkey") % 4 != 0, F.col("l_tax")),
        "Flow Byts/s": F.when(F.col("l_partkey") % 9 == 0, F.lit("Infinity")).otherwise(F.col("l_quantity").cast("string")),
        "Timestamp": F.date_format("l_shipdate", "dd/MM/yyyy HH:mm:ss"),
        "Label": F.concat(F.lit("flag "), "l_returnflag"),
    }
    counted = lambda i: ((F.col("l_linenumber") + i) % 50).cast("string")
    names = [f[0] for f in STATS_FIELDS]
    first = [given[n].cast("string") if n in given else counted(i) for i, n in enumerate(names[:8])]
    rows = li.select("l_linenumber", *[c.cast("string").alias(n) for n, c in given.items()], F.pmod(F.xxhash64(*first), F.lit(len(kinds))).alias("kind"))

    def run(a: int, b: int, back: bool) -> Column:
        """Fields ``a`` to ``b`` as text."""
        at = range(b, a - 1, -1) if back else range(a, b + 1)
        known = F.array(*[F.lit(",".join(str((n + i - a) % 50) for i in at)) for n in range(50)])
        start = F.col("l_linenumber") + a
        other = F.array_join(F.transform(F.sequence(F.lit(at[0]), F.lit(at[-1])), counted), ",", "")  # below 0, or null
        return F.when(start >= 0, F.get(known, start % 50)).otherwise(other)

    def line(back: bool, extra: int) -> Column:
        cells = []
        for own, at in groupby(range(len(names)), lambda i: names[i] in given):
            at = list(at)
            cells += [F.coalesce(F.col(f"`{names[i]}`"), F.lit("")) for i in at] if own else [run(at[0], at[-1], back)]
        return F.concat_ws(",", *[F.lit("x")] * extra, *(cells[::-1] if back else cells))

    lines = F.coalesce(*[F.when(F.col("kind") == k, line(*kind)) for k, kind in enumerate(kinds)])
    return rows.select(F.col("kind").cast("int").alias("kind"), lines.alias("line"))


def _write_stats(lines: DataFrame, headers: Sequence[str], path: str) -> None:
    """Finished lines as compressed files, those of each kind under its header, in one pass. Such a file is read by one task, so its lines are counted.

    A folder without rows has files of headers alone.
    """

    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        out, room, count = [None] * len(headers), [0] * len(headers), [0] * len(headers)

        def fresh(k: int) -> None:
            if out[k]:
                out[k].close()
            out[k], room[k], count[k] = GzipWriter(f"{path}/part-{k}-{task:05d}-{count[k]:03d}.csv.gz", LEVEL), LINES, count[k] + 1
            out[k].write(f"{headers[k]}\n".encode())

        if task == 0:
            for k in range(len(headers)):
                fresh(k)
        for batch in batches:
            for k in range(len(headers)):
                some = batch.column("line").filter(pc.equal(batch.column("kind"), k))
                while len(some):
                    if not room[k]:
                        fresh(k)
                    now, some = some[: room[k]], some[room[k] :]
                    room[k] -= len(now)
                    out[k].write(pc.binary_join(pa.ListArray.from_arrays([0, len(now)], now), "\n")[0].as_buffer())
                    out[k].write(b"\n")
        for f in out:
            if f:
                f.close()
        yield pa.RecordBatch.from_pydict({"task": pa.array([task], pa.int32()), "files": pa.array([sum(count)], pa.int64())})

    lines.mapInArrow(files, "task int, files bigint").write.mode("overwrite").parquet(f"{path}.files")


def stats_dir(spark: SparkSession, sf_dir: str, dialect: str) -> str:
    """CSV files of that table; some hold their header line again, and lines with a field too many."""

    def write(path: str) -> None:
        names = [f[0 if dialect == "A" else 1] for f in STATS_FIELDS]
        odd = spark.createDataFrame([(0, ",".join(names)), (0, ",".join(["7"] * (len(names) - 1) + ["flag A,1,2"]))], "kind int, line string")
        _write_stats(stats_rows(spark, sf_dir, [(False, 0)]).unionByName(odd), [",".join(names)], path)

    return _once(spark, sf_dir, f"stats_{dialect}", write)


def mixed_stats_dir(spark: SparkSession, sf_dir: str, dialect: str) -> str:
    """A folder whose files have three headers: the usual one, the reverse, and one with extra columns in front."""

    def write(path: str) -> None:
        names = [f[0 if dialect == "A" else 1] for f in STATS_FIELDS]
        extra = ["Flow ID", "Src IP", "Src Port", "Dst IP"]
        rows = stats_rows(spark, sf_dir, [(False, 0), (True, 0), (False, len(extra))])
        _write_stats(rows, [",".join(columns) for columns in (names, names[::-1], extra + names)], path)

    return _once(spark, sf_dir, f"stats_mixed_{dialect}", write)


def sequence_dir(spark: SparkSession, sf_dir: str) -> str:
    """The sequences as .data/.label pairs of ``PER_FILE`` lines; the first number of a line is its id."""

    def write(path: str) -> None:
        def one(pdf: pd.DataFrame) -> pd.DataFrame:
            no = int(pdf["file_no"].iloc[0])
            pdf = pdf.sort_values("seq_id")
            write_file(f"{path}/set{no}.data", "".join(f"{line}\n" for line in pdf["line"]).encode())
            write_file(f"{path}/set{no}.label", (" " + "".join(str(x) for x in pdf["label"]) + "\n").encode())
            return pd.DataFrame({"file_no": [no], "n": [len(pdf)]})

        s = stage(spark, sf_dir, "sequences")
        line = F.concat_ws(" ", F.col("seq_id").cast("string"), F.array_join(F.col("sizes").cast("array<string>"), " "))
        s = s.select("seq_id", line.alias("line"), (F.col("seq_id") % 2).alias("label"), F.floor(F.col("seq_id") / PER_FILE).alias("file_no"))
        s.groupBy("file_no").applyInPandas(one, "file_no bigint, n bigint").write.mode("overwrite").parquet(f"{path}.files")

    return _once(spark, sf_dir, "sequences", write)
