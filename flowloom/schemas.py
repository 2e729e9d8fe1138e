"""Table schemas and the fixed rule tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

PACKETS = (
    "src_file string, pkt_idx bigint, ts double, src_ip string, dst_ip string, "
    "src_port int, dst_port int, proto smallint, flags int, size int"
)

# One row per flow, part 0, with its first ``MAX_PACKETS`` packets. The parts of a longer flow that may not be cut (UDP)
# have the same columns; n_pkts, pktts_start, pktts_end and emit_at describe the whole flow in every row.
FLOWS = (
    "flow_id string, src_file string, srcip string, dstip string, srcport int, dstport int, proto smallint, "
    "part bigint, n_pkts bigint, pktsize array<int>, pktts array<double>, pktdirs array<tinyint>, "
    "pktts_start double, pktts_end double, emit_at bigint"
)

ATTACK_WINDOWS = (
    "day string, ord int, att array<string>, vic array<string>, start string, end string, label string"
)

DAY_PARAMS = (
    "day string, winsize int, tss_entro_t double, serdatalistmax int, clientiplent int, "
    "flowidlenmin int, lenseridsetmin int"
)

# ---- fixed values -------------------------------------------------------------------------------------
# Limits of flow assembly, the feature width, and the rule parameters. They must keep these values for
# results to agree with earlier work on the same captures.

TCP, UDP = 6, 17
FIN, RST, ACK = 0x01, 0x04, 0x10
TCP_IDLE, UDP_IDLE = 300, 120
MAX_PACKETS = 10_000
WIDTH = 32
LOCAL_HOURS = -4
BENIGN = "Benign"

# day, winsize, tss_entro_t, serdatalistmax, clientiplent, flowidlenmin, lenseridsetmin
DAY_PARAM_ROWS = [
    ("Friday-16-02-2018", 10, 1.0, 2, 3, 2, 1),
    ("Friday-23-02-2018", 4, 1.0, 2, 3, 2, 1),
    ("Thursday-15-02-2018", 3, 1.0, 2, 3, 2, 1),
    ("Tuesday-20-02-2018", 5, 1.0, 2, 3, 5, 1),
    ("Wednesday-14-02-2018", 10, 0.5, 2, 3, 5, 2),
    ("Wednesday-21-02-2018", 10, 0.5, 2, 3, 8, 2),
]
DEFAULT_PARAMS = dict(
    winsize=4, tss_entro_t=1.0, serdatalistmax=2, clientiplent=3, flowidlenmin=2, lenseridsetmin=1
)

_BOT_VICTIMS = [
    "18.217.218.111", "172.31.69.23", "18.222.10.237", "172.31.69.17", "18.222.86.193", "172.31.69.14",
    "18.222.62.221", "172.31.69.12", "13.59.9.106", "172.31.69.10", "18.222.102.2", "172.31.69.8",
    "18.219.212.0", "172.31.69.6", "18.216.105.13", "172.31.69.26", "18.219.163.126", "172.31.69.29",
    "18.216.164.12", "172.31.69.30",
]
_FLOOD_SOURCES = [
    "18.218.115.60", "18.219.9.1", "18.219.32.43", "18.218.55.126", "52.14.136.135", "18.219.5.43",
    "18.216.200.189", "18.218.229.235", "18.218.11.51", "18.216.24.42",
]
_WEB_VICTIM = ["18.217.21.148", "172.31.69.25"]
_APP_VICTIM = ["18.218.83.150", "172.31.69.28"]

# day, order within the day, attackers, victims, start, end (local wall clock), label
ATTACK_WINDOW_ROWS = [
    ("Friday-02-03-2018", 1, ["18.219.211.138"], _BOT_VICTIMS, "10:11", "11:34", "Bot"),
    ("Friday-02-03-2018", 2, ["18.219.211.138"], _BOT_VICTIMS, "14:24", "15:55", "Bot"),
    ("Friday-23-02-2018", 1, ["18.218.115.60"], _APP_VICTIM, "10:03", "11:03", "Brute Force -Web"),
    ("Friday-23-02-2018", 2, ["18.218.115.60"], _APP_VICTIM, "13:00", "14:10", "Brute Force -XSS"),
    ("Friday-23-02-2018", 3, ["18.218.115.60"], _APP_VICTIM, "15:05", "15:18", "SQL Injection"),
    ("Thursday-15-02-2018", 1, ["172.31.70.46", "18.219.211.138"], _WEB_VICTIM, "9:26", "10:09", "DoS-GoldenEye"),
    ("Thursday-15-02-2018", 2, ["172.31.70.8", "18.217.165.70"], _WEB_VICTIM, "10:59", "11:40", "DoS-Slowloris"),
    ("Tuesday-20-02-2018", 1, _FLOOD_SOURCES, _WEB_VICTIM, "10:12", "11:17", "DDoS attacks-LOIC-HTTP"),
    ("Tuesday-20-02-2018", 2, _FLOOD_SOURCES, _WEB_VICTIM, "13:13", "13:32", "DDoS-LOIC-UDP"),
    ("Wednesday-21-02-2018", 1, _FLOOD_SOURCES, _APP_VICTIM, "10:09", "10:43", "DDOS-LOIC-UDP"),
    ("Wednesday-21-02-2018", 2, _FLOOD_SOURCES, _APP_VICTIM, "14:05", "15:05", "DDOS-HOIC"),
    ("Friday-16-02-2018", 1, ["172.31.70.23", "13.59.126.31"], _WEB_VICTIM, "10:12", "11:08", "DoS-SlowHTTPTest"),
    ("Friday-16-02-2018", 2, ["172.31.70.16", "18.219.193.20"], _WEB_VICTIM, "13:45", "14:19", "DoS-Hulk"),
    ("Thursday-01-03-2018", 1, ["13.58.225.34"], ["18.216.254.154", "172.31.69.13"], "9:57", "10:55", "Infiltration"),
    ("Thursday-01-03-2018", 2, ["13.58.225.34"], ["18.216.254.154", "172.31.69.13"], "14:00", "15:37", "Infiltration"),
    ("Thursday-22-02-2018", 1, ["18.218.115.60"], _APP_VICTIM, "10:17", "11:24", "Brute Force -Web"),
    ("Thursday-22-02-2018", 2, ["18.218.115.60"], _APP_VICTIM, "13:50", "14:29", "Brute Force -XSS"),
    ("Thursday-22-02-2018", 3, ["18.218.115.60"], _APP_VICTIM, "16:15", "16:29", "SQL Injection"),
    ("Wednesday-14-02-2018", 1, ["172.31.70.4", "18.221.219.4"], _WEB_VICTIM, "10:32", "12:09", "FTP-BruteForce"),
    ("Wednesday-14-02-2018", 2, ["172.31.70.6", "13.58.98.64"], _WEB_VICTIM, "14:01", "15:31", "SSH-Bruteforce"),
    ("Wednesday-28-02-2018", 1, ["13.58.225.34"], ["18.221.148.137", "172.31.69.24"], "10:50", "12:05", "Infiltration"),
    ("Wednesday-28-02-2018", 2, ["13.58.225.34"], ["18.221.148.137", "172.31.69.24"], "13:42", "14:40", "Infiltration"),
]

# The 80 fields of a flow-statistics file in file order: name in dialect A, name in dialect B, type.
STATS_FIELDS = [
    ("Dst Port", "Dst Port", "bigint"),
    ("Protocol", "Protocol", "bigint"),
    ("Timestamp", "Timestamp", "string"),
    ("Flow Duration", "Flow Duration", "bigint"),
    ("Tot Fwd Pkts", "Total Fwd Packet", "bigint"),
    ("Tot Bwd Pkts", "Total Bwd packets", "bigint"),
    ("TotLen Fwd Pkts", "Total Length of Fwd Packet", "bigint"),
    ("TotLen Bwd Pkts", "Total Length of Bwd Packet", "double"),
    ("Fwd Pkt Len Max", "Fwd Packet Length Max", "bigint"),
    ("Fwd Pkt Len Min", "Fwd Packet Length Min", "bigint"),
    ("Fwd Pkt Len Mean", "Fwd Packet Length Mean", "double"),
    ("Fwd Pkt Len Std", "Fwd Packet Length Std", "double"),
    ("Bwd Pkt Len Max", "Bwd Packet Length Max", "bigint"),
    ("Bwd Pkt Len Min", "Bwd Packet Length Min", "bigint"),
    ("Bwd Pkt Len Mean", "Bwd Packet Length Mean", "double"),
    ("Bwd Pkt Len Std", "Bwd Packet Length Std", "double"),
    ("Flow Byts/s", "Flow Bytes/s", "double"),
    ("Flow Pkts/s", "Flow Packets/s", "double"),
    ("Flow IAT Mean", "Flow IAT Mean", "double"),
    ("Flow IAT Std", "Flow IAT Std", "double"),
    ("Flow IAT Max", "Flow IAT Max", "double"),
    ("Flow IAT Min", "Flow IAT Min", "double"),
    ("Fwd IAT Tot", "Fwd IAT Total", "double"),
    ("Fwd IAT Mean", "Fwd IAT Mean", "double"),
    ("Fwd IAT Std", "Fwd IAT Std", "double"),
    ("Fwd IAT Max", "Fwd IAT Max", "double"),
    ("Fwd IAT Min", "Fwd IAT Min", "double"),
    ("Bwd IAT Tot", "Bwd IAT Total", "double"),
    ("Bwd IAT Mean", "Bwd IAT Mean", "double"),
    ("Bwd IAT Std", "Bwd IAT Std", "double"),
    ("Bwd IAT Max", "Bwd IAT Max", "double"),
    ("Bwd IAT Min", "Bwd IAT Min", "double"),
    ("Fwd PSH Flags", "Fwd PSH Flags", "bigint"),
    ("Bwd PSH Flags", "Bwd PSH Flags", "bigint"),
    ("Fwd URG Flags", "Fwd URG Flags", "bigint"),
    ("Bwd URG Flags", "Bwd URG Flags", "bigint"),
    ("Fwd Header Len", "Fwd Header Length", "bigint"),
    ("Bwd Header Len", "Bwd Header Length", "bigint"),
    ("Fwd Pkts/s", "Fwd Packets/s", "double"),
    ("Bwd Pkts/s", "Bwd Packets/s", "double"),
    ("Pkt Len Min", "Packet Length Min", "bigint"),
    ("Pkt Len Max", "Packet Length Max", "bigint"),
    ("Pkt Len Mean", "Packet Length Mean", "double"),
    ("Pkt Len Std", "Packet Length Std", "double"),
    ("Pkt Len Var", "Packet Length Variance", "double"),
    ("FIN Flag Cnt", "FIN Flag Count", "bigint"),
    ("SYN Flag Cnt", "SYN Flag Count", "bigint"),
    ("RST Flag Cnt", "RST Flag Count", "bigint"),
    ("PSH Flag Cnt", "PSH Flag Count", "bigint"),
    ("ACK Flag Cnt", "ACK Flag Count", "bigint"),
    ("URG Flag Cnt", "URG Flag Count", "bigint"),
    ("CWE Flag Count", "CWR Flag Count", "bigint"),
    ("ECE Flag Cnt", "ECE Flag Count", "bigint"),
    ("Down/Up Ratio", "Down/Up Ratio", "bigint"),
    ("Pkt Size Avg", "Average Packet Size", "double"),
    ("Fwd Seg Size Avg", "Fwd Segment Size Avg", "double"),
    ("Bwd Seg Size Avg", "Bwd Segment Size Avg", "double"),
    ("Fwd Byts/b Avg", "Fwd Bytes/Bulk Avg", "bigint"),
    ("Fwd Pkts/b Avg", "Fwd Packet/Bulk Avg", "bigint"),
    ("Fwd Blk Rate Avg", "Fwd Bulk Rate Avg", "bigint"),
    ("Bwd Byts/b Avg", "Bwd Bytes/Bulk Avg", "bigint"),
    ("Bwd Pkts/b Avg", "Bwd Packet/Bulk Avg", "bigint"),
    ("Bwd Blk Rate Avg", "Bwd Bulk Rate Avg", "bigint"),
    ("Subflow Fwd Pkts", "Subflow Fwd Packets", "bigint"),
    ("Subflow Fwd Byts", "Subflow Fwd Bytes", "bigint"),
    ("Subflow Bwd Pkts", "Subflow Bwd Packets", "bigint"),
    ("Subflow Bwd Byts", "Subflow Bwd Bytes", "bigint"),
    ("Init Fwd Win Byts", "FWD Init Win Bytes", "bigint"),
    ("Init Bwd Win Byts", "Bwd Init Win Bytes", "bigint"),
    ("Fwd Act Data Pkts", "Fwd Act Data Pkts", "bigint"),
    ("Fwd Seg Size Min", "Fwd Seg Size Min", "bigint"),
    ("Active Mean", "Active Mean", "double"),
    ("Active Std", "Active Std", "double"),
    ("Active Max", "Active Max", "double"),
    ("Active Min", "Active Min", "double"),
    ("Idle Mean", "Idle Mean", "double"),
    ("Idle Std", "Idle Std", "double"),
    ("Idle Max", "Idle Max", "double"),
    ("Idle Min", "Idle Min", "double"),
    ("Label", "Label", "string"),
]
# ---- end of fixed values ------------------------------------------------------------------------------


def attack_windows(spark: SparkSession, rows=None) -> DataFrame:
    return spark.createDataFrame(ATTACK_WINDOW_ROWS if rows is None else rows, ATTACK_WINDOWS)


def day_params(spark: SparkSession, rows=None) -> DataFrame:
    return spark.createDataFrame(DAY_PARAM_ROWS if rows is None else rows, DAY_PARAMS)
