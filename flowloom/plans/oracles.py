"""DuckDB SQL giving the same rows as the registered queries, over the same tables."""

from __future__ import annotations

from flowloom.plans.fixtures import DAY, DAY_FILES, GRAPH_SIZE, SRC_FILE, WINDOW_ROWS, window_starts
from flowloom.plans.queries import MULTI_DAYS
from flowloom.plans.written import PER_FILE
from flowloom.schemas import ATTACK_WINDOW_ROWS, DAY_PARAM_ROWS, DEFAULT_PARAMS, MAX_PACKETS

LEFTOVER = 1 << 60


def whole(x: str, scale: str = "1e6") -> str:
    return f"CAST(floor(CAST({x} AS DOUBLE) * {scale} + 5e-1) AS BIGINT)"


def text(a: str, scale: str | None = "1e6") -> str:
    one = whole("x", scale) if scale else "CAST(x AS BIGINT)"
    return f"array_to_string(list_transform({a}, lambda x: CAST({one} AS VARCHAR)), ',')"


def ip_number(c: str) -> str:
    return " + ".join(f"CAST(split_part({c}, '.', {i + 1}) AS BIGINT) * {256 ** (3 - i)}" for i in range(4))


def pad(a: str, fill: str, n: int = 32) -> str:
    return f"list_concat(({a})[1:{n}], list_transform(range(0, {n}), lambda z: {fill}))[1:{n}]"


def squared(a: str, b: str) -> str:
    return (
        f"list_sum(list_transform(range(1, len({a}) + 1), lambda i: (CAST({a}[i] AS DOUBLE) - CAST({b}[i] AS DOUBLE))"
        f" * (CAST({a}[i] AS DOUBLE) - CAST({b}[i] AS DOUBLE))))"
    )


def text_list(items) -> str:
    return "[" + ", ".join(f"'{x}'" for x in items) + "]"


_SINCE = (
    "CAST(epoch_us(ts) - 1704067200000000 AS DOUBLE) / (CASE WHEN user_id % 10 = 0 THEN 24000e6 ELSE 240e6 END)"
    " + (CASE WHEN user_id % 10 = 0 THEN 1800e0 ELSE 0e0 END) + 1518700000e0"
)
PACKETS = f"""
raw_packets AS (
  SELECT event_id AS pkt_idx, {_SINCE} AS ts,
         '18.219.' || (user_id // 250) || '.' || (user_id % 250) AS cip,
         CAST(40000 + user_id % 20000 AS INT) AS cport,
         CASE WHEN user_id % 10 < 3 THEN '172.31.' || (70 + user_id // 150) || '.' || (user_id % 50)
              ELSE '172.31.69.' || (user_id % 3) END AS sip,
         [80,443,21,22,53][user_id % 5 + 1] AS sport,
         CAST(60 + floor(value * 3) AS INT) AS size, event_type, event_id % 2 AS rev
  FROM events),
packets AS (
  SELECT '{SRC_FILE}' AS src_file, pkt_idx, ts, size,
         CASE WHEN rev = 0 THEN cip ELSE sip END AS src_ip, CASE WHEN rev = 0 THEN sip ELSE cip END AS dst_ip,
         CASE WHEN rev = 0 THEN cport ELSE sport END AS src_port, CASE WHEN rev = 0 THEN sport ELSE cport END AS dst_port,
         CASE WHEN sport = 53 THEN 17 ELSE 6 END AS proto,
         CASE WHEN sport = 53 THEN 0 WHEN event_type = 'signup' THEN 2 WHEN event_type = 'error' THEN 4
              WHEN event_type = 'purchase' THEN 17 WHEN event_type = 'click' THEN 16 ELSE 24 END AS flags
  FROM raw_packets)"""


def keyed(name: str, a: str, b: str) -> str:
    return f"""
{name} AS (
  SELECT src_file, pkt_idx, ts, size, proto, flags,
         CASE WHEN fwd THEN src_ip ELSE dst_ip END AS srcip, CASE WHEN fwd THEN dst_ip ELSE src_ip END AS dstip,
         CASE WHEN fwd THEN src_port ELSE dst_port END AS srcport, CASE WHEN fwd THEN dst_port ELSE src_port END AS dstport,
         CASE WHEN fwd THEN 1 ELSE -1 END AS dir
  FROM (SELECT *, ({a} < {b}) OR ({a} = {b} AND src_port <= dst_port) AS fwd FROM packets))"""


KEYED = keyed("keyed", f"({ip_number('src_ip')})", f"({ip_number('dst_ip')})")
KEYED_TEXT = keyed("keyed_text", "src_ip", "dst_ip")
_KEY = "src_file, srcip, dstip, srcport, dstport, proto"
FLOWS = f"""
m1 AS (
  SELECT *, CASE WHEN proto = 6 THEN CASE WHEN flags & 4 <> 0 THEN 'R' WHEN flags & 1 <> 0 THEN 'F' WHEN flags & 16 <> 0 THEN 'A' END END AS cls
  FROM keyed),
m2 AS (
  SELECT *, lag(ts) OVER w AS pts, lag(cls) OVER w AS pcls, lead(pkt_idx) OVER w AS nxt
  FROM m1 WINDOW w AS (PARTITION BY {_KEY} ORDER BY pkt_idx)),
m3 AS (
  SELECT *, sum(CASE WHEN pts IS NULL OR ts - pts > (CASE WHEN proto = 6 THEN 300 ELSE 120 END) OR coalesce(pcls = 'R', false) THEN 1 ELSE 0 END)
    OVER (PARTITION BY {_KEY} ORDER BY pkt_idx) AS hard
  FROM m2),
m4 AS (
  SELECT *, last_value(CASE WHEN cls IN ('F', 'A') THEN cls END IGNORE NULLS)
    OVER (PARTITION BY {_KEY}, hard ORDER BY pkt_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen
  FROM m3),
m5 AS (SELECT *, coalesce(cls = 'A' AND seen = 'F', false) AS closing FROM m4),
m6 AS (
  SELECT *, coalesce(sum(CASE WHEN closing THEN 1 ELSE 0 END)
    OVER (PARTITION BY {_KEY}, hard ORDER BY pkt_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sub
  FROM m5),
flows AS (
  SELECT src_file || '#' || min(pkt_idx) AS flow_id, {_KEY}, 0 AS part, count(*) AS n_pkts,
         list(size ORDER BY pkt_idx) AS pktsize, list(ts ORDER BY pkt_idx) AS pktts, list(dir ORDER BY pkt_idx) AS pktdirs,
         min(ts) AS pktts_start, max(ts) AS pktts_end,
         CASE WHEN max_by(closing OR coalesce(cls = 'R', false), pkt_idx) THEN max(pkt_idx) * 2 + 1
              WHEN max_by(coalesce(nxt, -1), pkt_idx) >= 0 THEN max_by(coalesce(nxt, -1), pkt_idx) * 2
              ELSE min(pkt_idx) + {LEFTOVER} END AS emit_at
  FROM m6 GROUP BY {_KEY}, hard, sub)"""

_WINDOW_VALUES = ", ".join(
    f"({o}, {text_list(att)}, {text_list(vic)}, TIMESTAMP '2018-02-15 {s.zfill(5)}:00', TIMESTAMP '2018-02-15 {e.zfill(5)}:00', '{lab}')"
    for _, o, att, vic, s, e, lab in WINDOW_ROWS
)
_LOCAL = "TIMESTAMP '1970-01-01' + to_microseconds(CAST(round({0} * 1e6) AS BIGINT)) - INTERVAL 4 HOURS"
LABELLED = f"""
windows(ord, att, vic, w_start, w_end, label) AS (VALUES {_WINDOW_VALUES}),
labelled AS (
  SELECT f.*, {_LOCAL.format('f.pktts_start')} AS local_start, {_LOCAL.format('f.pktts_end')} AS local_end,
         coalesce((SELECT max_by(w.label, w.ord) FROM windows w
           WHERE ((list_contains(w.att, f.srcip) AND list_contains(w.vic, f.dstip)) OR (list_contains(w.vic, f.srcip) AND list_contains(w.att, f.dstip)))
             AND {_LOCAL.format('f.pktts_start')} >= w.w_start AND {_LOCAL.format('f.pktts_end')} <= w.w_end), 'Benign') AS label
  FROM flows f)"""

SIZE = "list_transform({0}, lambda s: CAST(CASE WHEN s > 0 THEN atan(log2(CAST(s AS DOUBLE)) / 8e0) * (2e0 / pi()) ELSE -1e0 END AS FLOAT))"


def gaps(ts: str, kind: str = "FLOAT") -> str:
    g = f"CAST(CAST(CAST({ts}[i + 1] AS {kind}) - CAST({ts}[i] AS {kind}) AS FLOAT) AS DOUBLE)"
    one = f"CAST(CASE WHEN {g} < 1e-1 THEN 0e0 ELSE least(round_even({g} / 5e-2, 0) * 5e-2, 1e1) / 1e1 END AS FLOAT)"
    return f"list_transform(range(1, 33), lambda i: CASE WHEN i < len({ts}) THEN {one} ELSE CAST(0 AS FLOAT) END)"


def offset(kind: str = "FLOAT") -> str:
    return (
        f"CAST(ln(1e0 + CAST(CAST(CAST(pktts[1] AS {kind}) - CAST((SELECT min(pktts_start) FROM flows) AS {kind}) AS FLOAT) AS DOUBLE)) / 12e0 AS FLOAT)"
    )


def f_time(kind: str = "FLOAT") -> str:
    """Needs a column ``off`` made by offset()."""
    return f"list_transform({gaps('pktts', kind)}, lambda g: CAST(CAST(g AS DOUBLE) + CAST(off AS DOUBLE) AS FLOAT))"


FEATURES = f"""
roles AS (
  SELECT *, CASE WHEN srcport < dstport THEN srcip ELSE dstip END AS server_ip, CASE WHEN srcport < dstport THEN srcport ELSE dstport END AS server_port,
         CASE WHEN srcport < dstport THEN dstip ELSE srcip END AS client_ip, CASE WHEN srcport < dstport THEN dstport ELSE srcport END AS client_port,
         CASE WHEN label <> 'Benign' THEN 1 ELSE 0 END AS y, {offset()} AS off
  FROM labelled),
feat1 AS (
  SELECT flow_id, src_file, emit_at, srcip, dstip, n_pkts, server_ip, server_port, client_ip, client_port, y, pktts,
         {SIZE.format(pad('pktsize', '1'))} AS f_size,
         list_transform({pad('pktdirs', '0')}, lambda d: CAST(CASE WHEN d = -1 THEN 5e-1 ELSE d END AS FLOAT)) AS f_dir,
         {f_time()} AS f_time, least(len(pktdirs), 32) AS eff_len
  FROM roles),
features AS MATERIALIZED (
  SELECT *, list_transform(range(1, 33), lambda i: CAST(f_size[i] * f_dir[i] AS FLOAT)) AS f_signed FROM feat1)"""

CLUSTERS = f"""
numbered AS MATERIALIZED (SELECT row_number() OVER (ORDER BY src_file, emit_at) AS rn, * FROM features),
near AS MATERIALIZED (
  SELECT a.rn AS a, b.rn AS b FROM numbered a JOIN numbered b
    ON a.server_ip = b.server_ip AND a.server_port = b.server_port AND {squared('a.f_signed', 'b.f_signed')} <= 1e-1 * 1e-1),
reach AS (
  SELECT a AS node, a AS root FROM near
  UNION
  SELECT n.b, r.root FROM reach r JOIN near n ON n.a = r.node WHERE r.root < n.b),
roots AS (
  SELECT n.rn, n.server_ip, n.server_port, min(r.root) AS root,
         (SELECT count(*) FROM near x WHERE x.a = n.rn) AS degree
  FROM numbered n JOIN reach r ON r.node = n.rn GROUP BY ALL),
clusters AS MATERIALIZED (
  SELECT n.*, CASE WHEN c.degree < 2 THEN -1
    ELSE dense_rank() OVER (PARTITION BY c.server_ip, c.server_port, c.degree < 2 ORDER BY c.root) - 1 END AS cluster_id
  FROM numbered n JOIN roots c ON c.rn = n.rn)"""

PROFILE = """
profile AS (
  SELECT server_ip, server_port, count(*) AS n_flows, count(DISTINCT client_ip) AS n_clients, count(DISTINCT cluster_id) AS n_clusters, max(y) AS malicious
  FROM clusters GROUP BY ALL)"""


def benign(many: str = "3", least: str = "2", few: str = "2") -> str:
    return f"(n_clients > {many} AND n_clusters >= {least}) OR (n_clients <= {many} AND n_flows <= {few})"


def gates(p: dict, by: str = "", profile: str = "profile", clusters: str = "clusters") -> str:
    """CTEs benign_s and gates; ``by`` is '' or 'day,'."""
    on = "p.day = b.day AND " if by else ""
    return f"""
benign_s AS (SELECT {by} server_ip, server_port, {benign(p['clientiplent'], p['flowidlenmin'], p['serdatalistmax'])} AS benign FROM {profile}),
gates AS (
  SELECT {by} client_ip, n_flows, n_servers,
         CASE WHEN NOT suspect THEN 'all_benign' WHEN n_flows = 1 THEN 'one_flow' WHEN n_servers = n_flows THEN 'all_distinct'
              WHEN n_servers > {p['lenseridsetmin']} THEN 'many_servers' WHEN n_flows < {p['winsize']} THEN 'short' ELSE 'scan' END AS gate
  FROM (SELECT {by.replace('day', 'p.day')} p.client_ip, sum(p.n) AS n_flows, count(*) AS n_servers, bool_or(NOT b.benign) AS suspect
               {", any_value(p.winsize) AS winsize, any_value(p.lenseridsetmin) AS lenseridsetmin" if by else ""}
        FROM (SELECT {by} client_ip, server_ip, server_port, count(*) AS n {", any_value(winsize) AS winsize, any_value(lenseridsetmin) AS lenseridsetmin" if by else ""}
              FROM {clusters} GROUP BY {by} client_ip, server_ip, server_port) p
        JOIN benign_s b ON {on} p.server_ip = b.server_ip AND p.server_port = b.server_port GROUP BY {by.replace('day', 'p.day')} p.client_ip))"""


def ordered(by: str = "", source: str = "clusters", name: str = "ordered", keys: str = "client_ip") -> str:
    return f"""
{name} AS (
  SELECT *, row_number() OVER w - 1 AS pos, CAST(f_time[1] AS DOUBLE) - coalesce(lag(CAST(f_time[1] AS DOUBLE)) OVER w, 0) AS dt
  FROM (SELECT *, min(emit_at) OVER (PARTITION BY {by} server_ip, server_port) AS seen FROM {source})
  WINDOW w AS (PARTITION BY {by} {keys} ORDER BY f_time, seen, emit_at))"""


def verdict(p: dict, by: str = "", source: str = "clusters") -> str:
    same = "AND v.day = g.day" if by else ""
    size, limit = ("winsize", "tss_entro_t") if by else (p["winsize"], p["tss_entro_t"])
    ent = "greatest((ln(sum(c)) - sum(c * ln(c)) / sum(c)) / ln(2), 0)"
    return f"""
scan_rows AS (SELECT v.* FROM {source} v JOIN gates g ON v.client_ip = g.client_ip {same} WHERE g.gate = 'scan'),
{ordered(by, 'scan_rows', 'scanned')},
windowed AS (SELECT *, pos // {size} AS win FROM scanned),
id_e AS (SELECT {by} client_ip, win, {ent} AS id_entropy FROM (SELECT {by} client_ip, win, server_ip, server_port, count(*) AS c FROM windowed GROUP BY ALL) GROUP BY {by} client_ip, win),
dt_e AS (SELECT {by} client_ip, win, {ent} AS dt_entropy FROM (SELECT {by} client_ip, win, dt, count(*) AS c FROM windowed GROUP BY ALL) GROUP BY {by} client_ip, win),
verdicts AS (
  SELECT w.flow_id, w.client_ip, 'scan' AS gate, w.pos, w.win, w.y, i.id_entropy, d.dt_entropy {", w.day" if by else ""},
         CASE WHEN i.id_entropy > 1 + 1e-9 OR d.dt_entropy > {limit} + 1e-9 THEN 0 ELSE 1 END AS pred
  FROM windowed w JOIN id_e i USING ({by} client_ip, win) JOIN dt_e d USING ({by} client_ip, win)
  UNION ALL
  SELECT v.flow_id, v.client_ip, g.gate, NULL, NULL, v.y, NULL, NULL {", v.day" if by else ""}, 0
  FROM {source} v JOIN gates g ON v.client_ip = g.client_ip {same} WHERE g.gate <> 'scan')"""


def positions(tag: str) -> str:
    return (
        f"list_transform(list_sort(list_transform(range(0, eff_len), lambda i: {{'h': md5('42|{tag}|' || flow_id || '|' || i), 'i': i}})),"
        f" lambda s: s.i)[1:greatest(1, CAST(floor(eff_len * 3e-1) AS INT))]"
    )


VIEW_MASK = "list_transform(range(0, 32), lambda i: CASE WHEN list_contains(p, i) THEN CAST(-1e-1 AS FLOAT) ELSE f_size[i + 1] END)"
VIEW_MISSING = pad("list_transform(list_filter(range(0, 32), lambda i: NOT list_contains(p, i)), lambda i: f_size[i + 1])", "CAST(0 AS FLOAT)")


def with_positions(tag: str) -> str:
    return f"drawn AS (SELECT *, {positions(tag)} AS p FROM features)"


def ring(keys: str, source: str, ident: str = "flow_id", at_least: int = 1) -> str:
    return f"""
ranked AS (
  SELECT {keys}, {ident} AS id, row_number() OVER (PARTITION BY {keys} ORDER BY md5('42|' || {ident}), {ident}) - 1 AS p, count(*) OVER (PARTITION BY {keys}) AS n
  FROM {source}),
triplets AS (
  SELECT {', '.join('a.' + k.strip() for k in keys.split(','))}, a.id AS anchor_id, b.id AS s1_id, c.id AS s2_id
  FROM ranked a JOIN ranked b ON {' AND '.join(f'a.{k.strip()} = b.{k.strip()}' for k in keys.split(','))} AND b.p = (a.p + 1) % a.n
  JOIN ranked c ON {' AND '.join(f'a.{k.strip()} = c.{k.strip()}' for k in keys.split(','))} AND c.p = (a.p + (CASE WHEN a.n = 2 THEN 1 ELSE 2 END)) % a.n
  WHERE a.n >= {at_least})"""


def similarity_parts(a: str, b: str) -> dict[str, str]:
    """Expressions over lists ``a`` and ``b`` already free of joint padding."""
    dot = "list_sum(list_transform(range(1, len({0}) + 1), lambda i: CAST({0}[i] AS DOUBLE) * CAST({1}[i] AS DOUBLE)))"
    norms = f"sqrt({dot.format(a, a)}) * sqrt({dot.format(b, b)})"
    return {
        "cos": f"CASE WHEN {norms} > 0 THEN {dot.format(a, b)} / ({norms}) ELSE 0e0 END",
        "ws": f"1e0 - list_sum(list_transform(range(1, len({a}) + 1), lambda i: abs(CAST(list_sort({a})[i] AS DOUBLE) - CAST(list_sort({b})[i] AS DOUBLE)))) / greatest(len({a}), 1)",
        "jw": f"jaro_winkler_similarity(array_to_string(list_transform({a}, lambda x: chr(CAST(64 + x AS INT))), ''), array_to_string(list_transform({b}, lambda x: chr(CAST(64 + x AS INT))), ''))",
    }


_FUSED = (
    "(exp((cos - top) / 1e-1) * cos + exp((jw - top) / 1e-1) * jw + exp((ws - top) / 1e-1) * ws)"
    " / (exp((cos - top) / 1e-1) + exp((jw - top) / 1e-1) + exp((ws - top) / 1e-1))"
)
_TRIM = "list_transform(list_filter(range(1, len({0}) + 1), lambda i: NOT ({0}[i] = 0 AND {1}[i] = 0)), lambda i: {2}[i])"


def similar(source: str, a: str, b: str, name: str, keep: str, codes: bool = False) -> str:
    """CTE ``name`` with cos, jw, ws, sim for lists a, b. ``codes``: one character per distinct value of the pair."""
    s = similarity_parts("xa", "xb")
    if codes:
        code = "array_to_string(list_transform({0}, lambda x: chr(CAST(63 + list_position(seen, x) AS INT))), '')"
        s["jw"] = f"jaro_winkler_similarity({code.format('xa')}, {code.format('xb')})"
    return f"""
{name}_t AS (SELECT {keep}, {_TRIM.format(a, b, a)} AS xa, {_TRIM.format(a, b, b)} AS xb FROM {source}),
{name}_s AS (SELECT {keep}, {s['cos']} AS cos, {s['jw']} AS jw, {s['ws']} AS ws FROM (SELECT *, list_distinct(list_concat(xa, xb)) AS seen FROM {name}_t)),
{name} AS (SELECT *, {_FUSED} AS sim FROM (SELECT *, greatest(cos, jw, ws) AS top FROM {name}_s))"""


SEQUENCES = f"""
sequences AS (
  SELECT l_orderkey AS seq_id,
         list(CAST(l_quantity AS INT) ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS sizes
  FROM lineitem GROUP BY l_orderkey),
padded AS (SELECT seq_id, {pad('sizes', '0')} AS v, row_number() OVER (ORDER BY seq_id) AS pos FROM sequences),
seq_pairs AS (SELECT a.seq_id, b.seq_id AS next_id, a.v AS a, b.v AS b FROM padded a JOIN padded b ON b.pos = a.pos + 1),
{similar('seq_pairs', 'a', 'b', 'scored', 'seq_id, next_id')}"""

VIEW_PAIRS = """
view_pairs AS (
  SELECT k, coalesce(i.embedding, j.embedding) AS z_i, coalesce(j.embedding, i.embedding) AS z_j, k // 16 AS batch_id
  FROM (SELECT vec_id // 2 AS k, embedding FROM embeddings WHERE vec_id % 2 = 0) i
  FULL JOIN (SELECT vec_id // 2 AS k, embedding FROM embeddings WHERE vec_id % 2 = 1) j USING (k))"""

_NORM = "sqrt(list_sum(list_transform({0}, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))))"


def unit(v: str) -> str:
    return f"list_transform({v}, lambda x: CAST(x AS DOUBLE) / greatest({_NORM.format(v)}, 1e-8))"


BASE = [PACKETS, KEYED, FLOWS, LABELLED, FEATURES]
DEFAULTS = {k: str(v) for k, v in DEFAULT_PARAMS.items()}
MIXED = {**DEFAULTS, "clientiplent": "60", "flowidlenmin": "9", "lenseridsetmin": "1", "winsize": "3"}


def sql(final: str, *ctes: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{','.join(ctes)} {final}" if ctes else final


def upto(*ctes: str) -> list[str]:
    return [*BASE, *ctes]


def clustered(final: str, *ctes: str) -> str:
    return sql(final, *BASE, CLUSTERS, PROFILE, *ctes, recursive=True)


def _flow_rows(source: str) -> str:
    return (
        f"SELECT flow_id, srcip, dstip, CAST(srcport AS BIGINT) AS srcport, CAST(dstport AS BIGINT) AS dstport, CAST(proto AS BIGINT) AS proto,"
        f" CAST(part AS BIGINT) AS part, n_pkts, {text('pktsize', None)} AS sizes, {text('pktts')} AS times, {text('pktdirs', None)} AS dirs,"
        f" CAST(emit_at AS BIGINT) AS emit_at FROM {source}"
    )


def _in_parts(source: str, size: int = MAX_PACKETS) -> str:
    cut = ", ".join(f"{c}[{size} * part + 1 : {size} * part + {size}] AS {c}" for c in ("pktsize", "pktts", "pktdirs"))
    return f"(SELECT * REPLACE ({cut}) FROM (SELECT * EXCLUDE (part), unnest(generate_series(0, (n_pkts - 1) // {size})) AS part FROM {source}))"


GROUPED = f"""
grouped AS (
  SELECT src_file || '#' || min(pkt_idx) AS flow_id, {_KEY}, 0 AS part, count(*) AS n_pkts, list(size ORDER BY pkt_idx) AS pktsize,
         list(ts ORDER BY pkt_idx) AS pktts, list(dir ORDER BY pkt_idx) AS pktdirs, min(pkt_idx) + {LEFTOVER} AS emit_at
  FROM keyed_text GROUP BY {_KEY})"""
_KEY_COLS = "pkt_idx, srcip, dstip, CAST(srcport AS BIGINT) AS srcport, CAST(dstport AS BIGINT) AS dstport, CAST(dir AS BIGINT) AS dir"
_VERDICT_COLS = (
    f"flow_id, client_ip, gate, CAST(pos AS BIGINT) AS pos, CAST(win AS BIGINT) AS win, CAST(pred AS BIGINT) AS pred, CAST(y AS BIGINT) AS y,"
    f" {whole('id_entropy')} AS id_entropy_u, {whole('dt_entropy')} AS dt_entropy_u"
)
_METRICS = (
    "SELECT {0} FROM (SELECT sum((y = pred)::INT) / count(*) AS accuracy, coalesce(sum((y = 1 AND pred = 1)::INT) / nullif(sum((pred = 1)::INT), 0), 0) AS precision,"
    " coalesce(sum((y = 1 AND pred = 1)::INT) / nullif(sum((y = 1)::INT), 0), 0) AS recall,"
    " coalesce(2 * sum((y = 1 AND pred = 1)::INT) / nullif(sum((pred = 1)::INT) + sum((y = 1)::INT), 0), 0) AS f1 FROM verdicts)"
)
_FOUR = ", ".join(f"{whole(c, '1e9')} AS {c}" for c in ("accuracy", "precision", "recall", "f1"))
_MULTI = "multi AS (SELECT * FROM features WHERE n_pkts > 1)"
_GATHER = (
    "SELECT t.*, a.f_size AS anchor, b.f_size AS s1, c.f_size AS s2 FROM triplets t JOIN features a ON a.flow_id = t.anchor_id"
    " JOIN features b ON b.flow_id = t.s1_id JOIN features c ON c.flow_id = t.s2_id"
)
_DAYS = f"""
by_day0 AS (SELECT *, ({text_list(MULTI_DAYS)})[CAST(split_part(client_ip, '.', 4) AS INT) % {len(MULTI_DAYS)} + 1] AS day FROM clusters),
day_params(day, winsize, tss_entro_t, serdatalistmax, clientiplent, flowidlenmin, lenseridsetmin) AS (
  VALUES {', '.join("('" + r[0] + "', " + ', '.join(str(x) for x in r[1:]) + ')' for r in DAY_PARAM_ROWS)}),
by_day AS MATERIALIZED (
  SELECT b.*, {', '.join(f'coalesce(p.{k}, {v}) AS {k}' for k, v in DEFAULTS.items())} FROM by_day0 b LEFT JOIN day_params p ON p.day = b.day),
day_profile AS (
  SELECT day, server_ip, server_port, count(*) AS n_flows, count(DISTINCT client_ip) AS n_clients, count(DISTINCT cluster_id) AS n_clusters,
         {', '.join(f'any_value({k}) AS {k}' for k in DEFAULTS)}
  FROM by_day GROUP BY day, server_ip, server_port)"""
_NAMES = {k: k for k in DEFAULTS}

_STATS_INPUT = f"""
stats_rows AS (
  SELECT l_suppkey % 65536 AS dst_port, {whole('l_extendedprice', '100')} AS duration, CAST(l_quantity AS BIGINT) AS fwd, {whole('l_discount', '100')} AS mean_c,
         CASE WHEN l_partkey % 4 = 0 THEN 1 ELSE 0 END::BIGINT AS no_idle, CASE WHEN l_partkey % 9 = 0 THEN 1 ELSE 0 END::BIGINT AS endless,
         strftime(l_shipdate, '%d/%m/%Y %H:%M:%S') AS stamp, 'flag ' || l_returnflag AS label
  FROM lineitem)"""


def _dbscan(source: str, group: str, vec: str, ident: str, order: str, eps2: str, m: int, tag: str) -> str:
    """CTEs ending in ``db_{tag}`` (ident, group, cluster_id): core rows, their components, border rows."""
    return f"""
pts_{tag} AS MATERIALIZED (SELECT row_number() OVER (ORDER BY {order}) AS rn, {ident} AS id, {group} AS g, {vec} AS v FROM {source}),
nb_{tag} AS MATERIALIZED (SELECT a.rn AS a, b.rn AS b FROM pts_{tag} a JOIN pts_{tag} b ON a.g = b.g AND {squared('a.v', 'b.v')} <= {eps2}),
core_{tag} AS MATERIALIZED (SELECT a AS rn FROM nb_{tag} GROUP BY a HAVING count(*) >= {m}),
link_{tag} AS MATERIALIZED (SELECT n.a, n.b FROM nb_{tag} n JOIN core_{tag} x ON x.rn = n.a JOIN core_{tag} y ON y.rn = n.b),
reach_{tag} AS (SELECT rn AS node, rn AS root FROM core_{tag} UNION SELECT l.b, r.root FROM reach_{tag} r JOIN link_{tag} l ON l.a = r.node WHERE r.root < l.b),
comp_{tag} AS MATERIALIZED (SELECT p.rn, p.g, min(r.root) AS root FROM pts_{tag} p JOIN reach_{tag} r ON r.node = p.rn GROUP BY ALL),
num_{tag} AS MATERIALIZED (SELECT rn, dense_rank() OVER (PARTITION BY g ORDER BY root) - 1 AS cid FROM comp_{tag}),
border_{tag} AS (SELECT n.a AS rn, min(c.cid) AS cid FROM nb_{tag} n JOIN num_{tag} c ON c.rn = n.b WHERE n.a NOT IN (SELECT rn FROM core_{tag}) GROUP BY n.a),
db_{tag} AS (SELECT p.id, p.g, coalesce(c.cid, b.cid, -1) AS cluster_id FROM pts_{tag} p LEFT JOIN num_{tag} c USING (rn) LEFT JOIN border_{tag} b USING (rn))"""


def _mlp() -> tuple[str, str]:
    """Layer CTEs: activations as (flow_id, node, value) joined with a generated weights table."""
    shapes = [(16, 32), (8, 16), (16, 8), (32, 16)]
    ctes = ["act0 AS (SELECT flow_id, unnest(range(0, 32)) AS node, CAST(unnest(f_signed) AS DOUBLE) AS x FROM features)"]
    for i, (n_out, n_in) in enumerate(shapes):
        ctes.append(
            f"w{i} AS (SELECT o.range AS o, i.range AS i, (((({i} * 31 + o.range * 17 + i.range * 7) % 11) - 5) / 20e0) AS w FROM range({n_out}) o, range({n_in}) i)"
        )
        total = "sum(x * w)" if i == len(shapes) - 1 else "greatest(sum(x * w), 0e0)"
        ctes.append(f"act{i + 1} AS (SELECT flow_id, o AS node, {total} AS x FROM act{i} JOIN w{i} ON node = i GROUP BY flow_id, o)")
    return ",".join(ctes), f"SELECT flow_id, {text('list(x ORDER BY node)')} AS v FROM act4 GROUP BY flow_id"


_MLP_CTES, _MLP_FINAL = _mlp()

GRAPH = f"""
{_MULTI},
windowed_g AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY src_file, emit_at) - 1 AS seq FROM multi),
gw AS MATERIALIZED (SELECT *, seq // {GRAPH_SIZE} AS graph_id FROM windowed_g),
first_seen AS (
  SELECT graph_id, ip, min(first_at) AS first_at FROM (SELECT graph_id, srcip AS ip, seq * 2 AS first_at FROM gw UNION ALL SELECT graph_id, dstip, seq * 2 + 1 FROM gw) GROUP BY ALL),
nodes AS MATERIALIZED (SELECT graph_id, ip, row_number() OVER (PARTITION BY graph_id ORDER BY first_at) - 1 AS node_id FROM first_seen),
edges AS MATERIALIZED (
  SELECT g.graph_id, g.flow_id, s.node_id AS src_node, d.node_id AS dst_node, g.f_size AS feat
  FROM gw g JOIN nodes s ON s.graph_id = g.graph_id AND s.ip = g.srcip JOIN nodes d ON d.graph_id = g.graph_id AND d.ip = g.dstip)"""

CONTEXT = """
ends AS (SELECT graph_id, src_node AS node, dst_node AS far, feat FROM edges UNION ALL SELECT graph_id, dst_node, src_node, feat FROM edges),
h1 AS MATERIALIZED (
  SELECT graph_id, node, dim, avg(x) AS h FROM (SELECT graph_id, node, unnest(range(0, 32)) AS dim, CAST(unnest(feat) AS DOUBLE) AS x FROM ends) GROUP BY ALL),
h2 AS (SELECT e.graph_id, e.node, h1.dim, avg(h1.h) AS h FROM ends e JOIN h1 ON h1.graph_id = e.graph_id AND h1.node = e.far GROUP BY ALL),
state AS MATERIALIZED (SELECT graph_id, node, list(h ORDER BY dim) AS h FROM h2 GROUP BY ALL),
context AS (
  SELECT e.flow_id, list_concat(list_concat(s.h, d.h), list_transform(e.feat, lambda x: CAST(x AS DOUBLE))) AS c
  FROM edges e JOIN state s ON s.graph_id = e.graph_id AND s.node = e.src_node JOIN state d ON d.graph_id = e.graph_id AND d.node = e.dst_node)"""

_FEATURE = lambda c: sql(f"SELECT flow_id, {text(c)} AS v FROM features", *BASE)
_TRIPLET_COLS = "anchor_id, s1_id, s2_id"

ORACLES: dict[str, str] = {
    "canonical_key": sql(f"SELECT {_KEY_COLS} FROM keyed", PACKETS, KEYED),
    "canonical_key_text": sql(f"SELECT {_KEY_COLS} FROM keyed_text", PACKETS, KEYED_TEXT),
    "proto_filter": sql(
        "SELECT pkt_idx, CAST(p AS BIGINT) AS proto, CAST(CASE WHEN p = 17 THEN 0 ELSE flags END AS BIGINT) AS flags"
        " FROM (SELECT *, CASE WHEN pkt_idx % 7 = 0 THEN 1 ELSE proto END AS p FROM packets) WHERE p IN (6, 17)", PACKETS),
    "packet_limit": sql("SELECT pkt_idx, CAST(size AS BIGINT) AS size FROM packets WHERE pkt_idx < 500", PACKETS),
    "flow_assembly": sql(_flow_rows("flows"), PACKETS, KEYED, FLOWS),
    "flow_group": sql(_flow_rows("grouped"), PACKETS, KEYED_TEXT, GROUPED),
    "flow_assembly_parts": sql(_flow_rows(_in_parts("flows")), PACKETS, KEYED, FLOWS),
    "flow_group_parts": sql(_flow_rows(_in_parts("grouped")), PACKETS, KEYED_TEXT, GROUPED),
    "flow_roundtrip_parts": sql(_flow_rows(_in_parts("flows")), PACKETS, KEYED, FLOWS),
    "flow_group_long": sql(
        _flow_rows("(SELECT * REPLACE (pktsize[1:4] AS pktsize, pktts[1:4] AS pktts, pktdirs[1:4] AS pktdirs) FROM grouped)"), PACKETS, KEYED_TEXT, GROUPED),
    "flow_parts_long": sql(
        f"SELECT flow_id, CAST(part AS BIGINT) AS part, n_pkts, {text('pktsize[4 * part + 1 : 4 * part + 4]', None)} AS sizes"
        " FROM (SELECT * EXCLUDE (part), unnest(generate_series(0, (n_pkts - 1) // 4)) AS part FROM grouped)", PACKETS, KEYED_TEXT, GROUPED),
    "flow_roundtrip": sql(_flow_rows("flows"), PACKETS, KEYED, FLOWS),
    "flow_extent": sql(f"SELECT flow_id, {whole('pktts_start')} AS start_us, {whole('pktts_end')} AS end_us FROM flows", PACKETS, KEYED, FLOWS),
    "multi_packet": sql("SELECT flow_id, n_pkts FROM flows WHERE n_pkts > 1", PACKETS, KEYED, FLOWS),
    "client_server": sql("SELECT flow_id, server_ip, client_ip, CAST(server_port AS BIGINT) AS server_port, CAST(client_port AS BIGINT) AS client_port FROM features", *BASE),
    "day_partitions": sql(
        f"SELECT '{DAY}' AS day, strftime(strptime(split_part('{SRC_FILE}', '/', 1), '%A-%d-%m-%Y'), '%Y-%m-%d') AS capture_date, count(*) AS n FROM packets", PACKETS),
    "attack_label": sql("SELECT flow_id, label FROM labelled", *BASE[:4]),
    "binary_target": sql("SELECT label, CAST(CASE WHEN label <> 'Benign' THEN 1 ELSE 0 END AS BIGINT) AS y, count(*) AS n FROM labelled GROUP BY ALL", *BASE[:4]),
    "label_encode": sql("SELECT flow_id, label, dense_rank() OVER (ORDER BY label) - 1 AS label_num FROM labelled", *BASE[:4]),
    "local_time": sql(
        "SELECT flow_id, strftime(local_start, '%Y-%m-%d %H:%M:%S.%f') AS local_start, strftime(local_end, '%Y-%m-%d %H:%M:%S.%f') AS local_end FROM labelled", *BASE[:4]),
    "pad_clip": sql(f"SELECT flow_id, {text(pad('pktsize', '1'), None)} AS sizes, {text(pad('pktdirs', '0'), None)} AS dirs FROM flows", PACKETS, KEYED, FLOWS),
    "size_channel": _FEATURE("f_size"),
    "direction_channel": _FEATURE("f_dir"),
    "signed_size": _FEATURE("f_signed"),
    "time_channel": _FEATURE("f_time"),
    "time_channel_float64": sql(f"SELECT flow_id, {text(f_time('DOUBLE'))} AS v FROM (SELECT *, {offset('DOUBLE')} AS off FROM flows)", PACKETS, KEYED, FLOWS),
    "gap_channel": sql(
        f"SELECT flow_id, {text(gaps('pktts'))} AS epoch_gaps, {text(gaps('rel'))} AS small_gaps"
        " FROM (SELECT *, list_transform(pktts, lambda t: t - 1518700000e0) AS rel FROM flows)", PACKETS, KEYED, FLOWS),
    "effective_len": sql("SELECT flow_id, CAST(eff_len AS BIGINT) AS eff_len FROM features", *BASE),
    "view_mask": sql(f"SELECT flow_id, {text(VIEW_MASK)} AS v FROM drawn", *BASE, with_positions("mask")),
    "view_missing": sql(f"SELECT flow_id, {text(VIEW_MISSING)} AS v FROM drawn", *BASE, with_positions("missing")),
    "view_duplicate": sql(
        f"SELECT flow_id, {text(pad('list_concat(f_size[1:eff_len], list_transform(p, lambda i: f_size[i + 1]))', 'CAST(0 AS FLOAT)'))} AS v FROM drawn",
        *BASE, with_positions("duplicate")),
    # Swaps from the highest position down carry the last value of a run of positions to just before the run.
    "view_reorder": sql(
        f"""SELECT flow_id, {text('''list_transform(range(0, 32), lambda i: CASE WHEN list_contains(s, i) THEN f_size[i]
            WHEN list_contains(s, i + 1) THEN f_size[1 + list_min(list_filter(range(i + 1, 33), lambda j: NOT list_contains(s, j + 1)))]
            ELSE f_size[i + 1] END)''')} AS v
        FROM (SELECT *, CASE WHEN list_contains(p, 0) AND list_contains(p, 1) THEN list_filter(p, lambda q: q > 1)
                             ELSE list_transform(p, lambda q: greatest(q, 1)) END AS s FROM drawn)""", *BASE, with_positions("reorder")),
    "exact_sample": sql("SELECT flow_id FROM flows ORDER BY md5('42|' || flow_id), flow_id LIMIT 1000", PACKETS, KEYED, FLOWS),
    "train_test_split": sql(
        "SELECT flow_id, CASE WHEN row_number() OVER (ORDER BY md5('42|' || flow_id), flow_id) <= floor(7e-1 * (SELECT count(*) FROM flows)) THEN 'train' ELSE 'test' END AS part FROM flows",
        PACKETS, KEYED, FLOWS),
    "triplets_server": sql(f"SELECT server_ip, CAST(server_port AS BIGINT) AS server_port, {_TRIPLET_COLS} FROM triplets", *BASE, _MULTI, ring("server_ip, server_port", "multi")),
    "triplets_window": sql(
        f"SELECT CAST(graph_id AS BIGINT) AS graph_id, server_ip, CAST(server_port AS BIGINT) AS server_port, {_TRIPLET_COLS} FROM triplets", *BASE, GRAPH,
        ring("graph_id, server_ip, server_port", "gw")),
    "triplets_service": sql(f"SELECT CAST(server_port AS BIGINT) AS server_port, {_TRIPLET_COLS} FROM triplets", *BASE, _MULTI, ring("server_port", "multi")),
    "triplets_big_groups": sql(f"SELECT server_ip, client_ip, {_TRIPLET_COLS} FROM triplets", *BASE, ring("server_ip, client_ip", "features", at_least=3)),
    "triplet_features": sql(
        f"SELECT anchor_id, {text('anchor')} AS anchor, {text('s1')} AS s1, {text('s2')} AS s2 FROM ({_GATHER})", *BASE, _MULTI, ring("server_ip, server_port", "multi")),
    "group_offsets": sql(
        "SELECT flow_id, row_number() OVER (ORDER BY server_ip, server_port, emit_at) - 1 AS global_idx,"
        " CAST((SELECT count(*) FROM features b WHERE (b.server_ip, b.server_port) < (a.server_ip, a.server_port)) AS BIGINT) AS group_offset,"
        " row_number() OVER (PARTITION BY server_ip, server_port ORDER BY emit_at) - 1 AS intra_idx FROM features a", *BASE),
    "server_groups": sql(
        "SELECT flow_id FROM (SELECT flow_id, count(*) OVER w AS n, max(y) OVER w AS bad FROM features WINDOW w AS (PARTITION BY server_ip, server_port)) WHERE n > 2 AND bad = 1", *BASE),
    "eps_neighbours": clustered("SELECT n.flow_id, count(*) - 1 AS n_neighbours FROM numbered n JOIN near x ON x.a = n.rn GROUP BY n.flow_id"),
    "server_clusters": clustered("SELECT flow_id, server_ip, CAST(server_port AS BIGINT) AS server_port, CAST(cluster_id AS BIGINT) AS cluster_id FROM clusters"),
    "clusters_json": clustered(
        f"SELECT flow_id, server_ip, client_ip, CAST(server_port AS BIGINT) AS server_port, CAST(cluster_id AS BIGINT) AS cluster_id, CAST(y AS BIGINT) AS y, {text('f_time')} AS f_time FROM clusters"),
    "dbscan": sql(
        " UNION ALL ".join(f"SELECT id AS vec_id, CAST(g AS BIGINT) AS label, CAST(cluster_id AS BIGINT) AS cluster_id, CAST({m} AS BIGINT) AS min_samples FROM db_{m}" for m in (2, 3, 5)),
        *[_dbscan("embeddings", "label", "embedding", "vec_id", "vec_id", "12e-1 * 12e-1", m, str(m)) for m in (2, 3, 5)], recursive=True),
    "dbscan_flows": sql(
        "SELECT id AS flow_id, CAST(cluster_id AS BIGINT) AS cluster_id FROM db_f", *BASE,
        "kept AS (SELECT * FROM (SELECT *, count(*) OVER w AS n, max(y) OVER w AS bad FROM features WINDOW w AS (PARTITION BY server_ip, server_port)) WHERE n > 2 AND bad = 1)",
        _dbscan("kept", "0", "f_signed", "flow_id", "src_file, emit_at", "1e-4 * 1e-4", 5, "f"), recursive=True),
    "server_profile": clustered(
        "SELECT server_ip, CAST(server_port AS BIGINT) AS server_port, n_flows, n_clients, n_clusters, CAST(malicious AS BIGINT) AS malicious FROM profile"),
    "benign_servers": clustered(f"SELECT server_ip, CAST(server_port AS BIGINT) AS server_port, CAST({benign()} AS BIGINT) AS benign FROM profile"),
    "client_recovery": sql("SELECT flow_id, client_ip FROM features", *BASE),
    "entropy": clustered(
        f"SELECT server_ip, CAST(server_port AS BIGINT) AS server_port, {whole('greatest((ln(sum(c)) - sum(c * ln(c)) / sum(c)) / ln(2), 0)')} AS entropy_u"
        " FROM (SELECT server_ip, server_port, cluster_id, count(*) AS c FROM clusters GROUP BY ALL) GROUP BY server_ip, server_port"),
    "client_gates": clustered("SELECT client_ip, gate, CAST(n_flows AS BIGINT) AS n_flows, n_servers FROM gates", gates(DEFAULTS)),
    "client_gates_mixed": clustered(
        "SELECT client_ip, gate, CAST(n_flows AS BIGINT) AS n_flows, n_servers FROM gates",
        "mixed AS (SELECT * REPLACE (substr(md5(flow_id), 1, 3) AS client_ip) FROM clusters)",
        "mixed_profile AS (SELECT server_ip, server_port, count(*) AS n_flows, count(DISTINCT client_ip) AS n_clients, count(DISTINCT cluster_id) AS n_clusters FROM mixed GROUP BY ALL)",
        gates(MIXED, "", "mixed_profile", "mixed")),
    "interflow_gap": clustered(f"SELECT flow_id, pos, {whole('dt')} AS dt_u FROM ordered", ordered()),
    "count_windows": clustered("SELECT flow_id, pos, pos // 4 AS win FROM ordered", ordered()),
    "verdicts": clustered(f"SELECT {_VERDICT_COLS} FROM verdicts", gates(DEFAULTS), verdict(DEFAULTS)),
    "verdict_by_day": clustered(
        f"SELECT {_VERDICT_COLS}, day FROM verdicts", _DAYS, gates(_NAMES, "day,", "day_profile", "by_day"), verdict(_NAMES, "day,", "by_day")),
    "metrics_binary": clustered(_METRICS.format(_FOUR), gates(DEFAULTS), verdict(DEFAULTS)),
    "metrics_macro": sql(
        f"SELECT {_FOUR} FROM (SELECT sum(tp) / sum(ap) AS accuracy, avg(coalesce(tp / nullif(pp, 0), 0)) AS precision, avg(coalesce(tp / nullif(ap, 0), 0)) AS recall,"
        " avg(coalesce(2 * tp / nullif(pp + ap, 0), 0)) AS f1 FROM (SELECT c, (SELECT count(*) FROM pairs WHERE y = c) AS ap, (SELECT count(*) FROM pairs WHERE p = c) AS pp,"
        " (SELECT count(*) FROM pairs WHERE y = c AND p = c) AS tp FROM (SELECT y AS c FROM pairs UNION SELECT p FROM pairs)))",
        "pairs AS (SELECT label AS y, (label + CASE WHEN vec_id % 3 = 0 THEN 1 ELSE 0 END) % 10 AS p FROM embeddings)"),
    "client_sequences": clustered(
        "SELECT server_ip, client_ip, CAST(server_port AS BIGINT) AS server_port, pos, CAST(cluster_id AS BIGINT) AS cluster_id, CAST(y AS BIGINT) AS y, flow_id FROM ordered",
        "kept AS (SELECT c.* FROM clusters c JOIN profile p ON p.server_ip = c.server_ip AND p.server_port = c.server_port WHERE p.n_flows > p.n_clients AND p.malicious = 1)",
        ordered("", "kept", "ordered", "server_ip, server_port, client_ip")),
    "client_timeline": clustered(
        f"SELECT client_ip, flow_id, server_ip, CAST(server_port AS BIGINT) AS server_port, pos, CAST(cluster_id AS BIGINT) AS cluster_id, CAST(y AS BIGINT) AS y, {whole('dt')} AS dt_u,"
        f" {text('list_transform(range(1, 33), lambda i: CAST(f_time[i] AS DOUBLE) - coalesce(CAST(f_time[i - 1] AS DOUBLE), 0e0))')} AS step_diffs FROM ordered",
        "kept AS (SELECT * FROM clusters WHERE client_ip IN (SELECT client_ip FROM clusters WHERE y = 1))", ordered("", "kept")),
    "vector_sort": sql("SELECT flow_id, row_number() OVER (ORDER BY f_time, emit_at) - 1 AS pos FROM features", *BASE),
    "intraflow_diff": sql(
        f"SELECT flow_id, {text('list_transform(range(1, 33), lambda i: CAST(f_time[i] AS DOUBLE) - coalesce(CAST(f_time[i - 1] AS DOUBLE), 0e0))')} AS v FROM features", *BASE),
    "sim_cosine": sql(f"SELECT seq_id, next_id, {whole('cos')} AS sim_u FROM scored", SEQUENCES),
    "sim_jaro_winkler": sql(f"SELECT seq_id, next_id, {whole('jw')} AS sim_u FROM scored", SEQUENCES),
    "sim_wasserstein": sql(f"SELECT seq_id, next_id, {whole('ws')} AS sim_u FROM scored", SEQUENCES),
    "flow_similarity": sql(f"SELECT seq_id, next_id, {whole('sim')} AS sim_u FROM scored", SEQUENCES),
    "l2_normalise": f"SELECT vec_id, {text(unit('embedding'))} AS v FROM embeddings",
    "mse": sql(f"SELECT {whole('sum(' + squared('z_i', 'z_j') + ') / sum(len(z_i))', '1e9')} AS mse_n FROM view_pairs", VIEW_PAIRS),
    "masked_mse": sql(
        " UNION ALL ".join(
            f"SELECT '{v}/{r}' AS \"case\", {whole(('sum(d * m)' if r == 'sum' else 'sum(d * m) / greatest(sum(m), 1)'), '1e9')} AS mse_n FROM {v}_l"
            for v in ("v_mask", "v_missing") for r in ("mean", "sum")),
        *BASE,
        *[
            f"{v}_d AS (SELECT *, {positions(tag)} AS p FROM features), {v}_v AS (SELECT f_size, {expr} AS x FROM {v}_d),"
            f" {v}_l AS (SELECT CASE WHEN b <> 0 THEN 1 ELSE 0 END AS m, (a - b) * (a - b) AS d FROM (SELECT CAST(unnest(x) AS DOUBLE) AS a, CAST(unnest(f_size) AS DOUBLE) AS b FROM {v}_v))"
            for v, tag, expr in (("v_mask", "mask", VIEW_MASK), ("v_missing", "missing", VIEW_MISSING))
        ]),
    "nt_xent": sql(
        f"SELECT batch_id, {whole('avg(lse - pos)')} AS loss_u, count(*) AS n_rows FROM (SELECT batch_id, a, ln(sum(exp(s - 1e1))) + 1e1 AS lse, max(CASE WHEN mate THEN s END) AS pos FROM sims WHERE NOT self GROUP BY batch_id, a) GROUP BY batch_id",
        VIEW_PAIRS,
        f"z AS (SELECT batch_id, k, 0 AS side, {unit('z_i')} AS z FROM view_pairs UNION ALL SELECT batch_id, k, 1, {unit('z_j')} FROM view_pairs)",
        "sims AS (SELECT x.batch_id, x.k * 2 + x.side AS a, x.k = y.k AND x.side = y.side AS self, x.k = y.k AND x.side <> y.side AS mate,"
        " list_sum(list_transform(range(1, len(x.z) + 1), lambda i: x.z[i] * y.z[i])) / 1e-1 AS s FROM z x JOIN z y ON x.batch_id = y.batch_id)"),
    "triplet_margin": sql(
        f"SELECT anchor_id, {whole('margin', '1e9')} AS margin_n FROM m UNION ALL SELECT -1, {whole('avg(margin)', '1e9')} FROM m",
        ring("label", "embeddings", "vec_id"),
        "d AS (SELECT t.anchor_id, t.anchor_id % 2 = 0 AS p1, t.anchor_id % 3 = 0 AS p2,"
        f" {squared('a.embedding', 'b.embedding')} / len(a.embedding) AS d1, {squared('a.embedding', 'c.embedding')} / len(a.embedding) AS d2 FROM triplets t"
        " JOIN embeddings a ON a.vec_id = t.anchor_id JOIN embeddings b ON b.vec_id = t.s1_id JOIN embeddings c ON c.vec_id = t.s2_id)",
        "m AS (SELECT anchor_id, CASE WHEN p1 AND NOT p2 THEN d1 - d2 WHEN p2 AND NOT p1 THEN d2 - d1 ELSE 0e0 END AS margin FROM d)"),
    "mlp_score": sql(_MLP_FINAL, *BASE, _MLP_CTES),
    "embed_flows": _FEATURE("f_signed"),
    "embed_unit": sql(f"SELECT flow_id, {text(unit('f_signed'))} AS v FROM features", *BASE),
    "graph_windows": sql("SELECT flow_id, seq, graph_id FROM gw", *BASE, GRAPH),
    "flow_graph": sql(
        "SELECT 'node' AS kind, graph_id, ip AS name, node_id AS a, CAST(-1 AS BIGINT) AS b FROM nodes"
        " UNION ALL SELECT 'edge', graph_id, flow_id, src_node, dst_node FROM edges", *BASE, GRAPH),
    "edge_context": sql(f"SELECT flow_id, {text(unit('c'))} AS v FROM context", *BASE, GRAPH, CONTEXT),
    "clean_stats": (
        "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, CASE WHEN l_partkey % 3 = 0 THEN -1 ELSE l_suppkey END AS l_suppkey,"
        f" CASE WHEN l_partkey % 7 = 0 OR l_partkey % 11 = 0 THEN -100 ELSE {whole('l_quantity', '100')} END AS qty,"
        f" CASE WHEN l_partkey % 13 = 0 OR l_partkey % 5 = 0 THEN -100 ELSE {whole('l_extendedprice', '100')} END AS price FROM lineitem"),
    "feature_disable": "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_suppkey FROM lineitem",
    "packets_from_pcap": sql(
        f"SELECT pkt_idx // {PER_FILE} AS file_no, row_number() OVER (PARTITION BY pkt_idx // {PER_FILE} ORDER BY pkt_idx) AS pkt_idx,"
        f" {whole('us // 1000000 + (us % 1000000) / 1e6')} AS ts_us, src_ip, dst_ip, CAST(src_port AS BIGINT) AS src_port, CAST(dst_port AS BIGINT) AS dst_port,"
        " CAST(proto AS BIGINT) AS proto, CAST(flags AS BIGINT) AS flags, CAST(size AS BIGINT) AS size"
        f" FROM (SELECT *, {whole('ts')} AS us FROM packets)", PACKETS),
    "packets_from_csv": sql(
        "SELECT CAST(size AS BIGINT) AS size, src_ip, dst_ip, CAST(src_port AS BIGINT) AS src_port, CAST(dst_port AS BIGINT) AS dst_port, CAST(proto AS BIGINT) AS proto FROM packets", PACKETS),
    "stats_csv": sql("SELECT * FROM stats_rows", _STATS_INPUT),
    "stats_csv_b": sql("SELECT * FROM stats_rows", _STATS_INPUT),
    "stats_union": sql("SELECT label, count(*) * 2 AS n, CAST(sum(duration) * 2 AS BIGINT) AS duration, CAST(sum(mean_c) * 2 AS BIGINT) AS mean_c FROM stats_rows GROUP BY label", _STATS_INPUT),
    "stats_mixed": sql(
        "SELECT label, count(*) * 2 AS n, CAST(sum(duration) * 2 AS BIGINT) AS duration, CAST(sum(mean_c) * 2 AS BIGINT) AS mean_c FROM stats_rows WHERE label <> 'flag A,1,2' GROUP BY label",
        _STATS_INPUT),
    "stats_dataset": (
        "SELECT CAST(label_num AS BIGINT) AS label_num, count(*) AS n, CAST(sum(l_suppkey % 65536) AS BIGINT) AS ports,"
        f" {whole('sum(CASE WHEN l_partkey % 9 = 0 THEN -1 ELSE l_quantity END)', '1')} AS bytes,"
        f" {whole('sum(CASE WHEN l_partkey % 4 = 0 THEN -1 ELSE l_tax END)', '100')} AS idle_c, CAST(77 AS BIGINT) AS width"
        " FROM (SELECT *, dense_rank() OVER (ORDER BY l_returnflag) - 1 AS label_num FROM lineitem) GROUP BY label_num"),
    "labelled_sequences": sql(
        f"SELECT seq_id, {text('sizes', None)} AS items, seq_id % 2 AS label FROM sequences WHERE len(sizes) + 1 > 3",
        "sequences AS (SELECT l_orderkey AS seq_id, list(CAST(l_quantity AS INT) ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS sizes FROM lineitem GROUP BY l_orderkey)"),
}
ORACLES["triplet_similarity"] = sql(
    f"SELECT anchor_id, s1_id, s2_id, {whole('q1.sim')} AS s1_u, {whole('q2.sim')} AS s2_u, CAST(q1.sim > 75e-2 AS BIGINT) AS p1, CAST(q2.sim > 75e-2 AS BIGINT) AS p2"
    " FROM q1 JOIN q2 USING (anchor_id, s1_id, s2_id)",
    *BASE, _MULTI, ring("server_ip, server_port", "multi"), f"gathered AS MATERIALIZED ({_GATHER})",
    similar("gathered", "anchor", "s1", "q1", _TRIPLET_COLS, True), similar("gathered", "anchor", "s2", "q2", _TRIPLET_COLS, True),
)

# ---- streams: the packets renumbered in time order ----
_TIMED = PACKETS.replace("packets AS (\n  SELECT '", "packets_c AS (\n  SELECT '") + """,
packets AS (SELECT * REPLACE (row_number() OVER (ORDER BY ts, pkt_idx) - 1 AS pkt_idx) FROM packets_c)"""
def _principal(source: str, col: str, k: int, rounds: int = 1500) -> list[str]:
    """Leading eigenvalues e0, e1, ... of the covariance, by power iteration and deflation."""
    parts = [
        f"pc_n0 AS (SELECT row_number() OVER () AS r, {col} AS v FROM {source})",
        "pc_d0 AS (SELECT unnest(generate_series(1, (SELECT max(len(v)) FROM pc_n0))) AS i)",
        "pc_mean0 AS (SELECT i, avg(CAST(v[i] AS DOUBLE)) AS mu FROM pc_n0, pc_d0 GROUP BY i)",
        "pc_dev0 AS (SELECT r, i, CAST(v[i] AS DOUBLE) - mu AS x FROM pc_n0 JOIN pc_mean0 ON true)",
        "pc_cov0 AS (SELECT a.i, b.i AS j, sum(a.x * b.x) / ((SELECT count(*) FROM pc_n0) - 1) AS c FROM pc_dev0 a JOIN pc_dev0 b USING (r) GROUP BY 1, 2)",
        "pc_m0 AS (SELECT list(row ORDER BY i) AS m FROM (SELECT i, list(c ORDER BY j) AS row FROM pc_cov0 GROUP BY i))",
    ]
    for a in range(k):
        product = "list_transform(m, lambda r: list_dot_product(r, v))"
        parts.append(
            f"pc_p{a} AS (SELECT 0 AS n, m, list_transform(m, lambda r, i: 1e0 + sin(i)) AS v FROM pc_m{a} UNION ALL"
            f" SELECT n + 1, m, list_transform(w, lambda x: x / sqrt(list_dot_product(w, w))) FROM (SELECT n, m, {product} AS w FROM pc_p{a} WHERE n < {rounds}))"
        )
        parts.append(f"pc_e{a} AS MATERIALIZED (SELECT m, v, list_dot_product(v, {product}) AS l FROM pc_p{a} WHERE n = {rounds})")
        parts.append(f"pc_m{a + 1} AS (SELECT list_transform(m, lambda r, i: list_transform(r, lambda x, j: x - l * v[i] * v[j])) AS m FROM pc_e{a})")
    return parts


def _axes(k: int) -> str:
    return " UNION ALL ".join(f"SELECT CAST({a} AS BIGINT) AS axis, {whole('l', '1e5')} AS variance FROM pc_e{a}" for a in range(k))


def _quoted(items: list[str]) -> str:
    return "[" + ", ".join(f"'{i}'" for i in items) + "]"


_SPAN = ", ".join(
    f"({n}, '{day}', {_quoted(att)}, {_quoted(vic)}, {at}, {int(row[1])},"
    f" {at + 60 * ((int(row[5].split(':')[0]) * 60 + int(row[5].split(':')[1])) - (int(row[4].split(':')[0]) * 60 + int(row[4].split(':')[1])))}, '{row[6]}')"
    for (n, day, att, vic, at), row in zip(window_starts(), ATTACK_WINDOW_ROWS)
)
ORACLES["attack_label_days"] = f"""
WITH w(n, day, att, vic, begins, ord, till, label) AS (VALUES {_SPAN}),
f AS (
  SELECT 'e' || event_id AS flow_id, day, att[event_id // 22 % len(att) + 1] AS a, vic[event_id // 22 % len(vic) + 1] AS v, event_id % 2 = 0 AS out,
    begins - 600 + event_id * 37 % 7200 AS t0, begins - 600 + event_id * 37 % 7200 + event_id % 300 AS t1
  FROM events JOIN w ON w.n = event_id % {len(ATTACK_WINDOW_ROWS)}),
d AS (SELECT flow_id, day, if(out, a, v) AS s, if(out, v, a) AS t, t0, t1 FROM f)
SELECT flow_id, day, coalesce((SELECT max_by(w.label, w.ord) FROM w WHERE w.day = d.day AND t0 >= w.begins AND t1 <= w.till
  AND ((list_contains(att, s) AND list_contains(vic, t)) OR (list_contains(vic, s) AND list_contains(att, t)))), 'Benign') AS label
FROM d
"""
ORACLES["pca_variance"] = sql(_axes(2), *_principal("embeddings", "embedding", 2), recursive=True)
ORACLES["linear_variance"] = sql(_axes(4), *BASE, *_principal("features", "f_signed", 4), recursive=True)
ORACLES["stream_flow_assembly"] = sql(
    f"SELECT flow_id, srcip, dstip, CAST(srcport AS BIGINT) AS srcport, CAST(dstport AS BIGINT) AS dstport, CAST(proto AS BIGINT) AS proto, CAST(0 AS BIGINT) AS part, n_pkts,"
    f" {text('pktsize', None)} AS sizes, {text('pktts')} AS times, {text('pktdirs', None)} AS dirs FROM flows", _TIMED, KEYED, FLOWS)
ORACLES["stream_long_flows"] = sql(
    f"SELECT flow_id, n_pkts, {text('pktsize[1:2]', None)} AS sizes, {whole('pktts_start')} AS start_us, {whole('pktts_end')} AS end_us FROM flows WHERE proto = 17",
    _TIMED, KEYED, FLOWS)
ORACLES["stream_idle_sessions"] = sql(
    f"SELECT srcip, dstip, CAST(srcport AS BIGINT) AS srcport, CAST(dstport AS BIGINT) AS dstport, CAST(proto AS BIGINT) AS proto, count(*) AS n_pkts,"
    f" CAST(sum(size) AS BIGINT) AS bytes, {whole('min(ts)')} AS start_us, {whole('max(ts)')} AS end_us FROM s2 GROUP BY src_file, srcip, dstip, srcport, dstport, proto, no",
    _TIMED, KEYED,
    f"s1 AS (SELECT *, ts - lag(ts) OVER (PARTITION BY {_KEY} ORDER BY pkt_idx) AS gap FROM keyed)",
    f"s2 AS (SELECT *, sum(CASE WHEN gap > (CASE WHEN proto = 6 THEN 300 ELSE 120 END) THEN 1 ELSE 0 END) OVER (PARTITION BY {_KEY} ORDER BY pkt_idx) AS no FROM s1)")
ORACLES["stream_attack_label"] = ORACLES["attack_label"]
ORACLES["stream_late_packets"] = sql(
    f"SELECT 'late' AS kind, srcip, dstip, CAST(srcport AS BIGINT) AS srcport, CAST(dstport AS BIGINT) AS dstport, CAST(proto AS BIGINT) AS proto, pkt_idx, CAST(1 AS BIGINT) AS n_pkts FROM told WHERE late"
    f" UNION ALL SELECT 'flows', srcip, dstip, CAST(srcport AS BIGINT), CAST(dstport AS BIGINT), CAST(proto AS BIGINT), CAST(-1 AS BIGINT), count(*) FROM told WHERE NOT late GROUP BY {_KEY}",
    _TIMED, KEYED,
    "sliced AS (SELECT *, CASE WHEN pkt_idx % 97 = 0 THEN 2 ELSE pkt_idx * 3 // (SELECT count(*) FROM packets) END AS slice FROM keyed)",
    "mark AS (SELECT floor(max(ts) * 1e3) - 6e5 AS ms FROM sliced WHERE slice < 2)",
    "told AS (SELECT *, slice = 2 AND ts * 1e3 < (SELECT ms FROM mark) AS late FROM sliced)")
ORACLES["stream_features"] = sql(
    f"SELECT flow_id, {text('f_time')} AS v, CASE WHEN emit_at % 2 = 1 AND emit_at < {LEFTOVER} THEN emit_at ELSE -1 END AS closed_at FROM features", _TIMED, KEYED, FLOWS, LABELLED, FEATURES)
ORACLES["dbscan_blocks"] = sql(
    "SELECT id AS vec_id, CAST(g AS BIGINT) AS label, CAST(cluster_id AS BIGINT) AS cluster_id FROM db_3",
    _dbscan("embeddings", "label", "embedding", "vec_id", "vec_id", "12e-1 * 12e-1", 3, "3"), recursive=True)

_SCORED = [
    _MLP_CTES, "scored_v AS (SELECT flow_id, list(CAST(x AS FLOAT) ORDER BY node) AS f_scored FROM act4 GROUP BY flow_id)",
    "scored_features AS MATERIALIZED (SELECT f.*, v.f_scored FROM features f JOIN scored_v v USING (flow_id))",
    CLUSTERS.replace("f_signed", "f_scored").replace("FROM features", "FROM scored_features"),
]
ORACLES["scored_clusters"] = sql(
    "SELECT flow_id, server_ip, CAST(server_port AS BIGINT) AS server_port, CAST(cluster_id AS BIGINT) AS cluster_id FROM clusters", *BASE, *_SCORED, recursive=True)
ORACLES["scored_verdicts"] = sql(f"SELECT {_VERDICT_COLS} FROM verdicts", *BASE, *_SCORED, PROFILE, gates(DEFAULTS), verdict(DEFAULTS), recursive=True)
ORACLES["embed_mlp"] = ORACLES["mlp_score"]
_OF_DAYS = PACKETS.replace("packets AS (\n  SELECT '", "packets_c AS (\n  SELECT '") + f""",
packets AS (SELECT * REPLACE ([{', '.join(repr(f) for f in DAY_FILES)}][pkt_idx * 3 // (SELECT count(*) FROM packets_c) + 1] AS src_file) FROM packets_c)"""
ORACLES["flow_assembly_days"] = sql(
    f"SELECT flow_id, split_part(src_file, '/', 1) AS day, n_pkts, row_number() OVER (ORDER BY src_file, emit_at) - 1 AS place,"
    f" {whole('pktts_start')} AS start_us, {whole('pktts_end')} AS end_us FROM flows", _OF_DAYS, KEYED, FLOWS)
ORACLES["day_files"] = sql(
    "SELECT split_part(src_file, '/', 1) AS day, CASE WHEN src_file LIKE 'Thu%' THEN '2018-02-15' ELSE '2018-02-16' END AS capture_date, src_file, count(*) AS n FROM packets GROUP BY ALL", _OF_DAYS)
ORACLES["server_groups_stored"] = ORACLES["server_groups"]
