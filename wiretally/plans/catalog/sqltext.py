"""SQL building blocks (DuckDB dialect) that restate the semantics for the checks."""

from __future__ import annotations

BASE = 1704067200000000
SIZES = (1, 5, 30, 60, 300)


def flows(coarse: bool = False) -> str:
    target = "k // 20" if coarse else "k"
    inside = 2 if coarse else 20
    return f"""
e0 AS (
  SELECT event_id AS eid, user_id, event_type, value, epoch_us(ts) AS us,
         CAST(json_extract_string(props, '$.k') AS INTEGER) AS k
  FROM events),
f0 AS (
  SELECT lpad(CAST(eid AS VARCHAR), 12, '0') AS event_id, k, value, event_type,
         {BASE} + (us - {BASE}) // 3600 AS ts_us,
         '10.0.' || CAST(user_id // 250 AS VARCHAR) || '.' || CAST(user_id % 250 + 1 AS VARCHAR) AS src_ip,
         CASE WHEN {target} < {inside} THEN '10.1.0.' ELSE '198.51.100.' END || CAST({target} AS VARCHAR) AS dst_ip,
         1 + (eid * 7) % 1024 AS dst_port,
         CASE WHEN event_type = 'purchase' THEN 'udp' ELSE 'tcp' END AS transport,
         event_type AS service, event_type = 'error' AS failed_flow,
         CAST(floor(value * 100) AS BIGINT) AS orig_bytes,
         CAST(1 + k % 10 AS BIGINT) AS orig_packets, eid
  FROM e0),
flows AS (
  SELECT *, CASE WHEN NOT failed_flow THEN value / 100 END AS duration,
         CASE WHEN NOT failed_flow THEN orig_bytes * (k % 7) END AS resp_bytes,
         CASE WHEN NOT failed_flow THEN CAST(1 + k % 5 AS BIGINT) END AS resp_packets,
         CASE WHEN failed_flow THEN 'S0' ELSE 'SF' END AS connection_state,
         CASE WHEN event_type = 'purchase' THEN
              substr(md5(CAST(eid AS VARCHAR)), 1, 8 + k % 25) || '.d' || CAST(k % 7 AS VARCHAR) || '.example.com' END AS dns_query,
         CASE WHEN event_type = 'purchase' THEN CASE WHEN k % 3 = 0 THEN 'TXT' ELSE 'A' END END AS dns_qtype,
         CASE WHEN event_type = 'purchase' THEN CASE WHEN k % 4 = 0 THEN 'NXDOMAIN' ELSE 'NOERROR' END END AS dns_rcode,
         CASE WHEN event_type = 'purchase' THEN k % 3 END AS dns_answers,
         CASE WHEN event_type = 'purchase' THEN orig_bytes % 900 END AS dns_resp,
         CASE WHEN event_type = 'view' THEN 'h' || CAST(k AS VARCHAR) || '.example.net' END AS sni,
         CASE WHEN event_type = 'view' THEN 't13d' || CAST(k % 11 AS VARCHAR) END AS ja4
  FROM f0)"""


def entities(coarse: bool = False) -> str:
    """Entity rows with the per-event values."""
    return flows(coarse) + """,
fe AS (
  SELECT ts_us, event_id, src_ip, dst_ip, dst_port, service, ja4, dns_query, dns_qtype, dns_rcode, dns_resp, sni, eid, k,
         duration, orig_bytes AS v_out, coalesce(resp_bytes, 0) AS v_in,
         orig_packets AS v_opkt, coalesce(resp_packets, 0) AS v_rpkt,
         orig_packets + coalesce(resp_packets, 0) AS v_packets,
         CASE WHEN failed_flow AND transport = 'tcp' THEN 1 ELSE 0 END AS v_syn,
         CASE WHEN failed_flow OR (coalesce(resp_packets, 0) = 0 AND coalesce(resp_bytes, 0) = 0) THEN 1 ELSE 0 END AS v_failed,
         CASE WHEN transport = 'tcp' THEN 1 ELSE 0 END AS v_tcp,
         CASE WHEN transport = 'udp' THEN 1 ELSE 0 END AS v_udp,
         CAST(round(coalesce(duration, 0) * 1e6) AS BIGINT) AS v_dur,
         CASE WHEN duration IS NOT NULL THEN 1 ELSE 0 END AS v_durn,
         CASE WHEN dns_query IS NOT NULL THEN 1 ELSE 0 END AS v_dns,
         CASE WHEN dns_qtype = 'TXT' THEN 1 ELSE 0 END AS v_txt,
         CASE WHEN dns_rcode = 'NXDOMAIN' THEN 1 ELSE 0 END AS v_nx,
         coalesce(dns_resp, 0) AS v_dresp,
         CASE WHEN coalesce(dns_resp, 0) > 0 THEN 1 ELSE 0 END AS v_drespn,
         greatest(0.0, 1.0 - least(1.0, (row_number() OVER (PARTITION BY src_ip, dst_ip ORDER BY ts_us, event_id) - 1) / 20.0)) AS rarity,
         transport, src_ip LIKE '10.%' AS src_in, dst_ip LIKE '10.%' AS dst_in
  FROM flows),
ent AS (
  SELECT 'HOST' AS entity_kind, src_ip AS entity_id, * FROM fe
  UNION ALL SELECT 'DESTINATION', dst_ip, * FROM fe
  UNION ALL SELECT 'PAIR', src_ip || '->' || dst_ip, * FROM fe)"""


def emission(step: int = 1000000) -> str:
    """Greedy emission as a pointer walk (needs WITH RECURSIVE)."""
    return f"""
pts AS (SELECT DISTINCT entity_kind, entity_id, ts_us FROM ent),
hops AS (
  SELECT entity_kind, entity_id, ts_us,
         min(ts_us) OVER (PARTITION BY entity_kind, entity_id ORDER BY ts_us
                          RANGE BETWEEN {step} FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt
  FROM pts),
walk AS (
  SELECT entity_kind, entity_id, min(ts_us) AS ts_us FROM pts GROUP BY ALL
  UNION ALL
  SELECT h.entity_kind, h.entity_id, h.nxt FROM walk w JOIN hops h
    ON h.entity_kind = w.entity_kind AND h.entity_id = w.entity_id AND h.ts_us = w.ts_us
  WHERE h.nxt IS NOT NULL)"""


def reads() -> str:
    return emission() + """,
reads AS (
  SELECT entity_kind, entity_id, ts_us, 'emit' AS read FROM walk
  UNION ALL
  SELECT entity_kind, entity_id, (SELECT max(ts_us) FROM flows), 'flush' FROM pts GROUP BY entity_kind, entity_id)"""


def inside(size: int) -> str:
    return f"e.ts_us > r.ts_us - {size * 1000000}"


COUNTERS = (
    "v_out", "v_in", "v_opkt", "v_rpkt", "v_packets", "v_syn", "v_failed", "v_tcp", "v_udp",
    "v_dur", "v_durn", "v_dns", "v_txt", "v_nx", "v_dresp", "v_drespn",
)


def window_totals(sizes=SIZES, reads_name: str = "reads") -> str:
    """All running totals of every read point, by joining back to the raw rows."""
    widest = max(sizes)
    cols = []
    for s in sizes:
        cols.append(f"count(e.event_id) FILTER (WHERE {inside(s)}) AS n_{s}")
        cols += [f"coalesce(sum(e.{c}) FILTER (WHERE {inside(s)}), 0) AS {c}_{s}" for c in COUNTERS]
        for name, col in (("src", "src_ip"), ("dst", "dst_ip"), ("port", "dst_port"), ("svc", "service"), ("ja4", "ja4"), ("name", "dns_query")):
            cols.append(f"count(DISTINCT e.{col}) FILTER (WHERE {inside(s)}) AS u_{name}_{s}")
    return f"""
tot AS (
  SELECT r.entity_kind, r.entity_id, r.ts_us, r.read, {", ".join(cols)}
  FROM {reads_name} r LEFT JOIN ent e ON e.entity_kind = r.entity_kind AND e.entity_id = r.entity_id
    AND e.ts_us <= r.ts_us AND {inside(widest)}
  GROUP BY ALL)"""


def key_stats(col: str, sizes=SIZES, name: str = "ks") -> str:
    """Entropy and largest share of one key per read point and size."""
    counts = ", ".join(f"count(*) FILTER (WHERE {inside(s)}) AS c_{s}" for s in sizes)
    stats = []
    for s in sizes:
        stats.append(
            f"CASE WHEN sum(c_{s}) > 0 THEN greatest(0, log2(sum(c_{s})) - "
            f"coalesce(sum(c_{s} * log2(c_{s})) FILTER (WHERE c_{s} > 0), 0) / sum(c_{s})) ELSE 0 END AS h_{s}"
        )
        stats.append(f"CASE WHEN sum(c_{s}) > 0 THEN max(c_{s}) / sum(c_{s}) ELSE 0 END AS top_{s}")
        stats.append(f"count(*) FILTER (WHERE c_{s} > 0) AS k_{s}")
    return f"""
{name}_c AS (
  SELECT r.entity_kind, r.entity_id, r.ts_us, r.read, e.{col} AS key, {counts}
  FROM reads r JOIN ent e ON e.entity_kind = r.entity_kind AND e.entity_id = r.entity_id
    AND e.ts_us <= r.ts_us AND {inside(max(sizes))}
  WHERE e.{col} IS NOT NULL GROUP BY ALL),
{name} AS (SELECT entity_kind, entity_id, ts_us, read, {", ".join(stats)} FROM {name}_c GROUP BY ALL)"""


def ratio(a: str, b: str, cap: str = "1e6") -> str:
    return f"(CASE WHEN {b} > 0 THEN least({cap}, CAST({a} AS DOUBLE) / {b}) WHEN {a} > 0 THEN {cap} ELSE 0.0 END)"


def exceed(o: str, t: str, sat: str = "4.0") -> str:
    return (
        f"(CASE WHEN {t} <= 0 THEN (CASE WHEN {o} > 0 THEN 1.0 ELSE 0.0 END) WHEN {o} <= 0 THEN 0.0 "
        f"WHEN ln(greatest(({o}) / {t}, 1e-9)) <= 0 THEN greatest(0.0, 0.5 * ({o}) / {t}) "
        f"ELSE least(1.0, 0.5 + 0.5 * least(1.0, ln(greatest(({o}) / {t}, 1e-9)) / ln(greatest({sat}, 1.0001)))) END)"
    )


def r6(expr: str, name: str) -> str:
    """Six decimals; the nudge keeps exact halves from rounding differently in two engines."""
    return f"round(CAST({expr} AS DOUBLE) + 1e-9, 6) AS {name}"
