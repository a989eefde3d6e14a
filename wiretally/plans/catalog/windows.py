"""Queries over the sliding-window, timing, emission and baseline operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from wiretally.operators import features as ft
from wiretally.operators import emission
from wiretally.operators.entities import entity_events
from wiretally.params import DEFAULT
from wiretally.plans.catalog import sqltext as q
from wiretally.plans.catalog.registry import QUERIES, query, r6
from wiretally.sources.event_flows import read_flows

KEY = ["entity_kind", "entity_id", "ts_us", "read"]


def _vectors(spark, sf, names, params=DEFAULT, coarse=False, facts=False):
    return ft.vectors(read_flows(spark, sf, coarse), params, names, protocol=False, facts=facts)


def _rounded(df, names, keys=KEY):
    return df.select(*keys, *[r6(n) for n in names])


def _sql(body: str, *ctes: str, coarse: bool = False) -> str:
    return "WITH RECURSIVE " + ",".join([q.entities(coarse), *ctes]) + " " + body


_KEYSQL = "entity_kind, entity_id, ts_us, read"

_counts = [f"{b}_{s}s" for s in (1, 5, 60, 300) for b in ("flow_count", "flows_per_sec", "packets_per_sec", "syn_count", "syn_rate", "udp_rate")]


@query("P8 W1 A1 R1", _sql(
    "SELECT " + _KEYSQL + ", " + ", ".join(
        q.r6(e.format(s=s), f"{b}_{s}s") for s in (1, 5, 60, 300) for b, e in (
            ("flow_count", "n_{s}"), ("flows_per_sec", "n_{s} / {s}.0"), ("packets_per_sec", "v_packets_{s} / {s}.0"),
            ("syn_count", "v_syn_{s}"), ("syn_rate", "v_syn_{s} / {s}.0"), ("udp_rate", "v_udp_{s} / {s}.0"))
    ) + " FROM tot", q.reads(), q.window_totals()))
def sliding_counts_and_rates(spark, sf):
    return _rounded(_vectors(spark, sf, _counts), _counts)


_bytes = [f"{b}_{s}s" for s in (1, 30, 300) for b in (
    "bytes_per_sec", "bytes_out_per_sec", "bytes_in_per_sec", "bytes_out_total", "bytes_in_total",
    "mean_packet_size", "mean_duration")]


@query("W1 A1", _sql(
    "SELECT " + _KEYSQL + ", " + ", ".join(
        q.r6(e.format(s=s), f"{b}_{s}s") for s in (1, 30, 300) for b, e in (
            ("bytes_per_sec", "(v_out_{s} + v_in_{s}) / {s}.0"), ("bytes_out_per_sec", "v_out_{s} / {s}.0"),
            ("bytes_in_per_sec", "v_in_{s} / {s}.0"), ("bytes_out_total", "v_out_{s}"), ("bytes_in_total", "v_in_{s}"),
            ("mean_packet_size", q.ratio("(v_out_{s} + v_in_{s})", "v_packets_{s}")),
            ("mean_duration", "CASE WHEN v_durn_{s} > 0 THEN v_dur_{s} / 1e6 / v_durn_{s} ELSE 0 END"))
    ) + " FROM tot", q.reads(), q.window_totals()))
def sliding_volumes(spark, sf):
    return _rounded(_vectors(spark, sf, _bytes), _bytes)


_ratios = [f"{b}_{s}s" for s in (5, 60) for b in (
    "syn_ratio", "failed_ratio", "tcp_ratio", "udp_ratio", "icmp_ratio", "orig_resp_byte_ratio",
    "orig_resp_packet_ratio", "amplification_ratio", "fanout")]


@query("W4 F18 P2 P3", _sql(
    "SELECT " + _KEYSQL + ", " + ", ".join(
        q.r6(e.format(s=s), f"{b}_{s}s") for s in (5, 60) for b, e in (
            ("syn_ratio", q.ratio("v_syn_{s}", "n_{s}", "1.0")), ("failed_ratio", q.ratio("v_failed_{s}", "n_{s}", "1.0")),
            ("tcp_ratio", q.ratio("v_tcp_{s}", "n_{s}", "1.0")), ("udp_ratio", q.ratio("v_udp_{s}", "n_{s}", "1.0")),
            ("icmp_ratio", "0.0"), ("orig_resp_byte_ratio", q.ratio("v_out_{s}", "v_in_{s}")),
            ("orig_resp_packet_ratio", q.ratio("v_opkt_{s}", "v_rpkt_{s}")),
            ("amplification_ratio", q.ratio("v_in_{s}", "v_out_{s}")), ("fanout", q.ratio("u_dst_{s}", "n_{s}", "1.0")))
    ) + " FROM tot", q.reads(), q.window_totals()))
def sliding_ratios(spark, sf):
    return _rounded(_vectors(spark, sf, _ratios), _ratios)


_unique = [f"{b}_{s}s" for s in (1, 5, 30, 60, 300) for b in (
    "unique_src_ips", "unique_dst_ips", "unique_dst_ports", "unique_services", "unique_ja4")]


@query("W2 A2", _sql(
    "SELECT " + _KEYSQL + ", " + ", ".join(
        q.r6(f"u_{c}_{s}", f"{b}_{s}s") for s in q.SIZES for b, c in (
            ("unique_src_ips", "src"), ("unique_dst_ips", "dst"), ("unique_dst_ports", "port"),
            ("unique_services", "svc"), ("unique_ja4", "ja4"))
    ) + " FROM tot", q.reads(), q.window_totals()))
def sliding_distinct_counts(spark, sf):
    return _rounded(_vectors(spark, sf, _unique), _unique)


def _entropy_sql() -> str:
    parts, cols = [], []
    for name, col in (("src", "src_ip"), ("dst", "dst_ip"), ("port", "dst_port")):
        parts.append(q.key_stats(col, (5, 60, 300), name))
    for s in (5, 60, 300):
        cols += [
            q.r6(f"coalesce(src.h_{s}, 0)", f"src_ip_entropy_{s}s"), q.r6(f"coalesce(dst.h_{s}, 0)", f"dst_ip_entropy_{s}s"),
            q.r6(f"coalesce(port.h_{s}, 0)", f"dst_port_entropy_{s}s"),
            q.r6(f"CASE WHEN src.k_{s} > 1 THEN src.h_{s} / log2(src.k_{s}) ELSE 0 END", f"src_ip_entropy_norm_{s}s"),
            q.r6(f"coalesce(src.top_{s}, 0)", f"src_concentration_{s}s"), q.r6(f"coalesce(dst.top_{s}, 0)", f"dst_concentration_{s}s"),
        ]
    joins = " ".join(f"LEFT JOIN {n} USING (entity_kind, entity_id, ts_us, read)" for n in ("src", "dst", "port"))
    return _sql(f"SELECT r.entity_kind, r.entity_id, r.ts_us, r.read, {', '.join(cols)} FROM reads r {joins}", q.reads(), *parts)


_entropy = [f"{b}_{s}s" for s in (5, 60, 300) for b in (
    "src_ip_entropy", "dst_ip_entropy", "dst_port_entropy", "src_ip_entropy_norm", "src_concentration", "dst_concentration")]


@query("W3 A3 A4 A5 A6", _entropy_sql())
def sliding_entropy_and_concentration(spark, sf):
    return _rounded(_vectors(spark, sf, _entropy), _entropy)


_dnsw = [f"{b}_{s}s" for s in (30, 60, 300) for b in ft.DNS_WINDOWED]


@query("W1 W2 W4 P6", _sql(
    "SELECT " + _KEYSQL + ", " + ", ".join(
        q.r6(e.format(s=s), f"{b}_{s}s") for s in (30, 60, 300) for b, e in (
            ("dns_queries_per_sec", "v_dns_{s} / {s}.0"), ("dns_query_count", "v_dns_{s}"),
            ("dns_unique_name_ratio", q.ratio("u_name_{s}", "v_dns_{s}", "1.0")),
            ("dns_txt_ratio", q.ratio("v_txt_{s}", "v_dns_{s}", "1.0")),
            ("dns_nxdomain_ratio", q.ratio("v_nx_{s}", "v_dns_{s}", "1.0")),
            ("dns_mean_response_bytes", "CASE WHEN v_drespn_{s} > 0 THEN CAST(v_dresp_{s} AS DOUBLE) / v_drespn_{s} ELSE 0 END"))
    ) + " FROM tot", q.reads(), q.window_totals()))
def sliding_dns_behaviour(spark, sf):
    return _rounded(_vectors(spark, sf, _dnsw), _dnsw)


_cov = [f"coverage_{s}s" for s in q.SIZES]


@query("W5", _sql(
    "SELECT " + _KEYSQL + ", " + ", ".join(
        q.r6(f"least(1.0, (r.ts_us - f.first_us) / 1e6 / {s})", f"coverage_{s}s") for s in q.SIZES
    ) + " FROM reads r JOIN (SELECT entity_kind, entity_id, min(ts_us) AS first_us FROM ent GROUP BY ALL) f USING (entity_kind, entity_id)",
    q.reads()))
def window_coverage(spark, sf):
    return _rounded(_vectors(spark, sf, _cov), _cov)


_TIMING_SQL = """
arr AS (
  SELECT entity_kind, entity_id, ts_us, row_number() OVER w AS a,
         (ts_us - lag(ts_us) OVER w) / 1e6 AS gap
  FROM pts WINDOW w AS (PARTITION BY entity_kind, entity_id ORDER BY ts_us)),
gaps AS (
  SELECT entity_kind, entity_id, ts_us,
         coalesce(avg(gap) OVER w, 0) AS m, coalesce(stddev_pop(gap) OVER w, 0) AS sd, count(gap) OVER w AS n
  FROM arr WINDOW w AS (PARTITION BY entity_kind, entity_id ORDER BY a ROWS BETWEEN 62 PRECEDING AND CURRENT ROW)),
vol AS (
  SELECT entity_kind, entity_id, ts_us, event_id,
         avg(v_out + v_in) OVER w AS bm, stddev_pop(v_out + v_in) OVER w AS bs,
         min(ts_us) OVER (PARTITION BY entity_kind, entity_id) AS first_us,
         row_number() OVER (PARTITION BY entity_kind, entity_id ORDER BY ts_us, event_id) AS cnt, rarity, src_in, dst_in
  FROM ent WINDOW w AS (PARTITION BY entity_kind, entity_id ORDER BY ts_us, event_id ROWS BETWEEN 63 PRECEDING AND CURRENT ROW)),
dur AS (
  SELECT entity_kind, entity_id, ts_us, avg(duration) OVER w AS dm, stddev_pop(duration) OVER w AS ds
  FROM ent WHERE duration IS NOT NULL
  WINDOW w AS (PARTITION BY entity_kind, entity_id ORDER BY ts_us, event_id ROWS BETWEEN 63 PRECEDING AND CURRENT ROW)),
tm AS (
  SELECT r.*, g.m, g.sd, g.n, CASE WHEN g.m > 0 THEN g.sd / g.m ELSE 0 END AS cv
  FROM reads r ASOF JOIN gaps g ON r.entity_kind = g.entity_kind AND r.entity_id = g.entity_id AND r.ts_us >= g.ts_us),
tv AS (
  SELECT r.*, v.bm, v.bs, v.first_us, v.cnt, v.ts_us AS last_us, v.rarity, v.src_in, v.dst_in
  FROM reads r ASOF JOIN vol v ON r.entity_kind = v.entity_kind AND r.entity_id = v.entity_id AND r.ts_us >= v.ts_us),
td AS (
  SELECT r.*, d.dm, d.ds
  FROM reads r ASOF LEFT JOIN dur d ON r.entity_kind = d.entity_kind AND r.entity_id = d.entity_id AND r.ts_us >= d.ts_us)"""

_interarrival = ["interarrival_mean", "interarrival_stdev", "interarrival_cv", "interarrival_count", "periodicity_score", "burstiness"]


@query("W6 W7 F13 F15 F16 A7", _sql(
    f"""SELECT {_KEYSQL}, {q.r6('m', 'interarrival_mean')}, {q.r6('sd', 'interarrival_stdev')}, {q.r6('cv', 'interarrival_cv')},
    {q.r6('n', 'interarrival_count')},
    {q.r6('CASE WHEN n > 0 THEN greatest(0, 1 - least(1, cv)) * least(1, n / 6.0) ELSE 0 END', 'periodicity_score')},
    {q.r6('CASE WHEN n < 2 OR sd + m = 0 THEN 0 ELSE (sd - m) / (sd + m) END', 'burstiness')} FROM tm""",
    q.reads(), _TIMING_SQL, coarse=True))
def interarrival_statistics(spark, sf):
    return _rounded(_vectors(spark, sf, _interarrival, coarse=True), _interarrival)


_stability = ["byte_stability_cv", "duration_stability_cv", "mean_flow_bytes", "observed_span", "entity_event_count"]


@query("W7 W8", _sql(
    f"""SELECT entity_kind, entity_id, ts_us, read,
    {q.r6('CASE WHEN bm > 0 THEN bs / bm ELSE 0 END', 'byte_stability_cv')},
    {q.r6('CASE WHEN dm > 0 THEN ds / dm ELSE 0 END', 'duration_stability_cv')},
    {q.r6('bm', 'mean_flow_bytes')}, {q.r6('(last_us - first_us) / 1e6', 'observed_span')}, {q.r6('cnt', 'entity_event_count')}
    FROM tv JOIN td USING (entity_kind, entity_id, ts_us, read)""",
    q.reads(), _TIMING_SQL, coarse=True))
def payload_and_duration_stability(spark, sf):
    return _rounded(_vectors(spark, sf, _stability, coarse=True), _stability)


@query("P8 W1 W7 W8", QUERIES["payload_and_duration_stability"].sql)
def sliced_payload_and_duration_stability(spark, sf):
    """The same vectors with nearly every entity cut into slices."""
    small = DEFAULT.with_(hot_rows=200, slice_rows=100)
    return _rounded(_vectors(spark, sf, _stability, small, coarse=True), _stability)


_context = ["is_internal_source", "is_internal_destination", "destination_rarity"]


@query("W10 J14 P4", _sql(
    f"""SELECT {_KEYSQL}, {q.r6('CASE WHEN src_in THEN 1 ELSE 0 END', 'is_internal_source')},
    {q.r6('CASE WHEN dst_in THEN 1 ELSE 0 END', 'is_internal_destination')},
    {q.r6("CASE WHEN read = 'flush' THEN 0 ELSE rarity END", 'destination_rarity')} FROM tv""",
    q.reads(), _TIMING_SQL, coarse=True))
def destination_context(spark, sf):
    return _rounded(_vectors(spark, sf, ["entity_event_count"], coarse=True, facts=True), _context)


@query("W16", _sql("SELECT entity_kind, entity_id, ts_us FROM walk", q.emission()))
def greedy_emission(spark, sf):
    ev = entity_events(read_flows(spark, sf), DEFAULT, None)
    return emission.emission_points(ev)


@query("W16", "WITH RECURSIVE " + q.flows() + ", ent AS (SELECT service AS entity_id, 'SERVICE' AS entity_kind, ts_us FROM flows UNION ALL SELECT 'all', 'NETWORK', ts_us FROM flows),"
       + q.emission() + " SELECT entity_kind, entity_id, ts_us FROM walk")
def busy_emission(spark, sf):
    """Entities that are hardly ever quiet: services, and the network as a whole. Runs above 64 events go
    by pieces of 20 steps of time, whose step functions are composed."""
    f = read_flows(spark, sf).select("service", "ts_us")
    views = F.array(F.struct(F.lit("SERVICE").alias("entity_kind"), F.col("service").alias("entity_id")), F.struct(F.lit("NETWORK").alias("entity_kind"), F.lit("all").alias("entity_id")))
    rows = f.select(F.inline(views), "ts_us")
    return emission.greedy_points(rows, ["entity_kind", "entity_id"], 1_000_000, fold=64, span=20)


@query("W16", _sql(
    "SELECT entity_kind, entity_id, max(ts_us) AS ts_us FROM ent GROUP BY entity_kind, entity_id, ts_us // 1000000"))
def tick_emission(spark, sf):
    ev = entity_events(read_flows(spark, sf), DEFAULT.with_(emission="tick"), None)
    return emission.emission_points(ev)


@query("W17 R8", _sql(
    "SELECT entity_kind, entity_id, max(ts_us) AS ts_us FROM ent GROUP BY entity_kind, entity_id"))
def flush_points(spark, sf):
    ev = entity_events(read_flows(spark, sf), DEFAULT.with_(flush_at="entity"), None)
    return emission.flush_points(ev, None)


@query("W9 U4", _sql(
    """SELECT r.entity_kind, r.entity_id, r.ts_us, r.read, CAST(len(v.ids) AS BIGINT) AS n_flow_ids,
       v.ids[1] AS oldest_event, v.ids[-1] AS newest_event
    FROM reads r ASOF JOIN (
      SELECT entity_kind, entity_id, ts_us, list(event_id) OVER (
        PARTITION BY entity_kind, entity_id ORDER BY ts_us, event_id ROWS BETWEEN 63 PRECEDING AND CURRENT ROW) AS ids
      FROM ent) v ON r.entity_kind = v.entity_kind AND r.entity_id = v.entity_id AND r.ts_us >= v.ts_us""", q.reads()))
def recent_flow_ids(spark, sf):
    flows = read_flows(spark, sf).withColumn("flow_id", F.col("event_id"))
    v = ft.vectors(flows, DEFAULT, ["entity_event_count"], protocol=False, extras=("flow_ids",))
    return v.select(
        *KEY, F.size("flow_ids").cast("bigint").alias("n_flow_ids"),
        F.element_at("flow_ids", 1).alias("oldest_event"), F.element_at("flow_ids", -1).alias("newest_event"),
    )


_BASELINE_SQL = f"""
ser AS (
  SELECT entity_kind, entity_id, ts_us, read, n_60 / 60.0 AS x,
         row_number() OVER (PARTITION BY entity_kind, entity_id ORDER BY ts_us, read) AS rn FROM tot),
ew AS (
  SELECT entity_kind, entity_id, ts_us, read, x, rn, CAST(x AS DOUBLE) AS mean, CAST(0 AS DOUBLE) AS var,
         CAST(0 AS DOUBLE) AS pm, CAST(0 AS DOUBLE) AS pv
  FROM ser WHERE rn = 1
  UNION ALL
  SELECT s.entity_kind, s.entity_id, s.ts_us, s.read, s.x, s.rn, w.mean + 0.05 * (s.x - w.mean),
         0.95 * (w.var + 0.05 * (s.x - w.mean) * (s.x - w.mean)), w.mean, w.var
  FROM ew w JOIN ser s ON s.entity_kind = w.entity_kind AND s.entity_id = w.entity_id AND s.rn = w.rn + 1),
p95 AS (
  SELECT entity_kind, entity_id, rn, quantile_cont(x, 0.95) OVER (
    PARTITION BY entity_kind, entity_id ORDER BY rn ROWS BETWEEN 256 PRECEDING AND 1 PRECEDING) AS p FROM ser)"""


@query("W11 F12 A8", _sql(
    f"""SELECT entity_kind, entity_id, ts_us, read, {q.r6('x', 'flows_per_sec_60s')},
    {q.r6('CASE WHEN rn <= 30 THEN 0 WHEN sqrt(pv) <= 1e-9 THEN (CASE WHEN abs(pm) <= 1e-9 THEN 0 ELSE (x - pm) / greatest(1e-9, abs(pm)) END) ELSE (x - pm) / sqrt(pv) END', 'flows_per_sec_60s_zscore')},
    {q.r6('CASE WHEN rn <= 30 THEN 0 ELSE pm END', 'flows_per_sec_60s_baseline_mean')},
    {q.r6('CASE WHEN rn <= 30 THEN 0 ELSE p END', 'flows_per_sec_60s_baseline_p95')},
    {q.r6('CASE WHEN rn <= 30 THEN 0 ELSE 1 END', 'flows_per_sec_60s_baseline_warm')}
    FROM ew JOIN p95 USING (entity_kind, entity_id, rn)""",
    q.reads(), q.window_totals((60,)), _BASELINE_SQL))
def ewma_baseline(spark, sf):
    names = ["flows_per_sec_60s", *ft.baseline_names("flows_per_sec_60s")]
    return _rounded(_vectors(spark, sf, names), names)


@query("P18", "WITH " + q.flows() + """, m AS (SELECT src_ip, 'bytes_out' AS metric FROM flows UNION ALL SELECT src_ip, 'dns_queries' FROM flows WHERE dns_query IS NOT NULL UNION ALL SELECT src_ip, 'failed' FROM flows WHERE failed_flow)
SELECT 'HOST' AS entity_kind, src_ip AS entity_id, array_to_string(list_sort(list(DISTINCT metric)), ',') AS metrics FROM m GROUP BY src_ip""")
def baseline_metrics_of_entities(spark, sf):
    """Which metrics of a host have a baseline: those it ever had a value of."""
    from wiretally.operators.baselines import final_state
    from wiretally.operators.reports import entity_metrics

    f = read_flows(spark, sf)
    seen = F.array_compact(F.array(F.lit("bytes_out"), F.when(F.col("dns").isNotNull(), "dns_queries"), F.when(F.col("connection_state") == "S0", "failed")))
    series = f.select(F.lit("HOST").alias("entity_kind"), F.col("src_ip").alias("entity_id"), "ts_us", F.explode(seen).alias("metric"), F.col("orig_bytes").cast("double").alias("value"))
    m = entity_metrics(final_state(series))
    return m.select("entity_kind", "entity_id", F.array_join("metrics", ",").alias("metrics"))


@query("R9 W11", _sql(
    f"""SELECT entity_kind, entity_id, 'flows_per_sec_60s' AS metric, {q.r6('arg_max(mean, rn)', 'mean')},
    {q.r6('arg_max(var, rn)', 'variance')}, max(rn) AS "count", {q.r6('arg_max(x, rn)', 'last_value')}
    FROM ew GROUP BY entity_kind, entity_id""",
    q.emission(), "reads AS (SELECT entity_kind, entity_id, ts_us, 'emit' AS read FROM walk)", q.window_totals((60,)), _BASELINE_SQL))
def baseline_snapshot(spark, sf):
    from wiretally.operators.baselines import final_state

    v = _vectors(spark, sf, ["flows_per_sec_60s"], DEFAULT.with_(flush_at="none"))
    series = v.select(
        "entity_kind", "entity_id", "ts_us", F.lit("flows_per_sec_60s").alias("metric"), F.col("flows_per_sec_60s").alias("value")
    )
    s = final_state(series)
    return s.select(
        "entity_kind", "entity_id", "metric",
        r6("mean"), r6("variance"), F.col("count"), r6("last_value"),
    )


@query("P17 P18 V21 V22", _sql(
    "SELECT entity_kind, feature, count(*) AS n, round(sum(value), 4) AS total FROM (" + " UNION ALL ".join(
        f"SELECT entity_kind, '{b}_{s}s' AS feature, CAST({e.format(s=s)} AS DOUBLE) AS value FROM tot"
        for s in (5, 60) for b, e in (("flow_count", "n_{s}"), ("syn_count", "v_syn_{s}"))
    ) + ") GROUP BY ALL", q.reads(), q.window_totals((5, 60))))
def features_long_form(spark, sf):
    names = [f"{b}_{s}s" for s in (5, 60) for b in ("flow_count", "syn_count")]
    v = _vectors(spark, sf, names).withColumn("values", ft.values_map(names))
    return (
        v.select("entity_kind", F.explode("values").alias("feature", "value"))
        .groupBy("entity_kind", "feature")
        .agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    )
