"""Queries over tables, read reports and the topology."""

from __future__ import annotations

from pyspark.sql import functions as F

from wiretally.operators import graph, reports
from wiretally.plans.catalog import sqltext as q
from wiretally.plans.catalog.registry import query, r6, table
from wiretally.sources import tables
from wiretally.sources.event_flows import read_flows

SEV = "list_extract(['INFO','LOW','MEDIUM','HIGH','CRITICAL'], CAST(k % 5 + 1 AS BIGINT))"
_ALERTS = q.flows() + f""",
al AS (SELECT event_id AS alert_id, ts_us, src_ip, dst_ip, service AS threat_class, {SEV} AS severity, (50 + k % 50) / 100.0 AS confidence,
  CASE WHEN k % 3 = 0 THEN 'NEW' WHEN k % 3 = 1 THEN 'TRIAGED' ELSE 'DISMISSED' END AS status FROM flows WHERE k < 50)"""


def event_alerts(spark, sf):
    """Alert rows read off the events: type as class, k as severity, confidence and status."""
    k = F.substring_index("dst_ip", ".", -1).cast("int")
    f = read_flows(spark, sf).withColumn("k", k).filter("k < 50")
    return f.select(
        F.col("event_id").alias("alert_id"), "ts_us", "ts", "src_ip", "dst_ip", F.col("service").alias("threat_class"),
        F.element_at(F.array(*[F.lit(s) for s in ("INFO", "LOW", "MEDIUM", "HIGH", "CRITICAL")]), F.col("k") % 5 + 1).alias("severity"),
        ((50 + F.col("k") % 50) / 100.0).alias("confidence"),
        F.when(F.col("k") % 3 == 0, "NEW").when(F.col("k") % 3 == 1, "TRIAGED").otherwise("DISMISSED").alias("status"),
    )


@query("A9 Q-A2", "WITH " + _ALERTS + """ SELECT 'threat_class' AS dimension, threat_class AS value, count(*) AS n FROM al GROUP BY ALL
UNION ALL SELECT 'severity', severity, count(*) FROM al GROUP BY ALL""")
def alert_summary(spark, sf):
    return reports.by_class_and_severity(event_alerts(spark, sf))


@query("P11 T1 A10 Q-A1", "WITH " + _ALERTS + """, f AS (SELECT * FROM al WHERE threat_class = 'error' AND severity = 'HIGH' AND confidence >= 0.6)
SELECT alert_id, ts_us, confidence, (SELECT count(*) FROM f) AS total FROM f ORDER BY ts_us DESC, alert_id LIMIT 50 OFFSET 10""")
def alert_page(spark, sf):
    f = reports.alert_filter(event_alerts(spark, sf), threat_class="error", severity="HIGH", min_confidence=0.6)
    total = f.agg(F.count("*").alias("total"))
    page = reports.newest(f, 50, "alert_id", offset=10)
    return page.withColumn("_k", F.lit(1)).join(total.withColumn("_k", F.lit(1)), "_k").select("alert_id", "ts_us", "confidence", "total")


@query("P12 T1 Q-A5", "WITH " + q.flows() + " SELECT event_id, src_ip, dst_ip, ts_us FROM flows WHERE src_ip = '10.0.0.9' AND ts_us >= 1704067300000000 ORDER BY ts_us DESC, event_id LIMIT 100")
def flow_page(spark, sf):
    f = reports.flow_filter(read_flows(spark, sf), src_ip="10.0.0.9", since_us=1704067300000000)
    return reports.newest(f, 100, "event_id").select("event_id", "src_ip", "dst_ip", "ts_us")


@query("P13 P14 P15 P16 T2", "WITH " + _ALERTS + " SELECT alert_id, ts_us FROM al WHERE status = 'NEW' AND ts_us <= 1704067700000000 ORDER BY ts_us DESC, alert_id LIMIT 500")
def newest_history(spark, sf):
    return reports.newest(reports.alert_filter(event_alerts(spark, sf), status="NEW", until_us=1704067700000000), 500, "alert_id").select("alert_id", "ts_us")


@query("A23 R4 Q-A11", "WITH " + _ALERTS + """ SELECT ts_us // 600000000 * 600000000 AS bucket_us, count(*) AS total, count(*) FILTER (WHERE severity IN ('HIGH','CRITICAL')) AS high FROM al GROUP BY ALL""")
def alert_timeline(spark, sf):
    return reports.timeline(event_alerts(spark, sf))


@query("A24", "WITH " + _ALERTS + """ SELECT count(*) FILTER (WHERE status <> 'DISMISSED') AS open, count(*) FILTER (WHERE status <> 'DISMISSED' AND severity IN ('HIGH','CRITICAL')) AS open_high FROM al""")
def open_alert_counts(spark, sf):
    return reports.open_alerts(event_alerts(spark, sf))


_LOG = """, lg AS (SELECT alert_id, ts_us, 'CREATED' AS kind, 'NEW' AS status, ts_us AS last_seen_us, 1 AS dedup_count FROM al
 UNION ALL SELECT alert_id, ts_us + 1000, 'DEDUPED', NULL, ts_us + 1000, 2 FROM al WHERE confidence > 0.6
 UNION ALL SELECT alert_id, ts_us + 2000, 'STATUS', 'CONFIRMED', NULL, NULL FROM al WHERE severity = 'LOW'
 UNION ALL SELECT alert_id, ts_us + 3000, 'STATUS', 'DISMISSED', NULL, NULL FROM al WHERE severity = 'LOW' AND confidence > 0.7)"""


def _log(a):
    none, txt = F.lit(None).cast("bigint"), F.lit(None).cast("string")
    row = lambda df, add, kind, status, seen, n: df.select(
        "alert_id", (F.col("ts_us") + add).alias("ts_us"), F.lit(kind).alias("kind"), (F.lit(status) if status else txt).alias("status"),
        (F.col("ts_us") + add if seen else none).alias("last_seen_us"), (F.lit(n).cast("bigint") if n else none).alias("dedup_count"))
    low = a.filter("severity = 'LOW'")
    return (row(a, 0, "CREATED", "NEW", True, 1).unionByName(row(a.filter("confidence > 0.6"), 1000, "DEDUPED", None, True, 2))
            .unionByName(row(low, 2000, "STATUS", "CONFIRMED", False, None)).unionByName(row(low.filter("confidence > 0.7"), 3000, "STATUS", "DISMISSED", False, None)))


@query("S11 P16", "WITH " + _ALERTS + _LOG + """ SELECT alert_id, coalesce(arg_max(lg.status, lg.ts_us) FILTER (WHERE kind = 'STATUS'), any_value(al.status)) AS status,
max(last_seen_us) AS last_seen_us, max(dedup_count) AS dedup_count FROM al JOIN lg USING (alert_id) GROUP BY alert_id""")
def current_alert_state(spark, sf):
    a = event_alerts(spark, sf)
    base = a.withColumns({"last_seen_us": F.col("ts_us"), "dedup_count": F.lit(1).cast("bigint")})
    return tables.current_alerts(base, _log(a)).select("alert_id", "status", "last_seen_us", "dedup_count")


@query("J6 Q-A3", "WITH " + _ALERTS + _LOG + """ SELECT alert_id, threat_class, lg.ts_us AS log_ts_us, kind, lg.status, row_number() OVER (PARTITION BY alert_id ORDER BY lg.ts_us, kind) AS seq
FROM al JOIN lg USING (alert_id)""")
def alert_history(spark, sf):
    a = event_alerts(spark, sf)
    return reports.history(a, _log(a)).select("alert_id", "threat_class", "log_ts_us", "kind", "status", "seq")


@query("J5 Q-A4", "WITH " + _ALERTS + """, inc AS (SELECT src_ip AS incident_id, count(*) AS alert_count, max(ts_us) AS last_seen_us FROM al GROUP BY src_ip HAVING count(DISTINCT threat_class) >= 2)
SELECT incident_id, alert_count, last_seen_us, alert_id, severity FROM inc JOIN al ON al.src_ip = inc.incident_id""")
def incident_detail(spark, sf):
    a = event_alerts(spark, sf)
    inc = a.groupBy(F.col("src_ip").alias("incident_id")).agg(
        F.count("*").alias("alert_count"), F.max("ts_us").alias("last_seen_us"), F.count_distinct("threat_class").alias("c")).filter("c >= 2").drop("c")
    return inc.join(a.withColumn("incident_id", F.col("src_ip")), "incident_id").select("incident_id", "alert_count", "last_seen_us", "alert_id", "severity")


@query("S9 W18", """SELECT user_id AS event_key, count(*) > 0 AS present FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE value > 250) GROUP BY user_id""")
def insert_or_ignore(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").alias("event_key"), "value")
    old = e.filter("value > 250").select("event_key")
    return tables.insert_or_ignore(e.select("event_key"), old, "event_key").withColumn("present", F.lit(True))


@query("S10 T8", """SELECT user_id, event_id AS version, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1""")
def latest_version_per_key(spark, sf):
    e = table(spark, sf, "events").select("user_id", F.col("event_id").alias("version"), "event_type")
    return tables.latest(e, "user_id", "version")


@query("T8 S16", "WITH " + _ALERTS + """, v AS (SELECT alert_id, ts_us, status, 1 AS version FROM al UNION ALL SELECT alert_id, ts_us, 'TRIAGED', 2 FROM al WHERE severity = 'HIGH')
SELECT alert_id, ts_us, arg_max(status, version) AS status, max(version) AS version FROM v GROUP BY alert_id, ts_us ORDER BY ts_us DESC, alert_id LIMIT 100""")
def live_alert_list(spark, sf):
    a = event_alerts(spark, sf).select("alert_id", "ts_us", "status", "severity")
    v = a.withColumn("version", F.lit(1)).unionByName(a.filter("severity = 'HIGH'").withColumns({"status": F.lit("TRIAGED"), "version": F.lit(2)}))
    return reports.live_tail(v, 100).select("alert_id", "ts_us", "status", "version")


@query("S13", """SELECT ts_us < 1704067500000000 AS dropped, count(*) AS n FROM (SELECT 1704067200000000 + (epoch_us(ts) - 1704067200000000) // 3600 AS ts_us FROM events) GROUP BY ALL""")
def retention_split(spark, sf):
    keep, drop = tables.split_by_age(read_flows(spark, sf), 1704067500000000)
    n = lambda df, flag: df.agg(F.count("*").alias("n")).select(F.lit(flag).alias("dropped"), "n")
    return n(keep, False).unionByName(n(drop, True))


@query("S8 S18 Q-A10", "SELECT 'events' AS table_name, count(*) AS rows FROM events UNION ALL SELECT 'labels', count(*) FROM labels UNION ALL SELECT 'pages', count(*) FROM pages")
def table_row_counts(spark, sf):
    return tables.counts({n: table(spark, sf, n) for n in ("events", "labels", "pages")})


_EDGES = "WITH " + _ALERTS + """, ed AS (SELECT src_ip, dst_ip, count(*) AS flows, sum(orig_bytes + coalesce(resp_bytes, 0))::BIGINT AS bytes FROM flows GROUP BY ALL),
ea AS (SELECT src_ip, dst_ip, count(DISTINCT alert_id) AS alerts, max(list_position(['INFO','LOW','MEDIUM','HIGH','CRITICAL'], severity)) AS s FROM al GROUP BY ALL),
eg AS (SELECT ed.*, coalesce(alerts, 0) AS alerts, list_extract(['INFO','LOW','MEDIUM','HIGH','CRITICAL'], s) AS severity FROM ed LEFT JOIN ea USING (src_ip, dst_ip)),
ends AS (SELECT src_ip AS id, * FROM eg UNION ALL SELECT dst_ip, * FROM eg),
svc AS (SELECT id, string_agg(service, ',' ORDER BY service) AS services FROM (SELECT DISTINCT src_ip AS id, service FROM flows UNION SELECT DISTINCT dst_ip, service FROM flows) GROUP BY id),
nd AS (SELECT id, sum(flows)::BIGINT AS connections, sum(bytes)::BIGINT AS bytes, sum(alerts * flows)::BIGINT AS alerts, any_value(services) AS services,
  CASE WHEN id LIKE '10.%' THEN 'internal' ELSE 'external' END AS kind FROM ends JOIN svc USING (id) GROUP BY id)"""


@query("A20 J9", _EDGES + " SELECT * FROM eg")
def topology_edges(spark, sf):
    return graph.edges(read_flows(spark, sf), event_alerts(spark, sf))


@query("A21 F23", _EDGES + " SELECT id, connections, bytes, alerts, services, kind FROM nd")
def topology_nodes(spark, sf):
    f = read_flows(spark, sf)
    return graph.nodes(graph.edges(f, event_alerts(spark, sf)), f)


@query("T3 Q-A11", _EDGES + """, tn AS (SELECT id FROM nd ORDER BY connections DESC, id LIMIT 200), te AS (SELECT * FROM eg ORDER BY flows DESC, src_ip, dst_ip LIMIT 500)
SELECT src_ip, dst_ip, flows, bytes FROM te WHERE src_ip IN (SELECT id FROM tn) AND dst_ip IN (SELECT id FROM tn)""")
def topology_top_view(spark, sf):
    f = read_flows(spark, sf)
    e = graph.edges(f)
    return graph.capped(e, graph.nodes(e, f))[1].select("src_ip", "dst_ip", "flows", "bytes")


@query("A22", _EDGES + """ SELECT e.*, n.*, total_nodes > 200 OR total_edges > 500 AS truncated FROM
(SELECT sum(flows)::BIGINT AS flows, sum(bytes)::BIGINT AS bytes, count(*) FILTER (WHERE alerts > 0) AS alerted_edges, count(*) AS total_edges FROM eg) e,
(SELECT count(*) FILTER (WHERE kind = 'internal') AS internal, count(*) FILTER (WHERE kind = 'external') AS external, count(*) AS total_nodes FROM nd) n""")
def topology_totals(spark, sf):
    f = read_flows(spark, sf)
    e = graph.edges(f, event_alerts(spark, sf))
    return graph.totals(e, graph.nodes(e, f))


@query("A22", "WITH " + q.flows() + " SELECT id, count(*) AS peers FROM (SELECT src_ip AS id, dst_ip AS p FROM flows UNION SELECT dst_ip, src_ip FROM flows) GROUP BY id")
def node_counterparts(spark, sf):
    return graph.counterparts(graph.edges(read_flows(spark, sf))).groupBy("id").agg(F.count("*").alias("peers"))


@query("A25", f"SELECT event_type AS metric, {q.r6('sum(value)', 'total')} FROM events GROUP BY event_type")
def metric_totals(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_type").alias("metric"), "value")
    t = reports.metric_totals(e)
    return t.select("metric", r6("total"))


_BOUNDS = (1.0, 5.0, 10.0, 25.0, 50.0, 100.0, 250.0)


@query("A26", "SELECT event_type, le, cumulative, n FROM (" + " UNION ALL ".join(
    f"SELECT event_type, '{b}' AS le, count(*) FILTER (WHERE value <= {b}) AS cumulative, count(*) AS n FROM events GROUP BY event_type" for b in _BOUNDS
) + " UNION ALL SELECT event_type, '+Inf', count(*), count(*) FROM events GROUP BY event_type)")
def latency_histogram(spark, sf):
    return reports.histogram(table(spark, sf, "events"), "value", list(_BOUNDS), ["event_type"]).select("event_type", "le", "cumulative", "n")


@query("A19 A8", f"SELECT event_type, count(value) AS n, {', '.join(q.r6(f'quantile_cont(value, {x})', f'p{int(x * 100)}') for x in (0.5, 0.95, 0.99))}, {q.r6('max(value)', 'max')} FROM events GROUP BY event_type")
def latency_percentiles(spark, sf):
    p = reports.latency_percentiles(table(spark, sf, "events"), "value", ["event_type"])
    return p.select("event_type", "n", r6("p50"), r6("p95"), r6("p99"), r6("max"))


@query("A28", "WITH " + q.flows() + """ SELECT event_id AS alert_id, u.name, u.observed, u.baseline, u.threshold, greatest(abs(u.observed), abs(coalesce(u.baseline, 0)), abs(u.threshold), 1.0) AS scale
FROM (SELECT event_id, unnest([
 {'name': 'syn_rate_1s', 'observed': CAST(orig_packets AS DOUBLE), 'baseline': NULL::DOUBLE, 'threshold': 7.0::DOUBLE},
 {'name': 'flows_per_sec_60s', 'observed': CAST(k AS DOUBLE), 'baseline': 3.5::DOUBLE, 'threshold': 7.0::DOUBLE}]) AS u FROM flows)""")
def evidence_readings(spark, sf):
    f = read_flows(spark, sf)
    d = lambda c: c.cast("double")
    a = f.select(
        F.col("event_id").alias("alert_id"),
        F.create_map(F.lit("syn_rate_1s"), d(F.col("orig_packets")), F.lit("flows_per_sec_60s"), d(F.substring_index("dst_ip", ".", -1))).alias("observations"),
        F.create_map(F.lit("flows_per_sec_60s_baseline_mean"), F.lit(3.5), F.lit("triggered_threshold"), F.lit(7.0)).alias("comparisons"),
    )
    return reports.evidence_readings(a)
