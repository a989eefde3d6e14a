"""Queries over scanning, normalisation and correlation."""

from __future__ import annotations

from pyspark.sql import functions as F

from wiretally.plans.catalog import sqltext as q
from wiretally.plans.catalog.registry import query, r6, table
from wiretally.sources import jsonlogs
from wiretally.sources.records import normalise, reject_counts, valid_feedback, valid_indicator


def _raw_flows(spark, sf):
    """The events as untrusted text records: some fields damaged by rules on their own values."""
    e = table(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    return e.select(
        F.when(k == 1, "-").when((k == 2) & (F.col("event_id") % 2 == 0), "1e300").when(k == 2, "soon").otherwise(F.format_string("%.6f", us / 1e6)).alias("ts"),
        F.when(k == 3, "10.0.0.256").when(k == 4, "").otherwise(F.concat(F.lit("10.0.0."), F.col("user_id") % 200)).alias("id.orig_h"),
        F.concat(F.lit("198.51.100."), k).alias("id.resp_h"),
        F.when(k == 5, "70000").when(k == 6, "-3").otherwise((F.col("event_id") % 60000).cast("string")).alias("id.orig_p"),
        F.lit("443.0").alias("id.resp_p"),
        F.when(k % 4 == 0, "6").when(k % 4 == 1, "UDP").when(k % 4 == 2, "253").otherwise(F.lit(None)).alias("proto"),
        F.concat(F.lit("  "), F.col("event_type"), F.lit(" ")).alias("service"),
        F.when(k == 7, "-5").otherwise(F.col("value").cast("string")).alias("orig_ip_bytes"),
        F.when(k % 5 == 0, "-").otherwise((F.col("value") * 10).cast("string")).alias("resp_ip_bytes"),
        (F.col("value") * 1000).cast("string").alias("flowDurationMilliseconds"),
        F.when(F.col("event_type") == "purchase", F.when(k == 8, "bad..name").otherwise(F.concat(F.lit("Host"), k, F.lit(".Example.COM.")))).alias("query"),
        F.when(F.col("event_type") == "view", F.concat(F.lit("t13d"), k)).alias("ja4"),
        F.col("event_id").cast("string").alias("pcap_reference"),
    )


_RAW = """
r0 AS (SELECT event_id, event_type, user_id, value, epoch_us(ts) AS us, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events),
r1 AS (SELECT *, CASE WHEN k = 1 THEN 'bad_timestamp' WHEN k = 2 THEN 'other' WHEN k = 4 THEN 'bad_address'
  WHEN event_type = 'purchase' AND k = 8 THEN 'bad_domain' WHEN k = 3 THEN 'bad_address' WHEN k = 5 THEN 'validation' END AS reason FROM r0),
r2 AS (SELECT *, '10.0.0.' || CAST(user_id % 200 AS VARCHAR) AS src_ip, '198.51.100.' || CAST(k AS VARCHAR) AS dst_ip,
  CASE WHEN k = 6 THEN NULL ELSE CAST(event_id % 60000 AS INTEGER) END AS src_port, 443 AS dst_port,
  CASE WHEN k % 4 = 0 THEN 'tcp' WHEN k % 4 = 1 THEN 'udp' ELSE 'other' END AS transport,
  CASE WHEN event_type = 'purchase' THEN 'host' || CAST(k AS VARCHAR) || '.example.com' END AS dns_query,
  CASE WHEN event_type = 'view' THEN 't13d' || CAST(k AS VARCHAR) END AS ja4
  FROM r1 WHERE reason IS NULL),
r3 AS (SELECT *, src_ip || ':' || coalesce(CAST(src_port AS VARCHAR), 'None') || '>' || dst_ip || ':443/' || transport
   || CASE WHEN dns_query IS NOT NULL THEN '|' || dns_query || '|' ELSE '' END AS flow_key FROM r2)"""


@query("S3 V1 V2 V3 V4 V5 V6 V7 V8 V9 V11 V12 V13 V14 V15 W18 P5 S17", "WITH " + _RAW + f"""
SELECT substr(sha256(printf('%.6f', us / 1e6) || '|' || flow_key || '|' || CASE WHEN dns_query IS NOT NULL THEN 'dns' WHEN ja4 IS NOT NULL THEN 'ssl' ELSE 'conn' END), 1, 32) AS event_id,
 us AS ts_us, substr(sha256(src_ip || '|' || coalesce(CAST(src_port AS VARCHAR), 'None') || '|' || dst_ip || '|443|' || transport), 1, 16) AS flow_id,
 src_ip, src_port, dst_ip, dst_port, 4 AS ip_version, transport, event_type AS service, 'OUTBOUND' AS direction, {q.r6('value', 'duration')},
 CASE WHEN k = 7 THEN 0 ELSE CAST(floor(value) AS BIGINT) END AS orig_bytes, 0::BIGINT AS orig_packets,
 CASE WHEN k % 5 = 0 THEN NULL ELSE CAST(floor(value * 10) AS BIGINT) END AS resp_bytes, dns_query, ja4, CAST(r3.event_id AS VARCHAR) AS capture FROM r3""")
def normalised_flows(spark, sf):
    f = normalise(_raw_flows(spark, sf), "IPFIX").flows
    return f.select(
        "event_id", "ts_us", "flow_id", "src_ip", "src_port", "dst_ip", "dst_port", "ip_version", "transport", "service", "direction",
        r6("duration"), "orig_bytes", "orig_packets", "resp_bytes", F.col("dns.query").alias("dns_query"), F.col("tls.ja4").alias("ja4"),
        F.col("pcap_reference").alias("capture"),
    )


@query("V16 V17 V18 S6", "WITH " + _RAW + " SELECT coalesce(reason, 'accepted') AS reason, count(*) AS n FROM r1 GROUP BY ALL")
def reject_reasons(spark, sf):
    return reject_counts(normalise(_raw_flows(spark, sf), "IPFIX"))


@query("S1 V16", """WITH l AS (SELECT CASE WHEN event_id % 7 IN (0, 3, 5) THEN 'bad_json' WHEN event_id % 7 IN (1, 2) THEN 'skipped' ELSE 'record' END AS outcome, event_id FROM events)
SELECT outcome, count(*) AS n, CAST(coalesce(sum(event_id) FILTER (WHERE outcome = 'record'), 0) AS BIGINT) AS ids FROM l WHERE outcome <> 'skipped' GROUP BY outcome""")
def json_line_scan(spark, sf):
    e = table(spark, sf, "events").withColumn("m", F.col("event_id") % 7)
    body = F.to_json(F.struct(F.col("event_id").cast("string").alias("uid"), F.col("event_type").alias("service")))
    line = F.when(F.col("m") == 0, F.concat(body, F.lit("}{"))).when(F.col("m") == 1, F.concat(F.lit("# "), body)).when(F.col("m") == 2, F.lit("  "))
    twice = F.concat(F.lit('{"uid":"0",'), F.substr(body, F.lit(2)))  # a repeated key: the last one counts
    line = line.when(F.col("m") == 3, F.concat(body, body)).when(F.col("m") == 4, twice).when(F.col("m") == 5, F.concat(body, F.lit(" x}"))).otherwise(body)
    records, bad = jsonlogs.parse_lines(e.select(line.alias("value")))
    both = records.select(F.lit("record").alias("outcome"), F.col("uid").cast("bigint").alias("id")).unionByName(bad.select(F.lit("bad_json").alias("outcome"), F.lit(0).cast("bigint").alias("id")))
    return both.groupBy("outcome").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


def _logs(spark, sf):
    """Turn 0 is the connection; user and assistant turns are the two protocol logs."""
    c = table(spark, sf, "conversations").filter(F.col("conv_id").isNotNull())
    q_ = c.select(F.col("conv_id").cast("string").alias("uid"), (F.col("turn") + 100).cast("string").alias("ts"), "turn", "role", F.length("text").cast("string").alias("n"))
    conn = q_.filter((F.col("turn") == 0) & (F.col("uid").cast("bigint") % 3 != 0)).select("uid", "ts", F.col("n").alias("service"), F.lit("tcp").alias("proto"))
    dns = q_.filter("role = 'user'").select("uid", "ts", F.col("n").alias("query"), F.lit(None).cast("string").alias("service"), F.col("turn").alias("_pos"))
    ssl = q_.filter("role = 'assistant'").select("uid", "ts", F.col("n").alias("service"), F.col("n").alias("sni"), F.col("turn").alias("_pos"))
    return conn, dns, ssl


@query("J1 J2 U1 S2", """WITH c AS (SELECT CAST(conv_id AS VARCHAR) AS uid, CAST(turn + 100 AS VARCHAR) AS ts, turn, role, CAST(length(text) AS VARCHAR) AS n FROM conversations),
conn AS (SELECT uid, ts, n AS service, 'tcp' AS proto FROM c WHERE turn = 0 AND CAST(uid AS BIGINT) % 3 <> 0),
p AS (SELECT uid, arg_max(ts, turn + CASE WHEN role = 'assistant' THEN 100000 ELSE 0 END) AS ts, arg_max(n, turn) FILTER (WHERE role = 'user') AS query,
  arg_max(n, turn) FILTER (WHERE role = 'assistant') AS service, arg_max(n, turn) FILTER (WHERE role = 'assistant') AS sni FROM c WHERE role IN ('user', 'assistant') GROUP BY uid)
SELECT conn.uid, conn.ts, coalesce(p.service, conn.service) AS service, proto, query, sni FROM conn LEFT JOIN p USING (uid)
UNION ALL SELECT uid, ts, service, NULL, query, sni FROM p WHERE uid NOT IN (SELECT uid FROM conn)""")
def correlated_logs(spark, sf):
    conn, dns, ssl = _logs(spark, sf)
    out = jsonlogs.correlate(conn, jsonlogs.merge_by_uid([dns, ssl]))
    return out.select("uid", "ts", "service", "proto", "query", "sni")


@query("V19", """WITH i AS (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'domain' WHEN 1 THEN 'sha256' ELSE 'ip' END AS kind,
 CASE o_orderkey % 3 WHEN 0 THEN o_orderpriority WHEN 1 THEN CASE WHEN o_orderkey % 2 = 0 THEN sha256(o_orderpriority) ELSE o_orderpriority END ELSE '192.0.2.1' END AS v FROM orders)
SELECT o_orderkey, kind, CASE kind WHEN 'domain' THEN CASE WHEN regexp_matches(lower(v), '^[a-z0-9_*-]{1,63}(\\.[a-z0-9_*-]{1,63})*$') THEN lower(v) END
 WHEN 'sha256' THEN CASE WHEN regexp_matches(v, '^[0-9a-fA-F]{64}$') THEN v END ELSE v END AS value FROM i""")
def indicator_validation(spark, sf):
    o = table(spark, sf, "orders")
    m = F.col("o_orderkey") % 3
    kind = F.when(m == 0, "domain").when(m == 1, "sha256").otherwise("ip")
    v = F.when(m == 0, F.col("o_orderpriority")).when(
        m == 1, F.when(F.col("o_orderkey") % 2 == 0, F.sha2("o_orderpriority", 256)).otherwise(F.col("o_orderpriority"))
    ).otherwise("192.0.2.1")
    return o.select("o_orderkey", kind.alias("kind"), valid_indicator(kind, v).alias("value"))


_FEEDBACK_SQL = """fb AS (SELECT 'f' || CAST(doc_id AS VARCHAR) AS feedback_id, CASE WHEN doc_id % 50 = 7 THEN 'gone' ELSE 'a' END || CAST(doc_id - doc_id % 3 AS VARCHAR) AS alert_id, doc_id AS ts_us,
 CASE WHEN toxic = 1 THEN 'FALSE_NEGATIVE' WHEN quality = 1 THEN 'TRUE_POSITIVE' ELSE 'FALSE_POSITIVE' END AS label, CASE WHEN doc_id % 2 = 0 THEN 'DGA' END AS corrected FROM labels)"""


def feedback_of(spark, sf):
    """Analyst judgements from the labels table: quality and toxicity of a document."""
    l = table(spark, sf, "labels")
    return l.select(
        F.concat(F.lit("f"), "doc_id").alias("feedback_id"), F.concat(F.when(F.col("doc_id") % 50 == 7, "gone").otherwise("a"), (F.col("doc_id") - F.col("doc_id") % 3).cast("string")).alias("alert_id"),
        F.col("doc_id").alias("ts_us"),
        F.when(F.col("toxic") == 1, "FALSE_NEGATIVE").when(F.col("quality") == 1, "TRUE_POSITIVE").otherwise("FALSE_POSITIVE").alias("label"),
        F.when(F.col("doc_id") % 2 == 0, "DGA").alias("corrected"),
    )


@query("V20", f"WITH {_FEEDBACK_SQL} SELECT feedback_id, label <> 'FALSE_NEGATIVE' OR corrected IS NOT NULL AS valid FROM fb")
def feedback_validation(spark, sf):
    return feedback_of(spark, sf).select("feedback_id", valid_feedback(F.col("label"), F.col("corrected")).alias("valid"))
