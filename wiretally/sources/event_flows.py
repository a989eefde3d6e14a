"""The `events` table seen as flows: a column mapping, no synthesis.

Thirty days are compressed 3600-fold so that second-scale windows hold rows; DNS and TLS facts
are functions of the event's own columns. `coarse` folds targets into five, so that pairs repeat.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BASE_US = 1704067200000000  # 2024-01-01T00:00Z


def read_flows(spark: SparkSession, sf_dir: str, coarse: bool = False) -> DataFrame:
    return map_events(spark.read.parquet(f"{sf_dir}/events.parquet"), coarse)


def map_events(e: DataFrame, coarse: bool = False) -> DataFrame:
    """The mapping itself; works on a batch or a stream of events."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    e = e.select(
        "event_id", "user_id", "event_type", "value",
        us.alias("us"), F.get_json_object("props", "$.k").cast("int").alias("k"),
    )
    ts_us = F.expr(f"{BASE_US} + (us - {BASE_US}) div 3600")
    failed = F.col("event_type") == "error"
    target = F.expr("k div 20") if coarse else F.col("k")
    inside = F.lit(2) if coarse else F.lit(20)
    dst = F.when(target < inside, F.concat(F.lit("10.1.0."), target)).otherwise(
        F.concat(F.lit("198.51.100."), target)
    )
    out_bytes = F.floor(F.col("value") * 100).cast("bigint")
    name = F.concat(
        F.substring(F.md5(F.col("event_id").cast("string")), F.lit(1), (8 + F.col("k") % 25)),
        F.lit(".d"), (F.col("k") % 7).cast("string"), F.lit(".example.com"),
    )
    dns = F.when(
        F.col("event_type") == "purchase",
        F.struct(
            name.alias("query"),
            F.when(F.col("k") % 3 == 0, "TXT").otherwise("A").alias("qtype"),
            F.when(F.col("k") % 4 == 0, "NXDOMAIN").otherwise("NOERROR").alias("rcode"),
            F.array_repeat(F.lit("192.0.2.1"), F.col("k") % 3).alias("answers"),
            (out_bytes % 900).alias("response_bytes"),
            F.lit(False).alias("rejected"),
        ),
    )
    text = lambda: F.lit(None).cast("string")
    tls = F.when(
        F.col("event_type") == "view",
        F.struct(
            F.lit("TLSv13").alias("version"),
            F.concat(F.lit("h"), F.col("k").cast("string"), F.lit(".example.net")).alias("sni"),
            F.concat(F.lit("t13d"), (F.col("k") % 11).cast("string")).alias("ja4"),
            text().alias("ja4s"), F.lit("AES128-GCM").alias("cipher"),
            text().alias("cert_subject_cn"), text().alias("cert_issuer_cn"),
            (F.col("k") + 30).cast("bigint").alias("cert_validity_days"),
            (F.col("k") % 5 == 0).alias("cert_self_signed"), F.lit(True).alias("established"),
        ),
    )
    port = (F.lit(1) + (F.col("event_id") * 7) % 1024).cast("int")
    transport = F.when(F.col("event_type") == "purchase", "udp").otherwise("tcp")
    src = F.concat(
        F.lit("10.0."), F.expr("user_id div 250").cast("string"), F.lit("."),
        (F.col("user_id") % 250 + 1).cast("string"),
    )
    flow_id = F.substring(
        F.sha2(F.concat_ws("|", src, F.lit("None"), dst, port.cast("string"), transport), 256), 1, 16
    )
    return e.select(
        F.lit("1.0.0").alias("schema_version"),
        F.lpad(F.col("event_id").cast("string"), 12, "0").alias("event_id"),
        F.timestamp_micros(ts_us).alias("ts"), ts_us.alias("ts_us"),
        F.timestamp_micros(ts_us).alias("ingest_ts"),
        F.lit("sensor-local").alias("sensor_id"), F.lit("NETFLOW").alias("source_type"),
        flow_id.alias("flow_id"), src.alias("src_ip"), F.lit(None).cast("int").alias("src_port"),
        dst.alias("dst_ip"), port.alias("dst_port"), F.lit(4).alias("ip_version"),
        transport.alias("transport"), F.col("event_type").alias("service"),
        F.lit("UNKNOWN").alias("direction"),
        F.when(~failed, F.col("value") / 100).alias("duration"),
        (1 + F.col("k") % 10).cast("bigint").alias("orig_packets"),
        F.when(~failed, (1 + F.col("k") % 5).cast("bigint")).alias("resp_packets"),
        out_bytes.alias("orig_bytes"),
        F.when(~failed, out_bytes * (F.col("k") % 7)).alias("resp_bytes"),
        F.when(failed, "S0").otherwise("SF").alias("connection_state"),
        text().alias("tcp_flags"), dns.alias("dns"), tls.alias("tls"),
        text().alias("pcap_reference"), text().alias("raw_event_reference"),
    )
