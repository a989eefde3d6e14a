"""Fixed traffic scenarios in closed form (no randomness)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from wiretally.schema import FLOW_DDL

T0 = 1_757_000_000_000_000

DEFAULTS = dict(
    src_ip="10.0.0.5", dst_ip="198.51.100.7", dst_port=443, transport="tcp", orig_bytes=1000, resp_bytes=2000,
    orig_packets=10, resp_packets=12, duration=1.0, connection_state="SF", tcp_flags="ShADadFf", service=None,
    query=None, qtype=None, rcode=None, response_bytes=None, pcap_reference=None,
)
_TYPES = dict(
    ts_us="bigint", src_ip="string", dst_ip="string", dst_port="int", transport="string", orig_bytes="bigint", resp_bytes="bigint",
    orig_packets="bigint", resp_packets="bigint", duration="double", connection_state="string", tcp_flags="string", service="string",
    query="string", qtype="string", rcode="string", response_bytes="bigint", pcap_reference="string",
)


def flows(spark, rows):
    """`rows` are dicts with `at` (seconds after T0) and any overrides."""
    full = []
    for r in rows:
        v = {**DEFAULTS, **{k: x for k, x in r.items() if k != "at"}}
        full.append((T0 + round(r["at"] * 1e6), *[v[k] for k in _TYPES if k != "ts_us"]))
    df = spark.createDataFrame(full, ", ".join(f"{k} {t}" for k, t in _TYPES.items()))
    schema = T.StructType.fromDDL(FLOW_DDL) if hasattr(T.StructType, "fromDDL") else spark.createDataFrame([], FLOW_DDL).schema
    dns = F.when(F.col("query").isNotNull(), F.struct(
        "query", "qtype", "rcode", F.array().cast("array<string>").alias("answers"), "response_bytes", F.lit(False).alias("rejected")))
    key = F.concat_ws("|", "ts_us", "src_ip", "dst_ip", F.col("dst_port").cast("string"), F.coalesce("query", F.lit("")))
    have = {
        "event_id": F.substring(F.sha2(key, 256), 1, 32), "flow_id": F.substring(F.sha2(key, 256), 1, 16), "dns": dns,
        "schema_version": F.lit("1.0.0"), "ts": F.timestamp_micros("ts_us"), "ip_version": F.lit(4), "direction": F.lit("UNKNOWN"),
        **{c: F.col(c) for c in df.columns if c in schema.names},
    }
    return df.select(*[(have[f.name] if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])


def syn_flood(n=3000):
    return [dict(at=i * 0.0005, src_ip=f"203.0.113.{i % 250}", dst_ip="10.0.0.9", connection_state="S0", tcp_flags="S",
                 orig_bytes=60, resp_bytes=None, orig_packets=1, resp_packets=None, duration=None, dst_port=80) for i in range(n)]


def vertical_scan():
    return [dict(at=i * 0.05, src_ip="10.0.0.66", dst_ip=f"10.0.1.{i % 3}", dst_port=1 + (7 * i) % 9000, connection_state="S0", tcp_flags="S",
                 resp_bytes=None, resp_packets=None, duration=0.0, orig_bytes=40, orig_packets=1) for i in range(400)]


def busy_client():
    return [dict(at=i * 0.1, src_ip="10.0.0.20", dst_ip=f"198.51.100.{i % 60}", orig_bytes=800 + i % 50) for i in range(300)]


def beacon():
    return [dict(at=100 + i * 30 + (i % 5 - 2) * 0.2, src_ip="10.0.0.77", dst_ip="198.51.100.200", orig_bytes=512 + i % 3, resp_bytes=128,
                 duration=0.4) for i in range(40)]


def polling():
    return [dict(at=i * 1.0, src_ip="10.0.0.78", dst_ip="198.51.100.201", orig_bytes=512, resp_bytes=128, duration=0.2) for i in range(120)]


def tunnel():
    hexes = "0123456789abcdef"
    name = lambda i: "".join(hexes[(i * 7 + j * 5 + i * j) % 16] for j in range(24)) + "." + "".join(
        hexes[(i * 3 + j * 11) % 16] for j in range(24)) + ".tunnel.example.net"
    return [dict(at=i * 0.1, src_ip="10.0.0.88", dst_ip="10.0.0.53", dst_port=53, transport="udp", orig_bytes=120, resp_bytes=600, duration=0.01,
                 query=name(i), qtype="TXT", rcode="NOERROR", response_bytes=400 + (i * 5) % 500) for i in range(200)]


def ordinary_dns():
    return [dict(at=i * 0.5, src_ip="10.0.0.89", dst_ip="10.0.0.53", dst_port=53, transport="udp", orig_bytes=80, resp_bytes=120, duration=0.01,
                 query=f"www{i % 12}.example.com", qtype="A", rcode="NOERROR", response_bytes=120) for i in range(120)]


def exfil():
    usual = [dict(at=i * 5.0, src_ip="10.0.0.99", dst_ip="198.51.100.10", orig_bytes=20_000, resp_bytes=40_000) for i in range(40)]
    leak = [dict(at=200 + i * 2.0, src_ip="10.0.0.99", dst_ip="203.0.113.99", orig_bytes=6_000_000 + i * 100_000, resp_bytes=3000) for i in range(60)]
    return usual + leak


def downloads():
    return [dict(at=i * 2.0, src_ip="198.51.100.30", dst_ip="10.0.0.31", orig_bytes=20_000_000, resp_bytes=2000) for i in range(60)]


def benign():
    return [dict(at=i * 0.4 + (i * i * 7919 + i * 104729) % 9973 / 100, src_ip=f"10.0.0.{(i * i + 3 * i) % 37 + 100}",
                 dst_ip=f"198.51.100.{(i * i * 31 + i * 7) % 251}", dst_port=(443, 80, 22)[i % 3],
                 orig_bytes=500 + (i * 37) % 3000, resp_bytes=1000 + (i * 91) % 9000, duration=0.1 + (i % 30) / 10,
                 connection_state="S0" if i % 20 == 0 else "SF", resp_packets=None if i % 20 == 0 else 12) for i in range(3000)]
