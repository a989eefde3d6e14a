"""Untrusted records to validated flows plus a reject table.

Any DataFrame whose columns use one of the known names can be a source; a new source adds
aliases, not code. Every value is read as text and parsed with try-casts, so one bad record is
one reject row and never a failed job.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wiretally.functions import net
from wiretally.functions.text import canonical_domain, short_text
from wiretally.params import DEFAULT, SCHEMA_VERSION, Params

# Accepted source names per field, in priority order -----------------
FIELD_ALIASES = {
    "timestamp": ("ts", "timestamp", "flowStartSeconds", "start_time", "first_switched"),
    "flow_id": ("uid", "flow_id", "flowId"),
    "src_ip": ("id.orig_h", "src_ip", "sourceIPv4Address", "sourceIPv6Address", "srcaddr"),
    "src_port": ("id.orig_p", "src_port", "sourceTransportPort", "srcport"),
    "dst_ip": ("id.resp_h", "dst_ip", "destinationIPv4Address", "destinationIPv6Address", "dstaddr"),
    "dst_port": ("id.resp_p", "dst_port", "destinationTransportPort", "dstport"),
    "transport": ("proto", "transport_protocol", "protocolIdentifier", "prot"),
    "service": ("service", "application", "app"),
    "duration": ("duration", "flowDurationMilliseconds", "elapsed"),
    "orig_packets": ("orig_pkts", "orig_packets", "packetDeltaCount", "dpkts", "in_pkts"),
    "resp_packets": ("resp_pkts", "resp_packets", "reversePacketDeltaCount", "out_pkts"),
    "orig_bytes": ("orig_ip_bytes", "orig_bytes", "octetDeltaCount", "dbytes", "in_bytes"),
    "resp_bytes": ("resp_ip_bytes", "resp_bytes", "reverseOctetDeltaCount", "out_bytes"),
    "connection_state": ("conn_state", "connection_state", "state"),
    "tcp_flags": ("history", "tcp_flags", "tcpControlBits", "flags"),
    "sensor_id": ("sensor_id", "_system_name", "observationDomainId"),
    "pcap_reference": ("pcap_reference", "_path_pcap", "capture_file"),
    "raw_event_reference": ("_path",),
    "schema_version": ("schema_version",),
}
DNS_ALIASES = {
    "query": ("query", "dns_query", "qname"),
    "qtype": ("qtype_name", "qtype", "dns_qtype"),
    "rcode": ("rcode_name", "rcode", "dns_rcode"),
    "answers": ("answers", "dns_answers"),
    "response_bytes": ("response_bytes", "resp_bytes_dns", "answer_bytes"),
    "rejected": ("rejected",),
}
TLS_ALIASES = {
    "version": ("version", "tls_version", "ssl_version"),
    "sni": ("server_name", "sni", "tls_sni"),
    "ja4": ("ja4", "ja4_fingerprint"),
    "ja4s": ("ja4s", "ja4s_fingerprint"),
    "cipher": ("cipher", "tls_cipher"),
    "cert_subject_cn": ("subject", "cert_subject_cn"),
    "cert_issuer_cn": ("issuer", "cert_issuer_cn"),
    "cert_validity_days": ("cert_validity_days",),
    "cert_self_signed": ("self_signed", "cert_self_signed"),
    "established": ("established",),
}
PROTOCOL_NUMBERS = {"1": "icmp", "6": "tcp", "17": "udp", "58": "icmp"}
# --------------------------------------------------------------------------------

NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def all_aliases(extra: dict[str, tuple[str, ...]] | None = None) -> list[str]:
    names = []
    for table in (FIELD_ALIASES, DNS_ALIASES, TLS_ALIASES, extra or {}):
        for v in table.values():
            names += v
    return list(dict.fromkeys(names))


def _text(df: DataFrame, name: str) -> Column:
    field = df.schema[name]
    col = F.col(f"`{name}`")
    if isinstance(field.dataType, (T.ArrayType, T.StructType, T.MapType)):
        return F.to_json(col)
    return col.cast("string")


#: Seconds of the years 1 to 9999.
YEARS = (-62135596800.0, 253402300799.0)


def pick(df: DataFrame, aliases) -> Column:
    """First usable value among the aliases; empty text, null and `-` do not count."""
    found = [_text(df, a) for a in aliases if a in df.columns]
    if not found:
        return F.lit(None).cast("string")
    return F.coalesce(*[F.when(~c.isin("", "-"), c) for c in found])


def number(x: Column) -> Column:
    return F.when(x.rlike(NUMBER), F.trim(x).try_cast("double"))


def optional_int(x: Column) -> Column:
    """Truncated towards zero; bad or negative becomes null."""
    n = number(x)
    whole = F.when(n >= 0, F.floor(n)).otherwise(F.ceil(n)).cast("bigint")
    return F.when(whole >= 0, whole)


def truthy(x: Column) -> Column:
    return F.when(x.isNotNull(), ~F.lower(x).isin("false", "0", "0.0", ""))


def transport(x: Column) -> Column:
    numbers = F.create_map(*[F.lit(v) for kv in PROTOCOL_NUMBERS.items() for v in kv])
    low = F.lower(x)
    return (
        F.when(x.rlike(r"^\d+$"), F.coalesce(F.try_element_at(numbers, x.try_cast("bigint").cast("string")), F.lit("other")))
        .when(low.isin("tcp", "udp", "icmp"), low)
        .otherwise("other")
    )


@dataclass
class Normalised:
    flows: DataFrame
    rejects: DataFrame


def normalise(
    df: DataFrame, source_type: str = "ZEEK_LOG", params: Params = DEFAULT,
    aliases: dict[str, tuple[str, ...]] | None = None, dedupe: bool = True, raw: str | None = None,
) -> Normalised:
    """Validated flows and the rejected records with a low-cardinality reason."""
    table = {**FIELD_ALIASES, **(aliases or {})}
    f = {k: pick(df, v) for k, v in table.items()}
    d = {k: pick(df, v) for k, v in DNS_ALIASES.items()}
    t = {k: pick(df, v) for k, v in TLS_ALIASES.items()}
    ms = F.lit(False)
    if "flowDurationMilliseconds" in df.columns:  # only when that name supplied the value
        earlier = [a for a in table["duration"] if a in df.columns]
        earlier = earlier[: earlier.index("flowDurationMilliseconds")]
        ms = pick(df, earlier).isNull() if earlier else F.lit(True)
    keep_raw = F.col(raw) if raw else F.to_json(F.struct(*[F.col(f"`{c}`").alias(c) for c in df.columns]))
    picked = df.select(
        keep_raw.alias("raw"), ms.alias("ms"),
        *[c.alias(f"f_{k}") for k, c in f.items()],
        *[c.alias(f"d_{k}") for k, c in d.items()], *[c.alias(f"t_{k}") for k, c in t.items()],
    )
    c = F.col
    ts = number(c("f_timestamp"))
    rows = picked.withColumns({
        "ts_s": ts, "ts_us": F.when(ts.between(*YEARS), F.round(ts * 1e6).try_cast("bigint")),
        "src": net.canonical_ip(F.trim("f_src_ip")), "dst": net.canonical_ip(F.trim("f_dst_ip")),
        "sport": optional_int(c("f_src_port")), "dport": optional_int(c("f_dst_port")),
        "tp": transport(c("f_transport")), "q": canonical_domain(c("d_query")), "s": canonical_domain(c("t_sni")),
        "has_tls": F.coalesce("t_version", "t_sni", "t_ja4", "t_ja4s", "t_cipher").isNotNull(),
    })
    ver = lambda x: F.when(x.contains(":"), 6).otherwise(4)
    rows = rows.withColumn("reason", (
        F.when(c("f_timestamp").isNull(), "bad_timestamp")
        .when(c("ts_us").isNull(), "other")  # no number, or outside the calendar
        .when(c("f_src_ip").isNull() | c("f_dst_ip").isNull(), "bad_address")
        .when(c("d_query").isNotNull() & c("q").isNull(), "bad_domain")
        .when(c("t_sni").isNotNull() & c("s").isNull(), "bad_domain")
        .when(c("src").isNull() | c("dst").isNull() | (ver(c("src")) != ver(c("dst"))), "bad_address")
        .when(c("f_schema_version").isNotNull() & (c("f_schema_version") != SCHEMA_VERSION), "schema_version")
        .when(~F.coalesce(c("sport"), F.lit(0)).between(0, 65535), "validation")
        .when(~F.coalesce(c("dport"), F.lit(0)).between(0, 65535), "validation")
    ))
    rejects = rows.filter("reason is not null").select("raw", F.lit(source_type).alias("source_type"), "reason")

    none = lambda x: F.coalesce(x.cast("string"), F.lit("None"))
    flow_key = F.coalesce(c("f_flow_id"), F.concat(
        c("f_src_ip"), F.lit(":"), none(c("sport")), F.lit(">"), c("f_dst_ip"), F.lit(":"), none(c("dport")), F.lit("/"), c("tp")
    ))
    qtype = short_text(c("d_qtype"))
    flow_key = F.when(c("q").isNotNull(), F.concat_ws("|", flow_key, c("q"), F.coalesce(qtype, F.lit("")))).otherwise(flow_key)
    kind = F.when(c("d_query").isNotNull(), "dns").when(c("has_tls"), "ssl").otherwise("conn")
    event_id = F.substring(F.sha2(F.concat_ws("|", F.format_string("%.6f", c("ts_s")), flow_key, kind), 256), 1, 32)
    derived = F.substring(F.sha2(F.concat_ws("|", c("src"), none(c("sport")), c("dst"), none(c("dport")), c("tp")), 256), 1, 16)
    answers = F.when(
        c("d_answers").startswith("["), F.from_json("d_answers", "array<string>")
    ).otherwise(F.array("d_answers"))
    dur = number(c("f_duration"))
    dns = F.when(c("d_query").isNotNull(), F.struct(
        c("q").alias("query"), qtype.alias("qtype"), short_text(c("d_rcode")).alias("rcode"),
        F.when(c("d_answers").isNull(), F.array().cast("array<string>")).otherwise(
            F.transform(F.slice(answers, 1, 64), lambda a: F.substring(a, 1, 256))
        ).alias("answers"),
        optional_int(c("d_response_bytes")).alias("response_bytes"),
        F.coalesce(truthy(c("d_rejected")), F.lit(False)).alias("rejected"),
    ))
    tls = F.when(c("has_tls"), F.struct(
        short_text(c("t_version")).alias("version"), c("s").alias("sni"), short_text(c("t_ja4")).alias("ja4"),
        short_text(c("t_ja4s")).alias("ja4s"), short_text(c("t_cipher")).alias("cipher"),
        short_text(c("t_cert_subject_cn")).alias("cert_subject_cn"), short_text(c("t_cert_issuer_cn")).alias("cert_issuer_cn"),
        optional_int(c("t_cert_validity_days")).alias("cert_validity_days"),
        truthy(c("t_cert_self_signed")).alias("cert_self_signed"), truthy(c("t_established")).alias("established"),
    ))
    good = rows.filter("reason is null")
    inside = lambda x: net.in_networks(x, params.home_networks)
    flows = good.select(
        F.lit(SCHEMA_VERSION).alias("schema_version"), event_id.alias("event_id"),
        F.timestamp_micros("ts_us").alias("ts"), "ts_us", F.current_timestamp().alias("ingest_ts"),
        F.substring(F.coalesce("f_sensor_id", F.lit(params.sensor_id)), 1, 256).alias("sensor_id"),
        F.lit(source_type).alias("source_type"),
        F.coalesce(F.substring("f_flow_id", 1, 256), derived).alias("flow_id"),
        c("src").alias("src_ip"), c("sport").cast("int").alias("src_port"),
        c("dst").alias("dst_ip"), c("dport").cast("int").alias("dst_port"), ver(c("src")).alias("ip_version"),
        c("tp").alias("transport"), short_text(c("f_service")).alias("service"),
        net.direction(inside(c("src")), inside(c("dst"))).alias("direction"),
        F.greatest(F.lit(0.0), F.when(c("ms"), dur / 1000.0).otherwise(dur)).alias("duration"),
        F.coalesce(optional_int(c("f_orig_packets")), F.lit(0)).cast("bigint").alias("orig_packets"),
        optional_int(c("f_resp_packets")).alias("resp_packets"),
        F.coalesce(optional_int(c("f_orig_bytes")), F.lit(0)).cast("bigint").alias("orig_bytes"),
        optional_int(c("f_resp_bytes")).alias("resp_bytes"),
        short_text(c("f_connection_state")).alias("connection_state"), short_text(c("f_tcp_flags")).alias("tcp_flags"),
        dns.alias("dns"), tls.alias("tls"),
        short_text(c("f_pcap_reference")).alias("pcap_reference"), short_text(c("f_raw_event_reference")).alias("raw_event_reference"),
    )
    flows = flows.withColumn("duration", F.when(F.col("duration").isNotNull(), F.col("duration")))
    return Normalised(flows.dropDuplicates(["event_id"]) if dedupe else flows, rejects)


def reject_counts(n: Normalised) -> DataFrame:
    """Accepted and rejected record counts per reason."""
    accepted = n.flows.agg(F.count("*").alias("n")).select(F.lit("accepted").alias("reason"), "n")
    return n.rejects.groupBy("reason").agg(F.count("*").alias("n")).unionByName(accepted)


def valid_indicator(kind: Column, value: Column) -> Column:
    """Canonical indicator value, or null when it does not fit its kind."""
    return (
        F.when(kind == "domain", canonical_domain(value))
        .when(kind == "sha256", F.when(value.rlike("^[0-9a-fA-F]{64}$"), value))
        .when(kind.isin("ip", "ja4", "ja4s") & (F.length(value) <= 256), value)
    )


def valid_feedback(label: Column, corrected: Column) -> Column:
    """A false negative must name the class it should have been."""
    return (label != "FALSE_NEGATIVE") | corrected.isNotNull()
