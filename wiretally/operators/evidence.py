"""Why an alert was raised: observations, comparisons, contributions, summary, lineage."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wiretally.functions.stats import compact_number
from wiretally.params import SCHEMA_VERSION

# Fixed values -------------------------------------------------------------------
COMPARISON_MARKERS = r"baseline|zscore|threshold|p95"
SUMMARY = {
    "DDOS": "Flood toward ",
    "RECON": "Scanning from ",
    "C2_BEACON": "Periodic beaconing ",
    "DGA": "Algorithmically-generated domain queried by ",
    "DNS_TUNNEL": "DNS tunnelling from ",
    "TLS_MALWARE": "Suspicious encrypted session ",
    "EXFILTRATION": "Outbound data transfer from ",
}
HEADLINE = {
    "DDOS": ("syn_rate_1s", "flows_per_sec_1s", "unique_src_ips_5s", "src_ip_entropy_5s"),
    "RECON": ("unique_dst_ports_60s", "unique_dst_ips_60s", "failed_ratio_60s"),
    "C2_BEACON": ("interarrival_mean", "interarrival_stdev", "periodicity_score"),
    "DGA": ("dga_probability", "dns_char_entropy", "dns_payload_length"),
    "DNS_TUNNEL": ("dns_domain_length", "dns_char_entropy", "dns_query_count_60s"),
    "TLS_MALWARE": ("tls_malware_probability", "tls_session_bytes"),
    "EXFILTRATION": ("bytes_out_total_300s", "orig_resp_byte_ratio_300s", "bytes_out_per_sec_60s_zscore"),
}
# --------------------------------------------------------------------------------


def subject() -> Column:
    """The asset to investigate: the target of a flood, otherwise the source."""
    return F.when(F.col("entity_kind") == "DESTINATION", F.coalesce("dst_ip", "entity_id")).otherwise(
        F.coalesce(F.col("src_ip"), F.substring_index("entity_id", "->", 1))
    )


def observations(support: Column) -> Column:
    return F.map_filter(support, lambda k, v: ~k.rlike(COMPARISON_MARKERS))


def comparisons(support: Column) -> Column:
    return F.map_filter(support, lambda k, v: k.rlike(COMPARISON_MARKERS))


def headline(threat_class: Column, support: Column, score: Column) -> Column:
    """`name=value` for the few numbers that matter for the class, else the score."""
    wanted = F.create_map(*[x for k, names in HEADLINE.items() for x in (F.lit(k), F.array(*[F.lit(n) for n in names]))])
    names = F.coalesce(F.try_element_at(wanted, threat_class), F.array().cast("array<string>"))
    parts = F.transform(
        F.filter(names, lambda n: F.map_contains_key(support, n)),
        lambda n: F.concat(n, F.lit("="), compact_number(F.element_at(support, n))),
    )
    text = F.array_join(parts, ", ")
    return F.when(text == "", F.concat(F.lit("score="), compact_number(score))).otherwise(text)


def summary(subject_id: Column, corroborating_classes: Column) -> Column:
    templates = F.create_map(*[F.lit(x) for kv in SUMMARY.items() for x in kv])
    lead = F.coalesce(F.try_element_at(templates, F.col("threat_class")), F.lit(""))
    text = F.concat(
        lead, subject_id, F.lit(": "),
        headline(F.col("threat_class"), F.col("supporting_features"), F.col("score")),
    )
    more = F.when(
        F.size(corroborating_classes) > 0,
        F.concat(F.lit(" (corroborated by "), F.array_join(corroborating_classes, ", "), F.lit(")")),
    ).otherwise("")
    return F.substring(F.concat(text, more), 1, 4096)


def entries_to_map(entries: Column) -> Column:
    return F.map_from_entries(F.filter(entries, lambda x: x["k"].isNotNull()))


def lineage(own_version: Column, own_model: Column, others: Column, run_id: str | None) -> Column:
    """Versions of everything that took part. `others` holds (detector, version, model)."""
    own = F.struct(F.col("detector_name").alias("d"), own_version.alias("v"), own_model.alias("m"))
    every = F.concat(F.array(own), F.coalesce(others, F.array().cast("array<struct<d:string,v:string,m:string>>")))
    versions = entries_to_map(F.transform(every, lambda x: F.struct(x["d"].alias("k"), x["v"].alias("v"))))
    models = entries_to_map(
        F.transform(F.filter(every, lambda x: x["m"].isNotNull()), lambda x: F.struct(x["d"].alias("k"), x["m"].alias("v")))
    )
    return F.struct(
        versions.alias("detector_versions"), models.alias("model_versions"),
        F.col("feature_schema_version"), F.lit(SCHEMA_VERSION).alias("event_schema_version"),
        F.lit(run_id).cast("string").alias("pipeline_run_id"),
    )
