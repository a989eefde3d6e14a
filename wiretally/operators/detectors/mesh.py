"""The detector mesh: every accepted row is shown to every ready detector once."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wiretally.operators import features as ft
from wiretally.operators.detectors import rules
from wiretally.operators.detectors.base import Detector
from wiretally.params import DEFAULT, Params

_DDOS = (
    "flow_count_1s", "syn_rate_1s", "flows_per_sec_1s", "packets_per_sec_1s", "udp_rate_1s",
    "amplification_ratio_5s", "unique_src_ips_5s", "src_ip_entropy_5s", "syn_ratio_5s", "udp_ratio_5s",
    "mean_packet_size_1s", "coverage_1s", "flows_per_sec_60s",
    *[n for n in ft.baseline_names("flows_per_sec_60s") if not n.endswith("_p95")],
)
_RECON = (
    "flow_count_60s", "unique_dst_ports_60s", "unique_dst_ips_60s", "failed_ratio_60s",
    "mean_duration_60s", "syn_ratio_60s", "dst_port_entropy_60s", "flows_per_sec_60s",
)
_C2 = (
    "interarrival_mean", "interarrival_stdev", "interarrival_cv", "interarrival_count",
    "periodicity_score", "burstiness", "byte_stability_cv", "duration_stability_cv",
    "mean_flow_bytes", "observed_span", "mean_duration_60s",
)
_EXFIL = (
    "bytes_out_total_300s", "bytes_in_total_300s", "orig_resp_byte_ratio_300s", "mean_duration_300s",
    "bytes_out_per_sec_300s", "bytes_out_per_sec_60s", *ft.baseline_names("bytes_out_per_sec_60s"),
)
_DNS = ("dns_queries_per_sec_60s", "dns_query_count_60s", "dns_unique_name_ratio_60s", "dns_txt_ratio_60s", "dns_nxdomain_ratio_60s")

# In evaluation order; `rank` breaks ties between results of one moment.
DETECTORS: tuple[Detector, ...] = (
    Detector("ddos", "DDOS", "HYBRID", "RULE_EVIDENCE", ("DESTINATION",), rules.flood, _DDOS, rank=0),
    Detector("recon", "RECON", "RULE", "RULE_EVIDENCE", ("HOST",), rules.scan, _RECON, rank=1),
    Detector("c2_beacon", "C2_BEACON", "STATISTICAL", "NORMALISED_ANOMALY", ("PAIR",), rules.beacon, _C2, rank=2),
    Detector("dga", "DGA", "SUPERVISED", "CALIBRATED_PROBABILITY", ("HOST",), rules.generated_name, _DNS, "dns", rank=3),
    Detector("dns_tunnel", "DNS_TUNNEL", "HYBRID", "RULE_EVIDENCE", ("HOST",), rules.tunnel, _DNS, "dns", rank=4),
    Detector("tls_malware", "TLS_MALWARE", "SUPERVISED", "CALIBRATED_PROBABILITY", ("PAIR",), rules.tls_session, (), "tls", rank=5),
    Detector("exfiltration", "EXFILTRATION", "STATISTICAL", "NORMALISED_ANOMALY", ("HOST",), rules.exfiltration, _EXFIL, rank=6),
)


def rule_detectors() -> tuple[Detector, ...]:
    """The detectors that are ready without a model."""
    return tuple(d for d in DETECTORS if d.technique != "SUPERVISED")


def needed_features(detectors=DETECTORS) -> list[str]:
    return list(dict.fromkeys(n for d in detectors for n in d.features))


def kinds_of(detectors=DETECTORS) -> tuple[str, ...]:
    """Kinds of entities whose vectors the detectors look at."""
    return tuple(sorted({k for d in detectors for k in d.kinds}))


def detector_states(champions: dict[str, object] | None = None) -> dict[str, str]:
    """READY or UNAVAILABLE per detector; a supervised one needs a champion model."""
    have = champions or {}
    return {d.name: "READY" if d.technique != "SUPERVISED" or d.name in have else "UNAVAILABLE" for d in DETECTORS}


def _inline(df: DataFrame, picked, params: Params, vec_rank, kinds: bool, flow_ids: bool, pcaps: bool) -> DataFrame:
    flushed = F.col("read") == "flush" if kinds else F.lit(False)
    empty = F.array().cast("array<string>")
    base = [
        "ts_us", "entity_kind", "entity_id", "window_seconds",
        F.when(~flushed, F.col("src_ip")).alias("src_ip"), F.when(~flushed, F.col("dst_ip")).alias("dst_ip"),
        (F.col("flow_ids") if flow_ids else empty).alias("flow_ids"),
        (F.col("pcap_references") if pcaps else empty).alias("pcap_references"),
        vec_rank.alias("vec_rank"),
    ]
    found = df.select(*base, F.array_compact(F.array(*[d.result(params) for d in picked])).alias("found"))
    # `inline` would let Spark put "found is not empty" below the vectors, with every column written out wherever it is used
    return found.select(*[c for c in found.columns if c != "found"], F.inline_outer("found")).filter(F.col("detector_name").isNotNull())


def detect(
    reads: DataFrame,
    params: Params = DEFAULT,
    detectors=DETECTORS,
    champions: dict | None = None,
    challengers: dict | None = None,
) -> DataFrame:
    """Detector results of all reads.

    `champions` / `challengers` map detector name to a model with `version` and
    `score(df, out) -> df`. Without a champion a supervised detector stays silent; challenger
    scores are marked `shadow` and never alert."""
    champions, challengers = champions or {}, challengers or {}
    windowed = [d for d in detectors if d.source == "windowed"]
    have = set(reads.columns)
    parts = []
    if windowed:
        rank = F.when(F.col("entity_kind") == "HOST", 0).when(F.col("entity_kind") == "DESTINATION", 1).otherwise(2)
        parts.append(_inline(
            reads.filter(F.col("window_seconds") > 0), windowed, params, rank, True,
            "flow_ids" in have, "pcap_references" in have,
        ))
    for source, vec, vec_rank, p_col in (
        ("dns", ft.dns_vectors, 3, "dga_p"), ("tls", ft.tls_vectors, 4, "tls_p"),
    ):
        picked = [d for d in detectors if d.source == source and (d.technique != "SUPERVISED" or d.name in champions)]
        shadowed = [d for d in detectors if d.source == source and d.name in challengers and d.name in champions]
        if not picked and not shadowed:
            continue
        df = vec(reads, params) if source == "dns" else vec(reads)
        for d in picked:
            if d.name in champions:
                df = champions[d.name].score(df, p_col)
        picked = [replace(d, model_version=champions[d.name].version) if d.name in champions else d for d in picked]
        if picked:
            parts.append(_inline(df, picked, params, F.lit(vec_rank), False, True, source == "dns"))
        for d in shadowed:
            parts.append(_shadow(df, d, challengers[d.name], p_col, params, vec_rank))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _shadow(df: DataFrame, d: Detector, model, p_col: str, params: Params, vec_rank: int) -> DataFrame:
    """Every challenger probability is kept for comparison, as INFO and shadow."""
    from wiretally.operators.detectors.base import Verdict

    gate = F.col("dns_payload_length") >= params.dga_min_domain_length if d.source == "dns" else F.lit(True)
    verdict = lambda p: Verdict(
        gate, F.col(p_col), F.col(p_col), F.lit("INFO"), F.array(F.lit("SHADOW_INFERENCE")),
        {("dga_probability" if d.name == "dga" else f"{d.name}_probability"): F.col(p_col)},
    )
    quiet = replace(d, evaluate=verdict, model_version=model.version)
    scored = model.score(df.drop(p_col), p_col)
    return _inline(scored, [quiet], params, F.lit(vec_rank), False, True, d.source == "dns").withColumn("shadow", F.lit(True))
