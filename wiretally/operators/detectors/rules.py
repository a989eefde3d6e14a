"""Rule and statistical detectors over windowed and per-query vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from wiretally.functions.stats import exceedance, ratio
from wiretally.operators.detectors.base import Verdict, codes, severity
from wiretally.params import Params

c = F.col


def flood(p: Params) -> Verdict:
    """Volumetric or protocol flood toward one destination."""
    def trigger(i, code, observed, threshold, cond):
        s = F.struct(
            exceedance(observed, threshold).alias("strength"), F.lit(-i).alias("nth"),
            F.lit(code).alias("code"), observed.alias("observed"), F.lit(float(threshold)).alias("threshold"),
        )
        return F.when(cond, s)

    udp_heavy = c("udp_ratio_5s") >= 0.5
    triggers = F.array_compact(F.array(
        trigger(0, "SYN_FLOOD_RATE", c("syn_rate_1s"), p.ddos_syn_rate,
                (c("syn_rate_1s") >= p.ddos_syn_rate) & (c("syn_ratio_5s") >= 0.5)),
        trigger(1, "UDP_FLOOD_RATE", c("udp_rate_1s"), p.ddos_flow_rate,
                (c("udp_rate_1s") >= p.ddos_flow_rate) & udp_heavy),
        trigger(2, "FLOW_RATE_EXCEEDED", c("flows_per_sec_1s"), p.ddos_flow_rate,
                c("flows_per_sec_1s") >= p.ddos_flow_rate),
        trigger(3, "PACKET_RATE_EXCEEDED", c("packets_per_sec_1s"), p.ddos_packet_rate,
                c("packets_per_sec_1s") >= p.ddos_packet_rate),
        trigger(4, "AMPLIFICATION_RATIO", c("amplification_ratio_5s"), p.ddos_amplification_ratio,
                (c("amplification_ratio_5s") >= p.ddos_amplification_ratio) & udp_heavy),
    ))
    top = F.array_max(triggers)  # the strongest; the earlier one wins a tie
    strength = top["strength"]
    distributed = (c("unique_src_ips_5s") >= p.ddos_min_unique_sources) & (
        c("src_ip_entropy_5s") >= p.ddos_source_entropy
    )
    warm = c("flows_per_sec_60s_baseline_warm") == 1.0
    multiple = ratio(c("flows_per_sec_60s"), c("flows_per_sec_60s_baseline_mean"))
    exceeded = warm & (multiple >= p.ddos_baseline_multiplier)
    confidence = 0.5 + 0.4 * strength + F.when(distributed, 0.05).otherwise(0.0) + F.when(exceeded, 0.05).otherwise(0.0)
    sev = severity(
        ((strength >= 0.9) & distributed & warm, "CRITICAL"),
        (strength >= 0.9, "HIGH"),
        ((strength >= 0.7) & distributed, "HIGH"),
        (strength >= 0.7, "MEDIUM"),
        (distributed, "MEDIUM"), default="LOW",
    )
    names = (
        "syn_rate_1s", "flows_per_sec_1s", "packets_per_sec_1s", "udp_rate_1s", "syn_ratio_5s",
        "amplification_ratio_5s", "unique_src_ips_5s", "src_ip_entropy_5s", "mean_packet_size_1s",
    )
    return Verdict(
        fires=(c("flow_count_1s") >= p.ddos_min_flows) & (F.size(triggers) > 0),
        score=F.when(top["threshold"] != 0, top["observed"] / top["threshold"]).otherwise(top["observed"]),
        confidence=F.least(F.lit(0.99), confidence),
        severity=sev,
        reasons=F.concat(
            F.transform(triggers, lambda t: t["code"]),
            codes((distributed, "DISTRIBUTED_SOURCES"), (exceeded, "BASELINE_EXCEEDED"), (~warm, "BASELINE_COLD")),
        ),
        supporting={
            **{n: c(n) for n in names},
            "triggered_observed": top["observed"], "triggered_threshold": top["threshold"],
            "coverage_1s": c("coverage_1s"),
            "flows_per_sec_60s_baseline_mean": F.when(warm, c("flows_per_sec_60s_baseline_mean")),
            "flows_per_sec_60s_zscore": F.when(warm, c("flows_per_sec_60s_zscore")),
            "observed_over_baseline": F.when(warm, multiple),
        },
    )


def scan(p: Params) -> Verdict:
    """Vertical, horizontal or sweeping reconnaissance by one source."""
    ports, hosts = c("unique_dst_ports_60s"), c("unique_dst_ips_60s")
    failed, syn, dur = c("failed_ratio_60s"), c("syn_ratio_60s"), c("mean_duration_60s")
    vertical, horizontal = ports >= p.recon_unique_ports, hosts >= p.recon_unique_hosts
    strength = F.greatest(
        F.when(vertical, exceedance(ports, p.recon_unique_ports)).otherwise(0.0),
        F.when(horizontal, exceedance(hosts, p.recon_unique_hosts)).otherwise(0.0),
    )
    names = (
        "unique_dst_ports_60s", "unique_dst_ips_60s", "failed_ratio_60s", "syn_ratio_60s",
        "mean_duration_60s", "dst_port_entropy_60s", "flow_count_60s", "flows_per_sec_60s",
    )
    return Verdict(
        fires=(c("flow_count_60s") >= p.recon_min_flows)
        & (vertical | horizontal)
        & ((failed >= p.recon_failed_ratio) | (syn >= p.recon_failed_ratio)),
        score=F.greatest(ports / p.recon_unique_ports, hosts / p.recon_unique_hosts),
        confidence=F.least(F.lit(0.97), 0.45 + 0.35 * strength + 0.2 * F.greatest(failed, syn)),
        severity=severity(
            (vertical & horizontal & (strength >= 0.7), "HIGH"), (hosts >= 200, "HIGH"),
            ((strength >= 0.7) | (hosts >= 50), "MEDIUM"), default="LOW",
        ),
        reasons=codes(
            (vertical & horizontal, "NETWORK_SWEEP"), (vertical & ~horizontal, "VERTICAL_PORT_SCAN"),
            (horizontal & ~vertical, "HORIZONTAL_HOST_SCAN"),
            (failed >= p.recon_failed_ratio, "HIGH_FAILED_CONNECTION_RATIO"),
            (syn >= p.recon_failed_ratio, "SYN_WITHOUT_ESTABLISH"),
            ((dur > 0) & (dur <= p.recon_max_mean_duration), "SHORT_LIVED_CONNECTIONS"),
        ),
        supporting={
            **{n: c(n) for n in names},
            "port_threshold": F.lit(float(p.recon_unique_ports)),
            "host_threshold": F.lit(float(p.recon_unique_hosts)),
        },
    )


def beacon(p: Params) -> Verdict:
    """Regular check-ins of a pair, with at least two supporting signals."""
    mean, cv, score = c("interarrival_mean"), c("interarrival_cv"), c("periodicity_score")
    rarity, dur = c("destination_rarity"), c("mean_duration_60s")
    signals = codes(
        (rarity >= 0.5, "RARE_DESTINATION"),
        (c("byte_stability_cv").between(0.0, p.c2_byte_stability_cv), "STABLE_PAYLOAD_SIZE"),
        (c("duration_stability_cv").between(0.0, p.c2_byte_stability_cv), "STABLE_CONNECTION_DURATION"),
        (c("is_internal_destination") == 0.0, "EXTERNAL_DESTINATION"),
        ((dur > 0.0) & (dur <= 5.0), "SHORT_CHECKIN_FLOWS"),
    )
    n = F.size(signals)
    names = (
        "interarrival_mean", "interarrival_stdev", "interarrival_cv", "interarrival_count",
        "periodicity_score", "burstiness", "byte_stability_cv", "duration_stability_cv",
        "mean_flow_bytes", "destination_rarity", "observed_span",
    )
    return Verdict(
        fires=(c("interarrival_count") >= p.c2_min_intervals)
        & mean.between(p.c2_min_interval, p.c2_max_interval)
        & (cv <= p.c2_max_cv) & (score >= p.c2_periodicity_score)
        & (c("interarrival_stdev") <= p.c2_max_jitter_seconds) & (n >= p.c2_min_corroboration),
        score=score,
        confidence=F.least(F.lit(0.97), 0.45 * score + 0.35 * F.least(F.lit(1.0), (n - 1) / 4.0) + 0.15),
        severity=severity(
            ((score >= 0.9) & (n >= 4) & (rarity >= 0.9), "HIGH"),
            ((score >= 0.85) & (n >= 3), "MEDIUM"), default="LOW",
        ),
        reasons=F.concat(F.array(F.lit("PERIODIC_INTERVALS")), signals),
        supporting={
            **{n_: c(n_) for n_ in names}, "corroborating_signals": n,
            "periodicity_threshold": F.lit(p.c2_periodicity_score), "cv_threshold": F.lit(p.c2_max_cv),
        },
    )


def tunnel(p: Params) -> Verdict:
    """DNS tunnelling: odd name and odd query behaviour together."""
    length, payload = c("dns_domain_length"), c("dns_payload_length")
    entropy, hexed, depth = c("dns_char_entropy"), c("dns_hex_ratio"), c("dns_subdomain_depth")
    count, rate = c("dns_query_count_60s"), c("dns_queries_per_sec_60s")
    unique, txt = c("dns_unique_name_ratio_60s"), c("dns_txt_ratio_60s")
    asym = c("dns_request_response_asymmetry")
    enough = count >= p.tunnel_min_queries
    lexical = codes(
        (length >= p.tunnel_query_length, "OVERSIZED_QUERY_NAME"),
        ((entropy >= p.tunnel_entropy) & (payload >= 24), "HIGH_QUERY_ENTROPY"),
        ((hexed >= 0.9) & (payload >= 24), "HEX_ENCODED_SUBDOMAIN"),
        ((depth >= 3) & (payload >= 30), "DEEP_ENCODED_SUBDOMAIN"),
    )
    behaviour = codes(
        (enough & (unique >= p.tunnel_unique_subdomain_ratio), "UNIQUE_SUBDOMAIN_PER_QUERY"),
        (enough & (txt >= p.tunnel_txt_ratio), "EXCESSIVE_TXT_QUERIES"),
        (enough & (rate >= 5.0), "SUSTAINED_QUERY_RATE"),
        ((asym >= 6.0) & (c("dns_response_bytes") >= 300), "RESPONSE_LARGER_THAN_QUERY"),
    )
    nl, nb = F.size(lexical), F.size(behaviour)
    strength = F.greatest(
        exceedance(length, p.tunnel_query_length), exceedance(entropy, p.tunnel_entropy, 1.4)
    )
    names = (
        "dns_domain_length", "dns_payload_length", "dns_char_entropy", "dns_hex_ratio",
        "dns_subdomain_depth", "dns_query_count_60s", "dns_queries_per_sec_60s",
        "dns_unique_name_ratio_60s", "dns_txt_ratio_60s", "dns_request_response_asymmetry",
    )
    return Verdict(
        fires=(nl > 0) & (nb > 0),
        score=strength,
        confidence=F.least(F.lit(0.96), 0.4 * strength + 0.15 * nl + 0.15 * nb),
        severity=severity(
            ((nl >= 2) & (nb >= 2) & (count >= 100), "HIGH"), ((nl >= 2) | (nb >= 2), "MEDIUM"), default="LOW"
        ),
        reasons=F.concat(lexical, behaviour),
        supporting={
            **{n: c(n) for n in names},
            "length_threshold": F.lit(float(p.tunnel_query_length)), "entropy_threshold": F.lit(p.tunnel_entropy),
        },
    )


def exfiltration(p: Params) -> Verdict:
    """Outbound volume from an internal host that also breaks its pattern."""
    out, inbound, rt = c("bytes_out_total_300s"), c("bytes_in_total_300s"), c("orig_resp_byte_ratio_300s")
    rarity, z, rate = c("destination_rarity"), c("bytes_out_per_sec_60s_zscore"), c("bytes_out_per_sec_60s")
    p95, warm = c("bytes_out_per_sec_60s_baseline_p95"), c("bytes_out_per_sec_60s_baseline_warm") == 1.0
    checks = (
        (rt >= p.exfil_outbound_inbound_ratio, "OUTBOUND_DOMINATED_TRANSFER"),
        (rarity >= p.exfil_destination_rarity, "RARE_DESTINATION"),
        (warm & (z >= p.exfil_baseline_zscore), "BASELINE_DEVIATION"),
        (warm & (p95 > 0) & (rate >= p95 * 2), "ABOVE_HISTORICAL_P95"),
    )
    signals = F.size(codes(*checks))
    gigabyte = 1_000_000_000
    strength = (
        0.25 * exceedance(out, float(p.exfil_min_outbound_bytes))
        + 0.25 * exceedance(rt, p.exfil_outbound_inbound_ratio)
        + 0.35 * F.when(warm, F.least(F.lit(1.0), z / (p.exfil_baseline_zscore * 2))).otherwise(0.0)
        + 0.1 * rarity
    )
    return Verdict(
        fires=(c("is_internal_source") == 1.0) & (c("is_internal_destination") != 1.0)
        & (out >= p.exfil_min_outbound_bytes) & (signals >= 1),
        score=out / float(p.exfil_min_outbound_bytes),
        confidence=F.least(F.lit(0.95), strength),
        severity=severity(
            ((out >= gigabyte) & (signals >= 2) & warm, "HIGH"),
            ((out >= gigabyte) | (signals >= 2), "MEDIUM"), default="LOW",
        ),
        reasons=F.concat(
            F.array(F.lit("HIGH_OUTBOUND_VOLUME")),
            codes(*checks, (c("mean_duration_300s") >= 60.0, "SUSTAINED_TRANSFER"), (~warm, "BASELINE_COLD")),
        ),
        supporting={
            "bytes_out_total_300s": out, "bytes_in_total_300s": inbound, "orig_resp_byte_ratio_300s": rt,
            "bytes_out_per_sec_300s": c("bytes_out_per_sec_300s"), "destination_rarity": rarity,
            "bytes_out_per_sec_60s": rate, "bytes_out_per_sec_60s_zscore": z,
            "bytes_out_per_sec_60s_baseline_mean": c("bytes_out_per_sec_60s_baseline_mean"),
            "bytes_out_per_sec_60s_baseline_p95": p95,
            "bytes_out_per_sec_60s_baseline_warm": F.when(warm, 1.0).otherwise(0.0),
            "mean_duration_300s": c("mean_duration_300s"),
            "volume_threshold": F.lit(float(p.exfil_min_outbound_bytes)),
            "ratio_threshold": F.lit(p.exfil_outbound_inbound_ratio),
            "zscore_threshold": F.lit(p.exfil_baseline_zscore),
        },
    )


def generated_name(p: Params) -> Verdict:
    """Champion probability that a queried name was generated (`dga_p` must be present)."""
    prob = c("dga_p")
    nx = c("dns_is_nxdomain") == 1.0
    return Verdict(
        fires=(c("dns_label_count") >= 2) & (c("dns_payload_length") >= p.dga_min_domain_length)
        & (prob >= p.dga_probability),
        score=prob, confidence=prob,
        severity=severity(
            ((prob >= 0.95) & ~nx, "HIGH"), ((prob >= 0.95) | ~nx, "MEDIUM"), default="LOW"
        ),
        reasons=F.concat(
            F.array(F.lit("DGA_MODEL_POSITIVE")),
            codes(
                (nx, "NXDOMAIN_RESPONSE"),
                ((c("dns_nxdomain_ratio_60s") >= 0.5) & (c("dns_query_count_60s") >= 10), "HOST_NXDOMAIN_BURST"),
                (c("dns_char_entropy") >= 3.5, "HIGH_NAME_ENTROPY"),
            ),
        ),
        supporting={
            "dga_probability": prob, "probability_threshold": F.lit(p.dga_probability),
            **{n: c(n) for n in _lexical()},
            "dns_nxdomain_ratio_60s": c("dns_nxdomain_ratio_60s"), "dns_query_count_60s": c("dns_query_count_60s"),
            "domain_length": F.length("dns_query").cast("double"),
        },
    )


def _lexical():
    from wiretally.functions.text import DNS_LEXICAL_FEATURES

    return DNS_LEXICAL_FEATURES


def tls_session(p: Params) -> Verdict:
    """Champion probability over handshake metadata (`tls_p` must be present)."""
    prob = c("tls_p")
    names = (
        "tls_session_bytes", "tls_session_packets", "tls_session_duration", "tls_mean_packet_size",
        "tls_orig_resp_byte_ratio", "tls_cert_validity_days", "tls_self_signed", "tls_established",
        "tls_sni_present", "tls_sni_length", "tls_sni_entropy", "destination_rarity",
        "interarrival_cv", "periodicity_score",
    )
    return Verdict(
        fires=prob >= p.tls_probability, score=prob, confidence=prob,
        severity=F.when(prob < p.tls_high_probability, "MEDIUM").otherwise("HIGH"),
        reasons=F.array(F.lit("TLS_METADATA_MODEL_POSITIVE")),
        supporting={"tls_malware_probability": prob, **{n: c(n) for n in names}},
    )
