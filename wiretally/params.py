"""All tunables in one place: windows, thresholds, fusion, drift, governance, skew."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields, replace

# Fixed values -------------------------------------------------------------------
SCHEMA_VERSION = "1.0.0"
SEVERITIES = ("INFO", "LOW", "MEDIUM", "HIGH", "CRITICAL")
THREAT_CLASSES = (
    "BENIGN", "DDOS", "C2_BEACON", "DGA", "DNS_TUNNEL", "TLS_MALWARE", "RECON", "EXFILTRATION",
)
SOURCE_TYPES = (
    "LIVE_TAP", "SPAN", "DIODE", "PCAP_REPLAY", "ZEEK_LOG", "NETFLOW", "IPFIX", "SFLOW", "SYNTHETIC",
)
ALERT_STATUSES = ("NEW", "TRIAGED", "CONFIRMED", "DISMISSED", "SUPPRESSED")
FEEDBACK_LABELS = ("TRUE_POSITIVE", "FALSE_POSITIVE", "FALSE_NEGATIVE", "UNCERTAIN")
# --------------------------------------------------------------------------------


@dataclass(frozen=True)
class Params:
    # windows
    sizes: tuple[int, ...] = (1, 5, 30, 60, 300)
    emit_interval: float = 1.0
    emission: str = "greedy"  # or "tick": last event of every whole second
    flush_at: str = "global"  # or "entity", or "none"
    home_networks: tuple[str, ...] = ("10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16")
    sensor_id: str = "sensor-local"
    unknown_resp_is_failed: bool = True
    # skew: an entity with more rows than this is cut into time slices
    hot_rows: int = 2_000_000
    slice_rows: int = 1_000_000
    # streams: how far the watermark lags, and how long an idle entity keeps its state
    stream_delay: int = 60
    state_idle: int = 3600
    # floods
    ddos_min_flows: int = 20
    ddos_syn_rate: float = 500.0
    ddos_flow_rate: float = 1000.0
    ddos_packet_rate: float = 20_000.0
    ddos_min_unique_sources: int = 50
    ddos_source_entropy: float = 4.0
    ddos_baseline_multiplier: float = 10.0
    ddos_amplification_ratio: float = 5.0
    # scanning
    recon_unique_ports: int = 20
    recon_unique_hosts: int = 25
    recon_failed_ratio: float = 0.8
    recon_min_flows: int = 20
    recon_max_mean_duration: float = 1.0
    # beaconing
    c2_min_intervals: int = 6
    c2_max_cv: float = 0.25
    c2_periodicity_score: float = 0.7
    c2_max_jitter_seconds: float = 30.0
    c2_byte_stability_cv: float = 0.3
    c2_min_interval: float = 5.0
    c2_max_interval: float = 3600.0
    c2_min_corroboration: int = 2
    # generated names
    dga_probability: float = 0.85
    dga_min_domain_length: int = 8
    # dns tunnels
    tunnel_query_length: int = 60
    tunnel_entropy: float = 3.6
    tunnel_unique_subdomain_ratio: float = 0.8
    tunnel_min_queries: int = 20
    tunnel_txt_ratio: float = 0.3
    # tls
    tls_probability: float = 0.9
    tls_high_probability: float = 0.97
    # exfiltration
    exfil_min_outbound_bytes: int = 10_000_000
    exfil_outbound_inbound_ratio: float = 20.0
    exfil_baseline_zscore: float = 4.0
    exfil_destination_rarity: float = 0.9
    # baselines
    ewma_alpha: float = 0.05
    baseline_min_observations: int = 30
    baseline_reservoir: int = 256
    # fusion
    correlation_window: int = 300
    dedup_window: int = 60
    corroboration_bonus: float = 0.08
    max_confidence: float = 0.99
    min_alert_confidence: float = 0.5
    incident_idle: int = 900
    backfill_incident: bool = False
    # drift
    psi_threshold: float = 0.2
    ks_threshold: float = 0.15
    js_threshold: float = 0.1
    drift_min_samples: int = 200
    drift_bins: int = 10
    # promotion gates
    min_precision: float = 0.9
    min_recall: float = 0.8
    max_false_positive_rate: float = 0.02
    max_inference_latency_ms: float = 5.0
    min_transfer_recall: float = 0.5
    require_dataset: bool = True
    require_champion_improvement: bool = True

    def with_(self, **changes) -> "Params":
        return replace(self, **changes)

    @staticmethod
    def from_env(prefix: str = "WIRETALLY_") -> "Params":
        """Override numeric and text fields from the environment."""
        base, changes = Params(), {}
        for f in fields(Params):
            raw = os.environ.get(prefix + f.name.upper())
            if raw is None:
                continue
            current = getattr(base, f.name)
            if isinstance(current, bool):
                changes[f.name] = raw.lower() in ("1", "true", "yes")
            elif isinstance(current, tuple):
                kind = type(current[0])
                changes[f.name] = tuple(kind(x.strip()) for x in raw.split(",") if x.strip())
            else:
                changes[f.name] = type(current)(raw)
        return replace(base, **changes)


DEFAULT = Params()
