"""Scenarios through the whole batch plan; the sliced plan must equal the plain one."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import fixtures as fx
from wiretally.operators import features as ft
from wiretally.params import DEFAULT
from wiretally.plans.detection import run_detection

SCENARIOS = {
    "syn_flood": (fx.syn_flood, "ddos", {"SYN_FLOOD_RATE", "DISTRIBUTED_SOURCES", "BASELINE_COLD"}),
    "vertical_scan": (fx.vertical_scan, "recon", {"VERTICAL_PORT_SCAN"}),
    "beacon": (fx.beacon, "c2_beacon", {"PERIODIC_INTERVALS", "STABLE_PAYLOAD_SIZE", "EXTERNAL_DESTINATION"}),
    "tunnel": (fx.tunnel, "dns_tunnel", {"OVERSIZED_QUERY_NAME", "UNIQUE_SUBDOMAIN_PER_QUERY", "EXCESSIVE_TXT_QUERIES"}),
    "exfil": (fx.exfil, "exfiltration", {"HIGH_OUTBOUND_VOLUME", "OUTBOUND_DOMINATED_TRANSFER"}),
}


@pytest.fixture(scope="module")
def mixed(spark):
    """All positive scenarios at once; their addresses do not overlap."""
    rows = [r for make, _, _ in SCENARIOS.values() for r in make()]
    d = run_detection(fx.flows(spark, rows), DEFAULT)
    found = d.results.groupBy("detector_name").agg(F.flatten(F.collect_set("reason_codes")).alias("c")).collect()
    return d, {r[0]: set(r[1]) for r in found}


@pytest.mark.parametrize("name", SCENARIOS)
def test_scenario_fires(mixed, name):
    _, detector, codes = SCENARIOS[name]
    assert codes <= mixed[1].get(detector, set())


def test_alerts_are_folded_and_explained(mixed):
    alerts = {r["detector_name"]: r for r in mixed[0].fused.alerts.collect()}
    assert set(alerts) >= {"ddos", "recon", "c2_beacon", "dns_tunnel", "exfiltration"}
    flood = alerts["ddos"]
    assert flood["correlation_id"] == "10.0.0.9" and flood["evidence"]["summary"].startswith("Flood toward 10.0.0.9: syn_rate_1s=")
    assert "triggered_threshold" in flood["evidence"]["baseline_comparisons"]
    assert flood["lineage"]["detector_versions"]["ddos"] == "1.0.0"
    assert alerts["dns_tunnel"]["dedup_count"] > 50 and len(alerts["dns_tunnel"]["evidence"]["flow_ids"]) >= 1


def test_quiet_traffic_is_silent(spark):
    rows = fx.busy_client() + fx.polling() + fx.ordinary_dns() + fx.downloads() + fx.benign() + fx.syn_flood(10)
    d = run_detection(fx.flows(spark, rows), DEFAULT)
    assert [(r["detector_name"], r["entity_id"]) for r in d.results.collect()] == []


def _vectors(flows, params, names):
    v = ft.vectors(flows, params, names, protocol=True, extras=("flow_ids", "pcap_references"), dns_sizes=(60,))
    keep = ["entity_kind", "entity_id", "ts_us", "read", "event_count", *names]
    return v.select(
        *keep[:5], *[F.round(F.col(n) + 1e-9, 5).alias(n) for n in names], F.array_join("flow_ids", ",").alias("ids"),
        F.array_join("pcap_references", ",").alias("files"),
        F.round("dns_query_count_60s", 5).alias("q"),
    )


def test_sliced_hot_entities_change_nothing(spark):
    """With a tiny hot limit the busy entities are cut into slices; every vector stays the same."""
    rows = []
    for i in range(4000):  # one target takes a third of the rows, over 40 minutes, with dense and sparse parts
        hot = i % 3 == 0
        rows.append(dict(
            at=i * 0.6 + (i % 7) * 0.013, src_ip=f"10.0.{i % 3}.{(i * 13) % 40}", dst_ip="10.9.9.9" if hot else f"198.51.100.{(i * 11) % 200}",
            dst_port=1 + (i * 17) % 300, duration=None if i % 4 else (i % 50) / 10, orig_bytes=100 + (i * 31) % 900,
            connection_state="S0" if i % 5 == 0 else "SF", transport="udp" if i % 6 == 0 else "tcp",
            query=f"n{i % 50}.example.com" if i % 6 == 0 else None, qtype="A", rcode="NOERROR", response_bytes=100, pcap_reference=f"{i // 37 % 60}.pcap" if i % 5 else None,
        ))
    flows = fx.flows(spark, rows).cache()
    names = [
        "flow_count_1s", "syn_rate_5s", "bytes_out_total_300s", "unique_src_ips_300s", "src_ip_entropy_60s", "src_concentration_60s",
        "coverage_300s", "mean_duration_60s", "interarrival_mean", "interarrival_cv", "interarrival_count", "byte_stability_cv",
        "duration_stability_cv", "destination_rarity", "entity_event_count", "flows_per_sec_60s", "flows_per_sec_60s_zscore",
        "flows_per_sec_60s_baseline_p95",
    ]
    plain = _vectors(flows, DEFAULT, names)
    cut = _vectors(flows, DEFAULT.with_(hot_rows=500, slice_rows=150), names)
    a, b = plain.collect(), cut.collect()
    assert len(a) == len(b)
    left, right = {tuple(r) for r in a}, {tuple(r) for r in b}
    assert left == right, (sorted(map(str, left - right))[:2], sorted(map(str, right - left))[:2])
