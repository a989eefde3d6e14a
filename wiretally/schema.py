"""Fixed schemas and the columns each stage works on."""

from __future__ import annotations

FLOW_DDL = """
schema_version string, event_id string, ts timestamp, ts_us bigint, ingest_ts timestamp,
sensor_id string, source_type string, flow_id string, src_ip string, src_port int, dst_ip string,
dst_port int, ip_version int, transport string, service string, direction string, duration double,
orig_packets bigint, resp_packets bigint, orig_bytes bigint, resp_bytes bigint,
connection_state string, tcp_flags string,
dns struct<query:string,qtype:string,rcode:string,answers:array<string>,response_bytes:bigint,rejected:boolean>,
tls struct<version:string,sni:string,ja4:string,ja4s:string,cipher:string,cert_subject_cn:string,cert_issuer_cn:string,cert_validity_days:bigint,cert_self_signed:boolean,established:boolean>,
pcap_reference string, raw_event_reference string
"""

REJECT_DDL = "raw string, source_type string, reason string"

RESULT_DDL = (
    "detector_name string, detector_version string, threat_class string, technique string, "
    "score double, confidence double, confidence_basis string, severity_hint string, "
    "ts_us bigint, entity_kind string, entity_id string, window_seconds double, src_ip string, "
    "dst_ip string, supporting_features map<string,double>, reason_codes array<string>, "
    "model_version string, feature_schema_version string, shadow boolean, "
    "flow_ids array<string>, pcap_references array<string>, vec_rank int, det_rank int"
)

FEEDBACK_DDL = (
    "feedback_id string, ts timestamp, alert_id string, label string, "
    "corrected_threat_class string, analyst_id string, analyst_confidence double, notes string"
)
