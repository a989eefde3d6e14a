"""Queries over the detectors and the fusion of their results."""

from __future__ import annotations

from pyspark.sql import functions as F

from wiretally.functions import stats
from wiretally.operators import features as ft
from wiretally.operators import fusion
from wiretally.operators.detectors import DETECTORS, detect, kinds_of, needed_features
from wiretally.operators.models import LinearModel
from wiretally.params import DEFAULT
from wiretally.plans.catalog import sqltext as q
from wiretally.plans.catalog.registry import query, r6
from wiretally.sources.event_flows import read_flows
from wiretally.sources.storage import materialise

# Thresholds lowered so that rules speak on the sparse test traffic.
LOW = DEFAULT.with_(
    ddos_min_flows=1, ddos_syn_rate=1.0, ddos_flow_rate=2.0, ddos_packet_rate=20.0, ddos_min_unique_sources=3,
    ddos_source_entropy=1.0, ddos_amplification_ratio=3.0, ddos_baseline_multiplier=2.0,
    recon_unique_ports=4, recon_unique_hosts=5, recon_failed_ratio=0.3, recon_min_flows=4,
    c2_min_intervals=3, c2_max_cv=0.8, c2_periodicity_score=0.2, c2_max_jitter_seconds=60.0, c2_min_interval=1.0,
    tunnel_query_length=30, tunnel_entropy=3.0, tunnel_min_queries=2,
    exfil_min_outbound_bytes=60_000, exfil_outbound_inbound_ratio=0.5, exfil_baseline_zscore=1.0,
    dga_probability=0.6, tls_probability=0.6, tls_high_probability=0.8,
)
NAME_MODEL = LinearModel("1", {"dns_char_entropy": 1.2, "dns_digit_ratio": 2.0, "dns_vowel_ratio": -1.5, "dns_payload_length": 0.05}, -4.0)
NAME_RIVAL = LinearModel("2", {"dns_char_entropy": 1.0, "dns_hex_ratio": 1.5, "dns_longest_consonant_run": 0.1}, -4.5)
TLS_MODEL = LinearModel("1", {"tls_cert_validity_days": -0.02, "tls_self_signed": 1.5, "tls_orig_resp_byte_ratio": 0.1, "destination_rarity": 1.0}, 0.2)

_BY_NAME = {d.name: d for d in DETECTORS}


def _results(spark, sf, name, coarse=False, champions=None, challengers=None):
    d = _BY_NAME[name]
    params = LOW if name == "exfiltration" or d.source == "windowed" else LOW.with_(flush_at="none")
    v = ft.vectors(read_flows(spark, sf, coarse), params, needed_features((d,)), protocol=d.source != "windowed", dns_sizes=(60,), kinds=kinds_of((d,)))
    return detect(v, params, (d,), champions, challengers)


def _shown(df, *support):
    return df.select(
        "detector_name", "entity_id", "ts_us", r6("score"), r6("confidence"), F.col("severity_hint").alias("severity"),
        F.array_join("reason_codes", ",").alias("codes"),
        *[r6(F.try_element_at("supporting_features", F.lit(n)), n) for n in support],
    )


def _codes(*pairs):
    return "concat_ws(',', " + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for c, n in pairs) + ")"


def _baseline(metric: str, expr: str) -> str:
    """EWMA, p95 and warmth of one expression over the reads of `tot`."""
    return f"""
ser AS (SELECT *, CAST({expr} AS DOUBLE) AS x, row_number() OVER (PARTITION BY entity_kind, entity_id ORDER BY ts_us, read) AS rn FROM tot),
ew AS (
  SELECT entity_kind, entity_id, rn, x AS mean, CAST(0 AS DOUBLE) AS var, CAST(0 AS DOUBLE) AS pm, CAST(0 AS DOUBLE) AS pv FROM ser WHERE rn = 1
  UNION ALL
  SELECT s.entity_kind, s.entity_id, s.rn, w.mean + 0.05 * (s.x - w.mean), 0.95 * (w.var + 0.05 * (s.x - w.mean) * (s.x - w.mean)), w.mean, w.var
  FROM ew w JOIN ser s ON s.entity_kind = w.entity_kind AND s.entity_id = w.entity_id AND s.rn = w.rn + 1),
p95 AS (SELECT entity_kind, entity_id, rn, quantile_cont(x, 0.95) OVER (
    PARTITION BY entity_kind, entity_id ORDER BY rn ROWS BETWEEN 256 PRECEDING AND 1 PRECEDING) AS p FROM ser),
base AS (SELECT ser.*, rn > 30 AS warm, CASE WHEN rn > 30 THEN pm ELSE 0 END AS bmean, CASE WHEN rn > 30 THEN p ELSE 0 END AS bp95,
  CASE WHEN rn <= 30 THEN 0 WHEN sqrt(pv) <= 1e-9 THEN (CASE WHEN abs(pm) <= 1e-9 THEN 0 ELSE (x - pm) / greatest(1e-9, abs(pm)) END)
       ELSE (x - pm) / sqrt(pv) END AS z
  FROM ser JOIN ew USING (entity_kind, entity_id, rn) JOIN p95 USING (entity_kind, entity_id, rn))"""


_EX = lambda o, t, s="4.0": q.exceed(o, str(t), s)


def _flood_ctes() -> list[str]:
    f = f"""
fl AS (
  SELECT b.*, src.h_5, v_syn_1 AS syn, n_1 AS fr, v_packets_1 AS pr, v_udp_1 AS ur, {q.ratio('v_in_5', 'v_out_5')} AS amp,
    {q.ratio('v_syn_5', 'n_5', '1.0')} AS synr, {q.ratio('v_udp_5', 'n_5', '1.0')} AS udpr, u_src_5 AS us
  FROM base b JOIN src USING (entity_kind, entity_id, ts_us, read) WHERE b.entity_kind = 'DESTINATION' AND n_1 >= 1),
tr AS (
  SELECT *, CASE WHEN syn >= 1.0 AND synr >= 0.5 THEN {_EX('syn', 1.0)} END AS s1,
    CASE WHEN ur >= 2.0 AND udpr >= 0.5 THEN {_EX('ur', 2.0)} END AS s2, CASE WHEN fr >= 2.0 THEN {_EX('fr', 2.0)} END AS s3,
    CASE WHEN pr >= 20.0 THEN {_EX('pr', 20.0)} END AS s4, CASE WHEN amp >= 3.0 AND udpr >= 0.5 THEN {_EX('amp', 3.0)} END AS s5
  FROM fl),
st AS (SELECT *, greatest(s1, s2, s3, s4, s5) AS st, us >= 3 AND h_5 >= 1.0 AS dist,
    warm AND {q.ratio('x', 'bmean')} >= 2.0 AS exc FROM tr WHERE greatest(s1, s2, s3, s4, s5) IS NOT NULL),
flood AS (
  SELECT 'ddos' AS detector_name, 'DDOS' AS threat_class, entity_kind, entity_id, ts_us, read,
    CASE WHEN s1 = st THEN syn / 1.0 WHEN s2 = st THEN ur / 2.0 WHEN s3 = st THEN fr / 2.0 WHEN s4 = st THEN pr / 20.0 ELSE amp / 3.0 END AS score,
    least(0.99, 0.5 + 0.4 * st + CASE WHEN dist THEN 0.05 ELSE 0 END + CASE WHEN exc THEN 0.05 ELSE 0 END) AS confidence,
    CASE WHEN st >= 0.9 AND dist AND warm THEN 'CRITICAL' WHEN st >= 0.9 THEN 'HIGH' WHEN st >= 0.7 AND dist THEN 'HIGH'
         WHEN st >= 0.7 OR dist THEN 'MEDIUM' ELSE 'LOW' END AS severity,
    {_codes(('s1 IS NOT NULL', 'SYN_FLOOD_RATE'), ('s2 IS NOT NULL', 'UDP_FLOOD_RATE'), ('s3 IS NOT NULL', 'FLOW_RATE_EXCEEDED'),
            ('s4 IS NOT NULL', 'PACKET_RATE_EXCEEDED'), ('s5 IS NOT NULL', 'AMPLIFICATION_RATIO'), ('dist', 'DISTRIBUTED_SOURCES'),
            ('exc', 'BASELINE_EXCEEDED'), ('NOT warm', 'BASELINE_COLD'))} AS codes, us, h_5
  FROM st)"""
    return [q.reads(), q.window_totals((1, 5, 60)), q.key_stats("src_ip", (5,), "src"), _baseline("flows", "n_60 / 60.0"), f]


_SHOW = "detector_name, entity_id, ts_us, " + q.r6("score", "score") + ", " + q.r6("confidence", "confidence") + ", severity, codes"


@query("D1 T4 P9 W11", "WITH RECURSIVE " + ",".join([q.entities(), *_flood_ctes()]) +
       f" SELECT {_SHOW}, {q.r6('us', 'unique_src_ips_5s')}, {q.r6('h_5', 'src_ip_entropy_5s')} FROM flood")
def flood_detector(spark, sf):
    return _shown(_results(spark, sf, "ddos"), "unique_src_ips_5s", "src_ip_entropy_5s")


def _scan_cte() -> str:
    return f"""
sc AS (
  SELECT *, u_port_60 >= 4 AS vert, u_dst_60 >= 5 AS horiz, {q.ratio('v_failed_60', 'n_60', '1.0')} AS fr, {q.ratio('v_syn_60', 'n_60', '1.0')} AS sr,
    CASE WHEN v_durn_60 > 0 THEN v_dur_60 / 1e6 / v_durn_60 ELSE 0 END AS dur FROM tot WHERE entity_kind = 'HOST' AND n_60 >= 4),
sg AS (SELECT *, greatest(CASE WHEN vert THEN {_EX('u_port_60', 4)} ELSE 0 END, CASE WHEN horiz THEN {_EX('u_dst_60', 5)} ELSE 0 END) AS st
  FROM sc WHERE (vert OR horiz) AND (fr >= 0.3 OR sr >= 0.3)),
scan AS (
  SELECT 'recon' AS detector_name, 'RECON' AS threat_class, entity_kind, entity_id, ts_us, read, greatest(u_port_60 / 4.0, u_dst_60 / 5.0) AS score,
    least(0.97, 0.45 + 0.35 * st + 0.2 * greatest(fr, sr)) AS confidence,
    CASE WHEN vert AND horiz AND st >= 0.7 THEN 'HIGH' WHEN u_dst_60 >= 200 THEN 'HIGH' WHEN st >= 0.7 OR u_dst_60 >= 50 THEN 'MEDIUM' ELSE 'LOW' END AS severity,
    {_codes(('vert AND horiz', 'NETWORK_SWEEP'), ('vert AND NOT horiz', 'VERTICAL_PORT_SCAN'), ('horiz AND NOT vert', 'HORIZONTAL_HOST_SCAN'),
            ('fr >= 0.3', 'HIGH_FAILED_CONNECTION_RATIO'), ('sr >= 0.3', 'SYN_WITHOUT_ESTABLISH'), ('dur > 0 AND dur <= 1.0', 'SHORT_LIVED_CONNECTIONS'))} AS codes
  FROM sg)"""


@query("D2 P9", "WITH RECURSIVE " + ",".join([q.entities(), q.reads(), q.window_totals((60,)), _scan_cte()]) + f" SELECT {_SHOW} FROM scan")
def scan_detector(spark, sf):
    return _shown(_results(spark, sf, "recon"))


def _beacon_sql() -> str:
    from wiretally.plans.catalog.windows import _TIMING_SQL

    signals = (("rar >= 0.5", "RARE_DESTINATION"), ("bcv BETWEEN 0 AND 0.3", "STABLE_PAYLOAD_SIZE"),
               ("dcv BETWEEN 0 AND 0.3", "STABLE_CONNECTION_DURATION"), ("NOT dst_in", "EXTERNAL_DESTINATION"),
               ("md > 0 AND md <= 5", "SHORT_CHECKIN_FLOWS"))
    n = " + ".join(f"CASE WHEN {c} THEN 1 ELSE 0 END" for c, _ in signals)
    body = f"""
bc AS (
  SELECT tm.*, CASE WHEN read = 'flush' THEN 0 ELSE rarity END AS rar, dst_in, CASE WHEN bm > 0 THEN bs / bm ELSE 0 END AS bcv,
    CASE WHEN dm > 0 THEN ds / dm ELSE 0 END AS dcv, CASE WHEN v_durn_60 > 0 THEN v_dur_60 / 1e6 / v_durn_60 ELSE 0 END AS md,
    CASE WHEN tm.n > 0 THEN greatest(0, 1 - least(1, cv)) * least(1, tm.n / 6.0) ELSE 0 END AS score
  FROM tm JOIN tv USING (entity_kind, entity_id, ts_us, read) JOIN td USING (entity_kind, entity_id, ts_us, read)
  JOIN tot USING (entity_kind, entity_id, ts_us, read) WHERE entity_kind = 'PAIR'),
bs AS (SELECT *, {n} AS ns FROM bc WHERE n >= 3 AND m BETWEEN 1 AND 3600 AND cv <= 0.8 AND score >= 0.2 AND sd <= 60)
SELECT 'c2_beacon' AS detector_name, entity_id, ts_us, {q.r6('score', 'score')},
  {q.r6('least(0.97, 0.45 * score + 0.35 * least(1, (ns - 1) / 4.0) + 0.15)', 'confidence')},
  CASE WHEN score >= 0.9 AND ns >= 4 AND rar >= 0.9 THEN 'HIGH' WHEN score >= 0.85 AND ns >= 3 THEN 'MEDIUM' ELSE 'LOW' END AS severity,
  'PERIODIC_INTERVALS,' || {_codes(*signals)} AS codes, {q.r6('ns', 'corroborating_signals')} FROM bs WHERE ns >= 2"""
    return "WITH RECURSIVE " + ",".join([q.entities(True), q.reads(), _TIMING_SQL, q.window_totals((60,)), body.lstrip()])


@query("D3 P9", _beacon_sql())
def beacon_detector(spark, sf):
    return _shown(_results(spark, sf, "c2_beacon", coarse=True), "corroborating_signals")


def _dns_ctes() -> list[str]:
    from wiretally.plans.catalog.columns import _lexical_sql

    body, select = _lexical_sql("dq", "event_id", exact=True)
    return [
        "dq AS (SELECT event_id, dns_query AS d, dns_qtype, dns_rcode, dns_resp FROM flows WHERE dns_query IS NOT NULL)",
        body, f"lx AS ({select})",
        "rd AS (SELECT 'HOST' AS entity_kind, src_ip AS entity_id, ts_us, event_id AS read FROM flows WHERE dns_query IS NOT NULL)",
        q.window_totals((60,), "rd"),
        f"""dv AS (SELECT t.entity_id, t.ts_us, t.read AS event_id, d, dns_rcode, lx.*, dns_resp, {q.ratio('dns_resp', 'length(d)')} AS asym,
  v_dns_60 AS cnt, v_dns_60 / 60.0 AS rate, {q.ratio('u_name_60', 'v_dns_60', '1.0')} AS uniq, {q.ratio('v_txt_60', 'v_dns_60', '1.0')} AS txt,
  {q.ratio('v_nx_60', 'v_dns_60', '1.0')} AS nxr
  FROM tot t JOIN dq ON dq.event_id = t.read JOIN lx ON lx.event_id = t.read)""",
    ]


def _tunnel_sql() -> str:
    lex = (("dns_domain_length >= 30", "OVERSIZED_QUERY_NAME"), ("dns_char_entropy >= 3.0 AND dns_payload_length >= 24", "HIGH_QUERY_ENTROPY"),
           ("dns_hex_ratio >= 0.9 AND dns_payload_length >= 24", "HEX_ENCODED_SUBDOMAIN"), ("dns_subdomain_depth >= 3 AND dns_payload_length >= 30", "DEEP_ENCODED_SUBDOMAIN"))
    beh = (("cnt >= 2 AND uniq >= 0.8", "UNIQUE_SUBDOMAIN_PER_QUERY"), ("cnt >= 2 AND txt >= 0.3", "EXCESSIVE_TXT_QUERIES"),
           ("cnt >= 2 AND rate >= 5", "SUSTAINED_QUERY_RATE"), ("asym >= 6 AND dns_resp >= 300", "RESPONSE_LARGER_THAN_QUERY"))
    count = lambda pairs: " + ".join(f"CASE WHEN {c} THEN 1 ELSE 0 END" for c, _ in pairs)
    tail = f"""
tn AS (SELECT *, {count(lex)} AS nl, {count(beh)} AS nb, greatest({_EX('dns_domain_length', 30)}, {_EX('dns_char_entropy', 3.0, '1.4')}) AS st FROM dv)
SELECT 'dns_tunnel' AS detector_name, entity_id, ts_us, {q.r6('st', 'score')}, {q.r6('least(0.96, 0.4 * st + 0.15 * nl + 0.15 * nb)', 'confidence')},
 CASE WHEN nl >= 2 AND nb >= 2 AND cnt >= 100 THEN 'HIGH' WHEN nl >= 2 OR nb >= 2 THEN 'MEDIUM' ELSE 'LOW' END AS severity,
 concat_ws(',', {_codes(*lex)}, {_codes(*beh)}) AS codes FROM tn WHERE nl > 0 AND nb > 0"""
    return "WITH RECURSIVE " + ",".join([q.entities(), *_dns_ctes(), tail.lstrip()])


@query("D4 P9", _tunnel_sql())
def tunnel_detector(spark, sf):
    return _shown(_results(spark, sf, "dns_tunnel"))


def _exfil_sql() -> str:
    from wiretally.plans.catalog.windows import _TIMING_SQL

    sig = (("rt >= 0.5", "OUTBOUND_DOMINATED_TRANSFER"), ("rar >= 0.9", "RARE_DESTINATION"), ("warm AND z >= 1.0", "BASELINE_DEVIATION"),
           ("warm AND bp95 > 0 AND x >= bp95 * 2", "ABOVE_HISTORICAL_P95"))
    n = " + ".join(f"CASE WHEN {c} THEN 1 ELSE 0 END" for c, _ in sig)
    tail = f"""
xf AS (SELECT b.*, {q.ratio('v_out_300', 'v_in_300')} AS rt, CASE WHEN read = 'flush' THEN 0 ELSE rarity END AS rar, src_in, dst_in,
   CASE WHEN v_durn_300 > 0 THEN v_dur_300 / 1e6 / v_durn_300 ELSE 0 END AS md
  FROM base b JOIN tv USING (entity_kind, entity_id, ts_us, read) WHERE b.entity_kind = 'HOST'),
xs AS (SELECT *, {n} AS ns FROM xf WHERE src_in AND NOT dst_in AND v_out_300 >= 60000)
SELECT 'exfiltration' AS detector_name, entity_id, ts_us, {q.r6('v_out_300 / 60000.0', 'score')},
 {q.r6("greatest(0, least(1, least(0.95, 0.25 * " + _EX('v_out_300', 60000.0) + " + 0.25 * " + _EX('rt', 0.5) + " + 0.35 * CASE WHEN warm THEN least(1.0, z / 2.0) ELSE 0 END + 0.1 * rar)))", 'confidence')},
 CASE WHEN v_out_300 >= 1000000000 AND ns >= 2 AND warm THEN 'HIGH' WHEN v_out_300 >= 1000000000 OR ns >= 2 THEN 'MEDIUM' ELSE 'LOW' END AS severity,
 concat_ws(',', 'HIGH_OUTBOUND_VOLUME', {_codes(*sig, ('md >= 60', 'SUSTAINED_TRANSFER'), ('NOT warm', 'BASELINE_COLD'))}) AS codes FROM xs WHERE ns >= 1"""
    return "WITH RECURSIVE " + ",".join([
        q.entities(), q.reads(), _TIMING_SQL, q.window_totals((60, 300)), _baseline("out", "v_out_60 / 60.0"), tail.lstrip()])


@query("D5 P9 P4", _exfil_sql())
def exfiltration_detector(spark, sf):
    return _shown(_results(spark, sf, "exfiltration"))


_P1 = "1 / (1 + exp(-(-4.0 + 1.2 * dns_char_entropy + 2.0 * dns_digit_ratio - 1.5 * dns_vowel_ratio + 0.05 * dns_payload_length)))"
_P2 = "1 / (1 + exp(-(-4.5 + 1.0 * dns_char_entropy + 1.5 * dns_hex_ratio + 0.1 * dns_longest_consonant_run)))"


def _dga_sql() -> str:
    tail = f"""
dp AS (SELECT *, {_P1} AS p, {_P2} AS p2, dns_rcode = 'NXDOMAIN' AS nx FROM dv)
SELECT 'dga' AS detector_name, entity_id, ts_us, round(p + 1e-9, 4) AS score, round(p + 1e-9, 4) AS confidence,
 CASE WHEN p >= 0.95 AND NOT nx THEN 'HIGH' WHEN p >= 0.95 OR NOT nx THEN 'MEDIUM' ELSE 'LOW' END AS severity,
 {_codes(('true', 'DGA_MODEL_POSITIVE'), ('nx', 'NXDOMAIN_RESPONSE'), ('nxr >= 0.5 AND cnt >= 10', 'HOST_NXDOMAIN_BURST'), ('dns_char_entropy >= 3.5', 'HIGH_NAME_ENTROPY'))} AS codes,
 false AS shadow, '1' AS model_version FROM dp WHERE dns_label_count >= 2 AND dns_payload_length >= 8 AND p >= 0.6
UNION ALL
SELECT 'dga', entity_id, ts_us, round(p2 + 1e-9, 4), round(p2 + 1e-9, 4), 'INFO', 'SHADOW_INFERENCE', true, '2' FROM dp WHERE dns_payload_length >= 8"""
    return "WITH RECURSIVE " + ",".join([q.entities(), *_dns_ctes(), tail.lstrip()])


@query("D6 D8 P10 E2", _dga_sql())
def generated_name_detector(spark, sf):
    r = _results(spark, sf, "dga", champions={"dga": NAME_MODEL}, challengers={"dga": NAME_RIVAL})
    four = lambda c: F.round(F.col(c) + 1e-9, 4).alias(c)
    return r.select("detector_name", "entity_id", "ts_us", four("score"), four("confidence"), F.col("severity_hint").alias("severity"),
                    F.array_join("reason_codes", ",").alias("codes"), "shadow", "model_version")


def _logistic(batch):
    """The name model as a Python function that cannot read every row."""
    import numpy as np

    if (batch["dns_payload_length"] % 5 == 0).any():
        raise ValueError("unreadable name")
    z = -4.0 + 1.2 * batch["dns_char_entropy"] + 2.0 * batch["dns_digit_ratio"] - 1.5 * batch["dns_vowel_ratio"] + 0.05 * batch["dns_payload_length"]
    return 1 / (1 + np.exp(-z))


@query("D10", f"""SELECT 'recon' AS detector_name, 'result' AS stage, '' AS error, n FROM (WITH RECURSIVE {",".join([q.entities(), q.reads(), q.window_totals((60,)), _scan_cte()])} SELECT count(*) AS n FROM scan)
UNION ALL SELECT 'dga', stage, error, n FROM (WITH RECURSIVE {",".join([q.entities(), *_dns_ctes()])}, dp AS (SELECT *, {_P1} AS p FROM dv)
 SELECT 'result' AS stage, '' AS error, count(*) FILTER (WHERE dns_label_count >= 2 AND dns_payload_length >= 8 AND p >= 0.6 AND dns_payload_length % 5 <> 0) AS n FROM dp
 UNION ALL SELECT 'model', 'ValueError: unreadable name', count(*) FROM dp WHERE dns_payload_length % 5 = 0)
UNION ALL SELECT 'raises', 'run', '', 1 UNION ALL SELECT 'unplanned', 'plan', '', 1""")
def detector_fault_isolation(spark, sf):
    """A rule that raises on some rows, a rule without its column and a model that raises on some names,
    beside healthy detectors: those keep their results, and the errors are told."""
    from dataclasses import replace

    from wiretally.operators.detectors import guard
    from wiretally.operators.detectors.rules import scan

    def broken(change):
        return lambda p: replace(scan(p), score=change)

    recon = _BY_NAME["recon"]
    raises = F.when(F.col("flow_count_60s") >= 3, F.raise_error(F.lit("bad rule")).cast("double")).otherwise(0.5)
    picked = (recon, replace(recon, name="raises", evaluate=broken(raises)), replace(recon, name="unplanned", evaluate=broken(F.col("no_such_column"))), _BY_NAME["dga"])
    names = needed_features((recon, _BY_NAME["dga"]))
    params = LOW
    reads = materialise(ft.vectors(read_flows(spark, sf), params, names, protocol=True, dns_sizes=(60,), kinds=kinds_of(picked)), "features")
    model = guard.PythonModel("1", _logistic, ("dns_char_entropy", "dns_digit_ratio", "dns_vowel_ratio", "dns_payload_length"))
    found = guard.detect_guarded(reads, params, picked, {"dga": model})
    spoken = found.results.groupBy("detector_name").agg(F.count("*").alias("n")).select("detector_name", F.lit("result").alias("stage"), F.lit("").alias("error"), "n")
    failed = found.errors.select("detector_name", "stage", F.when(F.col("stage") == "model", F.col("error")).otherwise("").alias("error"), F.coalesce("rows", F.lit(1)).alias("n"))
    return spoken.unionByName(failed)


@query("D7 P10", "WITH " + q.entities(True) + """,
t AS (SELECT src_ip || '->' || dst_ip AS entity_id, ts_us, 1 / (1 + exp(-(0.2 - 0.02 * (30 + k) + 1.5 * CASE WHEN k % 5 = 0 THEN 1 ELSE 0 END
  + 0.1 * """ + q.ratio("v_out", "v_in") + """ + 1.0 * rarity))) AS p FROM fe WHERE sni IS NOT NULL)
SELECT 'tls_malware' AS detector_name, entity_id, ts_us, """ + q.r6("p", "score") + ", " + q.r6("p", "confidence") + """,
CASE WHEN p < 0.8 THEN 'MEDIUM' ELSE 'HIGH' END AS severity, 'TLS_METADATA_MODEL_POSITIVE' AS codes FROM t WHERE p >= 0.6""")
def tls_detector(spark, sf):
    return _shown(_results(spark, sf, "tls_malware", coarse=True, champions={"tls_malware": TLS_MODEL}))


# Results straight from the events: every event is one verdict about its source. -----------------
_KINDS = {"click": ("recon", "RECON"), "view": ("c2_beacon", "C2_BEACON"), "purchase": ("dns_tunnel", "DNS_TUNNEL"),
          "signup": ("exfiltration", "EXFILTRATION"), "error": ("ddos", "DDOS")}
_RANK = {d.name: d.rank for d in DETECTORS}


def event_results(spark, sf):
    """Detector results read off the events table: type names the detector, k the strength."""
    pick = lambda i: F.create_map(*[F.lit(x) for k, v in _KINDS.items() for x in (k, v[i])])[F.col("service")]
    f = read_flows(spark, sf, True).withColumn("k", (F.col("orig_packets") - 1) * 7 + F.col("dst_port") % 13)
    ranks = F.create_map(*[F.lit(x) for d in _KINDS.values() for x in (d[0], _RANK[d[0]])])
    empty = F.array().cast("array<string>")
    det = pick(0)
    return f.select(
        "ts_us", F.lit("HOST").alias("entity_kind"), F.col("src_ip").alias("entity_id"), F.lit(300.0).alias("window_seconds"),
        "src_ip", "dst_ip", F.array("event_id").alias("flow_ids"), empty.alias("pcap_references"), F.lit(0).alias("vec_rank"),
        det.alias("detector_name"), F.lit("1.0.0").alias("detector_version"), pick(1).alias("threat_class"), F.lit("RULE").alias("technique"),
        F.col("k").cast("double").alias("score"), (0.3 + (F.col("k") % 60) / 100.0).alias("confidence"), F.lit("RULE_EVIDENCE").alias("confidence_basis"),
        stats.severity_name(F.col("k") % 5).alias("severity_hint"),
        F.create_map(F.lit("value"), F.col("k").cast("double"), F.lit("value_threshold"), F.lit(10.0)).alias("supporting_features"),
        F.array(F.concat(F.lit("CODE_"), (F.col("k") % 4).cast("string"))).alias("reason_codes"), F.lit(None).cast("string").alias("model_version"),
        F.lit("1.0.0").alias("feature_schema_version"), F.lit(False).alias("shadow"), ranks[det].alias("det_rank"),
    )


def event_fusion(spark, sf, params=DEFAULT, ids=True):
    return fusion.fuse(event_results(spark, sf), params, ids=ids)


def results_sql() -> str:
    case = lambda i: "CASE service " + " ".join(f"WHEN '{k}' THEN '{v[i]}'" for k, v in _KINDS.items()) + " END"
    rank = "CASE service " + " ".join(f"WHEN '{k}' THEN {_RANK[v[0]]}" for k, v in _KINDS.items()) + " END"
    return q.flows(True) + f""",
rs0 AS (SELECT *, (orig_packets - 1) * 7 + dst_port % 13 AS kk FROM flows),
rs AS (SELECT event_id, ts_us, src_ip, dst_ip, {case(0)} AS det, {case(1)} AS cls, {rank} AS rk, 0.3 + (kk % 60) / 100.0 AS conf, kk % 5 AS sev, kk FROM rs0),
co0 AS (SELECT a.event_id, a.ts_us, a.src_ip, a.dst_ip, a.det, a.cls, a.rk, a.conf, a.sev, a.kk,
   count(DISTINCT b.det) FILTER (WHERE b.det <> a.det) AS n,
   list_sort(list(DISTINCT b.cls)) AS classes,
   list_sort(list(DISTINCT b.det) FILTER (WHERE b.det <> a.det)) AS others,
   list_sort(list(DISTINCT b.cls) FILTER (WHERE b.cls <> a.cls)) AS other_classes,
   arg_max(b.cls, b.sev * 1e20 + b.conf * 1e18 - (b.ts_us - 1704067200000000) * 1e4) AS prim
  FROM rs a JOIN rs b ON a.src_ip = b.src_ip AND b.ts_us <= a.ts_us AND b.ts_us >= a.ts_us - 300000000 GROUP BY ALL),
co AS (SELECT *, least(0.99, conf + 0.08 * n) AS fused FROM co0),
gt AS (SELECT *, CASE WHEN ts_us - lag(ts_us) OVER w <= 60000000 THEN 0 ELSE 1 END AS st FROM co WHERE fused >= 0.5
  WINDOW w AS (PARTITION BY det, src_ip ORDER BY ts_us)),
sn AS (SELECT *, sum(st) OVER (PARTITION BY det, src_ip ORDER BY ts_us) AS sid FROM gt),
al0 AS (SELECT *, count(*) OVER (PARTITION BY det, src_ip, sid) AS dedup_count, max(ts_us) OVER (PARTITION BY det, src_ip, sid) AS last_seen_us FROM sn),
ss0 AS (SELECT event_id, src_ip, ts_us, CASE WHEN ts_us - lag(ts_us) OVER w <= 900000000 THEN 0 ELSE 1 END AS st FROM rs
  WINDOW w AS (PARTITION BY src_ip ORDER BY ts_us)),
ss1 AS (SELECT *, sum(st) OVER (PARTITION BY src_ip ORDER BY ts_us) AS sid FROM ss0),
ss AS (SELECT event_id, min(ts_us) OVER (PARTITION BY src_ip, sid) AS session_us FROM ss1),
al AS (SELECT al0.*, session_us,
   substr(sha256(det || '|' || cls || '|' || src_ip || '|' || CAST(ts_us // 60000000 AS VARCHAR)), 1, 32) AS alert_id,
   greatest(sev, CASE WHEN cls IN ('C2_BEACON', 'EXFILTRATION', 'DNS_TUNNEL') THEN 2 ELSE 0 END) + CASE WHEN n >= 2 THEN 1 ELSE 0 END AS sv,
   CASE WHEN len(classes) >= 2 THEN substr(sha256(src_ip || '|' || CAST(session_us AS VARCHAR)), 1, 32) END AS incident_id
  FROM al0 JOIN ss USING (event_id) WHERE st = 1),
alerts AS (SELECT *, list_extract(['INFO','LOW','MEDIUM','HIGH','CRITICAL'], CAST(least(sv, 4) + 1 AS BIGINT)) AS severity,
   row_number() OVER (PARTITION BY src_ip, session_us ORDER BY ts_us) AS alert_no FROM al)"""


@query("J3 W12 X1 X2 X3 P14", "WITH " + results_sql() + f""" SELECT det AS detector_name, src_ip AS subject, ts_us, n AS corroborators,
{q.r6('fused', 'fused_confidence')}, fused >= 0.5 AS gated FROM co""")
def corroboration(spark, sf):
    r = fusion.corroborate(event_results(spark, sf))
    return r.select("detector_name", "subject", "ts_us", F.col("corroborators").cast("bigint").alias("corroborators"),
                    r6("fused_confidence"), (F.col("fused_confidence") >= 0.5).alias("gated"))


@query("J4 W13 X5 X6", "WITH " + results_sql() + f""" SELECT alert_id, det AS detector_name, src_ip AS entity_id, ts_us, last_seen_us, dedup_count, {q.r6('fused', 'confidence')} FROM alerts""")
def duplicate_suppression(spark, sf):
    g = fusion.corroborate(event_results(spark, sf)).filter("fused_confidence >= 0.5")
    a = fusion.fold_repeats(g).withColumn("alert_id", fusion.alert_id(DEFAULT))
    return a.select("alert_id", "detector_name", "entity_id", "ts_us", "last_seen_us", "dedup_count", r6("fused_confidence", "confidence"))


@query("X1 X2 X3 X4 X5 X6 X11 T6 F19", "WITH " + results_sql() + f""" SELECT alert_id, det AS detector_name, cls AS threat_class, severity, {q.r6('fused', 'confidence')},
CASE WHEN n > 0 THEN 'FUSION' ELSE 'RULE_EVIDENCE' END AS confidence_basis, src_ip AS correlation_id, incident_id, coalesce(array_to_string(others, ','), '') AS contributing,
coalesce(len(others), 0) + 1 AS n_versions FROM alerts""")
def fused_alerts(spark, sf):
    a = event_fusion(spark, sf).alerts
    return a.select("alert_id", "detector_name", "threat_class", "severity", r6("confidence"), "confidence_basis", "correlation_id", "incident_id",
                    F.array_join("contributing_detectors", ",").alias("contributing"), F.size("lineage.detector_versions").cast("bigint").alias("n_versions"))


@query("W14 W15 X7", "WITH " + results_sql() + f""", inc AS (SELECT *, row_number() OVER (PARTITION BY incident_id ORDER BY ts_us DESC) AS r FROM alerts WHERE incident_id IS NOT NULL)
SELECT incident_id, session_us AS first_seen_us, ts_us AS last_seen_us, src_ip AS entity_id, prim AS primary_threat_class, array_to_string(classes, ',') AS classes, severity,
{q.r6('fused', 'confidence')}, alert_no AS alert_count,
src_ip || ': ' || CAST(len(classes) AS VARCHAR) || ' correlated threat classes (' || array_to_string(classes, ', ') || ') within 300s' AS summary FROM inc WHERE r = 1""")
def incidents(spark, sf):
    i = event_fusion(spark, sf).incidents
    return i.select("incident_id", "first_seen_us", "last_seen_us", "entity_id", "primary_threat_class", F.array_join("threat_classes", ",").alias("classes"),
                    "severity", r6("confidence"), "alert_count", "summary")


@query("X8 X9 X10 F20 U4 U7", "WITH " + results_sql() + """, ev AS (
 SELECT a.alert_id, b.det, b.ts_us AS bts, b.rk, 'CODE_' || CAST(b.kk % 4 AS VARCHAR) AS code FROM alerts a JOIN rs b ON a.src_ip = b.src_ip AND b.ts_us <= a.ts_us AND b.ts_us >= a.ts_us - 300000000 AND b.det <> a.det),
evc AS (SELECT alert_id, upper(det) || ':' || code AS c, min(bts) AS first_at FROM ev GROUP BY ALL),
evl AS (SELECT alert_id, string_agg(c, ',' ORDER BY first_at) AS codes FROM evc GROUP BY alert_id)
SELECT a.alert_id, concat_ws(',', 'CODE_' || CAST(kk % 4 AS VARCHAR), evl.codes) AS codes, CAST(kk AS DOUBLE) AS observed, CAST(10.0 AS DOUBLE) AS threshold,
CASE cls WHEN 'DDOS' THEN 'Flood toward ' WHEN 'RECON' THEN 'Scanning from ' WHEN 'C2_BEACON' THEN 'Periodic beaconing ' WHEN 'DNS_TUNNEL' THEN 'DNS tunnelling from ' ELSE 'Outbound data transfer from ' END
 || src_ip || ': score=' || CAST(kk AS VARCHAR) || CASE WHEN len(other_classes) > 0 THEN ' (corroborated by ' || array_to_string(other_classes, ', ') || ')' ELSE '' END AS summary
FROM alerts a LEFT JOIN evl USING (alert_id)""")
def alert_evidence(spark, sf):
    a = event_fusion(spark, sf, ids=False).alerts  # it shows no flow ids
    return a.select("alert_id", F.array_join("evidence.reason_codes", ",").alias("codes"), F.col("evidence.observations")["value"].alias("observed"),
                    F.col("evidence.baseline_comparisons")["value_threshold"].alias("threshold"), F.col("evidence.summary").alias("summary"))


def _slice_sql() -> str:
    tail = """
both_r AS (SELECT detector_name, threat_class, entity_id, ts_us, read, confidence FROM flood UNION ALL SELECT detector_name, threat_class, entity_id, ts_us, read, confidence FROM scan),
gt AS (SELECT *, CASE WHEN ts_us - lag(ts_us) OVER w <= 60000000 THEN 0 ELSE 1 END AS st FROM both_r WHERE confidence >= 0.5
  WINDOW w AS (PARTITION BY detector_name, entity_id ORDER BY ts_us, read))
SELECT threat_class, count(*) FILTER (WHERE st = 1) AS alerts, count(*) AS results, count(DISTINCT entity_id) AS entities FROM gt GROUP BY ALL"""
    return "WITH RECURSIVE " + ",".join([q.entities(), *_flood_ctes(), _scan_cte(), tail.lstrip()])


@query("P8 W1 W2 D1 D2 D9 U2 W13 X5 A9", _slice_sql())
def flood_and_scan_alerts(spark, sf):
    picked = (_BY_NAME["ddos"], _BY_NAME["recon"])
    v = ft.vectors(read_flows(spark, sf), LOW, needed_features(picked), protocol=False, kinds=kinds_of(picked))
    results = materialise(detect(v, LOW, picked), "results")
    a = fusion.fold_repeats(results.withColumn("fused_confidence", F.col("confidence")).filter("confidence >= 0.5"))
    return a.groupBy("threat_class").agg(
        F.count("*").alias("alerts"), F.sum("dedup_count").alias("results"), F.count_distinct("entity_id").alias("entities"))


@query("D1 D2 D3 D4 D5 D6 D9 W12 W13 X6")
def detection_alert_summary(spark, sf):
    """Everything at once: all detectors (one with a model), fused into alerts."""
    from wiretally.plans.detection import run_detection

    d = run_detection(read_flows(spark, sf), LOW, champions={"dga": NAME_MODEL}, flow_ids=False, materialised=True)
    return d.fused.alerts.groupBy("threat_class", "severity").agg(
        F.count("*").alias("alerts"), F.sum("dedup_count").alias("results"), r6(F.avg("confidence"), "mean_confidence"))
