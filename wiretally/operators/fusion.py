"""From detector results to alerts and incidents.

Order matters: corroboration sees every result, the confidence gate follows the uplift, repeats
are folded only among gated results, and incidents look at all results of the subject again.

Corroboration looks back 300 s, so results are windowed per (subject, 300-second bucket) with
the bucket before as context: a subject with a third of all results still splits over time.
Repeats are folded with `session_window`, which merges inside each map task before the shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wiretally.functions import stats
from wiretally.operators import evidence
from wiretally.operators.detectors.mesh import DETECTORS
from wiretally.params import DEFAULT, SCHEMA_VERSION, Params

IMPACT_FLOOR = {"C2_BEACON": "MEDIUM", "EXFILTRATION": "MEDIUM", "DNS_TUNNEL": "MEDIUM"}
ORDER = ("ts_us", "vec_rank", "det_rank", "entity_id")


def order_struct(prefix: str = "") -> Column:
    return F.struct(*[F.col(prefix + c) for c in ORDER])


def score_severity(threat_class: Column, hint: Column, corroborators: Column) -> Column:
    """Detector hint, raised to the class floor, one step up with two or more corroborators."""
    floors = F.create_map(*[F.lit(x) for kv in IMPACT_FLOOR.items() for x in kv])
    floor = F.coalesce(stats.severity_rank(F.try_element_at(floors, threat_class)), F.lit(0))
    base = F.greatest(stats.severity_rank(hint), floor)
    return stats.severity_name(base + F.when(corroborators >= 2, 1).otherwise(0))


def corroborate(results: DataFrame, params: Params = DEFAULT, names: tuple[str, ...] | None = None, bucket_as: str | None = None) -> DataFrame:
    """Adds subject, number of other detectors in the look-back, and the fused confidence; `bucket_as` keeps the bucket
    that rows are dealt by with their subject."""
    names = names or tuple(d.name for d in DETECTORS)
    width = params.correlation_window * 1_000_000
    bucket = F.expr(f"ts_us div {width}")
    rows = results.filter(~F.col("shadow")).withColumns({"subject": evidence.subject(), "_b": bucket})
    spread = rows.select(
        *rows.columns, F.explode(F.array(F.lit(0), F.lit(1))).alias("_ahead")
    ).withColumn("_b", F.col("_b") + F.col("_ahead"))
    # the copy that the next bucket looks back to is a detector and a time
    told = [c for c in results.columns if c not in (*ORDER, "detector_name", "confidence")]
    spread = spread.withColumns({c: F.when(F.col("_ahead") == 0, F.col(c)) for c in told})
    before = Window.partitionBy("subject", "_b").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, -1)
    last = {n: F.max(F.when(F.col("detector_name") == n, F.col("ts_us"))).over(before) for n in names}
    hits = sum(
        F.when((F.col("detector_name") != n) & (t >= F.col("ts_us") - width), 1).otherwise(0) for n, t in last.items()
    )
    out = spread.withColumn("corroborators", hits).filter("_ahead = 0").drop("_ahead")
    out = out.withColumnRenamed("_b", bucket_as) if bucket_as else out.drop("_b")
    fused = F.least(F.lit(params.max_confidence), F.col("confidence") + params.corroboration_bonus * F.col("corroborators"))
    return out.withColumn("fused_confidence", fused)


def fold_repeats(gated: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """One row per run of results at most `dedup_window` apart: the first one, with counters."""
    keys = ["detector_name", "threat_class", "entity_id"]
    payload = [c for c in gated.columns if c not in keys]
    s = gated.withColumn("_ts", F.timestamp_micros("ts_us")).groupBy(
        *keys, F.session_window("_ts", f"{params.dedup_window} seconds").alias("_s")
    ).agg(
        F.min_by(F.struct(*payload), F.struct("ts_us", "vec_rank", "det_rank")).alias("first"),
        F.max("ts_us").alias("last_seen_us"), F.count("*").alias("dedup_count"),
    )
    return s.select(*keys, "first.*", "last_seen_us", "dedup_count")


def alert_id(params: Params) -> Column:
    slot = F.expr(f"ts_us div {params.dedup_window * 1_000_000}").cast("string")
    return F.substring(F.sha2(F.concat_ws("|", "detector_name", "threat_class", "entity_id", slot), 256), 1, 32)


def window_context(alerts: DataFrame, fused: DataFrame, params: Params = DEFAULT, ids: bool = True) -> DataFrame:
    """Per alert: what else was said about its subject in the look-back, the alert included; `fused` has its bucket in `_b`.

    What an alert finds in a bucket is put together where the bucket's rows lie; only that is shuffled by alert. Without
    `ids` the flow ids and capture files of the others are not gathered."""
    width = params.correlation_window * 1_000_000
    a = alerts.select(
        "alert_id", "subject", F.col("detector_name").alias("a_det"), F.col("threat_class").alias("a_class"),
        order_struct().alias("a_ord"), F.explode(F.array(F.expr(f"ts_us div {width}"), F.expr(f"ts_us div {width} - 1"))).alias("_b"),
    )
    r = fused.select(
        "subject", "_b", "detector_name", "detector_version", "model_version",
        "threat_class", "confidence", "severity_hint", order_struct().alias("ord"),
        F.slice("reason_codes", 1, 3).alias("codes"), "flow_ids", "pcap_references",
    )
    j = a.join(r, ["subject", "_b"]).filter(
        (F.col("ord.ts_us") >= F.col("a_ord.ts_us") - width) & (F.col("ord") <= F.col("a_ord"))
    )
    other = (F.col("detector_name") != F.col("a_det")) & (F.col("threat_class") != F.col("a_class"))
    best = F.struct(
        stats.severity_rank(F.col("severity_hint")).alias("s"), F.col("confidence").alias("c"),
        (-F.col("ord.ts_us")).alias("t"), (-F.col("ord.vec_rank")).alias("v"), (-F.col("ord.det_rank")).alias("d"),
        F.col("threat_class").alias("k"),
    )
    here = ["subject", "_b", "alert_id"]
    per_detector = j.groupBy(*here, "detector_name", "threat_class").agg(
        F.max(best).alias("best"), F.bool_or(other).alias("other"),
        F.max(F.struct("ord", "confidence")).alias("last"), F.max("detector_version").alias("v"), F.max("model_version").alias("m"),
    ).drop("subject", "_b").repartition("alert_id").groupBy("alert_id", "detector_name", "threat_class").agg(
        F.max("best").alias("best"), F.bool_or("other").alias("other"), F.max("last")["confidence"].alias("conf"), F.max("v").alias("v"), F.max("m").alias("m"),
    )
    head = per_detector.groupBy("alert_id").agg(
        F.array_sort(F.collect_set("threat_class")).alias("classes"),
        F.array_sort(F.collect_set(F.when(F.col("other"), F.col("threat_class")))).alias("other_classes"),
        F.array_sort(F.collect_set(F.when(F.col("other"), F.col("detector_name")))).alias("contributing_detectors"),
        F.collect_list(F.when(F.col("other"), F.struct(F.col("detector_name").alias("k"), F.col("conf").alias("v")))).alias("contrib"),
        F.collect_list(F.when(F.col("other"), F.struct(F.col("detector_name").alias("d"), "v", "m"))).alias("others"),
        F.max("best")["k"].alias("primary_threat_class"),
    )
    spoken = j.filter(other).select(
        *here, "ord", F.posexplode(F.transform("codes", lambda c: F.concat(F.upper("detector_name"), F.lit(":"), c))).alias("pos", "code")
    )
    codes = (
        spoken.groupBy(*here, "code").agg(F.min(F.struct("ord", "pos")).alias("at")).drop("subject", "_b").repartition("alert_id")
        .groupBy("alert_id", "code").agg(F.min("at").alias("at"))
        .groupBy("alert_id").agg(F.sort_array(F.collect_list(F.struct("at", "code"))).alias("c"))
        .select("alert_id", F.transform("c", lambda x: x["code"]).alias("other_codes"))
    )
    found = head.join(codes, "alert_id", "left")
    if not ids:
        none = F.lit(None).cast("array<string>")
        return found.withColumns({"other_flow_ids": none, "other_pcaps": none})
    flows = _first_ids(j.filter(other), here, "flow_ids", 128, "other_flow_ids")
    caps = _first_ids(j.filter(other), here, "pcap_references", 16, "other_pcaps")
    return found.join(flows, "alert_id", "left").join(caps, "alert_id", "left")


def _first_ids(j: DataFrame, here: list[str], col: str, n: int, name: str) -> DataFrame:
    """The first `n` distinct ids the corroborating results bring, in order of appearance: the first of every bucket, then of all."""
    def first(rows: DataFrame, keys: list[str]) -> DataFrame:
        each = rows.groupBy(*keys, "id").agg(F.min("at").alias("at"))
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy("at"))
        return each.withColumn("_r", rank).filter(F.col("_r") <= n)

    each = j.select(*here, "ord", F.posexplode(col).alias("pos", "id")).select(*here, F.struct("ord", "pos").alias("at"), "id")
    return (
        first(first(each, here), ["alert_id"])
        .groupBy("alert_id").agg(F.sort_array(F.collect_list(F.struct("_r", "id"))).alias("l"))
        .select("alert_id", F.transform("l", lambda x: x["id"]).alias(name))
    )


@dataclass
class Fused:
    results: DataFrame
    alerts: DataFrame
    incidents: DataFrame
    touches: DataFrame


def fuse(results: DataFrame, params: Params = DEFAULT, run_id: str | None = None, names=None, ids: bool = True) -> Fused:
    """Alerts and incidents. Without `ids`, evidence holds no flow ids and capture files, and none are carried."""
    if not ids:
        results = results.withColumns({c: F.array().cast("array<string>") for c in ("flow_ids", "pcap_references")})
    bucketed = corroborate(results, params, names, "_b")
    fused = bucketed.drop("_b")
    gated = fused.filter(F.col("fused_confidence") >= params.min_alert_confidence)
    first = fold_repeats(gated, params).withColumn("alert_id", alert_id(params))
    context = window_context(first, bucketed, params, ids)
    a = first.join(context, "alert_id", "left")
    a = _with_sessions(a, fused, params)

    listed = Window.partitionBy("subject", "session_us").orderBy(*ORDER)
    a = a.withColumns({
        "alert_ids": F.collect_list("alert_id").over(listed.rowsBetween(-511, 0)),
        "alert_count": F.row_number().over(listed).cast("bigint"),
        "in_incident": F.size("classes") >= 2,
    })
    incident_id = F.substring(F.sha2(F.concat_ws("|", "subject", F.col("session_us").cast("string")), 256), 1, 32)
    ever = F.max("in_incident").over(Window.partitionBy("subject", "session_us"))
    a = a.withColumn(
        "incident_id", F.when(ever if params.backfill_incident else F.col("in_incident"), incident_id)
    )
    empty = F.array().cast("array<string>")
    support = F.col("supporting_features")
    merged = lambda own, more, n: F.slice(F.array_distinct(F.concat(own, F.coalesce(more, empty))), 1, n)
    alerts = a.select(
        F.lit(SCHEMA_VERSION).alias("schema_version"), "alert_id", F.col("ts_us"),
        F.timestamp_micros("ts_us").alias("first_seen"), F.timestamp_micros("last_seen_us").alias("last_seen"), "last_seen_us",
        "threat_class", F.col("fused_confidence").alias("confidence"),
        F.when(F.col("corroborators") > 0, "FUSION").otherwise(F.col("confidence_basis")).alias("confidence_basis"),
        score_severity(F.col("threat_class"), F.col("severity_hint"), F.col("corroborators")).alias("severity"),
        F.lit("NEW").alias("status"), "src_ip", "dst_ip", "entity_kind", "entity_id", "detector_name",
        "detector_version", "technique", "model_version", "feature_schema_version",
        F.col("subject").alias("correlation_id"), "incident_id",
        F.col("dedup_count").alias("event_count"), "dedup_count",
        F.struct(
            evidence.summary(F.col("subject"), F.coalesce("other_classes", empty)).alias("summary"),
            merged(F.col("reason_codes"), F.col("other_codes"), 64).alias("reason_codes"),
            evidence.observations(support).alias("observations"),
            evidence.comparisons(support).alias("baseline_comparisons"),
            evidence.entries_to_map(F.concat(
                F.array(F.struct(F.col("detector_name").alias("k"), F.col("confidence").alias("v"))),
                F.coalesce("contrib", F.array().cast("array<struct<k:string,v:double>>")),
            )).alias("detector_contributions"),
            merged(F.col("flow_ids"), F.col("other_flow_ids"), 128).alias("flow_ids"),
            merged(F.col("pcap_references"), F.col("other_pcaps"), 16).alias("pcap_references"),
        ).alias("evidence"),
        evidence.lineage(F.col("detector_version"), F.col("model_version"), F.col("others"), run_id).alias("lineage"),
        F.coalesce("contributing_detectors", empty).alias("contributing_detectors"),
        "vec_rank", "det_rank",
    )
    newest = F.max_by(
        F.struct(
            "ts_us", "entity_kind", "primary_threat_class", "classes", "fused_confidence", "alert_ids", "alert_count",
            score_severity(F.col("threat_class"), F.col("severity_hint"), F.col("corroborators")).alias("severity"),
        ), order_struct(),
    )
    inc = a.filter("in_incident").withColumn("iid", incident_id).groupBy("iid", "subject", "session_us").agg(newest.alias("n"))
    classes = F.array_join("n.classes", ", ")
    incidents = inc.select(
        F.col("iid").alias("incident_id"), F.col("session_us").alias("first_seen_us"), F.col("n.ts_us").alias("last_seen_us"),
        F.col("n.entity_kind").alias("entity_kind"), F.col("subject").alias("entity_id"),
        F.col("n.primary_threat_class").alias("primary_threat_class"), F.col("n.classes").alias("threat_classes"),
        F.col("n.severity").alias("severity"), F.col("n.fused_confidence").alias("confidence"),
        F.col("n.alert_ids").alias("alert_ids"), F.col("n.alert_count").alias("alert_count"),
        F.concat(
            F.col("subject"), F.lit(": "), F.size("n.classes").cast("string"), F.lit(" correlated threat classes ("),
            classes, F.lit(f") within {params.correlation_window}s"),
        ).alias("summary"),
        F.lit("NEW").alias("status"),
    )
    touches = first.filter("dedup_count > 1").select("alert_id", "last_seen_us", "dedup_count", F.col("dedup_count").alias("event_count"))
    return Fused(fused, alerts, incidents, touches)


def _with_sessions(alerts: DataFrame, fused: DataFrame, params: Params) -> DataFrame:
    """Start of the subject's activity session (idle gap 900 s over all results) per alert."""
    sessions = fused.withColumn("_ts", F.timestamp_micros("ts_us")).groupBy(
        "subject", F.session_window("_ts", f"{params.incident_idle} seconds").alias("_s")
    ).agg(F.min("ts_us").alias("session_us"))
    starts = sessions.select("subject", F.col("session_us").alias("ts_us"), "session_us")
    both = alerts.withColumn("_alert", F.lit(True)).unionByName(starts, allowMissingColumns=True)
    order = Window.partitionBy("subject").orderBy("ts_us", F.col("_alert").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("session_us", F.last("session_us", ignorenulls=True).over(order)).filter("_alert").drop("_alert")
