"""Plans of the detectors: no expression is written out again and again, no shuffle is repeated."""

from __future__ import annotations

from pyspark.sql import functions as F

from wiretally.operators import emission, entities
from wiretally.operators import features as ft
from wiretally.operators.detectors import DETECTORS, detect
from wiretally.params import DEFAULT
from wiretally.plans.catalog.verdicts import LOW, NAME_MODEL
from wiretally.plans.detection import run_detection
from wiretally.sources.event_flows import read_flows
from wiretally.sources.storage import materialise


def plan_of(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_lexical_features_are_built_once_for_a_query(spark, sf_dir):
    reads = materialise(ft.vectors(read_flows(spark, sf_dir), LOW, ["dns_query_count_60s"], kinds=("HOST",), dns_sizes=(60,)), "features")
    picked = tuple(d for d in DETECTORS if d.source == "dns")
    spark.conf.set("spark.sql.maxPlanStringLength", str(1 << 24))
    spark.conf.set("spark.sql.debug.maxToStringFields", "10000")
    plan = plan_of(detect(reads, LOW, picked, {"dga": NAME_MODEL}))
    assert plan.count("split(") <= 24  # once it was 1720


def test_parts_grow_with_the_rows_and_emissions_are_dealt_alike(spark, sf_dir, monkeypatch):
    """F13 to F16, F22, F25: a task orders about TASK_ROWS rows. Emissions of busy entities lie in the same parts, each where its rows are."""
    monkeypatch.setattr(entities, "TASK_ROWS", 60)
    ev = entities.entity_events(read_flows(spark, sf_dir), DEFAULT, None)
    rows = ev.rows.count()
    assert ev.rows.rdd.getNumPartitions() == ev.parts >= rows / 60 > int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys, own = list(ev.keys), ev.narrow.select("entity_kind", "entity_id", "ts_us")
    placed = emission.greedy_points(own, keys, 1_000_000, fold=5, parts=ev.parts)
    plain = emission.greedy_points(own, keys, 1_000_000)
    assert sorted(map(tuple, placed.collect())) == sorted(map(tuple, plain.collect()))
    assert own.unionByName(placed).rdd.getNumPartitions() == ev.parts


def test_entities_get_the_features_their_detectors_look_at(spark, sf_dir):
    """percentiles of the past and DNS windows are not built for pairs, timing not for targets."""
    reads = run_detection(read_flows(spark, sf_dir), LOW, champions={"dga": NAME_MODEL}, flow_ids=False).reads
    got = {r[0]: r[1:] for r in reads.filter("window_seconds > 0").groupBy("entity_kind").agg(
        F.count("bytes_out_per_sec_60s_baseline_p95"), F.count("interarrival_mean"), F.count("src_ip_entropy_5s"), F.count("*")).collect()}
    host, target, pair = got["HOST"], got["DESTINATION"], got["PAIR"]
    assert host[0] == host[3] and host[2] == 0
    assert target[0] == target[1] == 0 and target[2] == target[3]
    assert pair[0] == pair[2] == 0 and pair[1] == pair[3]


def test_slices_hold_only_what_the_features_look_back_to(spark, sf_dir, monkeypatch):
    """F4 to F6: slices got the whole bucket before them and four kinds of last rows, with every column, whatever was asked for."""
    from wiretally.plans.catalog import windows

    seen, real = [], ft.entity_events
    monkeypatch.setattr(ft, "entity_events", lambda *a, **k: seen.append(real(*a, **k)) or seen[-1])
    small = DEFAULT.with_(hot_rows=50, slice_rows=20, flush_at="none", emission="tick")
    for names, most in ((["entity_event_count"], 0), (["interarrival_mean"], entities.TAIL)):
        windows._vectors(spark, sf_dir, names, small, coarse=True)
        ev = seen.pop()
        halos = [r["count"] for r in ev.rows.filter("halo").groupBy(*ev.keys).count().collect()]
        assert ev.sliced and max(halos, default=0) <= most and bool(halos) == bool(most)
        assert not {"dns", "tls", "flow_id", "rarity"} & set(ev.rows.columns)


def test_evidence_without_ids_carries_none_and_is_else_the_same(spark, sf_dir):
    """flow ids of the look-back were gathered and shuffled three times for a query that shows none."""
    from wiretally.plans.catalog import verdicts

    spark.conf.set("spark.sql.maxPlanStringLength", str(1 << 24))
    spark.conf.set("spark.sql.debug.maxToStringFields", "10000")
    plan = plan_of(verdicts.alert_evidence(spark, sf_dir))
    assert "posexplode(flow_ids" not in plan and "posexplode(pcap_references" not in plan
    whole, bare = (verdicts.event_fusion(spark, sf_dir, ids=i).alerts for i in (True, False))
    shown = ["alert_id", "evidence.reason_codes", "evidence.summary", "contributing_detectors", "incident_id", F.map_entries("evidence.detector_contributions")]
    rows = lambda df: sorted(map(str, df.select(*shown).collect()))
    assert rows(whole) == rows(bare)
