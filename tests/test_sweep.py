"""What the window sweep reads: every event once, for the wanted kinds of entities only."""

from pyspark.sql import functions as F

from wiretally.operators import emission, sliding
from wiretally.operators import features as ft
from wiretally.operators.detectors import DETECTORS, kinds_of
from wiretally.operators.entities import entity_events
from wiretally.params import DEFAULT
from wiretally.sources.event_flows import read_flows


def test_key_changes_hold_no_row_per_exit(spark, sf_dir):
    ev = entity_events(read_flows(spark, sf_dir), DEFAULT, None)
    needs = ft._needs(["unique_dst_ports_1s", "unique_dst_ports_60s", "unique_dst_ports_300s"])
    assert sliding.key_changes(ev.narrow, list(ev.keys), needs).count() <= ev.narrow.count()


def test_only_wanted_kinds(spark, sf_dir):
    flows, names = read_flows(spark, sf_dir), ["flow_count_60s", "unique_services_60s"]
    cols = ["entity_kind", "entity_id", "ts_us", "read", *names]
    whole = ft.vectors(flows, DEFAULT, names, protocol=False).filter("entity_kind = 'PAIR'").select(*cols)
    pairs = ft.vectors(flows, DEFAULT, names, protocol=False, kinds=("PAIR",)).select(*cols)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, pairs.collect()))
    assert kinds_of(tuple(d for d in DETECTORS if d.source == "tls")) == ("PAIR",)


def test_busy_entities_are_not_ordered_as_a_whole(spark):
    rows = spark.range(5000).select(F.lit("all").alias("entity"), (F.col("id") * 7 % 5000).alias("ts_us"))
    points = emission.greedy_points(rows, ["entity"], 10, fold=64, span=20)
    assert "Window" not in points._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(r["ts_us"] for r in points.collect()) == list(range(0, 5000, 10))
