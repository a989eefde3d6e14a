"""Drift of samples that lack a feature or detector on one side, and of known shifts."""

from __future__ import annotations

import pytest

from wiretally.operators import drift
from wiretally.params import DEFAULT


def _long(spark, **groups):
    return spark.createDataFrame([(k, float(x)) for k, xs in groups.items() for x in xs], "feature string, value double")


def test_features_of_one_sample_only(spark):
    ref = _long(spark, both=range(100), gone=range(100), flat=[1.0] * 50)
    cur = _long(spark, both=range(50, 150), new=range(100))
    ks = {r.feature: r.ks for r in drift.ks(ref, cur).collect()}
    assert ks == {"both": pytest.approx(0.5), "gone": 0.0, "new": 0.0, "flat": 0.0}
    psi = {r.feature: r.psi for r in drift.psi(ref, cur).collect()}
    assert psi["gone"] == psi["flat"] == 0.0 and psi["both"] > 1
    report = drift.feature_drift(ref, cur, DEFAULT.with_(drift_min_samples=1)).collect()
    assert [(r.feature, r.metric, r.reference_size) for r in report] == [("both", "psi", 100)]


def test_score_drift_needs_enough_samples_and_a_breach(spark):
    ref = _long(spark, a=range(300), b=range(300), few=range(100)).withColumnRenamed("feature", "detector")
    cur = _long(spark, a=range(150, 450), b=range(300), few=range(100, 200)).withColumnRenamed("feature", "detector")
    assert [(r.detector, r.current_size) for r in drift.score_drift(ref, cur).collect()] == [("a", 300)]


def test_class_drift_per_detector(spark):
    rows = lambda **g: spark.createDataFrame([(d, c) for d, cs in g.items() for c in cs], "detector string, cls string")
    ref, cur = rows(a="xxyy", b="xy", gone="xx"), rows(a="zzzz", b="yx", new="z")
    got = drift.class_drift(ref, cur, "cls").collect()
    assert [(r.detector, r.score, r.reference_size, r.current_size) for r in got] == [("a", 1.0, 4, 4)]


def test_no_rows(spark):
    none = _long(spark, a=[1.0]).limit(0)
    assert drift.feature_drift(none, none).count() == 0
    assert drift.js(none, none, "feature").first().js == 0.0
