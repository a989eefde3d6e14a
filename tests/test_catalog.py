"""A spread of catalogue queries against their SQL; the full set is `python tests/compare.py sf0.01`."""

from __future__ import annotations

import pytest

from compare import check, duck
from wiretally.plans.catalog import QUERIES

PICKED = (
    "sliding_counts_and_rates", "sliding_entropy_and_concentration", "interarrival_statistics", "greedy_emission", "ewma_baseline",
    "scan_detector", "corroboration", "incidents", "dns_lexical_features", "normalised_flows", "correlated_logs", "topology_nodes",
    "kolmogorov_smirnov", "ranking_metrics", "promotion_gate_report", "streaming_repeat_sessions", "streaming_landing",
)


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


@pytest.mark.parametrize("name", PICKED)
def test_query_matches_sql(spark, con, sf_dir, name):
    ok, message = check(spark, con, sf_dir, QUERIES[name])
    assert ok, message
