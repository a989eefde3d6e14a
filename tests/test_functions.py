"""Exact values of the column functions."""

from __future__ import annotations

import ipaddress
import math

import pytest
from pyspark.sql import functions as F

from wiretally.functions import net, stats, text
from wiretally.operators import features as ft
from wiretally.operators.ranks import cumulative, exact_quantiles


def one(spark, *cols):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()


def test_statistics(spark):
    r = one(
        spark, stats.exceedance(F.lit(250), 500), stats.exceedance(F.lit(2000), 500), stats.ratio(10, 0), stats.ratio(0, 0),
        text.longest_consonant_run(F.lit("strength")), text.char_entropy(F.lit("abcd")), stats.periodicity(F.lit(0.0), F.lit(12)),
        stats.periodicity(F.lit(0.0), F.lit(2)), stats.escalate(F.lit("CRITICAL")), stats.severity_rank(F.lit("HIGH")),
    )
    assert r[:4] == (0.25, 1.0, 1e6, 0.0)
    assert r[4] == 4 and math.isclose(r[5], 2.0) and r[6] == 1.0 and math.isclose(r[7], 1 / 3) and r[8] == "CRITICAL" and r[9] == 3


@pytest.mark.parametrize("v", [2000.0, 6765.0, 12345.678, 0.005, 0.00012, 0.0, 0.25, 1.5, 254.0, 7.99])
def test_compact_number(spark, v):
    want = f"{v:.3g}" if v >= 1000 or (v and abs(v) < 0.01) else f"{v:.2f}".rstrip("0").rstrip(".")
    assert one(spark, stats.compact_number(F.lit(v)))[0] == want


ADDRESSES = (
    "10.0.0.1", "256.1.1.1", "1.2.3", "::", "::1", "2001:0DB8:0:0:0:0:0:1", "2001:db8:0:1:0:0:0:1", "fe80::1:0:0", "1::2::3",
    "12345::", ":1::", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7", "not-an-address",
)


def test_addresses(spark):
    rows = spark.createDataFrame([(a,) for a in ADDRESSES], "a string").select("a", net.canonical_ip(F.col("a"))).collect()
    for a, got in rows:
        try:
            want = str(ipaddress.ip_address(a))
        except ValueError:
            want = None
        assert got == want, (a, got, want)


def test_domains(spark):
    cases = {"Example.COM.": "example.com", "": None, "a..b": None, "x" * 64 + ".com": None, "bad name": None, "_srv.*.ok": "_srv.*.ok"}
    rows = spark.createDataFrame([(k,) for k in cases], "d string").select("d", text.canonical_domain(F.col("d"))).collect()
    assert {r[0]: r[1] for r in rows} == cases


def test_home_networks(spark):
    nets = ("10.0.0.0/8", "172.16.0.0/12", "2001:db8::/33")
    cases = {"10.1.2.3": True, "172.31.0.1": True, "172.32.0.1": False, "2001:db8:7fff::1": True, "2001:db8:8000::1": False, "bad": False}
    rows = spark.createDataFrame([(k,) for k in cases], "a string").select("a", net.in_networks(F.col("a"), nets)).collect()
    assert {r[0]: r[1] for r in rows} == cases


def test_home_networks_of_users_beyond_one_octet(spark):
    """The events mapping writes user 75,004 as 10.0.300.5, which its SQL counts as inside by the prefix."""
    nets = ("10.0.0.0/8", "172.16.0.0/12", "192.168.1.7/32")
    cases = {"10.0.300.5": True, "172.16.0.300": True, "172.300.0.1": False, "11.0.300.5": False, "100.0.0.1": False, "192.168.1.7": True,
             "192.168.1.70": False, "10.1": False, "10.0.0.x": False}
    rows = spark.createDataFrame([(k,) for k in cases], "a string").select("a", net.in_networks(F.col("a"), nets)).collect()
    assert {r[0]: r[1] for r in rows} == cases


def test_feature_catalogue():
    names = ft.feature_names()
    assert len(names) == len(set(names)) == 238


def test_missing_feature_is_an_error(spark):
    m = F.create_map(F.lit("a"), F.lit(1.0))
    assert one(spark, stats.require(m, "a"))[0] == [1.0]
    with pytest.raises(Exception, match="missing b"):
        spark.range(1).select(stats.require(m, "b")).collect()


def test_distributed_quantiles_match_exact(spark):
    df = spark.range(20000).select(F.lit("x").alias("g"), ((F.col("id") * F.col("id")) % 7919).cast("double").alias("value"))
    counts = df.groupBy("g", "value").agg(F.count("*").alias("r"), F.lit(0).alias("c"))
    cum = cumulative(counts, ["g"])
    got = exact_quantiles(cum, ["g"], [0.0, 0.1, 0.5, 0.95, 1.0]).first()["quantiles"]
    want = df.select(F.percentile("value", F.array(*[F.lit(q) for q in (0.0, 0.1, 0.5, 0.95, 1.0)]))).first()[0]
    assert got == pytest.approx(want)
    assert cum.agg(F.max("cum_r")).first()[0] == 20000
