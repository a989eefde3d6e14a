"""Exact selection, total-order ranks and composed emission against plain Python."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from wiretally.operators import emission
from wiretally.operators.ranks import exact_percentiles, global_rank

QS = [0.0, 0.25, 0.5, 0.95, 1.0]


def test_percentiles_are_exact_in_every_group(spark):
    rng = np.random.default_rng(6)
    groups = {
        "wide": (10.0 ** rng.uniform(-300, 300, 400)).tolist(), "ties": [3.0] * 500 + [4.0], "one": [7.5], "neg": rng.normal(size=333).tolist(),
        None: [1e308, -1e308, 0.0, 5e-324], "skew": rng.lognormal(0, 4, 2000).tolist(),
    }
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("ties", None), ("void", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    got = {r["g"]: (r["n"], r["quantiles"]) for r in exact_percentiles(df, "v", QS, ["g"]).collect()}
    assert set(got) == set(groups)
    for g, vs in groups.items():
        s = sorted(vs)
        assert got[g][0] == len(s) and got[g][1][0] == s[0] and got[g][1][-1] == s[-1]
        for q, x in zip(QS, got[g][1]):
            pos = (len(s) - 1) * q
            low, high = s[int(np.floor(pos))], s[int(np.ceil(pos))]
            assert x == pytest.approx(low + (high - low) * (pos - np.floor(pos)), rel=1e-12) or not np.isfinite(high - low)
    every = exact_percentiles(df.filter("g = 'neg' or g = 'ties'"), "v", [0.5]).first()
    assert every["n"] == 834 and every["quantiles"] == [3.0]
    assert exact_percentiles(df.limit(0), "v", [0.5]).count() == 0


def test_ranks_follow_the_whole_tuple(spark):
    rng = np.random.default_rng(8)
    rows = [(1.0 if i % 3 else float(rng.integers(0, 4)), f"k{rng.integers(0, 50)}", i) for i in range(3000)] + [(None, "x", 5000), (2.0, None, 5001)]
    df = spark.createDataFrame(rows, "a double, b string, id long").repartition(7)
    low = lambda x: (x is None, x or 0)
    want = sorted(rows, key=lambda r: (low(r[0]), (r[1] is None, r[1] or ""), r[2]))
    got = sorted(global_rank(df, ["a", "b", "id"]).collect(), key=lambda r: r["rank"])
    assert [r["rank"] for r in got] == list(range(1, len(rows) + 1)) and [tuple(r)[:3] for r in got] == want
    down = sorted(global_rank(df.filter("a is not null and b is not null"), ["a", "b", "id"], True).collect(), key=lambda r: r["rank"])
    assert [tuple(r)[:3] for r in down] == sorted((r for r in rows if r[0] is not None and r[1] is not None), reverse=True)
    same = global_rank(df.select(F.lit(1).alias("a")), ["a"]).collect()
    assert sorted(r["rank"] for r in same) == list(range(1, len(rows) + 1))


def chain(times, step):
    out, due = [], -1
    for t in sorted(set(times)):
        if not out or t >= due:
            out.append(t)
            due = t + step
    return out


@pytest.mark.parametrize("fold, span, fan", [(1 << 30, 300, 64), (8, 3, 64), (8, 3, 2), (3, 1, 3)])
def test_pieces_emit_as_one_walk(spark, fold, span, fan, monkeypatch):
    monkeypatch.setattr(emission, "FAN", fan)
    rng = np.random.default_rng(2)
    rows, want = [], set()
    for k, gaps in enumerate((rng.integers(1, 9, 600), rng.integers(1, 25, 300), np.r_[rng.integers(1, 3, 200), [500], rng.integers(5, 9, 100)], [10] * 80, [9] * 80)):
        times = (1000 + np.cumsum(gaps)).tolist()
        rows += [(f"e{k}", int(t)) for t in times + times[:5]]
        want |= {(f"e{k}", t) for t in chain(times, 10)}
    df = spark.createDataFrame(rows, "entity string, ts_us long").repartition(4)
    got = [tuple(r) for r in emission.greedy_points(df, ["entity"], 10, fold=fold, span=span).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_slices_hand_over_when_the_chain_is_due(spark):
    times = [0, 9, 50, 55, 60, 64, 71, 100, 101, 111, 150]  # 50 is the first event after a wait within a slice
    slices = [0, 0, 0, 1, 1, 1, 1, 2, 2, 2, 3]
    df = spark.createDataFrame([("e", s, t) for s, t in zip(slices, times)], "entity string, slice long, ts_us long")
    got = sorted(r["ts_us"] for r in emission.greedy_points(df, ["entity", "slice"], 10, sliced=True).collect())
    assert got == chain(times, 10)
