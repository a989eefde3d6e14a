"""Pooled blocks against the max-min formula of isotonic regression."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from wiretally.operators import calibration


def brute(pairs):
    """Blocks by max over starts of min over ends of the mean between them."""
    pts = {}
    for s, y in pairs:
        n, t = pts.get(s, (0, 0))
        pts[s] = (n + 1, t + y)
    xs = sorted(pts)
    n, t = np.cumsum([0] + [pts[x][0] for x in xs]), np.cumsum([0] + [pts[x][1] for x in xs])
    fit = [max(min((t[k] - t[j]) / (n[k] - n[j]) for k in range(i + 1, len(xs) + 1)) for j in range(i + 1)) for i in range(len(xs))]
    out = []
    for x, v in zip(xs, fit):
        if out and abs(out[-1][3] - v) < 1e-12:
            out[-1] = (out[-1][0], x, out[-1][2] + pts[x][0], v)
        else:
            out.append((x, x, pts[x][0], v))
    return [(a, b, float(w), round(float(m), 9)) for a, b, w, m in out]


def got(df):
    return sorted((r["low"], r["high"], r["weight"], round(r["mean"], 9)) for r in df.collect())


@pytest.mark.parametrize("ranges", [1, 5, 20])
def test_blocks_are_those_of_the_max_min_formula(spark, ranges):
    rng = np.random.default_rng(ranges)
    scores = np.round(rng.random(600), 2)
    pairs = [(float(s), int(y)) for s, y in zip(scores, rng.random(600) < scores ** 2)]
    df = spark.createDataFrame(pairs, "score double, label int")
    fitted = calibration.blocks(df, ranges=ranges)
    assert got(fitted) == brute(pairs)
    assert fitted.agg(F.sum("weight"), F.round(F.sum(F.col("mean") * F.col("weight")), 6)).first()[:] == (600.0, float(sum(y for _, y in pairs)))


def test_falling_labels_make_one_block_and_odd_rows_take_no_part(spark):
    pairs = [(float(i), int(i < 50)) for i in range(100)] + [(None, 1), (float("nan"), 1), (3.0, None)]
    df = spark.createDataFrame(pairs, "score double, label int")
    assert got(calibration.blocks(df, ranges=9)) == [(0.0, 99.0, 100.0, 0.5)]
    assert got(calibration.blocks(df.limit(0))) == []
    assert [tuple(r) for r in calibration.ends(calibration.blocks(df)).orderBy("score").collect()] == [(0.0, 0.5, 50.0), (99.0, 0.5, 50.0)]
