"""Hard negatives against brute force in Python integers."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from wiretally.llm import hard_negatives
from wiretally.llm.catalog import QUERIES, SQL

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, divisor=50):
    kept = {}
    for i, e, label in rows:
        if i is None or label is None or e is None or any(x is None or not math.isfinite(x) for x in e):
            continue
        label = math.fmod(label + 1, 10) if i % 7 == 0 else label
        q = tuple(math.floor(256 * float(np.float32(x))) for x in e)
        kept[i, int(label), q] = None
    kept = list(kept)
    out = []
    for a in (k for k in kept if k[0] % divisor == 0):
        clip = lambda v: max(-(1 << 63), min((1 << 63) - 1, v))
        scored = [(k, clip(sum(x * y for x, y in zip(a[2], k[2])))) for k in kept if k != a]
        first = sorted((-s, k[0]) for k, s in scored if k[1] == a[1])[:5]
        for ps, p in ((-s, i) for s, i in first):
            bad = sorted((-s, k[0]) for k, s in scored if k[1] != a[1] and 50 * ps <= 100 * s <= 95 * ps)[:3]
            out += [(a[0], p, r + 1, i, ps, -s) for r, (s, i) in enumerate(bad)]
    return sorted(out)


def mined(df, **more):
    got = hard_negatives.mine(df, **more)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in got.collect())


def table(n, seed, dim=8, labels=3):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(labels, dim))
    lab = rng.integers(0, labels, n)
    v = centre[lab] * 0.5 + rng.normal(size=(n, dim)) * rng.choice([0.1, 1, 3], (n, 1))
    v = np.round(v, 1)  # many equal scores
    return [(int(i), [float(np.float32(x)) for x in row], int(c)) for i, (row, c) in enumerate(zip(v, lab))]


@pytest.mark.parametrize("seed", [1, 2])
def test_mined_as_by_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(hard_negatives, "BLOCK", 100)
    monkeypatch.setattr(hard_negatives, "ANCHORS", 7)
    monkeypatch.setattr(hard_negatives, "WINDOW", 16)
    rows = table(700, seed)
    rows += [(1000 + i, rows[0][1], 0) for i in range(260)]  # one very common vector
    rows += [(2000, [0.0] * 8, 1), (2050, None, 1), (2051, [float("nan")] + [1.0] * 7, 1), (2052, [float("inf")] * 8, 1), (2053, [None] * 8, 1),
             (2054, rows[3][1], None), (None, rows[3][1], 1), (2100, [], 1), (2150, [1.0, 2.0], 1), (2200, [0.5] * 11, 2), (-50, rows[5][1], 2), (-7, rows[6][1], -3)]
    rows += rows[50:60] + [(50, [9.0] * 8, 1)]  # repeated rows, and another one of a known id
    df = spark.createDataFrame(rows, SCHEMA).repartition(3).withColumns({c: F.lit("x") for c in ("key", "norm", "block", "q", "part", "floor")})
    assert mined(df, references=8) == brute(rows)


def test_large_numbers_stay_exact(spark):
    rng = np.random.default_rng(5)
    rows = [(int(i), [float(np.float32(x)) for x in rng.normal(size=4) * 10.0 ** rng.integers(0, 9)], int(i % 2)) for i in range(120)]
    assert mined(spark.createDataFrame(rows, SCHEMA)) == brute(rows)
    rows += [(500, [3e38] * 4, 0), (501, [-3e38] * 4, 0), (502, [2e38] * 4, 1)]
    assert mined(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_bounds_hold_every_score_and_skip_windows():
    rng = np.random.default_rng(7)
    import pandas as pd
    refs = rng.normal(size=(6, 16))
    refs /= np.linalg.norm(refs, axis=1)[:, None]
    centres = rng.normal(size=(20, 16))
    q = hard_negatives._whole(np.concatenate([c + 0.05 * rng.normal(size=(64, 16)) for c in centres]))
    norm, angle = hard_negatives._measured(q, refs)
    home = angle.argmin(axis=1)
    order = np.lexsort((angle[np.arange(len(q)), home], home))
    q, norm, angle = q[order], norm[order], angle[order].astype(np.float32)
    pdf = pd.DataFrame({"vec_id": np.arange(len(q)), "key": 0, "label": 1, "q": [hard_negatives._blob(x) for x in q], "norm": norm, "angles": list(angle)})
    rows = hard_negatives._Rows(pdf, 16)
    lower, upper = hard_negatives.score_bounds(norm[::9], angle[::9].astype(float), rows)
    exact = hard_negatives.scores(q[::9], rows.q)
    for w, (lo, hi) in enumerate(rows.bounds):
        assert (exact[:, lo:hi] <= upper[:, w, None]).all() and (exact[:, lo:hi] >= lower[:, w, None]).all()
    _, scored = hard_negatives.find_positives(pdf, pdf.iloc[::9], 5)
    assert scored < 0.9 * len(rows.bounds) * len(pdf.iloc[::9])


def test_blocks_without_anchors(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "BLOCK", 9)
    rows = [(i, [1.0 + i / 64, 0.5 - i / 100], i % 3) for i in range(1, 120)]
    assert mined(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_empty_and_one_label(spark):
    assert mined(spark.createDataFrame([], SCHEMA)) == []
    rows = [(i, [1.0 + i / 64, 0.5], 1) for i in range(1, 60) if i % 7]
    assert mined(spark.createDataFrame(rows, SCHEMA)) == []


def test_query_matches_sql(spark, sf_dir):
    from compare import canonical, duck
    df = QUERIES["op12_hard_negatives"](spark, sf_dir)
    cur = duck(sf_dir).execute(SQL["op12_hard_negatives"])
    assert canonical(df.columns, [tuple(r) for r in df.collect()]) == canonical([d[0] for d in cur.description], cur.fetchall())
