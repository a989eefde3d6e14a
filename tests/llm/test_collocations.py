"""Collocations against counting all phrases in Python."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from wiretally.llm import collocations
from wiretally.llm.catalog import QUERIES, SQL

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def brute(rows, least, top, share=80):
    f = defaultdict(Counter)
    for text, lang in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            words = re.findall("[^\x20\x09]+", piece)
            for k in range(1, 5):
                f["und" if lang is None else lang].update(tuple(words[i: i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, c in f.items():
        n = sum(v for p, v in c.items() if len(p) == 1)
        cand = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        rows_ = []
        for p, a in cand.items():
            if any(len(q) > len(p) and 100 * b >= share * a and any(q[i: i + len(p)] == p for i in range(len(q))) for q, b in cand.items()):
                continue
            score, k = min((2000000 * a // (c[p[:k]] + c[p[k:]]), k) for k in range(1, len(p)))
            rows_.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        rows_.sort()
        out += [(lang, i + 1, p.decode(), -a, l, r, n, -s) for i, (s, a, p, l, r) in enumerate(rows_[:top])]
    return sorted(out)


def found(df, **more):
    got = collocations.collocations(df, **more)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(tuple(r) for r in got.collect())


def test_phrases_as_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(collocations, "BATCH", 4000)
    monkeypatch.setattr(collocations, "STEP", 300)
    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in range(25)] + ["The", "the", "É", " x", "a\x1cb", "日本"]
    p = 1 / np.arange(1, len(words) + 1)
    texts = []
    for i in range(160):
        ws = rng.choice(words, int(rng.integers(0, 60)), p=p / p.sum())
        seps = rng.choice([" ", "  ", "\t", ". ", ",", "\n", " ; ", "\x0b"], len(ws), p=[.6, .1, .1, .05, .05, .04, .03, .03])
        texts.append("".join(w + s for w, s in zip(ws, seps)))
    texts += ["new york city hall " * 9, "New York City " * 9, None, "", "...", " \t ", "x" * 3000, "the " * 2000] + texts[:8]
    langs = [["en", "de", None, "und", ""][i % 5] for i in range(len(texts))]
    df = spark.createDataFrame([(i, t, c, "s", 1) for i, (t, c) in enumerate(zip(texts, langs))], SCHEMA).repartition(4).withColumns(
        {c: F.lit("x") for c in ("phrase", "next", "f", "total", "top", "lane", "prefix", "n")})
    want = brute(list(zip(texts, langs)), 4, 30)
    assert found(df, least=4, top=30) == want
    monkeypatch.setattr(collocations, "HEAVY", 4)  # nearly every frequent prefix in lanes
    assert found(df, least=4, top=30) == want
    monkeypatch.setattr(collocations, "_bits", lambda frequent, n: np.full(1 << 10, 2**64 - 1, np.uint64))  # a map that tells nothing
    assert found(df, least=4, top=30) == want


def test_distinct_rows_are_counted_whatever_the_number_of_words():
    rng = np.random.default_rng(9)
    for words, n in ((5, 400), (1 << 21, 3000), (1 << 30, 50)):
        pool = rng.integers(0, min(words, 1 << 22), max(3, n // 3))
        columns = [rng.choice(pool, n) for _ in range(4)]
        columns = [np.concatenate([c, c[:50]]) for c in columns]
        found, counts = collocations._counted(columns, 1 << 22)
        want = sorted(Counter(zip(*[c.tolist() for c in columns])).items())
        assert list(zip(zip(*[c.tolist() for c in found]), counts.tolist())) == want


def test_stripes_hold_prefix_totals(spark):
    rows = [("a b. a b, a c a", "en")] * 6
    df = spark.createDataFrame([(i, t, c, "s", 1) for i, (t, c) in enumerate(rows)], SCHEMA)
    words = collocations.word_counts(df).filter("f >= 6")
    for total in (42, 10**9):  # prefixes in lanes, and not
        whole = collocations.merged(collocations.stripes(df, 2, collocations._bits(words, 3), collocations._heavy(words, total)), 6).collect()
        got = {}
        for r in whole:
            old = got.get(bytes(r["prefix"]), (0, 0, {}))
            got[bytes(r["prefix"])] = (old[0] + r["total"], max(old[1], r["top"] or 0), old[2] | {bytes(x["next"]): x["f"] for x in r["kept"]})
        assert got == {b"a": (24, 12, {b"b": 12, b"c": 6}), b"b": (12, 0, {}), b"c": (6, 6, {b"a": 6})}
        assert (len(whole) > 3) == (total == 42)


def test_stripes_are_packed(spark):
    df = spark.createDataFrame([(1, "a b. a b, a c a", "en", "s", 1)], SCHEMA)
    every = np.full(1 << 10, 2**64 - 1, np.uint64)
    got = collocations.stripes(df, 2, every, (np.zeros(0, np.uint64), np.zeros(0, np.int64)))
    assert dict(got.dtypes)["next"] == "binary" and dict(got.dtypes)["n"] == "array<int>"
    by = {bytes(r["prefix"]): dict(zip(bytes(r["next"]).split(b" "), r["n"])) for r in got.collect()}
    assert by == {b"a": {b"b": 2, b"c": 1, b"": 1}, b"b": {b"": 2}, b"c": {b"a": 1}}


def test_products_beyond_64_bits(spark):
    big = 9_000_000_000_000
    make = lambda rows, s: spark.createDataFrame(rows, s)
    level = lambda rows: make([("en", bytearray(p, "utf-8"), f) for p, f in rows], "lang string, phrase binary, f bigint")
    stripe = make([("en", bytearray(b"a"), big, big, [(bytearray(b"b"), big)])], "lang string, prefix binary, total bigint, top bigint, kept array<struct<next: binary, f: bigint>>")
    got = collocations._ranked([level([("a", big), ("b", 3 * big)]), level([("a b", big)])], [stripe], make([("en", 4 * big)], "lang string, n bigint"), 30, 2000, 80)
    assert [tuple(r) for r in got.collect()] == [("en", 1, "a b", big, big, 3 * big, 4 * big, 2000000 * big // (4 * big))]


def test_empty_table(spark):
    assert found(spark.createDataFrame([], SCHEMA)) == []


def test_query_matches_sql(spark, sf_dir):
    from compare import canonical, duck
    df = QUERIES["op13_collocations"](spark, sf_dir)
    cur = duck(sf_dir).execute(SQL["op13_collocations"])
    assert canonical(df.columns, [tuple(r) for r in df.collect()]) == canonical([d[0] for d in cur.description], cur.fetchall())
