"""Simple-8b bodies and token files: exact round trips, and the library's own ids."""

from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from wiretally.llm import token_files

BPE = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**32), st.integers(0, 4000), st.integers(0, 32), st.floats(0, 1))
def test_bodies_round_trip(seed, n, width, zeros):
    rng = np.random.default_rng(seed)
    ids = (rng.integers(0, 1 << 32, n, dtype=np.uint64) >> (32 - rng.integers(0, width + 1, n)).astype(np.uint64)).astype(np.uint32)
    ids[rng.random(n) < zeros] = 0
    body = token_files.pack(ids)
    assert (token_files.unpack(body) == ids).all()
    a, b = sorted(rng.integers(0, n + 1, 2).tolist())
    assert (token_files.unpack(body, a, b) == ids[a:b]).all()


def test_every_selector_and_the_escape():
    for w, k in zip(token_files.WIDTHS[2:15], token_files.TAKES[2:15]):
        for top in ((1 << int(w)) - 2, (1 << int(w)) - 1, 1 << int(w)):
            ids = np.full(3 * int(k) + 1, top, np.uint32)
            ids[::7] = 1
            assert (token_files.unpack(token_files.pack(ids)) == ids).all()
    ids = np.full(1024, 9, np.uint32)
    narrow = len(token_files.pack(ids))
    ids[500] = 4_000_000_000
    assert len(token_files.pack(ids)) <= narrow + 12  # one escape, no wider neighbours
    assert len(token_files.pack(np.zeros(10_000, np.uint32))) < 600
    with pytest.raises(ValueError):
        token_files.unpack(b"0123456789ab")


ODD = ["", " ", "  a", "a ", "a  b", "a \n b", "x\n\n y", " \ty", "<|endoftext|>", "a <|endoftext|> b", "a  <|endoftext|>", "it's 'tis we're", " x   y",
       "\x1c a \x1f b", "日本 語 の", "\0 a \0", "a" * 5000, "ab " * 9000, "\U0001f600 \U0001f600x", "é è", "_ _a", "1 22  333", "  a  b", "tab\tx \t y"]


def test_chunks_encode_like_whole_texts():
    encoder = token_files.Encoder(open(BPE, encoding="utf-8").read())
    library = Tokenizer.from_file(BPE)
    rng = np.random.default_rng(3)
    letters = list("ab 1'.\n\t  é日_\x1c\0") + ["<|endoftext|>", "  "]
    texts = ODD + ["".join(rng.choice(letters, rng.integers(1, 40))) for _ in range(2000)]
    for batch in (texts, texts[::-1]):
        ids, counts = encoder.encode(batch, 7)
        at = 0
        for t, n in zip(batch, counts.tolist()):
            assert ids[at: at + n].tolist() == [*library.encode(t, add_special_tokens=False).ids, 7], repr(t)
            at += n
        assert at == len(ids)


def test_other_vocabularies_get_whole_texts(spark, tmp_path):
    path = public_tokenizers.path("word_bpe_49k.json")
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(ODD[:12])], "doc_id long, text string")
    token_files.write_tokens(docs, path, str(tmp_path / "w"), end_id=3)
    library = Tokenizer.from_file(path)
    got = {r["doc_id"]: r["ids"] for r in token_files.read_tokens(spark, str(tmp_path / "w")).collect()}
    assert got == {i: [*library.encode(t, add_special_tokens=False).ids, 3] for i, t in enumerate(ODD[:12])}


def test_files_against_the_library(spark, sf_dir, tmp_path, monkeypatch):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    rows += [(9000 + i, t, None, None, None) for i, t in enumerate(ODD)]
    rows += [(None, "null id", "en", "s", 1), (None, None, None, None, None), (9500, None, "en", "s", 0), (-5, "minus", "en", "s", 1)]
    rows += [(9600, "same row", "en", "s", 1)] * 40 + [(9600, f"same id {i}", "en", "s", 1) for i in range(40)]
    monkeypatch.setattr(token_files, "SEGMENT", 5000)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5).withColumns({c: F.lit(1) for c in ("ids", "start", "key", "row", "part", "first", "body", "n_tokens")})
    folder = str(tmp_path / "tokens")
    token_files.write_tokens(docs, BPE, folder)
    library = Tokenizer.from_file(BPE)
    ids = lambda t: [*library.encode(t or "", add_special_tokens=False).ids, 0]
    got = sorted(token_files.read_tokens(spark, folder).collect(), key=lambda r: r["start"])
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["ids"]) for r in got) == sorted((r[0] is not None, r[0] or 0, ids(r[1])) for r in rows)
    names = [(r["doc_id"] is not None, r["doc_id"] or 0) for r in got]
    assert names == sorted(names)
    at = 0
    for r in got:
        assert r["start"] == at and r["n_tokens"] == len(r["ids"])
        at += len(r["ids"])
    crc = lambda x: zlib.crc32(np.array(x, "<u4").tobytes())
    digests = {(r["start"]): (r["n_tokens"], r["ids_crc32"]) for r in token_files.read_digests(spark, folder).collect()}
    assert digests == {r["start"]: (len(r["ids"]), crc(r["ids"])) for r in got}
    # other partitions, the same order
    again = str(tmp_path / "again")
    token_files.write_tokens(docs.repartition(2), BPE, again)
    key = lambda r: (r["start"], r["n_tokens"], r["ids_crc32"])
    assert {key(r) for r in token_files.read_digests(spark, again).collect()} == {key(r) for r in token_files.read_digests(spark, folder).collect()}


def test_no_documents(spark, tmp_path):
    token_files.write_tokens(spark.createDataFrame([], SCHEMA), BPE, str(tmp_path / "none"))
    assert token_files.read_digests(spark, str(tmp_path / "none")).count() == 0
