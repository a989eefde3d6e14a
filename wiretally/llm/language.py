"""Language identification with hyperdimensional profiles.

Every letter has a random bipolar vector. A letter trigram is the product (binding) of its letters'
vectors, each rotated by its place; a text or a language is the sum (bundle) of its trigrams. A text
goes to the language whose prototype has the highest cosine with the text's vector.

Letters are lower-cased; every run of other characters is one blank. Texts are padded with a blank
on both sides, so a single letter still makes a trigram.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wiretally.llm.common import slices, texts

DIM = 2048
SEED = b"letters-1"
CHUNK = 1 << 21  # bytes of text handled at once


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """1 for code points that are letters."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


@lru_cache(maxsize=1 << 16)
def _letter(code: int, dim: int) -> np.ndarray:
    raw = hashlib.shake_256(SEED + code.to_bytes(4, "big")).digest(dim // 8)
    return np.unpackbits(np.frombuffer(raw, np.uint8)).astype(np.int8) * 2 - 1


def _grams(batch: list[str]):
    """(document index, gram number) of each trigram, and the three code points of each gram number."""
    joined = np.frombuffer("\0".join(t.lower() for t in batch).encode("utf-32-le", "surrogatepass"), np.uint32)
    cut = np.cumsum(joined == 0)  # a NUL inside a text would shift documents: it is replaced by the caller
    code = np.where(_letters()[joined], joined, 32).astype(np.uint32)
    doc = cut.astype(np.int32)
    code = np.concatenate([[32], code, [32]]).astype(np.uint32)
    doc = np.concatenate([[0], doc, [len(batch) - 1]]).astype(np.int32)
    keep = np.ones(len(code), bool)
    keep[1:] = (code[1:] != 32) | (code[:-1] != 32)
    code, doc = code[keep], doc[keep]
    alphabet, small = np.unique(code, return_inverse=True)
    k = len(alphabet)
    if len(code) < 3 or k < 2:
        return np.empty(0, np.int32), np.empty(0, np.int64), np.empty((0, 3), np.uint32)
    small = small.astype(np.int64)
    gram = (small[:-2] * k + small[1:-1]) * k + small[2:]
    blank = int(np.searchsorted(alphabet, 32))
    middle = small[1:-1] != blank  # each word's grams: a blank only at its ends
    gram, at = gram[middle], doc[1:-1][middle]
    found, number = np.unique(gram, return_inverse=True) if k > 160 else _dense(gram, k ** 3)
    triples = alphabet[np.stack([found // (k * k), found // k % k, found % k], axis=1)]
    return at, number, triples


def _dense(gram: np.ndarray, size: int):
    present = np.zeros(size, bool)
    present[gram] = True
    number = np.cumsum(present) - 1
    return np.flatnonzero(present), number[gram]


def _vectors(triples: np.ndarray, dim: int) -> np.ndarray:
    """Bound vectors of grams: place 0 rotated twice, place 1 once."""
    codes, at = np.unique(triples, return_inverse=True)
    base = np.stack([_letter(int(c), dim) for c in codes])
    at = at.reshape(triples.shape)
    once, twice = np.roll(base, 1, axis=1), np.roll(base, 2, axis=1)
    return twice[at[:, 0]] * once[at[:, 1]] * base[at[:, 2]]


def _bundles(row: np.ndarray, number: np.ndarray, triples: np.ndarray, rows: int, dim: int) -> np.ndarray:
    """Sums of gram vectors by row. Grams are bound in blocks, so memory does not grow with the alphabet:
    a block holds at most 2**22 counts and 4,096 vectors. Sums are whole numbers and exact."""
    out = np.zeros((rows, dim), np.float32 if len(number) < 1 << 24 else np.float64)
    width = int(max(64, min(4096, (1 << 22) // max(1, rows))))
    order = np.argsort(number, kind="stable") if len(triples) > width else np.arange(len(number))
    row, number = row[order].astype(np.int64), number[order]
    cuts = np.searchsorted(number, np.arange(0, len(triples) + width, width)) if len(triples) > width else [0, len(number)]
    for lo, hi, start in zip(cuts[:-1], cuts[1:], range(0, len(triples), width)):
        n = min(width, len(triples) - start)
        counts = np.bincount(row[lo:hi] * n + number[lo:hi] - start, minlength=rows * n).reshape(rows, n)
        out += counts.astype(out.dtype) @ _vectors(triples[start: start + n], dim).astype(out.dtype)
    return out


def train(docs: DataFrame, dim: int = DIM, text: str = "text", lang: str = "lang") -> dict[str, np.ndarray]:
    """Unit prototypes by language, from every row with text and language.

    Each task sends one bundle per language it met; their sum has languages x dim numbers, so what
    reaches the driver depends on the number of languages only."""

    def bundle(batches):
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            for lo, hi in slices(b, text, CHUNK):
                part = b.slice(lo, hi - lo)
                langs = part.column(part.schema.get_field_index(lang)).to_pylist()
                at, number, triples = _grams([t.replace("\0", " ") for t in texts(part, text)])
                if not len(number):
                    continue
                names, row = np.unique(langs, return_inverse=True)
                total = _bundles(row[at], number, triples, len(names), dim)
                for name, v in zip(names.tolist(), total.astype(np.float64)):
                    sums[name] = sums.get(name, 0) + v
        if sums:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(sums)), pa.array([v.astype(np.int64).tolist() for v in sums.values()], pa.list_(pa.int64()))],
                names=["lang", "v"])

    rows = docs.select(F.col(text), F.col(lang)).filter(F.col(text).isNotNull() & F.col(lang).isNotNull())
    parts = rows.mapInArrow(bundle, "lang string, v array<bigint>")
    sums = parts.select("lang", F.posexplode("v")).groupBy("lang", "pos").agg(F.sum("col").alias("s"))
    out: dict[str, np.ndarray] = {}
    for r in sums.collect():
        out.setdefault(r["lang"], np.zeros(dim))[r["pos"]] = r["s"]
    return {k: v / norm for k, v in sorted(out.items()) if (norm := np.linalg.norm(v)) > 0}


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], text: str = "text") -> DataFrame:
    """Adds `lang_pred` and `score` (cosine of the best prototype, 0 to 1). `und` and 0 for a null
    text, a text without a letter, or when no prototype exists. Ties go to the first name. Texts are read whole,
    a batch of about CHUNK bytes or one longer text at a time."""
    names = list(prototypes)
    table = np.stack(list(prototypes.values())).astype(np.float32) if names else None
    schema = docs.withColumn("lang_pred", F.lit("")).withColumn("score", F.lit(0.0)).schema
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast((names, table))  # languages x dim floats

    def score(batches):
        names, table = model.value
        for b in batches:
            for lo, hi in slices(b, text, CHUNK):
                part = b.slice(lo, hi - lo)
                pred, best = ["und"] * len(part), np.zeros(len(part))
                at, number, triples = _grams([t.replace("\0", " ") for t in texts(part, text)])
                if len(number) and names:
                    own = _bundles(at, number, triples, len(part), table.shape[1])
                    size = np.linalg.norm(own, axis=1)
                    cos = (own @ table.T) / np.maximum(size, 1e-9)[:, None]
                    win = cos.argmax(axis=1)
                    lettered = np.bincount(at, minlength=len(part)) > 0
                    best = np.where(lettered, np.clip(cos[np.arange(len(part)), win], 0, 1), 0.0)
                    pred = [names[w] if ok else "und" for w, ok in zip(win.tolist(), lettered.tolist())]
                arrays = [*part.columns, pa.array(pred, pa.string()), pa.array(best.astype(np.float64))]
                yield pa.RecordBatch.from_arrays(arrays, names=[*part.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(score, schema)


def held_out(doc_id: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def identify(docs: DataFrame, dim: int = DIM) -> DataFrame:
    """Learns from the rows that are not held out and predicts every row of `docs`.

    Result: doc_id, held_out, lang_pred, score; one row per input row. A null doc_id counts as the
    empty text for the hold-out. Repeated rows get equal predictions, further columns are ignored."""
    rows = docs.select("doc_id", held_out().alias("held_out"), "text", "lang")
    model = train(rows.filter(~F.col("held_out")), dim)
    return predict(rows.drop("lang"), model).drop("text")


def keep_identified(docs: DataFrame, least: float = 0.05) -> DataFrame:
    """Documents whose language is told: lettered, with a cosine of at least `least`. All columns stay."""
    model = train(docs.select("text", "lang", held_out().alias("_h")).filter(~F.col("_h")))
    told = predict(docs.withColumnRenamed("lang_pred", "__llm_lang_pred").withColumnRenamed("score", "__llm_score"), model)
    kept = told.filter((F.col("lang_pred") != "und") & (F.col("score") >= least)).drop("lang_pred", "score")
    return kept.withColumnRenamed("__llm_lang_pred", "lang_pred").withColumnRenamed("__llm_score", "score")
