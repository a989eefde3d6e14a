"""Benchmark decontamination: short test items found inside long documents.

Items are parted by size (number of distinct shingles q). To hold a share `least` of an item, a
document must hold at least one of any q - ceil(least q) + 1 of its shingles; the item's MinHash
sketch is the smallest that many of its shingle hashes, so the sketch length follows from the size
partition and the search loses nothing. Documents that hold a sketch value are candidates; all their
shingles that belong to items are then counted for the exact containment. Every size partition has a
sketch map of its own, and documents too short for a partition's items are not looked up in it.

Words are lower-cased runs of letters and digits, shingles have `width` words. An item with fewer
words has one shingle, all its words, and is found wherever these words follow each other; a text
without words has no shingle and matches nothing. An item is its id and its text: items that share an
id are found or not each for itself.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wiretally.llm.common import slices, text_key, texts, written

WIDTH = 5
LEAST = 0.8
BITS = 22  # size of the bit maps sent to the tasks: 2**22 bits, whatever the tables hold
_MULT = np.uint64(0x9E3779B97F4A7C15)
_WORD = re.compile(r"\w+")
_CHUNK = 1 << 22


def word_ids(batch: list[str], known: dict[str, int]):
    """(hash of each word, number of words per text)."""
    lists = [_WORD.findall(t.lower()) for t in batch]
    ids: list[int] = []
    for ws in lists:
        try:
            ids.extend([known[w] for w in ws])
        except KeyError:
            for w in ws:
                if w not in known:
                    known[w] = xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"), 7)
            ids.extend([known[w] for w in ws])
    if len(known) > 1 << 20:  # a cache only
        known.clear()
    return np.array(ids, dtype=np.uint64), np.array([len(ws) for ws in lists], dtype=np.int64)


def shingle_hashes(h: np.ndarray, sizes: np.ndarray, width: int):
    """(hashes of all shingles, number of shingles per text); a hash covers the words and their order."""
    ends = np.cumsum(sizes)
    counts = np.where(sizes >= width, sizes - width + 1, np.minimum(sizes, 1))
    padded = np.concatenate([h, np.zeros(width, np.uint64)])
    roll = np.zeros(len(h), np.uint64)
    for i in range(width):
        roll = (roll ^ padded[i: len(h) + i]) * _MULT
        roll ^= roll >> np.uint64(29)
    first = np.repeat(ends - sizes, counts)
    step = np.arange(len(first)) - np.repeat(np.cumsum(counts) - counts, counts)
    out = roll[first + step]
    for d in np.flatnonzero((sizes > 0) & (sizes < width)).tolist():  # a short text: all its words
        x = np.uint64(sizes[d])
        with np.errstate(over="ignore"):
            for v in h[ends[d] - sizes[d]: ends[d]]:
                x = (x ^ v) * _MULT
                x ^= x >> np.uint64(29)
        out[(np.cumsum(counts) - counts)[d]] = x
    return out, counts


def short_windows(h: np.ndarray, sizes: np.ndarray, k: int):
    """(text number, hash) of all runs of k words, hashed as a whole text of k words is."""
    x = np.full(max(0, len(h) - k + 1), k, np.uint64)
    for i in range(k):
        x = (x ^ h[i: len(x) + i]) * _MULT
        x ^= x >> np.uint64(29)
    text = np.repeat(np.arange(len(sizes)), sizes)
    inside = text[: len(x)] == text[k - 1: k - 1 + len(x)]
    return text[: len(x)][inside], x[inside]


def item_shingles(items: DataFrame, item_id: str, text: str, width: int, least: float) -> DataFrame:
    """(item_id, item_key, words, h, q, need, in_sketch, size_class) for each distinct shingle of each item."""

    def run(batches):
        known: dict[str, int] = {}
        for b in batches:
            ids = b.column(0)
            ws, sizes = word_ids(texts(b, text), known)
            h, counts = shingle_hashes(ws, sizes, width)
            at = np.concatenate([[0], np.cumsum(counts)])
            row, out, q, need, sketch = [], [], [], [], []
            for i in range(len(counts)):
                own = np.unique(h[at[i]: at[i + 1]])
                n = len(own)
                enough = int(np.ceil(least * n - 1e-9))
                row += [i] * n
                out.append(own)
                q += [n] * n
                need += [enough] * n
                sketch += [j < n - enough + 1 for j in range(n)]
            if row:
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(row)), b.column(1).take(pa.array(row)), pa.array(sizes[row]), pa.array(np.concatenate(out).view(np.int64)),
                     pa.array(q, pa.int64()), pa.array(need, pa.int64()), pa.array(sketch)],
                    names=["item_id", "item_key", "words", "h", "q", "need", "in_sketch"])

    kind = items.schema[item_id].dataType.simpleString()
    rows = items.select(F.col(item_id).alias("item_id"), text_key(text).alias("item_key"), F.col(text)).dropDuplicates(["item_id", "item_key"])
    rows = rows.mapInArrow(run, f"item_id {kind}, item_key bigint, words bigint, h bigint, q bigint, need bigint, in_sketch boolean")
    return rows.withColumn("size_class", F.floor(F.log2("q")).cast("int"))


def _bitmap(rows: DataFrame) -> np.ndarray:
    """2**BITS bits, set at the low bits of each hash; gathered as at most 2**BITS / 64 words."""
    at = F.col("h").bitwiseAND(F.lit((1 << BITS) - 1))
    words = rows.select(F.shiftright(at, 6).alias("w"), F.expr(f"shiftleft(1L, cast(h & 63 as int))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b"))
    out = np.zeros(1 << (BITS - 6), np.int64)
    for r in words.collect():
        out[r["w"]] = r["b"]
    return out


def containment(docs: DataFrame, items: DataFrame, width: int = WIDTH, least: float = LEAST, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(doc_id, key, item_id, item_key, item_shingles, found, containment) for each document and item
    with containment of at least `least`. `key` tells rows apart that repeat a doc_id, `item_key`
    texts that share an item_id; equal rows count once. Null ids stay null. Null or wordless texts
    match nothing."""
    spark = docs.sparkSession
    table = written(item_shingles(items, item_id, text, width, least), "items")
    # a row per power of two of item sizes: at most 64
    classes = sorted((r["size_class"], r["need"]) for r in table.groupBy("size_class").agg(F.min("need").alias("need")).collect())
    sketches = [(need, _bitmap(table.filter((F.col("size_class") == c) & F.col("in_sketch")))) for c, need in classes]
    short = sorted(r["words"] for r in table.filter(F.col("words") < width).select("words").distinct().collect())  # below width
    maps = spark.sparkContext.broadcast((sketches, _bitmap(table)))  # 2**BITS bits for every class and for all

    def run(batches):
        sketches, every = maps.value
        known: dict[str, int] = {}
        hit = lambda m, h: ((m[((h & np.uint64((1 << BITS) - 1)) >> np.uint64(6)).astype(np.int64)].view(np.uint64) >> (h & np.uint64(63))) & np.uint64(1)).astype(bool)
        for b in batches:
            for lo, hi in slices(b, "text", _CHUNK):
                part = b.slice(lo, hi - lo)
                ws, sizes = word_ids(texts(part), known)
                h, counts = shingle_hashes(ws, sizes, width)
                owner = np.repeat(np.arange(len(counts)), counts)
                for own, hashes in (short_windows(ws, sizes, k) for k in short):
                    owner, h = np.concatenate([owner, own]), np.concatenate([h, hashes])
                candidate = np.zeros(len(counts), bool)
                for need, sketch in sketches:
                    long = counts[owner] >= need
                    candidate[owner[long][hit(sketch, h[long])]] = True
                near = np.flatnonzero(candidate[owner])
                near = near[hit(every, h[near])]
                if not len(near):
                    continue
                pair = np.unique(np.stack([owner[near].astype(np.uint64), h[near]], axis=1), axis=0)
                row = pa.array(pair[:, 0].astype(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(row), part.column(1).take(row), pa.array(counts[pair[:, 0].astype(np.int64)]), pa.array(pair[:, 1].copy().view(np.int64))],
                    names=["doc_id", "key", "n", "h"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    found = docs.select("doc_id", text_key().alias("key"), F.col("text")).mapInArrow(run, f"doc_id {kind}, key bigint, n bigint, h bigint").distinct()
    hits = found.join(table, "h").filter("n >= need")  # a shorter document cannot hold enough
    held = hits.groupBy("doc_id", "key", "item_id", "item_key").agg(
        F.max("q").alias("item_shingles"), F.count("*").alias("found"), F.max("need").alias("need"), F.max("in_sketch").alias("candidate"))
    return held.filter("candidate AND found >= need").select(
        "doc_id", "key", "item_id", "item_key", "item_shingles", "found", (F.col("found") / F.col("item_shingles")).alias("containment"))


def drop_contaminated(docs: DataFrame, items: DataFrame, width: int = WIDTH, least: float = LEAST) -> DataFrame:
    """Documents that hold no item; all columns and repeated rows stay."""
    bad = containment(docs, items, width, least).select(F.col("doc_id").alias("__llm_id"), F.col("key").alias("__llm_k")).distinct()
    keyed = docs.withColumn("__llm_key", text_key())
    return keyed.join(bad, F.col("doc_id").eqNullSafe(F.col("__llm_id")) & (F.col("__llm_key") == F.col("__llm_k")), "left_anti").drop("__llm_key")
