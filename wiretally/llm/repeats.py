"""Removal of repeated byte strings by depth-limited radix sort of suffixes.

A string of `depth` bytes that starts anywhere else, in the same or another document, is repeated,
and all its bytes go. Suffixes are told apart only through their first `depth` bytes, by passes that
each look at a further digit and keep only groups of at least two; equal groups after the last pass
are exactly the repeated windows. Digits are content-defined, so that equal windows meet however
they lie in their texts:

1. the anchor: of the window's 64-byte grams the one with the least hash. Neighbouring windows share
   it; such a run is sorted as one item, by its anchor and its whole content;
2. for runs whose anchor others have with other content, blocks of 16 windows on a grid that counts
   from the anchor, by the bytes that all windows of the block share;
3. single windows of blocks left over, by all their bytes.

A run or block whose content occurs twice is repeated as a whole, one whose digit occurs once is not
repeated at all; both leave the sort. Contents are compared by 128-bit or, within groups that agree
on a 64-bit digit, by further 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wiretally.llm.common import flat, only_with, slices, text_key, written

DEPTH = 400
GRAM = 64
BLOCK = 16
CHUNK = 1 << 21
_PLACE = np.uint64((1 << 28) - 1)  # a text may have up to 2**28 bytes
_MULT = 0x5851F42D4C957F2D
_MIX = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up = np.full(n, _MULT, np.uint64)
    down = np.full(n, pow(_MULT, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes from each position on."""
    n = len(data)
    up, down = _powers(1 << max(21, int(n).bit_length()))
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    h = (sums[GRAM:] - sums[:-GRAM]) * down[: n - GRAM + 1]
    h ^= h >> np.uint64(32)
    h *= _MIX
    h ^= h >> np.uint64(29)
    return h


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Least of every w neighbours."""
    n = len(x)
    rows = -(-n // w)
    padded = np.full(rows * w, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = x
    grid = padded.reshape(rows, w)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], ahead[w - 1: n])


def runs(data: np.ndarray, offsets: np.ndarray, depth: int = DEPTH):
    """Runs of windows with one anchor: (text number, first window, last window, anchor place, anchor hash).

    Places count from the start of `data`."""
    none = np.empty(0, np.int64)
    if len(data) < depth:
        return none, none, none, none, none.astype(np.uint64)
    if len(data) > int(_PLACE):
        raise ValueError("a text of more than 2**28 bytes")
    h = gram_hashes(data)
    places = np.arange(len(h), dtype=np.uint64)
    least = _sliding_min((h & ~_PLACE) | (_PLACE - places), depth - GRAM + 1)  # of equals the last
    anchor = (_PLACE - (least & _PLACE)).astype(np.int64)
    step = np.zeros(len(data) + 1, np.int64)
    sizes = np.diff(offsets)
    fit = sizes >= depth
    np.add.at(step, offsets[:-1][fit], 1)
    np.add.at(step, offsets[1:][fit] - depth + 1, -1)
    at = np.flatnonzero(np.cumsum(step)[: len(anchor)])
    if not len(at):
        return none, none, none, none, none.astype(np.uint64)
    a = anchor[at]
    cut = np.flatnonzero((np.diff(a) != 0) | (np.diff(at) != 1))
    first, last = at[np.concatenate([[0], cut + 1])], at[np.concatenate([cut, [len(at) - 1]])]
    a = anchor[first]
    return np.searchsorted(offsets, first, "right") - 1, first, last, a, h[a]


def _hashes(raw: bytes, starts, stops) -> np.ndarray:
    digest = xxhash.xxh3_64_digest
    return np.frombuffer(b"".join([digest(raw[a:b]) for a, b in zip(starts.tolist(), stops.tolist())]), ">i8").astype(np.int64)


def first_digit(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(doc_id, key, start, more, off, a, d): runs of more + 1 windows from `start` of a document, the
    anchor `off` bytes on, its hash, and a hash of the run's whole content."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            for lo, hi in slices(b, "text", CHUNK):
                part = b.slice(lo, hi - lo)
                data, offsets = flat(part)
                doc, first, last, anchor, h = runs(data, offsets, depth)
                if not len(doc):
                    continue
                row = pa.array(doc)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(row), part.column(1).take(row), pa.array((first - offsets[doc]).astype(np.int32)), pa.array((last - first).astype(np.int32)),
                     pa.array((anchor - first).astype(np.int32)), pa.array(h.view(np.int64)), pa.array(_hashes(data.tobytes(), first, last + depth))],
                    names=["doc_id", "key", "start", "more", "off", "a", "d"])

    return docs.select("doc_id", text_key().alias("key"), "text").mapInArrow(
        run, f"doc_id {kind}, key bigint, start int, more int, off int, a bigint, d bigint")


def _live(rows: DataFrame, digit: str, content: str, open_: str) -> DataFrame:
    """(digit, content, n, kinds, singles) of the groups with a digit that occurs twice.

    `singles` counts contents that occur once and still ask (`open_`). Hot groups are counted map-side."""
    kinds = rows.groupBy(digit, content).agg(F.count("*").alias("n"), F.max(open_).alias("asks"))
    per = kinds.groupBy(digit).agg(F.sum("n").alias("_all"), F.count("*").alias("kinds"), F.count(F.when((F.col("n") == 1) & F.col("asks"), 1)).alias("singles"))
    return kinds.join(per.filter("_all >= 2"), digit).select(digit, content, "n", "kinds", "singles")


def _join_text(docs: DataFrame, lists: DataFrame, how: str) -> DataFrame:
    right = lists.withColumnsRenamed({"doc_id": "_id", "key": "_k"})
    on = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_k"))
    return docs.join(right, on, how).drop("_id", "_k")


def second_digit(docs: DataFrame, open_runs: DataFrame, depth: int) -> DataFrame:
    """(doc_id, key, place, mine, lo, hi, c, e, left, right): blocks of windows of the open runs.

    `place` is where the block's grid begins in its document, lo and hi its first and last window
    from there, c a hash of anchor, grid and shared bytes, left and right the bytes beside those, e
    a hash of lo, hi, left and right."""
    lists = open_runs.groupBy("doc_id", "key").agg(F.collect_list(F.struct("start", "more", "off", "a", "mine")).alias("runs"))  # of one document
    kind = docs.schema["doc_id"].dataType.simpleString()
    digest = xxhash.xxh3_64_intdigest
    signed = lambda x: x - (1 << 64) if x >= 1 << 63 else x

    def run(batches):
        for b in batches:
            row, place, mine, los, his, c, e, left, right = ([] for _ in range(9))
            raws = b.column(2).cast(pa.large_binary())
            for i, found in enumerate(b.column(3).to_pylist()):
                raw = raws[i].as_py()
                for x in found:
                    p, a = x["start"] + x["off"], x["a"] & 0xFFFFFFFFFFFFFFFF
                    for g in range(-x["off"] // BLOCK, (x["more"] - x["off"]) // BLOCK + 1):
                        base = p + BLOCK * g
                        lo, hi = max(0, x["start"] - base), min(BLOCK - 1, x["start"] + x["more"] - base)
                        near, far = raw[base + lo: base + BLOCK - 1], raw[base + depth: base + hi + depth]
                        row.append(i)
                        place.append(base)
                        mine.append(x["mine"])
                        los.append(lo)
                        his.append(hi)
                        c.append(signed(digest(raw[base + BLOCK - 1: base + depth], a ^ (g & 0xFFFFFFFF))))
                        e.append(signed(digest(near + far, lo * BLOCK + hi)))
                        left.append(near)
                        right.append(far)
                if len(row) > 50_000 or i == len(b) - 1 and row:
                    at = pa.array(row)
                    yield pa.RecordBatch.from_arrays(
                        [b.column(0).take(at), b.column(1).take(at), pa.array(place, pa.int32()), pa.array(mine), pa.array(los, pa.int32()), pa.array(his, pa.int32()),
                         pa.array(c, pa.int64()), pa.array(e, pa.int64()), pa.array(left, pa.binary()), pa.array(right, pa.binary())],
                        names=["doc_id", "key", "place", "mine", "lo", "hi", "c", "e", "left", "right"])
                    row, place, mine, los, his, c, e, left, right = ([] for _ in range(9))

    texts_ = _join_text(only_with(docs, lists, ["doc_id", "key"]), lists, "inner").select("doc_id", "key", "text", "runs")
    return texts_.mapInArrow(run, f"doc_id {kind}, key bigint, place int, mine boolean, lo int, hi int, c bigint, e bigint, left binary, right binary")


def last_digit(blocks: DataFrame, depth: int) -> DataFrame:
    """(doc_id, key, at, mine, w): single windows of blocks, w a hash of block digit and remaining bytes."""
    kind = blocks.schema["doc_id"].dataType.simpleString()
    digest = xxhash.xxh3_64_intdigest

    def run(batches):
        for b in batches:
            row, at, w = [], [], []
            place, lo, hi, c, left, right = (b.column(b.schema.get_field_index(n)).to_pylist() for n in ("place", "lo", "hi", "c", "left", "right"))
            for i in range(len(place)):
                seed = c[i] & 0xFFFFFFFFFFFFFFFF
                for r in range(lo[i], hi[i] + 1):
                    row.append(i)
                    at.append(place[i] + r)
                    x = digest(left[i][r - lo[i]:] + right[i][:r], seed ^ r)
                    w.append(x - (1 << 64) if x >= 1 << 63 else x)
            k = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(k), b.column(1).take(k), pa.array(at, pa.int32()), b.column(3).take(k), pa.array(w, pa.int64())], names=["doc_id", "key", "at", "mine", "w"])

    return blocks.select("doc_id", "key", "place", "mine", "lo", "hi", "c", "left", "right").mapInArrow(
        run, f"doc_id {kind}, key bigint, at int, mine boolean, w bigint")


def repeated_spans(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(doc_id, key, lo, hi): byte spans that repeated strings of `depth` bytes cover; they may overlap.

    `docs` has doc_id, key and text; rows equal in the first two have equal texts."""
    span = lambda lo, hi: [F.col("doc_id"), F.col("key"), lo.cast("int").alias("lo"), hi.cast("int").alias("hi")]
    first = written(first_digit(docs, depth), "first-digit")
    found = _live(first.withColumn("asks", F.lit(True)), "a", "d", "asks")
    members = written(first.join(found, ["a", "d"]), "members")
    spans = members.filter("n >= 2").select(*span(F.col("start"), F.col("start") + F.col("more") + depth))
    open_runs = members.filter("kinds >= 2 AND singles >= 1").withColumn("mine", F.col("n") == 1)
    blocks = written(second_digit(docs, open_runs.dropDuplicates(["a", "d"]), depth), "blocks")
    found = _live(blocks, "c", "e", "mine")
    members = written(blocks.join(found, ["c", "e"]).filter("(n >= 2 AND mine) OR singles >= 1"), "block-members")
    spans = spans.union(members.filter("n >= 2 AND mine").select(*span(F.col("place") + F.col("lo"), F.col("place") + F.col("hi") + depth)))
    rest = members.filter("singles >= 1").withColumn("mine", F.col("mine") & (F.col("n") == 1))
    windows = written(last_digit(rest.dropDuplicates(["c", "e"]), depth), "windows")
    twice = windows.groupBy("w").agg(F.count("*").alias("n")).filter("n >= 2").select("w")
    return spans.union(windows.filter("mine").join(twice, "w", "left_semi").select(*span(F.col("at"), F.col("at") + depth)))


def remove_repeats(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept binary, kept_sha256) for every row of `docs`.

    A null text counts as empty. Rows that repeat doc_id and text are repeats of each other: a text of
    at least `depth` bytes goes whole. Null doc_ids are documents like others; further columns play no
    part. The kept bytes may cut a character; they are returned as they are."""
    rows = docs.select("doc_id", text_key().alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    spans = written(repeated_spans(rows, depth), "spans")
    lists = spans.groupBy("doc_id", "key").agg(F.sort_array(F.collect_set(F.struct("lo", "hi"))).alias("spans"))  # of one document
    lists = written(lists, "span-lists")
    kind = docs.schema["doc_id"].dataType.simpleString()
    none = F.lit(0).cast("long")
    clean = only_with(rows, lists, ["doc_id", "key"], negate=True).select(
        "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), none.alias("n_removed"), none.alias("n_spans"),
        F.col("text").cast("binary").alias("kept"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))

    def cut(batches):
        for b in batches:
            raws, out = b.column(1).cast(pa.large_binary()), []
            for i, found in enumerate(b.column(2)):
                raw, kept, end, n = raws[i].as_py(), [], 0, 0
                if found.is_valid:
                    flat_ = found.values.flatten()
                    for lo, hi in zip(flat_[0].to_pylist(), flat_[1].to_pylist()):
                        if lo > end or n == 0:
                            kept.append(raw[end:lo])
                            n += 1
                        end = max(end, hi)
                kept = b"".join([*kept, raw[end:]])
                out.append((len(raw), len(raw) - len(kept), n, kept, hashlib.sha256(kept).hexdigest()))
            n_bytes, n_removed, n_spans, kept, sha = zip(*out) if out else ((),) * 5
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(kept, pa.binary()), pa.array(sha, pa.string())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])

    held = _join_text(only_with(rows, lists, ["doc_id", "key"]), lists, "left").select("doc_id", "text", "spans")
    return clean.union(held.mapInArrow(cut, f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary, kept_sha256 string"))
