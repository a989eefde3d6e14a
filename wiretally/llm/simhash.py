"""SimHash fingerprints and exact near-duplicate classes through vantage-point trees.

Fingerprints within `radius` bits are linked. The 64 bits are cut into radius + 2 blocks; linked
fingerprints agree on at least two of them, so each pair of blocks with its values names a family
in which no link is lost. Within a family, shells of Hamming distance to a vantage point part the
fingerprints; by the triangle bound linked ones differ by at most `radius` in that distance, so each
shell also gets the rows of the shell below that lie within `radius` of the border. A shard is
parted further by a vantage-point tree with the same overlap until its leaves are small or stop
shrinking; a leaf is searched breadth first, where a found fingerprint is never compared again, so a
leaf gives a spanning tree of each class and not all its pairs.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wiretally.llm.common import slices, text_key, texts, written
from wiretally.llm.components import components

RADIUS = 4
LEAF = 128
SHELL = 8
VANTAGE = 0x5A3C_96E1_0F87_D24B
CHUNK = 1 << 22


def shingle_bytes(text: str, width: int) -> tuple[bytes, np.ndarray, np.ndarray]:
    """ASCII-lowered words joined by one blank; the starts and ends of the word shingles in it."""
    norm = b" ".join(text.encode("utf-8", "surrogatepass").lower().split())
    if not norm:
        return norm, np.empty(0, np.int64), np.empty(0, np.int64)
    gaps = np.flatnonzero(np.frombuffer(norm, np.uint8) == 32)
    starts, ends = np.concatenate([[0], gaps + 1]), np.concatenate([gaps, [len(norm)]])
    if len(starts) <= width:
        return norm, starts[:1], ends[-1:]
    return norm, starts[: len(starts) - width + 1], ends[width - 1:]


def fingerprints_of(batch: list[str], width: int, seed: int = 42) -> np.ndarray:
    """One 64-bit fingerprint per text: a bit is set if it is set in over half of the shingle hashes."""
    digest, raw, counts = xxhash.xxh64_digest, [], []
    for t in batch:
        norm, a, b = shingle_bytes(t, width)
        raw.append(b"".join([digest(norm[i:j], seed) for i, j in zip(a.tolist(), b.tolist())]))
        counts.append(len(a))
    h = np.frombuffer(b"".join(raw), ">u8").astype(np.uint64)
    counts = np.array(counts, np.int64)
    out = np.zeros(len(batch), np.uint64)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    per = -(-counts[full] // 255)  # byte lanes hold up to 255 ones
    first = np.concatenate([[0], np.cumsum(counts[full])[:-1]])
    owner = np.repeat(np.arange(len(full)), per)
    step = np.arange(len(owner)) - np.repeat(np.concatenate([[0], np.cumsum(per)[:-1]]), per)
    cuts = first[owner] + 255 * step
    by_doc = np.concatenate([[0], np.cumsum(per)[:-1]])
    lanes, got = np.uint64(0x0101010101010101), np.zeros(len(full), np.uint64)
    for bit in range(8):
        sums = np.add.reduceat((h >> np.uint64(bit)) & lanes, cuts)
        ones = np.add.reduceat(sums.astype("<u8").view(np.uint8).reshape(-1, 8).astype(np.int64), by_doc, axis=0)
        over = (2 * ones > counts[full][:, None]).astype(np.uint64)
        for byte in range(8):
            got |= over[:, byte] << np.uint64(8 * byte + bit)
    out[full] = got
    return out


def fingerprint(docs: DataFrame, width: int = 4, text: str = "text") -> DataFrame:
    """docs without the text, with `fp` (the 64 bits as a long). No words: zero."""
    schema = docs.drop(text).withColumn("fp", F.lit(0).cast("long")).schema

    def run(batches):
        for b in batches:
            for lo, hi in slices(b, text, CHUNK):
                part = b.slice(lo, hi - lo)
                fp = fingerprints_of(texts(part, text), width).view(np.int64)
                rest = [(n, c) for n, c in zip(part.schema.names, part.columns) if n != text]
                yield pa.RecordBatch.from_arrays([*[c for _, c in rest], pa.array(fp)], names=[*[n for n, _ in rest], "fp"])

    return docs.mapInArrow(run, schema)


def tree_links(points: np.ndarray, radius: int = RADIUS, leaf: int = LEAF) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links (child, parent) that span the classes of distinct uint64 `points`."""
    out, todo = [], [points]
    while todo:
        p = todo.pop()
        if len(p) < 2:
            continue
        if len(p) > leaf:
            d = np.bitwise_count(p ^ p[len(p) // 2]).astype(np.int16)
            mid = np.partition(d, (len(d) - 1) // 2)[(len(d) - 1) // 2]
            inner, outer = p[d <= mid + radius], p[d > mid]
            if max(len(inner), len(outer)) <= 0.9 * len(p):
                todo += [inner, outer]
                continue
        rest, queue = p[1:], [p[0]]
        while len(rest) or queue:
            if not queue:
                queue, rest = [rest[0]], rest[1:]
            at = queue.pop()
            if len(rest):
                near = np.bitwise_count(rest ^ at) <= radius
                if near.any():
                    found = rest[near]
                    out.append((found, np.full(len(found), at)))
                    queue.extend(found)
                    rest = rest[~near]
            else:
                break
    return out


def links(fps: DataFrame, radius: int = RADIUS, leaf: int = LEAF) -> DataFrame:
    """fps (fp long, distinct) -> links (a, b) that span every class of fingerprints within `radius`."""
    n = radius + 2
    edges = [round(64 * i / n) for i in range(n + 1)]
    masks = [((1 << (hi - lo)) - 1) << lo for lo, hi in zip(edges, edges[1:])]
    signed = lambda x: x - (1 << 64) if x >= 1 << 63 else x
    pairs = [masks[i] | masks[j] for i, j in combinations(range(n), 2)]
    bits = F.array(*[F.col("fp").bitwiseAND(F.lit(signed(m)).cast("long")) for m in pairs])
    home = (F.bit_count(F.col("fp").bitwiseXOR(F.lit(signed(VANTAGE)).cast("long"))) / SHELL).cast("int")
    over = F.bit_count(F.col("fp").bitwiseXOR(F.lit(signed(VANTAGE)).cast("long"))) % SHELL >= SHELL - radius
    shells = F.when(over, F.array(home, home + 1)).otherwise(F.array(home))
    rows = fps.select("fp", F.posexplode(bits).alias("family", "value")).select("fp", "family", "value", F.explode(shells).alias("shell"))
    shards = rows.repartition("family", "value", "shell").sortWithinPartitions("family", "value", "shell")

    def run(batches):
        held: list[np.ndarray] = []
        key = None
        done: list = []

        def flush():
            nonlocal done
            if done:
                a, b = (np.concatenate(x).view(np.int64) for x in zip(*done))
                done = []
                return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            fp, fam, val, sh = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            if not len(fp):
                continue
            cut = np.flatnonzero((fam[1:] != fam[:-1]) | (val[1:] != val[:-1]) | (sh[1:] != sh[:-1])) + 1
            cut = np.concatenate([[0], cut, [len(fp)]])
            if key is not None and key != (fam[0], val[0], sh[0]):
                done += tree_links(np.concatenate(held), radius, leaf) if sum(map(len, held)) > 1 else []
                held = []
            for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist()):
                if lo:
                    if len(held) > 1 or len(held[0]) > 1:
                        done += tree_links(np.concatenate(held), radius, leaf)
                    held = []
                held.append(fp[lo:hi].view(np.uint64).copy())
            key = (fam[-1], val[-1], sh[-1])
            if (out := flush()) is not None:
                yield out
        if held:
            done += tree_links(np.concatenate(held), radius, leaf)
        if (out := flush()) is not None:
            yield out

    return shards.mapInArrow(run, "a bigint, b bigint").distinct()


def _members(docs: DataFrame, width: int, radius: int) -> DataFrame:
    """(doc_id, key, fp, root) of every row; `root` is the least fingerprint of the class."""
    fp = written(fingerprint(docs.select("doc_id", "text", text_key().alias("key")), width), "fingerprints")
    fps = fp.select("fp").distinct()
    roots = components(links(fps, radius)).withColumnRenamed("node", "fp")
    return fp.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def classes(docs: DataFrame, width: int = 4, radius: int = RADIUS) -> DataFrame:
    """Every row of `docs` as (doc_id, fp, component_id): the least doc_id reachable by links.

    Null, empty and wordless texts have fingerprint zero and are linked like any other. Equal rows
    share a class. A class whose doc_ids are all null has a null id; else nulls are passed over.
    Further columns are ignored."""
    rows = written(_members(docs, width, radius), "members")
    ids = rows.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return rows.join(ids, "root").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, width: int = 4, radius: int = RADIUS) -> DataFrame:
    """One document of each class, with all its columns: the least doc_id, nulls last; among rows
    that repeat it the least text hash; of equal rows one."""
    order = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "key")
    firsts = _members(docs, width, radius).groupBy("root").agg(F.min(order).alias("r")).select(
        F.col("r.doc_id").alias("__llm_id"), F.col("r.key").alias("__llm_k"))
    keyed = docs.withColumn("__llm_key", text_key())
    kept = keyed.join(firsts, F.col("doc_id").eqNullSafe(F.col("__llm_id")) & (F.col("__llm_key") == F.col("__llm_k")), "left_semi")
    return kept.dropDuplicates(["doc_id", "__llm_key"]).drop("__llm_key")
