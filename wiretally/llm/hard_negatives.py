"""Hard negatives by angular triangle filtering.

Every row stores its norm and its angles to a few reference directions. For an anchor and a row the
angles give, by the triangle inequality on the sphere, an interval of the angle between them, and with the
norms an interval of their score. Rows lie in order of (label, nearest reference, angle to it) in blocks of
windows; a window is scored in whole numbers only if its interval, widened for rounding, can hold a score
that is still wanted. Anchors are dealt against blocks of rows, block by block, so that no task holds more
than one block of either.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wiretally.llm.common import written

REFERENCES = 32
WINDOW = 256
BLOCK = 1 << 14
ANCHORS = 1 << 13
POSITIVES = 5
NEGATIVES = 3
SLACK = 1e-6  # radians; arc cosines near 1 are off by up to 2e-8
EXACT = 1 << 53
LOW, HIGH = -(1 << 63), (1 << 63) - 1


def quantised(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, embedding) of the rows that take part, with the moved labels, each distinct row once."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()).filter(~bad)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), label.cast("bigint").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))


def _whole(embedding) -> np.ndarray:
    return np.floor(256 * np.asarray(embedding, np.float64))


def _unpacked(blobs, dim: int) -> np.ndarray:
    """Rows of whole numbers (as doubles), shorter ones filled with zeros."""
    out = np.zeros((len(blobs), dim))
    for i, b in enumerate(blobs):
        q = np.frombuffer(b[1:], "<i2" if b[:1] == b"s" else "<f8")
        out[i, : len(q)] = q
    return out


def _blob(q: np.ndarray) -> bytes:
    return b"s" + q.astype("<i2").tobytes() if np.abs(q).max(initial=0) < 32768 else b"d" + q.astype("<f8").tobytes()


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers, as 64-bit integers; beyond those the nearest one."""
    if np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * max(1, a.shape[1]) < EXACT:
        return np.rint(a @ b.T).astype(np.int64)
    whole = lambda x: np.array([[int(v) for v in r] for r in x.tolist()], object).reshape(x.shape)
    return np.clip(whole(a) @ whole(b).T, LOW, HIGH).astype(np.int64)


def _measured(q: np.ndarray, refs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Norms, and angles to the references."""
    scale = np.abs(q).max(axis=1, initial=1)
    unit = q / scale[:, None]
    norm = np.linalg.norm(unit, axis=1)
    angle = np.arccos(np.clip((unit / np.where(norm > 0, norm, 1)[:, None]) @ refs.T, -1, 1))
    return norm * scale, angle


def _references(rows: DataFrame, count: int) -> np.ndarray:
    """Unit vectors of `count` rows, picked by a hash of their id and vector."""
    picked = rows.orderBy(F.xxhash64("vec_id"), "vec_id", F.xxhash64("embedding")).limit(count).select("embedding").collect()
    q = [_whole(r[0]) for r in picked]
    out = np.zeros((len(q), max(map(len, q), default=0)))
    for i, v in enumerate(q):
        out[i, : len(v)] = v / (np.abs(v).max(initial=0) or 1)
    norm = np.linalg.norm(out, axis=1)
    return out[norm > 0] / norm[norm > 0][:, None]


def placed(rows: DataFrame, refs: np.ndarray) -> DataFrame:
    """(block, vec_id, label, key, q, norm, angles) of every distinct row, written block by block."""
    dim = refs.shape[1]
    schema = "vec_id bigint, label bigint, key bigint, q binary, norm double, angles array<float>, home int, near float"

    def measure(batches):
        import xxhash

        for b in batches:
            vectors = b.column(2)
            q = [_whole(v) for v in vectors.to_pylist()]
            wide = max(dim, max(map(len, q), default=0))
            m, r = np.zeros((len(q), wide)), np.zeros((len(refs), wide))
            r[:, :dim] = refs
            for i, v in enumerate(q):
                m[i, : len(v)] = v
            norm, angle = _measured(m, r)
            blobs = [_blob(v) for v in q]
            home = angle.argmin(axis=1) if len(refs) else np.zeros(len(q), int)
            near = angle[np.arange(len(q)), home] if len(refs) else np.zeros(len(q))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([xxhash.xxh64_intdigest(x) - (1 << 63) for x in blobs], pa.int64()), pa.array(blobs, pa.binary()),
                 pa.array(norm), pa.array(angle.astype(np.float32).tolist(), pa.list_(pa.float32())), pa.array(home.astype(np.int32)), pa.array(near.astype(np.float32))],
                names=[c.split()[0] for c in schema.split(", ")])

    once = rows.mapInArrow(measure, schema).dropDuplicates(["vec_id", "label", "key"])
    n = max(1, -(-rows.count() // BLOCK))
    ranged = once.repartitionByRange(n, "label", "home", "near", "vec_id", "key").sortWithinPartitions("label", "home", "near", "vec_id", "key")

    def number(batches):
        part = TaskContext.get().partitionId()
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(b), part, np.int64)), *b.columns[:6]], names=["block", *b.schema.names[:6]])

    return written(ranged.mapInArrow(number, "block bigint, " + ", ".join(schema.split(", ")[:6])), "vectors")


class _Rows:
    """One block's rows as windows with the ranges of their norms and angles."""

    def __init__(self, pdf: pd.DataFrame, dim: int):
        order = np.lexsort((pdf["key"], pdf["vec_id"]))  # ties of a window go by id
        window = np.arange(len(pdf)) // WINDOW
        order = order[np.argsort(window[order], kind="stable")]
        pdf = pdf.iloc[order]
        self.ids, self.keys, self.labels = (pdf[c].to_numpy(np.int64) for c in ("vec_id", "key", "label"))
        self.q = _unpacked(pdf["q"].tolist(), dim)
        angles, norms = np.array(pdf["angles"].tolist(), np.float64).reshape(len(pdf), -1), pdf["norm"].to_numpy()
        cut = np.arange(0, len(pdf), WINDOW)
        self.bounds = list(zip(cut.tolist(), np.append(cut[1:], len(pdf)).tolist()))
        low, high = np.minimum.reduceat, np.maximum.reduceat
        self.label_lo, self.label_hi = low(self.labels, cut), high(self.labels, cut)
        self.norm_lo, self.norm_hi = low(norms, cut), high(norms, cut)
        self.angle_lo, self.angle_hi = low(angles, cut, axis=0), high(angles, cut, axis=0)


def score_bounds(norm: np.ndarray, angles: np.ndarray, rows: _Rows) -> tuple[np.ndarray, np.ndarray]:
    """(lower, upper) bounds of the scores of each anchor with each window, safe for rounding."""
    shape = (len(norm), len(rows.bounds))
    least, most = np.zeros(shape), np.full(shape, np.pi)
    for j in range(angles.shape[1]):
        a, lo, hi = angles[:, j, None].astype(np.float64), rows.angle_lo[:, j] - SLACK, rows.angle_hi[:, j] + SLACK
        np.maximum(least, np.maximum(a - hi, lo - a), out=least)
        s, t = a + lo, a + hi
        np.minimum(most, np.where((s <= np.pi) & (t >= np.pi), np.pi, np.maximum(np.minimum(s, 2 * np.pi - s), np.minimum(t, 2 * np.pi - t))), out=most)
    top, bottom = np.cos(np.clip(least - SLACK, 0, np.pi)), np.cos(np.clip(most + SLACK, 0, np.pi))
    reach = norm[:, None] * rows.norm_hi
    upper = norm[:, None] * np.where(top > 0, rows.norm_hi, rows.norm_lo) * top
    lower = norm[:, None] * np.where(bottom > 0, rows.norm_lo, rows.norm_hi) * bottom
    return lower - 1e-9 * reach - 1, upper + 1e-9 * reach + 1


class _Best:
    """The first `k` rows by score (descending), id and key, of each of `n` searches."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.score, self.id, self.key = np.zeros((n, k), np.int64), np.zeros((n, k), np.int64), np.zeros((n, k), np.int64)
        self.held = np.zeros((n, k), bool)

    def floor(self, at: np.ndarray) -> np.ndarray:
        """What a score must reach to matter."""
        return np.where(self.held[at, -1], self.score[at, -1], LOW)

    def add(self, at: np.ndarray, score: np.ndarray, wanted: np.ndarray, ids: np.ndarray, keys: np.ndarray) -> None:
        """score and wanted: len(at) x len(ids), where ids ascend (ties: keys)."""
        wanted = wanted & (score >= self.floor(at)[:, None])
        some = wanted.any(axis=1)
        if not some.any():
            return
        at, score, wanted = at[some], score[some], wanted[some]
        pick = np.lexsort((np.broadcast_to(np.arange(len(ids)), score.shape), -np.maximum(score, LOW + 1), ~wanted), axis=1)[:, : self.k]
        line = np.arange(len(at))[:, None]
        s = np.concatenate([self.score[at], score[line, pick]], axis=1)
        i, k = np.concatenate([self.id[at], ids[pick]], axis=1), np.concatenate([self.key[at], keys[pick]], axis=1)
        h = np.concatenate([self.held[at], wanted[line, pick]], axis=1)
        first = np.lexsort((k, i, -np.maximum(s, LOW + 1), ~h), axis=1)[:, : self.k]
        self.score[at], self.id[at], self.key[at], self.held[at] = s[line, first], i[line, first], k[line, first], h[line, first]


def _anchors(pdf: pd.DataFrame, dim: int):
    ids, keys, labels = (pdf[c].to_numpy(np.int64) for c in ("vec_id", "key", "label"))
    return ids, keys, labels, _unpacked(pdf["q"].tolist(), dim), pdf["norm"].to_numpy(), np.array(pdf["angles"].tolist(), np.float64).reshape(len(pdf), -1)


def _dims(*frames: pd.DataFrame) -> int:
    return max((len(b) // 2 if b[:1] == b"s" else len(b) // 8 for f in frames for b in f["q"]), default=0)


def find_positives(rows_pdf: pd.DataFrame, anchors_pdf: pd.DataFrame, k: int, floor: np.ndarray | None = None) -> tuple[_Best, int]:
    """The block's first `k` rows of each anchor's label, and how many windows were scored."""
    dim = _dims(rows_pdf, anchors_pdf)
    rows = _Rows(rows_pdf, dim)
    ids, keys, labels, q, norm, angles = _anchors(anchors_pdf, dim)
    _, upper = score_bounds(norm, angles, rows)
    best, scored = _Best(len(ids), k), 0
    floor = np.full(len(ids), LOW, np.int64) if floor is None else floor
    for w in np.argsort(-upper.max(axis=0, initial=0)).tolist():  # likely windows first, so that floors rise early
        lo, hi = rows.bounds[w]
        everyone = np.arange(len(ids))
        need = np.maximum(best.floor(everyone), floor)
        at = np.flatnonzero((labels >= rows.label_lo[w]) & (labels <= rows.label_hi[w]) & (upper[:, w] >= need))
        if len(at):
            scored += len(at)
            s = scores(q[at], rows.q[lo:hi])
            own = (rows.ids[lo:hi] == ids[at, None]) & (rows.keys[lo:hi] == keys[at, None])
            wanted = (rows.labels[lo:hi] == labels[at, None]) & ~own & (s >= floor[at, None])
            best.add(at, s, wanted, rows.ids[lo:hi], rows.keys[lo:hi])
    return best, scored


def find_negatives(rows_pdf: pd.DataFrame, anchors_pdf: pd.DataFrame, k: int) -> tuple[list[_Best], int]:
    """For each place in the anchors' lists of positive scores, the block's first `k` rows of another label
    between 50 and 95 percent of that score."""
    dim = _dims(rows_pdf, anchors_pdf)
    rows = _Rows(rows_pdf, dim)
    ids, keys, labels, q, norm, angles = _anchors(anchors_pdf, dim)
    positives = [np.asarray(p, np.int64) for p in anchors_pdf["scores"]]
    places = max(map(len, positives), default=0)
    p = np.zeros((len(ids), places), np.int64)
    have = np.zeros((len(ids), places), bool)
    for i, x in enumerate(positives):
        p[i, : len(x)], have[i, : len(x)] = x, True
    least, most = -((-p) // 2), p + (-p) // 20
    have &= least <= most
    lower, upper = score_bounds(norm, angles, rows)
    best, scored = [_Best(len(ids), k) for _ in range(places)], 0
    everyone = np.arange(len(ids))
    for w in np.argsort(-upper.max(axis=0, initial=0)).tolist():
        lo, hi = rows.bounds[w]
        other = ~((rows.label_lo[w] == rows.label_hi[w]) & (labels == rows.label_lo[w]))
        live = [have[:, j] & other & (upper[:, w] >= np.maximum(least[:, j], best[j].floor(everyone))) & (lower[:, w] <= most[:, j]) for j in range(places)]
        at = np.flatnonzero(np.logical_or.reduce(live)) if live else []
        if not len(at):
            continue
        scored += len(at)
        s = scores(q[at], rows.q[lo:hi])
        differs = rows.labels[lo:hi] != labels[at, None]
        for j in range(places):
            mine = live[j][at]
            if mine.any():
                a = at[mine]
                t = s[mine]
                best[j].add(a, t, differs[mine] & (t >= least[a, j][:, None]) & (t <= most[a, j][:, None]), rows.ids[lo:hi], rows.keys[lo:hi])
    return best, scored


_ROW = ("vec_id", "key", "label", "q", "norm", "angles")


def _dealt(rows: DataFrame, anchors: DataFrame, blocks: int, groups: int):
    """Rows and anchors, each against every block of the other."""
    sides = rows.select("block", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("part"), *_ROW)
    dealt = anchors.withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))))
    return sides.groupBy("block", "part"), dealt.groupBy("block", "part")


def mine(vectors: DataFrame, divisor: int = 50, positives: int = POSITIVES, negatives: int = NEGATIVES, references: int = REFERENCES) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Anchors are the rows whose vec_id is divisible by `divisor`; scores are whole-number inner products.
    Rows without id, label or a finite vector take no part. Vectors of different lengths are compared as if
    filled with zeros; scores beyond 64 bits count as the nearest 64-bit number. Rows equal in id, label and
    vector are one row; rows that share only the id are several, told apart by a hash of the vector. Equal
    scores go by id, then by that hash. Other columns are ignored; an empty table gives no rows."""
    rows = quantised(vectors)
    refs = _references(rows, references)
    rows = placed(rows, refs)
    blocks = (rows.agg(F.max("block")).first()[0] or 0) + 1
    mine_ = rows.filter(F.col("vec_id") % divisor == 0)
    groups = max(1, -(-mine_.count() // ANCHORS))
    part = F.pmod(F.xxhash64("vec_id", "key"), F.lit(groups)).cast("int").alias("part")
    seeded = written(_seeds(rows, divisor, positives).withColumn("part", part), "anchors")

    def ahead(r: pd.DataFrame, a: pd.DataFrame) -> pd.DataFrame:
        if not len(r) or not len(a):
            return pd.DataFrame({c: np.zeros(0, np.int64) for c in ("vec_id", "key", "id", "other", "score")})
        best, _ = find_positives(r, a, positives, a["floor"].to_numpy(np.int64))
        i, j = np.nonzero(best.held)
        return pd.DataFrame({"vec_id": a["vec_id"].to_numpy()[i], "key": a["key"].to_numpy()[i], "id": best.id[i, j], "other": best.key[i, j], "score": best.score[i, j]})

    r, a = _dealt(rows, seeded, blocks, groups)
    near = r.cogroup(a).applyInPandas(ahead, "vec_id bigint, key bigint, id bigint, other bigint, score bigint")
    order = Window.partitionBy("vec_id", "key").orderBy(F.desc("score"), "id", "other")
    firsts = near.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= positives)
    lists = firsts.groupBy("vec_id", "key").agg(F.sort_array(F.collect_list(F.struct("place", "id", "score"))).alias("p"))
    keyed = written(seeded.join(lists, ["vec_id", "key"]).select("part", *_ROW, F.col("p.id").alias("ids"), F.col("p.score").alias("scores")), "positives")

    def behind(r: pd.DataFrame, a: pd.DataFrame) -> pd.DataFrame:
        names = ("vec_id", "key", "place", "positive_id", "positive_score", "id", "other", "score")
        if not len(r) or not len(a):
            return pd.DataFrame({c: np.zeros(0, np.int64) for c in names})
        out = []
        for place, best in enumerate(find_negatives(r, a, negatives)[0]):
            i, j = np.nonzero(best.held)
            pos = [[a[c].iloc[x][place] for x in i.tolist()] for c in ("ids", "scores")]
            out.append(pd.DataFrame(dict(zip(names, (a["vec_id"].to_numpy()[i], a["key"].to_numpy()[i], np.full(len(i), place), *pos, best.id[i, j], best.key[i, j], best.score[i, j])))))
        return pd.concat(out) if out else pd.DataFrame({c: np.zeros(0, np.int64) for c in names})

    r, a = _dealt(rows, keyed, blocks, groups)
    far = r.cogroup(a).applyInPandas(
        behind, "vec_id bigint, key bigint, place bigint, positive_id bigint, positive_score bigint, id bigint, other bigint, score bigint")
    order = Window.partitionBy("vec_id", "key", "place").orderBy(F.desc("score"), "id", "other")
    ranked = far.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= negatives)
    return ranked.select(
        F.col("vec_id").alias("anchor_id"), "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"))


def _seeds(rows: DataFrame, divisor: int, k: int) -> DataFrame:
    """Anchors with `floor`: the score of their k-th row of the same label in their own block, which their
    positives elsewhere must reach; the least number where the block has fewer."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        a = pdf[pdf["vec_id"] % divisor == 0]
        if not len(a):
            return a[list(_ROW)].assign(floor=np.zeros(0, np.int64))
        best, _ = find_positives(pdf, a, k)
        return a[list(_ROW)].assign(floor=best.floor(np.arange(len(a))))

    return rows.groupBy("block").applyInPandas(run, "vec_id bigint, key bigint, label bigint, q binary, norm double, angles array<float>, floor bigint")
