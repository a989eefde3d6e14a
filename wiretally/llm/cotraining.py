"""Quality classifier by co-training of a text view and a page-metadata view.

Two logistic models learn from labelled documents: one sees what the text says (shapes of words,
marks, repetition and hashed words), the other only what is known about the page (source, language,
length, layout). In each round both score every unlabelled document and each hands the other its most
confident ones with their labels. At the end either view is calibrated on labelled rows that no
model saw, and the two calibrated views are combined for all documents.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wiretally.llm.common import text_key, texts, written

WORDS = 128
#: The models are fitted on at most this many labelled rows, those with the least hashes; and each
#: view hands over one text of either label per round for so many of them.
MAX_LABELLED = 20_000
LABELLED_PER_HANDED = 8
ROUNDS = 3
_MARKS = "!?*#$%&|<>{}[]@"


def _bucket(word: str) -> int:
    return zlib.crc32(word.lower().encode("utf-8", "surrogatepass")) % WORDS


def text_features(text: str, known: dict[str, int]) -> np.ndarray:
    words = text.split()
    n = len(words)
    out = np.zeros(10 + WORDS, np.float32)
    if not n:
        return out
    try:
        ids = [known[w] for w in words]
    except KeyError:
        for w in words:
            if w not in known:
                known[w] = _bucket(w)
        ids = [known[w] for w in words]
    chars = len(text)
    marks = chars - len(text.translate(_DROP))
    distinct = len(set(words))
    lines = [x for x in text.split("\n") if x.strip()]
    out[:10] = (
        np.log1p(n) / 5, (chars - n) / n / 10, marks / n, distinct / n, sum(map(str.isupper, words)) / n,
        1 - len(set(lines)) / max(1, len(lines)), len(set(zip(words, words[1:]))) / n, sum(map(str.isdigit, words)) / n,
        sum(map(str.isalpha, words)) / n, sum(map(str.istitle, words)) / n)
    out[10:] = np.bincount(ids, minlength=WORDS) / n * 4
    return out


_DROP = {ord(c): None for c in _MARKS}


def page_features(text: str, source: str | None, lang: str | None, n_chars) -> np.ndarray:
    out = np.zeros(5 + 32, np.float32)
    lines = text.count("\n") + 1
    n = float(n_chars) if n_chars is not None else 0.0
    out[:5] = (np.log1p(max(n, 0.0)) / 8, np.log1p(lines) / 4, n / lines / 500, len(text.encode("utf-8", "surrogatepass")) / max(1, len(text)) - 1, n_chars is None)
    out[5 + zlib.crc32(("s" + (source or "")).encode()) % 16] = 1
    out[21 + zlib.crc32(("l" + (lang or "")).encode()) % 16] = 1
    return out


def features(docs: DataFrame) -> DataFrame:
    """(doc_id, key, h, said, page): both views of every document; h orders rows at random."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        known: dict[str, int] = {}
        for b in batches:
            source, lang, n_chars = (b.column(i).to_pylist() for i in (4, 5, 6))
            own = texts(b)
            said = np.concatenate([text_features(t, known) for t in own]) if own else np.empty(0, np.float32)
            page = np.concatenate([page_features(t, *x) for t, *x in zip(own, source, lang, n_chars)]) if own else np.empty(0, np.float32)
            if len(known) > 1 << 20:
                known.clear()
            rows = lambda flat, width: pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, width, dtype=np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), b.column(2), rows(said, 10 + WORDS), rows(page, 37)], names=["doc_id", "key", "h", "said", "page"])

    asked = docs.select("doc_id", text_key().alias("key"), F.xxhash64(F.lit(11), "doc_id", "text").alias("h"), "text", "source", "lang", "n_chars")
    return asked.mapInArrow(run, f"doc_id {kind}, key bigint, h bigint, said array<float>, page array<float>")


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 25) -> np.ndarray:
    """Ridge logistic regression by Newton steps; weights with the constant last."""
    x = np.hstack([x, np.ones((len(x), 1))]).astype(np.float64)
    w = np.zeros(x.shape[1])
    keep = np.full(len(w), ridge)
    keep[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        v = np.maximum(p * (1 - p), 1e-6)
        move = np.linalg.solve((x * v[:, None]).T @ x + np.diag(keep), x.T @ (y - p) - keep * w)
        w += np.clip(move, -5, 5)
        if np.abs(move).max() < 1e-6:
            break
    return w


def logits(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return np.clip(x @ w[:-1] + w[-1], -30, 30)


def score_views(rows: DataFrame, said: np.ndarray, page: np.ndarray) -> DataFrame:
    """Adds the logits z_said and z_page; the models have one number per feature."""
    schema = rows.drop("said", "page").withColumns({"z_said": F.lit(0.0), "z_page": F.lit(0.0)}).schema
    names = schema.names[:-2]

    def run(batches):
        for b in batches:
            grid = lambda n: b.column(b.schema.get_field_index(n)).flatten().to_numpy(zero_copy_only=False).reshape(len(b), -1)  # noqa: E731, B023
            if len(b):
                columns = [b.column(b.schema.get_field_index(n)) for n in names]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(logits(grid("said"), said)), pa.array(logits(grid("page"), page))], names=[*names, "z_said", "z_page"])

    return rows.mapInArrow(run, schema)


def _grids(rows: DataFrame, *more: str):
    """A bounded set of rows on the driver: both views as matrices, and further columns."""
    got = rows.select("said", "page", *more).toArrow().combine_chunks()
    n = got.num_rows
    grid = lambda c: got.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.empty((0, 1))
    return grid("said"), grid("page"), *[got.column(c).to_numpy() for c in more]


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality", rounds: int = ROUNDS, handed: int | None = None, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """(doc_id, p_text, p_page, score, keep) for every row of `docs`; probabilities of a good document.

    A null text counts as empty, null metadata as values of their own. Documents with several labels
    take part with their mean, rounded. Without labelled documents of both kinds nothing can be
    learned: the score is their share of good ones, 0.5 if there are none. With few labels the models
    learn from all of them where the three tenths set apart for calibration would leave one kind only.
    A view hands over different texts, however often each is repeated: the most confident ones, as
    many as `handed` says (one for each LABELLED_PER_HANDED rows fitted on). `keep` is score >= 0.5."""
    told = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.round(F.avg(F.col(label).cast("double"))).cast("int").alias("y"))
    feats = written(features(docs).join(told, "doc_id", "left"), "views")  # the only shuffle of features
    rows = written(feats.filter("y is not null").orderBy("h", "key").limit(max_labelled), "labelled")
    said, page, y, h = _grids(rows, "y", "h")
    prior = float(y.mean()) if len(y) else 0.5
    free = feats.filter("y is null")
    both = lambda v: len(v) > 0 and v.min() != v.max()
    if not both(y):
        flat = F.lit(prior)
        return feats.select("doc_id", flat.alias("p_text"), flat.alias("p_page"), flat.alias("score"), (flat >= 0.5).alias("keep"))
    apart = np.arange(len(y)) % 10 < 3  # rows are in hash order
    held = [said[apart], page[apart], y[apart]]
    if not both(y[~apart]):
        apart = np.zeros(len(y), bool)
    handed = handed or -(-len(y) // LABELLED_PER_HANDED)
    sets = {"said": [said[~apart], y[~apart]], "page": [page[~apart], y[~apart]]}
    models = {v: fit(*sets[v]) for v in sets}
    given: set[tuple] = set()
    for _ in range(rounds):
        scored = score_views(free.select("h", "key", "said", "page", F.col("said").alias("s"), F.col("page").alias("p")), models["said"], models["page"])
        scored = written(scored.select("h", "key", F.col("s").alias("said"), F.col("p").alias("page"), "z_said", "z_page").filter(
            (F.abs("z_said") > 2) | (F.abs("z_page") > 2)), "confident")
        fresh = 0
        for view, other in (("said", "page"), ("page", "said")):
            for sign, value in ((1, 1), (-1, 0)):
                # each text once, by its most confident row; only keys and logits are shuffled
                sure = scored.select("key", "h", (F.col(f"z_{view}") * sign).alias("z")).filter("z > 2")
                different = sure.groupBy("key").agg(F.max(F.struct("z", "h")).alias("m")).select("key", "m.z", "m.h")
                most = F.broadcast(different.orderBy(F.desc("z"), "key").limit(handed).drop("z"))  # at most `handed` rows
                rows = scored.join(most, ["key", "h"]).dropDuplicates(["key", "h"]).orderBy("h", "key")
                s, p, hs = _grids(rows, "key")
                new = [i for i, k in enumerate(hs.tolist()) if (other, k) not in given]
                given |= {(other, hs[i]) for i in new}
                x = (s if other == "said" else p)[new] if new else None
                if x is not None:
                    sets[other] = [np.vstack([sets[other][0], x]), np.concatenate([sets[other][1], np.full(len(new), value)])]
                    fresh += len(new)
        if not fresh:
            break
        models = {v: fit(*sets[v]) for v in sets}
    z = [logits(held[0], models["said"]), logits(held[1], models["page"])]
    line = [fit(v[:, None], held[2], ridge=1e-2) for v in z] if both(held[2]) else [np.array([1.0, 0.0])] * 2
    tuned = [v * w[0] + w[1] for v, w in zip(z, line)]
    base = float(np.log(prior / (1 - prior)))
    calm = [line[0][0], line[0][1], line[1][0], line[1][1]]
    out = score_views(feats.select("doc_id", "said", "page"), models["said"], models["page"])
    a, b = F.col("z_said") * float(calm[0]) + float(calm[1]), F.col("z_page") * float(calm[2]) + float(calm[3])
    p = lambda x: 1 / (1 + F.exp(-x))
    # views that err apart: their evidence adds, the prior counts once
    out = out.select("doc_id", p(a).alias("p_text"), p(b).alias("p_page"), p(a + b - F.lit(base)).alias("score"))
    assert all(np.isfinite(t).all() for t in tuned)
    return out.withColumn("keep", F.col("score") >= 0.5)
