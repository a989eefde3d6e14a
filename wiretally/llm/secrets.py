"""Secrets: fixed patterns, and strings that a character model finds random.

Two first-order Markov models over characters, one of random strings and one of ordinary
identifiers, give a string its log-likelihood ratio per character. Samples are labelled by the
patterns: values of base matches are random strings; ordinary are, off the base matches, the words,
dotted, underscored and slashed identifiers of the texts, their separator lines, and their words and
numbers joined into names: in camel case, and in small and large letters with a separator. Transition counts are summed over all documents; a model is a
table of 68 x 68 numbers, whatever the corpus holds. The ratio alone decides about a candidate; its
threshold is the least that keeps all but one in 100,000 of the ordinary samples out.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wiretally.llm.common import texts

# The base patterns ---------------------------------------------------
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
HEX_RUN = re.compile(r"[0-9a-f]{16,}")  # what is left of HEX: its matches are whole runs
KINDS = ("assign", "access", "hex", "random")
# -----------------------------------------------------------------------------------
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
IDENTIFIER = re.compile(r"(?<![A-Za-z0-9+/_=.-])[A-Za-z]+(?:[_./-][A-Za-z]+)*(?![A-Za-z0-9+/_=-])|[+/_=-]{2,}")
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
SIZE = len(ALPHABET) + 1  # 0 stands for every other character and for both ends
LEAST_RATIO = 0.0  # nats per character: a candidate must at least be likelier as a random string
FALSE_SHARE = 1e-5
PIECE = 20  # characters of a joined sample
BINS, STEP = 400, 0.05  # thresholds from -10 to 10
SMOOTH = 0.5
_CODE = np.zeros(256, np.uint8)
_CODE[list(ALPHABET.encode())] = np.arange(1, SIZE)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base matches, by start, then kind in table order."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [(m.start(), 2, m.end()) for m in HEX_RUN.finditer(text)]
    return [(KINDS[k], a, b) for a, k, b in sorted(found)]


def _transitions(strings: list[str]) -> np.ndarray:
    codes = _CODE[np.frombuffer(("\n" + "\n".join(strings) + "\n").encode("latin-1", "replace"), np.uint8)].astype(np.int64)
    return np.bincount(codes[:-1] * SIZE + codes[1:], minlength=SIZE * SIZE)


def _values(text: str) -> list[str]:
    out = [m.group(2) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 12]
    return out + [m.group() for m in ACCESS.finditer(text) if len(m.group()) >= 18] + [m.group() for m in HEX_RUN.finditer(text) if not m.group().isdigit()]


def _off(text: str, base) -> str:
    """The text without its base spans."""
    out, at = [], 0
    for _, a, b in base:
        if a >= at:
            out.append(text[at:a])
        at = max(at, b)
    return "\n".join([*out, text[at:]])


_BLANKED = bytes(c if c in ALPHABET[:62].encode() else 32 for c in range(256))
_UNDERSCORE = 1 + ALPHABET.index("_")
_OTHER_SEPARATORS = tuple(1 + ALPHABET.index(c) for c in "-/")


def _names(text: str) -> np.ndarray:
    """Codes of the text's words and numbers (no mixtures of both) joined into long names."""
    words = [w for w in text.encode("latin-1", "replace").translate(_BLANKED).split() if w.isalpha() or w.isdigit()]
    snake = b"_".join(words).lower()
    return _CODE[np.frombuffer(b"\n".join([b"".join([w.capitalize() for w in words]), snake, snake.upper()]), np.uint8)].astype(np.int64)


def _separated(counts: np.ndarray) -> np.ndarray:
    """Counts of joined names with the other separators standing as often as the underscore."""
    grid = counts.reshape(SIZE, SIZE).copy()
    for c in _OTHER_SEPARATORS:
        grid[c] += grid[_UNDERSCORE]
        grid[:, c] += counts.reshape(SIZE, SIZE)[:, _UNDERSCORE]
    return grid.ravel()


def train(docs: DataFrame) -> np.ndarray:
    """Log-likelihood ratio (random over ordinary) of each transition, from all texts."""

    def count(batches):
        total, names = np.zeros((2, SIZE * SIZE), np.int64), np.zeros(SIZE * SIZE, np.int64)
        for b in batches:
            for t in texts(b):
                total[0] += _transitions(v) if (v := _values(t)) else 0
                rest = _off(t, base_spans(t))
                total[1] += _transitions(IDENTIFIER.findall(rest))
                c = _names(rest)
                names += np.bincount(c[:-1] * SIZE + c[1:], minlength=SIZE * SIZE)
        total[1] += _separated(names)
        label, cell = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(label.astype(np.int32)), pa.array(cell.astype(np.int32)), pa.array(total[label, cell])], names=["label", "cell", "n"])

    counts = docs.select("text").mapInArrow(count, "label int, cell int, n bigint").groupBy("label", "cell").agg(F.sum("n").alias("n"))
    table = np.zeros((2, SIZE * SIZE))
    for r in counts.collect():  # at most 2 x SIZE x SIZE rows
        table[r["label"], r["cell"]] = r["n"]
    table = table.reshape(2, SIZE, SIZE)
    # random strings draw any character after any other: a flat share keeps alphabets that no sample shows likely
    flat = np.where(np.arange(SIZE) > 0, 1.0, 0.25) / SIZE
    table[0] = 0.5 * (table[0] + SMOOTH) / (table[0] + SMOOTH).sum(axis=1, keepdims=True) + 0.5 * flat
    table[1] = (table[1] + SMOOTH) / (table[1] + SMOOTH).sum(axis=1, keepdims=True)
    return np.log(table[0]) - np.log(table[1])


def steps(model: np.ndarray, s: str) -> np.ndarray:
    """Log-likelihood ratio of each transition of one string: into its characters, then to its end."""
    c = _CODE[np.frombuffer(s.encode("latin-1", "replace"), np.uint8)]
    c = np.concatenate([[0], c, [0]]).astype(np.int64)
    return model[c[:-1], c[1:]]


def ratio(model: np.ndarray, s: str) -> float:
    """Mean log-likelihood ratio per transition of one string."""
    return float(steps(model, s).mean())


def threshold(docs: DataFrame, model: np.ndarray, share: float = FALSE_SHARE) -> float:
    """The least ratio, not under LEAST_RATIO, that at most `share` of all ordinary samples reach:
    identifiers as long as a candidate, and pieces of the joined names."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # SIZE x SIZE numbers

    def count(batches):
        model, total = sent.value, np.zeros(BINS, np.int64)
        for b in batches:
            for t in texts(b):
                rest = _off(t, base_spans(t))
                c = _names(rest)
                n = max(0, len(c) - 1) // PIECE
                means = [*model[c[:n * PIECE], c[1:n * PIECE + 1]].reshape(n, PIECE).mean(axis=1)] if n else []
                means += [ratio(model, s) for s in IDENTIFIER.findall(rest) if len(s) >= 16]
                at = np.clip(np.asarray(means) / STEP + BINS // 2, 0, BINS - 1).astype(np.int64)
                total += np.bincount(at, minlength=BINS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["bin", "n"])

    total = np.zeros(BINS, np.int64)
    for r in docs.select("text").mapInArrow(count, "bin int, n bigint").groupBy("bin").agg(F.sum("n").alias("n")).collect():  # BINS rows
        total[r["bin"]] = r["n"]
    above = np.concatenate([np.cumsum(total[::-1])[::-1], [0]])  # samples at or above each bin's lower end
    first = int(np.argmax(above <= share * total.sum()))
    return max(LEAST_RATIO, (first - BINS // 2) * STEP)


def random_spans(text: str, base: list[tuple[str, int, int]], model: np.ndarray, least: float = LEAST_RATIO) -> list[tuple[str, int, int]]:
    """Candidates that the models call random: as a whole, and in what lies off the base spans."""
    out, at, reached = [], 0, 0
    for m in CANDIDATE.finditer(text):
        a, b = m.span()
        v, off = steps(model, m.group()), np.ones(b - a, bool)
        off[: max(0, reached - a)] = False  # a span that began before an earlier candidate ended
        while at < len(base) and base[at][1] < b:
            _, x, y = base[at]
            off[max(0, x - a): max(0, y - a)] = False
            reached = max(reached, y)
            at += 1
        if off.any() and v.mean() >= least and v[:-1][off].mean() >= least:
            out.append(("random", a, b))
    return out


def joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def scan(docs: DataFrame, model: np.ndarray | None = None, least: float | None = None) -> DataFrame:
    """(doc_id, spans array<struct<kind, start, end>>) for every row: base spans and random strings,
    by start, then kind; offsets in code points, end exclusive. A null text counts as empty; equal
    rows give equal results; further columns play no part. A random string may hold base spans within
    it, but lies in none. Model and threshold are learned from `docs` where they are not given."""
    model = train(docs) if model is None else model
    least = threshold(docs, model) if least is None else least
    model = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()
    item = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for b in batches:
            out = []
            for t in texts(b):
                base = base_spans(t)
                spans = base + random_spans(t, base, model.value, least)
                out.append([{"kind": k, "start": a, "end": e} for k, a, e in sorted(spans, key=lambda x: (x[1], KINDS.index(x[0])))])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, item)], names=["doc_id", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, spans array<struct<kind:string,start:bigint,end:bigint>>")


def digest(found: DataFrame) -> DataFrame:
    """Counts and digests of scan()'s rows."""
    n = lambda k: F.size(F.filter("spans", lambda s: s.getField("kind") == k)).cast("long")
    text = lambda xs: F.array_join(F.transform(xs, lambda s: F.concat_ws(":", s.getField("kind"), s.getField("start"), s.getField("end"))), ",")
    base = F.filter("spans", lambda s: s.getField("kind") != "random")
    return found.select("doc_id", n("assign").alias("n_assign"), n("access").alias("n_access"), n("hex").alias("n_hex"),
                        F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))
