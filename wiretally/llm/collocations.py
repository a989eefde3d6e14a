"""Phrase collocations from stripes: every prefix keys a counter of the words that follow it.

Tasks count phrases of one length at a time and send a prefix with all its next words as one stripe;
stripes of a prefix are merged word by word where they meet. A merged stripe holds the counts of all
extensions of its prefix; their sum, with the empty word for "anything else", is the prefix's own total;
their largest is how much of the prefix one extension explains. Phrases whose own parts are too rare are
not counted: a phrase is as frequent as its rarest part at most. Which parts are frequent is told by a bit
map of bounded size; a false bit costs time and changes no count. A prefix that holds over one in HEAVY of
all words (HEAVY of them at most) is dealt into lanes by its next words, so that no stripe grows without bound.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wiretally.llm.common import flat, slices, written

LEAST = 30
LONGEST = 4
TOP = 2000
SHARE = 80
BATCH = 1 << 23
STEP = 1 << 21
HEAVY = 2048
MOST_BITS = 27
# ASCII letters are lowered; blank and tab part words, these part pieces
LOWER = bytes.maketrans(bytes(range(65, 91)) + b"\t.,;:!?\x0b\x0c\r", bytes(range(97, 123)) + b" \n\n\n\n\n\n\n\n\n")
_MIX, _ADD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _word_hash(lang: str, words) -> np.ndarray:
    seed = xxhash.xxh64_intdigest(lang.encode("utf-8", "surrogatepass"), 13)
    return np.array([xxhash.xxh64_intdigest(w, seed) for w in words], np.uint64)


def _longer(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hash of a phrase from that of all but its last word and that of its last word."""
    x = (left * _MIX) ^ (right + _ADD)
    x ^= x >> np.uint64(29)
    x *= _ADD
    return x ^ (x >> np.uint64(32))


def _phrase_hash(lang: str, phrase: bytes) -> int:
    h = _word_hash(lang, phrase.split(b" "))
    out = h[:1]
    for w in h[1:]:
        out = _longer(out, np.array([w]))
    return int(out[0])


class _Words:
    """The words of a slice of one language's texts as numbers; 0 is the border of a piece."""

    def __init__(self, data: bytes):
        names: dict[bytes, int] = {b"\n": 0, b"": 1}
        lowered, at, out = data.translate(LOWER), 0, [np.zeros(0, np.int64)]
        while at < len(lowered):  # some words at a time become objects
            end = len(lowered)
            if end - at > STEP:
                cut = lowered.rfind(b" ", at, at + STEP)
                cut = cut if cut > at else lowered.find(b" ", at + STEP)
                end = cut + 1 if cut >= 0 else end
            found = lowered[at:end].replace(b"\n", b" \n ").split(b" ")
            for w in found:
                if w not in names:
                    names[w] = len(names)
            ids = np.array([names[w] for w in found], np.int64)
            out.append(ids[ids != 1])
            at = end
        self.ids = np.concatenate(out)
        self.names = list(names)


def _by_language(batch: pa.RecordBatch):
    """(lang, joined bytes) of slices of the batch; null lang is und."""
    for lo, hi in slices(batch, "text", BATCH):
        part = batch.slice(lo, hi - lo)
        data, offsets = flat(part)
        by: dict[str, list[bytes]] = {}
        raw, at = data.tobytes(), offsets.tolist()
        for i, lang in enumerate(part.column(part.schema.get_field_index("lang")).to_pylist()):
            by.setdefault("und" if lang is None else lang, []).append(raw[at[i]: at[i + 1]])
        for lang, texts in by.items():
            yield lang, b"\n".join(texts)


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, next, f): how often each word occurs; the stripe of the empty prefix, dealt by word."""
    def run(batches):
        for b in batches:
            for lang, data in _by_language(b):
                w = _Words(data)
                counts = np.bincount(w.ids, minlength=len(w.names))
                counts[0] = 0
                some = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(some), pa.string()), pa.array([w.names[i] for i in some], pa.binary()), pa.array(counts[some].astype(np.int64))],
                    names=["lang", "phrase", "f"])

    return _rows(docs).mapInArrow(run, "lang string, phrase binary, f bigint").groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def _bits(frequent: DataFrame, n: int) -> np.ndarray:
    """Bit map of the frequent phrases' hashes, 2**MOST_BITS bits at most, about 16 for each."""
    width = min(MOST_BITS, max(16, int(16 * max(n, 1)).bit_length()))

    def run(batches):
        for b in batches:
            h = np.array([_phrase_hash(*x) for x in zip(b.column(0).to_pylist(), b.column(1).to_pylist())], np.uint64)
            at = (h >> np.uint64(64 - width)).astype(np.int64)
            word, bit = at >> 6, np.left_shift(np.uint64(1), (at & 63).astype(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(bit.view(np.int64))], names=["word", "bit"])

    words = frequent.select("lang", "phrase").mapInArrow(run, "word bigint, bit bigint").groupBy("word").agg(F.bit_or("bit").alias("bits"))
    out = np.zeros(1 << (width - 6), np.uint64)
    got = words.toArrow()  # no more rows than the map has words
    out[got.column(0).to_numpy()] = got.column(1).to_numpy().view(np.uint64)
    return out


def _within(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = h >> np.uint64(64 - 6 - (len(bits).bit_length() - 1))
    return (bits[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def _heavy(frequent: DataFrame, total: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted hashes, lanes) of the phrases that hold over one in HEAVY of all words: HEAVY at most."""
    rows = frequent.filter(F.col("f") > total / HEAVY).select("lang", "phrase", "f").collect()
    found = sorted((_phrase_hash(r["lang"], bytes(r["phrase"])), 1 + r["f"] * HEAVY // total) for r in rows)
    return np.array([h for h, _ in found], np.uint64), np.array([n for _, n in found], np.int64)


def _counted(columns: list[np.ndarray], n_names: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The distinct rows of columns of word numbers, in order, and how often each occurs."""
    used = np.zeros(n_names, bool)
    for c in columns:
        used[c] = True
    number, back = np.cumsum(used) - 1, np.flatnonzero(used)
    width = len(back)
    first, rest = columns[:1], columns[1:]
    key, size, folded = number[first[0]], width, []
    for c in rest:
        if size > (1 << 62) // width:  # no room for another word: what is there gets numbers of its own
            names, key = np.unique(key, return_inverse=True)
            folded.append((names, len(first)))
            size = len(names)
        key, size = key * width + number[c], size * width
        first = [*first, c]
    found, counts = np.unique(key, return_counts=True)
    out: list[np.ndarray] = []
    at = len(columns)
    while at:  # words come off the end
        if folded and folded[-1][1] == at:
            found = folded.pop()[0][found]
        if at == 1:
            out.append(back[found])
        else:
            found, last = np.divmod(found, width)
            out.append(back[last])
        at -= 1
    return out[::-1], counts


def stripes(docs: DataFrame, length: int, bits: np.ndarray, heavy: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(lang, prefix, lane, next, n): phrases of `length` words as stripes of each slice of texts; `next` has the
    next words with a blank between them, `n` their counts, so that a word costs little more than its bytes. A prefix
    that may be frequent brings all its occurrences: those without a next word that may matter count
    under the empty word, in lane 0."""
    sent = docs.sparkSession.sparkContext.broadcast((bits, *heavy))

    def of(lang, w):
        own, hot, lanes = sent.value
        ids, names = w.ids, w.names
        hashes = _word_hash(lang, names)
        k = length - 1
        m = len(ids) - k + 1  # places of prefixes
        if m <= 0:
            return None
        good, h = ids[:m] != 0, hashes[ids[:m]]
        for j in range(1, k):
            good &= ids[j: j + m] != 0
            h = _longer(h, hashes[ids[j: j + m]])
        good &= _within(own, h)
        at = np.flatnonzero(good)
        if not len(at):
            return None
        after = np.where(at + k < len(ids), ids[np.minimum(at + k, len(ids) - 1)], 0)
        # the phrase's last k words are the prefix that begins one place further on
        fits = (after != 0) & (at + 1 < m) & good[np.minimum(at + 1, m - 1)]
        columns = [ids[at + j] for j in range(k)] + [np.where(fits, after, 1)]
        phrases, counts = _counted(columns, len(names))
        h = hashes[phrases[0]]
        for c in phrases[1:k]:
            h = _longer(h, hashes[c])
        after = phrases[k]
        new = np.zeros(len(counts), bool)  # phrases are in order, so a stripe lies together
        new[0] = True
        for c in phrases[:k]:
            new[1:] |= c[1:] != c[:-1]
        if len(hot):
            lane = np.zeros(len(counts), np.int64)
            where = np.minimum(np.searchsorted(hot, h), len(hot) - 1)
            mine = (hot[where] == h) & (after != 1)
            lane[mine] = (hashes[after[mine]] % lanes[where[mine]].astype(np.uint64)).astype(np.int64)
            order = np.lexsort((lane, np.cumsum(new)))
            phrases, counts, after, lane, new = [c[order] for c in phrases], counts[order], after[order], lane[order], new.copy()
            new[1:] = lane[1:] != lane[:-1]
            for c in phrases[:k]:
                new[1:] |= c[1:] != c[:-1]
        else:
            lane = np.zeros(len(counts), np.int64)
        begin = np.flatnonzero(new)
        ends = np.append(begin, len(counts)).astype(np.int32)
        if k == 1:
            prefixes = [names[x] for x in phrases[0][begin].tolist()]
        else:
            prefixes = [b" ".join(w) for w in zip(*[[names[x] for x in c[begin].tolist()] for c in phrases[:k]])]
        words = pa.array(names, pa.binary())
        return pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(begin), pa.string()), pa.array(prefixes, pa.binary()), pa.array(lane[begin]),
             pc.binary_join(pa.ListArray.from_arrays(pa.array(ends), words.take(pa.array(after))), b" "),
             pa.ListArray.from_arrays(pa.array(ends), pa.array(counts.astype(np.int32)))],
            names=["lang", "prefix", "lane", "next", "n"])

    def run(batches):
        for b in batches:
            for lang, data in _by_language(b):
                if (out := of(lang, _Words(data))) is not None:
                    yield out

    return _rows(docs).mapInArrow(run, "lang string, prefix binary, lane bigint, next binary, n array<int>")


def merged(parts: DataFrame, least: int) -> DataFrame:
    """(lang, prefix, total, top, kept): merged stripes, by lane. `total` counts the prefix, `top` is its most
    frequent extension, `kept` has the frequent ones. Lanes are shuffled once; counters are unfolded and
    added where they meet."""
    lane = ["lang", "prefix", "lane"]
    met = parts.repartition(*lane)
    words = F.split(F.col("next").cast("string"), " ").cast("array<binary>").alias("next")
    summed = met.select(*lane, F.inline(F.arrays_zip(words, "n"))).groupBy(*lane, "next").agg(F.sum("n").alias("f"))
    return summed.groupBy(*lane).agg(
        F.sum("f").alias("total"),
        F.max(F.when((F.col("next") != F.lit(b"")) & (F.col("f") >= least), F.col("f"))).alias("top"),
        F.collect_list(F.when((F.col("next") != F.lit(b"")) & (F.col("f") >= least), F.struct("next", "f"))).alias("kept"))


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, share: int = SHARE, longest: int = LONGEST) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's `top` phrases of 2 to `longest` words.

    Words are counted per lang (null: und) within pieces; a null or empty text has none, repeated rows
    count each time, texts of any length are read whole. A phrase with at least `least` occurrences is
    scored at its weakest cut, floor(2000000 a / (l + r)), ties to the shorter first part; it is dropped if
    one that contains it has `share` percent of its occurrences or more. An extension by one word has at
    least the count of any longer phrase around it, so only those are looked at. Other columns are
    ignored; an empty table gives no rows."""
    counts = written(word_counts(docs), "words")
    per_lang = counts.groupBy("lang").agg(F.sum("f").alias("n"))
    total = counts.agg(F.sum("f")).first()[0] or 1
    levels = [written(counts.filter(F.col("f") >= least), "phrases")]
    found = []
    for k in range(2, longest + 1):
        last = levels[-1]
        parts = stripes(docs, k, _bits(last, last.count()), _heavy(last, total))
        rows = written(merged(parts, least), "stripes")
        ext = rows.select("lang", "prefix", F.inline("kept"))
        levels.append(written(ext.select("lang", F.concat_ws(" ", F.col("prefix").cast("string"), F.col("next").cast("string")).cast("binary").alias("phrase"), "f"), "phrases"))
        found.append(rows)
    return _ranked(levels, found, per_lang, least, top, share)


def _ranked(levels: list[DataFrame], found: list[DataFrame], per_lang: DataFrame, least: int, top: int, share: int) -> DataFrame:
    wide = None
    for rows in found[1:]:  # how much of a phrase one extension explains: by the next word and by the word before
        ahead = rows.select("lang", F.col("prefix").alias("inner"), "top")
        behind = rows.select("lang", F.split(F.col("prefix").cast("string"), " ", 2).alias("w"), F.inline("kept")).select(
            "lang", F.concat_ws(" ", F.element_at("w", 2), F.col("next").cast("string")).cast("binary").alias("inner"), F.col("f").alias("top"))
        both = ahead.unionByName(behind)
        wide = both if wide is None else wide.unionByName(both)
    phrases = levels[1]
    for level in levels[2:]:
        phrases = phrases.unionByName(level)
    if wide is not None:
        most = wide.groupBy("lang", "inner").agg(F.max("top").alias("top")).withColumnsRenamed({"lang": "xl"})
        phrases = phrases.join(most, (F.col("lang") == F.col("xl")) & (F.col("phrase") == F.col("inner")), "left")
        phrases = phrases.filter(F.coalesce(100 * F.col("top") < share * F.col("f"), F.lit(True))).select("lang", "phrase", "f")
    words = F.split(F.col("phrase").cast("string"), " ")
    join = lambda a, n: F.array_join(F.slice("w", a, n), " ").cast("binary")
    cuts = phrases.withColumn("w", words).select("lang", "phrase", "f", "w", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "f", "k", join(F.lit(1), F.col("k")).alias("left"), join(F.col("k") + 1, F.size("w") - F.col("k")).alias("right"))
    known, totals = levels[0], None
    for level in levels[1:-1]:
        known = known.unionByName(level)
    for rows in found:
        own = rows.select(F.col("lang").alias("lg"), F.col("prefix").alias("lp"), "total")
        totals = own if totals is None else totals.unionByName(own)
    totals = totals.groupBy("lg", "lp").agg(F.sum("total").alias("l"))  # over lanes
    cuts = cuts.join(totals, (F.col("lang") == F.col("lg")) & (F.col("left") == F.col("lp"))).join(
        known.select(F.col("lang").alias("rg"), F.col("phrase").alias("rp"), F.col("f").alias("r")), (F.col("lang") == F.col("rg")) & (F.col("right") == F.col("rp")))
    # whole numbers of up to 38 digits: the product may pass 64 bits
    score = F.expr("(cast(f as decimal(20,0)) * cast(2000000 as decimal(7,0))) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
    best = cuts.withColumn("score", score.cast("bigint")).groupBy("lang", "phrase", "f").agg(F.min(F.struct("score", "k", "l", "r")).alias("b"))
    rows = best.select("lang", F.col("phrase").cast("string").alias("phrase"), F.col("f").alias("a"), "b.l", "b.r", "b.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    ranked = rows.withColumn("rank", F.row_number().over(order).cast("bigint")).filter(F.col("rank") <= top)
    named = per_lang.withColumnRenamed("lang", "xl")
    return ranked.join(named, F.col("lang") == F.col("xl")).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
