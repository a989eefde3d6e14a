"""Token ids in Simple-8b files.

A dataset is a folder of Parquet files whose rows are segments: some whole documents in ascending
doc_id order, their token counts, and one binary body. A body packs the segment's ids in blocks of
BLOCK ids, each block on its own:

    magic, ids, blocks | word offset of every block, end | escape offset of every block, end | words | escapes

A 64-bit word is a 4-bit selector over 60 bits of payload; the selector says how many ids of which
width the word holds (or that it stands for a run of zeros). The value of all ones is an escape: the id
itself is the next of the block's escapes, so that one large id does not widen its neighbours. With the
two offset tables every block, and so every document, can be decoded without those before it.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from wiretally.llm.common import slices, text_key, texts

BLOCK = 1024
SEGMENT = 1 << 18
BATCH = 1 << 20
MAGIC = 0x31423853
# Ids per word and their width, by selector
TAKES = np.array([240, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
WIDTHS = np.array([0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
# The least id that a lane of the word cannot hold itself; zero runs hold nothing else and have no escapes.
LIMITS = np.array([1, 1] + [(1 << int(w)) - 1 for w in WIDTHS[2:15]] + [1 << 32])
WORST = 1 << 16
JOINED = 4096
#: Names of chunks that cannot be taken for others: what a text begins with, and its end.
FIRST, END = "\0", ""
MARKS = ".,;:!?"
#: A blank at which a text is not cut. Python's letters and numbers are visible to every vocabulary.
UNCUT = re.compile(r" (?![!-~\w])")


def pack(ids: np.ndarray) -> bytes:
    """The body of ids (unsigned 32 bits)."""
    n = len(ids)
    ids = np.ascontiguousarray(ids, np.uint32)
    blocks = -(-n // BLOCK)
    stop = np.minimum(np.arange(1, blocks + 1) * BLOCK, n)
    # where few ids are small, selectors of narrow lanes are not tried
    tried = np.arange(16 if 8 * np.count_nonzero(ids < np.uint32(LIMITS[6])) >= n else 10)[::-1]
    tried = 15 - tried
    over = np.zeros((len(tried), n + 1), np.int32)  # how many ids before a place a selector cannot hold
    for line, s in enumerate(tried.tolist()):
        if s < 15:
            np.cumsum(ids >= np.uint32(LIMITS[s]), out=over[line, 1:], dtype=np.int32)
    zeros = np.count_nonzero(tried < 2)
    over, width = over.ravel(), n + 1
    at, live = np.arange(blocks) * BLOCK, np.arange(blocks)
    where, chosen, owner = [], [], []
    rows, takes = np.arange(len(tried))[:, None] * width, TAKES[tried][:, None]
    while len(live):  # one word of every unfinished block at a time
        end = np.minimum(at + takes, stop[live])
        cost = over[rows + end]
        cost -= over[rows + at]
        cost[:zeros] *= WORST
        cost *= 4
        cost += 8
        best = (cost / (end - at).astype(np.float32)).argmin(axis=0)
        where.append(at)
        chosen.append(tried[best])
        owner.append(live)
        at = end[best, np.arange(len(live))]
        if (at >= stop[live]).any():
            left = at < stop[live]
            at, live = at[left], live[left]
    where, chosen, owner = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (where, chosen, owner))
    order = np.argsort(where, kind="stable")
    where, chosen, owner = where[order], chosen[order], owner[order]
    words = chosen.astype(np.uint64) << np.uint64(60)
    escaped = np.zeros(n, bool)
    padded = np.concatenate([ids, np.zeros(240, np.uint32)]).astype(np.uint64)
    for s in range(2, 16):
        mine = np.flatnonzero(chosen == s)
        if not len(mine):
            continue
        places = where[mine][:, None] + np.arange(TAKES[s])
        inside = places < stop[owner[mine]][:, None]
        values = np.where(inside, padded[places], 0)
        if s < 15:
            wide = values >= LIMITS[s]
            escaped[places[wide]] = True
            values[wide] = LIMITS[s]
        shifts = (np.arange(TAKES[s]) * WIDTHS[s]).astype(np.uint64)
        words[mine] |= np.bitwise_or.reduce(values << shifts, axis=1)
    held = np.flatnonzero(escaped)
    starts = np.arange(blocks + 1) * BLOCK
    offsets = np.concatenate([np.searchsorted(owner, np.arange(blocks + 1)), np.searchsorted(held, starts)])
    head = np.concatenate([[MAGIC, n, blocks], offsets]).astype("<u4")
    return head.tobytes() + words.astype("<u8").tobytes() + ids[held].astype("<u4").tobytes()


def unpack(body: bytes, first: int = 0, last: int | None = None) -> np.ndarray:
    """Ids first to last (exclusive; None: to the end) of a body; only the blocks that hold them are decoded."""
    magic, n, blocks = np.frombuffer(body, "<u4", 3).tolist()
    if magic != MAGIC:
        raise ValueError("not a token body")
    last = n if last is None else last
    if first >= last:
        return np.zeros(0, np.uint32)
    word_at = np.frombuffer(body, "<u4", blocks + 1, 12).astype(np.int64)
    escape_at = np.frombuffer(body, "<u4", blocks + 1, 16 + 4 * blocks).astype(np.int64)
    base = 20 + 8 * blocks
    lo, hi = first // BLOCK, -(-last // BLOCK)
    words = np.frombuffer(body, "<u8", word_at[hi] - word_at[lo], base + 8 * word_at[lo])
    escapes = np.frombuffer(body, "<u4", escape_at[hi] - escape_at[lo], base + 8 * word_at[-1] + 4 * escape_at[lo])
    selector = (words >> np.uint64(60)).astype(np.int64)
    takes = TAKES[selector]
    upto = np.concatenate([[0], np.cumsum(takes)])
    begin = word_at[lo:hi] - word_at[lo]
    # every block gets room for what its last word holds beyond its end
    place = upto[:-1] - np.repeat(upto[begin] - np.arange(hi - lo) * (BLOCK + 240), np.diff(np.append(begin, len(words))))
    out = np.zeros((hi - lo) * (BLOCK + 240), np.uint32)
    marked = np.zeros(len(out), bool)
    for s in range(2, 16):
        mine = np.flatnonzero(selector == s)
        if not len(mine):
            continue
        shifts = (np.arange(TAKES[s]) * WIDTHS[s]).astype(np.uint64)
        values = ((words[mine][:, None] >> shifts) & np.uint64((1 << int(WIDTHS[s])) - 1)).astype(np.uint32)
        places = place[mine][:, None] + np.arange(TAKES[s])
        out[places] = values
        if s < 15:
            marked[places[values == LIMITS[s]]] = True
    rows = out.reshape(hi - lo, BLOCK + 240)[:, :BLOCK].ravel()
    rows[np.flatnonzero(marked.reshape(hi - lo, BLOCK + 240)[:, :BLOCK].ravel())] = escapes
    return rows[first - lo * BLOCK: last - lo * BLOCK]


class Encoder:
    """Ids of whole texts by the tokenizers library, which is asked once for every distinct chunk.

    In a plain byte-level vocabulary a piece never reaches across a blank that a visible character follows,
    so a text may be cut there and its chunks encoded one by one. Other vocabularies get whole texts."""

    def __init__(self, spec: str):
        self.library = Tokenizer.from_str(spec)
        model = json.loads(spec)
        pre = model.get("pre_tokenizer") or {}
        specials = model.get("added_tokens", [])
        self.cuts = (
            model["model"]["type"] == "BPE" and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
            and not model.get("normalizer") and not any(" " in t["content"] or t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in specials)
        )
        # a letter of a byte-level vocabulary stands for one byte
        size = {i: len(t) for t, i in model["model"]["vocab"].items()} if self.cuts else {}
        size |= {t["id"]: len(t["content"].encode()) for t in specials}
        self.bytes = np.zeros(max(size, default=0) + 1, np.int64)
        self.bytes[list(size)] = list(size.values())
        self.marks = {c: self.library.encode(c, add_special_tokens=False).ids[0] for c in MARKS}
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.end = None
        self.flat, self.starts, self.used = np.zeros(1 << 16, np.uint32), array("q", [0]), 0

    def chunks(self, text: str) -> list[str]:
        """Names of a text's chunks: the first with FIRST before it, the others without their blank."""
        if not self.cuts:
            return [FIRST + text]
        parts = text.split(" ")
        parts[0] = FIRST + parts[0]
        if UNCUT.search(text):  # a blank that white space or nothing follows stays with what is before it
            out = parts[:1]
            for c in parts[1:]:
                if UNCUT.match(" " + c):
                    out[-1] += " " + c
                else:
                    out.append(c)
            return out
        return parts

    def keep(self, ids: np.ndarray) -> int:
        """Puts ids behind those of all known chunks; the place where they begin."""
        at = self.used
        if at + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(len(self.flat), len(ids)), np.uint32)])
        self.flat[at: at + len(ids)] = ids
        self.used += len(ids)
        return at

    def learn(self, new: list[str]) -> None:
        """A mark behind a letter or number begins a piece: such chunks take the ids of what is before the mark."""
        marked = [c for c in new if c[-1] in MARKS and len(c) > 1 and c[-2].isalnum()] if self.cuts else []
        if not marked:
            return self.ask(new)
        known = self.known
        self.ask(list({*new, *(c[:-1] for c in marked)}.difference(known, marked)))
        starts = np.array(self.starts, np.int64)
        base = np.array([known[c[:-1]] for c in marked], np.int64)
        n = starts[base + 1] - starts[base]
        ends = np.cumsum(n + 1)
        ids = np.empty(int(ends[-1]), np.uint32)
        ids[ends - 1] = [self.marks[c[-1]] for c in marked]
        place = np.ones(len(ids), bool)
        place[ends - 1] = False
        ids[place] = self.flat[np.arange(int(n.sum())) + np.repeat(starts[base] - (np.cumsum(n) - n), n)]
        first = len(self.starts) - 1
        at = self.keep(ids)
        known.update(zip(marked, range(first, first + len(marked))))
        self.starts.extend((ends + at).tolist())

    def ask(self, new: list[str]) -> None:
        """Firsts go to the library one by one, the others joined: a chunk's share of the ids is told by their bytes."""
        firsts, others = [c for c in new if c[0] == FIRST], [c for c in new if c[0] != FIRST]
        for i in range(0, len(firsts), 256):
            part = firsts[i: i + 256]
            for c, e in zip(part, self.library.encode_batch_fast([c[1:] for c in part], add_special_tokens=False)):
                self.keep(np.array(e.ids, np.uint32))
                self.known[c] = len(self.starts) - 1
                self.starts.append(self.used)
        for i in range(0, len(others), JOINED):
            group = others[i: i + JOINED]
            text = " " + " ".join(group)
            ids, data = np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32), text.encode("utf-8", "surrogatepass")
            ends = np.append(np.flatnonzero(np.frombuffer(data, np.uint8) == 32)[1:], len(data))
            if len(ends) != len(group):  # some chunk has a blank in it
                ends = np.cumsum([len(c.encode("utf-8", "surrogatepass")) + 1 for c in group])
            upto = np.cumsum(self.bytes[ids])
            cut = np.searchsorted(upto, ends)
            if upto[-1] != len(data) or (upto[cut] != ends).any():
                raise ValueError("a token reaches across a blank")
            self.known.update(zip(group, range(len(self.starts) - 1, len(self.starts) - 1 + len(group))))
            self.starts.extend((cut + 1 + self.keep(ids)).tolist())

    def encode(self, batch: list[str], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, ids of each text), each text with its end id."""
        if len(self.known) > 1 << 19 or self.used > 1 << 23 or self.end != end_id:
            self.clear()
            self.keep(np.array([end_id], np.uint32))
            self.starts.append(1)
            self.known[END], self.end = 0, end_id
        names: list[str] = []
        upto = np.empty(len(batch) + 1, np.int64)
        upto[0] = 0
        for i, t in enumerate(batch):
            names += self.chunks(t)
            names.append(END)
            upto[i + 1] = len(names)
        known = self.known
        new = set(names).difference(known)
        if new:
            self.learn(list(new))
        which = np.fromiter(map(known.__getitem__, names), np.int64, len(names))
        starts = np.array(self.starts, np.int64)
        n = np.diff(starts)[which]
        place = np.concatenate([[0], np.cumsum(n)])
        ids = self.flat[np.arange(place[-1]) + np.repeat(starts[which] - place[:-1], n)]
        return ids, np.diff(place[upto])


@lru_cache(maxsize=1)
def _encoder(spec: str) -> Encoder:
    return Encoder(spec)


def write_tokens(docs: DataFrame, tokenizer: str, folder: str, end_id: int = 0, text: str = "text") -> None:
    """Writes the ids of every whole text (null: empty), each followed by `end_id`, to `folder`.

    Files ascend in doc_id, null first; rows that share one ascend in a hash of their text, and equal
    rows follow one another in any order. Partitions are ranges of (doc_id, hash, row), so a doc_id that
    many rows share is split too. `tokenizer` is the path of a tokenizers .json file; the driver reads
    it and tasks get its contents. A task holds one slice of texts, or the ids of one text if that is larger. Other columns are ignored;
    an empty table gives an empty dataset."""
    with open(tokenizer, encoding="utf-8") as f:
        sent = docs.sparkSession.sparkContext.broadcast(f.read())  # as large as the file
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.col(text).alias("text"), text_key(text).alias("key")).withColumn("row", F.monotonically_increasing_id())
    placed = rows.repartitionByRange(F.asc_nulls_first("doc_id"), "key", "row").sortWithinPartitions(F.asc_nulls_first("doc_id"), "key").select("doc_id", "text")
    schema = f"part int, segment int, first bigint, n_ids bigint, doc_ids array<{kind}>, counts array<bigint>, body binary"
    arrow = pa.schema([("part", pa.int32()), ("segment", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int64())])

    def run(batches):
        encoder, part = _encoder(sent.value), TaskContext.get().partitionId()
        segment, first, held, n_held = 0, 0, [], 0

        def close():
            nonlocal segment, first, held, n_held
            ids, counts = np.concatenate([x[1] for x in held]), np.concatenate([x[2] for x in held])
            names = pa.concat_arrays([x[0] for x in held])
            row = [pa.array([v], t) for v, t in zip((part, segment, first, len(ids)), arrow.types)]
            lists = [pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v) for v in (names, pa.array(counts, pa.int64()))]
            out = pa.RecordBatch.from_arrays([*row, *lists, pa.array([pack(ids)], pa.binary())], names=[*arrow.names, "doc_ids", "counts", "body"])
            segment, first, held, n_held = segment + 1, first + len(ids), [], 0
            return out

        for b in batches:
            for lo, hi in slices(b, "text", BATCH):
                piece = b.slice(lo, hi - lo)
                if not len(piece):
                    continue
                ids, counts = encoder.encode(texts(piece), end_id)
                upto = np.cumsum(counts)
                at = 0
                while at < len(counts):  # whole documents until a segment is full
                    done = int(upto[at - 1]) if at else 0
                    take = max(at + 1, int(np.searchsorted(upto, done + SEGMENT - n_held, "right")))
                    held.append((piece.column(0).slice(at, take - at), ids[done: int(upto[take - 1])], counts[at:take]))
                    n_held += int(upto[take - 1]) - done
                    at = take
                    if n_held >= SEGMENT or at < len(counts):
                        yield close()
        if held:
            yield close()

    placed.mapInArrow(run, schema).write.option("compression", "zstd").parquet(folder)


def _segments(spark: SparkSession, folder: str) -> DataFrame:
    """Segments with `start`, the ids of all files' segments before them. One row per file is ranked and broadcast."""
    rows = spark.read.parquet(folder)
    per = rows.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = per.select(F.col("part").alias("p"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return rows.join(F.broadcast(starts), F.col("part") == F.col("p")).select(
        (F.col("before") + F.col("first")).alias("start"), "doc_ids", "counts", "body")


def _by_document(segments: DataFrame, last: str, kind: pa.DataType, value) -> DataFrame:
    """(doc_id, start, n_tokens, `last`) of every document; value(ids) gives the last column."""
    doc = segments.schema["doc_ids"].dataType.elementType.simpleString()

    def run(batches):
        for b in batches:
            for i in range(len(b)):
                start, names, counts, body = (b.column(j)[i] for j in range(4))
                counts = counts.values.to_numpy(zero_copy_only=False)
                ids = unpack(body.as_py()).astype("<u4", copy=False)
                upto = np.concatenate([[0], np.cumsum(counts)]).tolist()
                found = pa.array([value(ids[x:y]) for x, y in zip(upto, upto[1:])], kind)
                yield pa.RecordBatch.from_arrays(
                    [names.values, pa.array(np.array(upto[:-1], np.int64) + start.as_py()), pa.array(counts, pa.int64()), found],
                    names=["doc_id", "start", "n_tokens", last.split()[0]])

    return segments.mapInArrow(run, f"doc_id {doc}, start bigint, n_tokens bigint, {last}")


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document of a written folder, end ids included;
    `start` counts the ids of all documents before it."""
    return _by_document(_segments(spark, folder), "ids array<bigint>", pa.list_(pa.int64()), lambda ids: ids)


def read_digests(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32): as `read_tokens`, the ids as the CRC-32 of their unsigned
    32-bit little-endian values."""
    return _by_document(_segments(spark, folder), "ids_crc32 bigint", pa.int64(), lambda ids: zlib.crc32(ids.tobytes()))
