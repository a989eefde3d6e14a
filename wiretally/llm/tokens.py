"""Token counts of byte-level BPE by compiled finite-state transducers.

Two transducers count the tokens of a text:

* The splitter reads character classes and marks where a piece (the unit within which merges happen)
  begins. It is a dense table. A text is cut into chunks; each chunk is run from all states at once,
  which gives its state map; maps are composed by a parallel prefix scan, which gives the true state
  at every chunk's start, and a second run marks the borders.
* The merger reads the bytes of a piece. Its states stand for the token borders that may still
  change; an arc carries by how much the byte changes the number of tokens, so a piece's count is the
  sum over its path. States are built when first reached: the last token of every prefix is the one
  longest-suffix token that the merges would leave beside the token before it.
"""

from __future__ import annotations

import json
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import pre_tokenizers

from wiretally.llm.common import slices, texts

CHUNK = 256  # characters whose map is one element of the scan
BATCH = 1 << 22

# Character classes of the splitting pattern
# 's|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+
OTHER, LETTER, NUMBER, BLANK, WHITE = range(5)


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """Class by code point, by Python's character table. Code points that it does not know yet are put
    to the library, whose table may be newer."""
    out, later = np.zeros(0x110000, np.uint8), []
    for c in range(0x110000):
        k = unicodedata.category(chr(c))
        if k[0] == "L":
            out[c] = LETTER
        elif k[0] == "N":
            out[c] = NUMBER
        elif k[0] == "Z" or c in (9, 10, 11, 12, 13, 0x85):
            out[c] = WHITE
        elif k == "Cn" and c < 0x40000:  # the planes beyond hold no character in any version
            later.append(c)
    out[32] = BLANK
    split = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
    for lo in range(0, len(later), 4096):
        block = later[lo: lo + 4096]
        begins = {span[0] for _, span in split.pre_tokenize_str("\n".join(f"a{chr(c)}1" for c in block))}
        for i, c in enumerate(block):  # a letter joins the letter before it, a number the number after it
            out[c] = LETTER if 4 * i + 1 not in begins else NUMBER if 4 * i + 2 not in begins else OTHER
    return out


START, L, N, O, W, JOIN, TWO, ONE = range(8)  # START: whatever comes next begins a piece
# symbols: class 0-2, apostrophe of a contraction of two or three characters, white space by what follows, a cut
S_OTHER, S_LETTER, S_NUMBER, S_TWO, S_THREE, S_RUN, S_BLANK, S_LAST, S_CUT = range(9)


@lru_cache(maxsize=1)
def _splitter() -> tuple[np.ndarray, np.ndarray]:
    """(next state, whether a piece begins) by symbol and state."""
    step, begin = np.zeros((9, 8), np.uint8), np.ones((9, 8), bool)
    for s in range(8):
        for sym, state in ((S_OTHER, O), (S_LETTER, L), (S_NUMBER, N)):
            step[sym, s], begin[sym, s] = state, s not in (state, JOIN)
        step[S_TWO, s], step[S_THREE, s] = (O, O) if s in (O, JOIN) else (ONE, TWO)
        begin[S_TWO, s] = begin[S_THREE, s] = s not in (O, JOIN)
        step[S_RUN, s], begin[S_RUN, s] = W, s != W
        step[S_BLANK, s], step[S_LAST, s], step[S_CUT, s] = JOIN, START, START
    step[S_LETTER, TWO], begin[S_LETTER, TWO] = ONE, False
    step[S_LETTER, ONE], begin[S_LETTER, ONE] = START, False
    return step, begin


def _symbols(table: np.ndarray, codes: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Symbols of code points; `cuts` are the places of separators between texts."""
    kind = table[codes]
    sym = kind.copy()
    white = kind >= BLANK
    after = np.empty(len(codes), bool)  # something other than white space follows in the same text
    after[:-1] = ~white[1:]
    after[-1:] = False
    cut = np.zeros(len(codes), bool)
    cut[cuts] = True
    after[:-1] &= ~cut[1:]
    sym[white] = S_RUN
    sym[white & after] = S_LAST
    sym[white & after & (kind == BLANK)] = S_BLANK
    quote = np.flatnonzero(codes == 39)
    if len(quote):
        ahead = np.concatenate([codes, np.zeros(2, codes.dtype)])
        one, two = ahead[quote + 1], ahead[quote + 2]
        sym[quote[np.isin(one, [ord(c) for c in "stmd"])]] = S_TWO
        pair = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        sym[quote[pair]] = S_THREE
    sym[cut] = S_CUT
    return sym


def borders(table: np.ndarray, codes: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Places where a piece begins (a cut counts as one)."""
    step, begin = _splitter()
    n = len(codes)
    rows = max(1, -(-n // CHUNK))
    sym = np.full(rows * CHUNK, S_CUT, np.uint8)
    sym[:n] = _symbols(table, codes, cuts)
    sym = np.ascontiguousarray(sym.reshape(rows, CHUNK).T)
    steps, begins = step.ravel(), begin.ravel()
    base = sym * np.uint8(8)
    # State maps. After S_BLANK, S_LAST or S_CUT every state is the same one, so the map of a chunk with
    # such a symbol is constant and one run gives it; only the others are run from every state.
    state = np.zeros(rows, np.uint8)
    for j in range(CHUNK):
        state = steps[base[j] + state]
    maps = np.repeat(state[:, None], 8, axis=1)
    odd = np.flatnonzero(~(((sym == S_BLANK) | (sym >= S_LAST)).any(axis=0)))
    if len(odd):
        m, own = np.tile(np.arange(8, dtype=np.uint8), (len(odd), 1)), base[:, odd]
        for j in range(CHUNK):
            m = steps[own[j][:, None] + m]
        maps[odd] = m
    far = 1
    while far < rows:  # inclusive scan: map i becomes the composition of maps 0 to i
        maps[far:] = np.take_along_axis(maps[far:], maps[:-far], axis=1)
        far *= 2
    state = np.concatenate([[START], maps[:-1, START]]).astype(np.uint8)
    out = np.empty((CHUNK, rows), bool)
    for j in range(CHUNK):
        at = base[j] + state
        out[j] = begins[at]
        state = steps[at]
    return np.flatnonzero(out.T.ravel()[:n])


def _byte_letters() -> dict[str, int]:
    """The printable letter that the vocabulary file uses for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in plain}
    return out | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}


class Merger:
    """Transducer over the bytes of a piece; arcs carry changes of the token count."""

    def __init__(self, spec: str, table: np.ndarray):
        self.table = table
        model = json.loads(spec)
        letters = _byte_letters()
        raw = lambda s: bytes(letters[c] for c in s)
        self.rank: dict[tuple[bytes, bytes], int] = {}
        for i, m in enumerate(model["model"]["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            self.rank[raw(a), raw(b)] = i
        special = {t["content"] for t in model["added_tokens"]}
        self.tokens = {raw(t) for t in model["model"]["vocab"] if t not in special}
        self.prefixes = {t[:i] for t in self.tokens for i in range(1, len(t))}  # of longer tokens
        self.beside: dict[tuple[bytes, bytes], bool] = {}
        # a state: for every place where a token may still begin, (bytes since, last token before, count before - count now)
        self.names: dict[tuple, int] = {((b"", b"", 0),): 0}
        self.states: list[tuple] = [((b"", b"", 0),)]
        self.arcs: list[dict[int, tuple[int, int]]] = [{}]
        self.known: dict[str, int] = {}

    def merged(self, word: bytes) -> list[bytes]:
        parts = [word[i: i + 1] for i in range(len(word))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.rank.get((parts[i], parts[i + 1]), 1 << 60))
            if (parts[best], parts[best + 1]) not in self.rank:
                break
            parts[best: best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def stays(self, a: bytes, b: bytes) -> bool:
        """Whether the merges leave token b as it is after token a (or at the start)."""
        key = (a, b)
        if key not in self.beside:
            self.beside[key] = self.merged(a + b) == ([a, b] if a else [b])
        return self.beside[key]

    def arc(self, state: int, byte: int) -> tuple[int, int]:
        c, live, last, count = bytes((byte,)), [], None, 0
        for since, before, lag in self.states[state]:
            s = since + c
            if s in self.prefixes:
                live.append((s, before, lag))
            if last is None and s in self.tokens and self.stays(before, s):
                last, count = s, lag + 1
        if last is None:
            raise ValueError(f"no token ends at byte {byte}")
        name = tuple((s, before, lag - count) for s, before, lag in live) + ((b"", last, 0),)
        if name not in self.names:
            self.names[name] = len(self.states)
            self.states.append(name)
            self.arcs.append({})
        self.arcs[state][byte] = (self.names[name], count)
        return self.arcs[state][byte]

    def count(self, piece: str) -> int:
        state = total = 0
        for byte in piece.encode("utf-8", "surrogatepass"):
            state, change = self.arcs[state].get(byte) or self.arc(state, byte)
            total += change
        if len(self.states) > 1 << 17:  # states are built again when needed
            self.names, self.states, self.arcs = {((b"", b"", 0),): 0}, [((b"", b"", 0),)], [{}]
        return total

    def counts(self, pieces: list[str]) -> list[int]:
        known = self.known
        try:
            return [known[p] for p in pieces]
        except KeyError:
            for p in pieces:
                if p not in known:
                    known[p] = self.count(p)
            out = [known[p] for p in pieces]
            if len(known) > 1 << 19:
                known.clear()
            return out


@lru_cache(maxsize=1)
def _merger(spec: str, table: bytes) -> Merger:
    return Merger(spec, np.frombuffer(table, np.uint8))


def count_batch(merger: Merger, batch: list[str], special: tuple[str, ...]) -> np.ndarray:
    """Tokens of each text. A special string counts one and cuts the text, as the library does."""
    out = np.zeros(len(batch), np.int64)
    parts, owner = [], []
    for i, t in enumerate(batch):
        cut = [t]
        for s in special:
            if s in t:
                cut = [x for piece in cut for x in piece.split(s)]
        out[i] += len(cut) - 1
        parts += cut
        owner += [i] * len(cut)
    text = "\0".join(parts)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    cuts = np.cumsum(sizes + 1)[:-1] - 1
    if not len(codes):
        return out
    at = borders(merger.table, codes, cuts)
    sep = np.zeros(len(codes), bool)
    sep[cuts] = True
    stop = np.concatenate([at[1:], [len(codes)]])
    keep = ~sep[at]
    at, stop = at[keep], stop[keep]
    n = np.array(merger.counts([text[a:b] for a, b in zip(at.tolist(), stop.tolist())]), np.int64)
    part = np.searchsorted(cuts, at, "right")
    np.add.at(out, np.asarray(owner)[part], n)
    return out


def count_tokens(docs: DataFrame, tokenizer: str, text: str = "text") -> DataFrame:
    """`docs` without the text, with n_bytes (UTF-8) and n_tokens of every whole text, null as empty.

    `tokenizer` is the path of a byte-level BPE file (.json); the driver reads it, tasks get its
    contents (as large as the file). Repeated rows count alike; other columns stay, but
    for input columns n_bytes and n_tokens, which the new ones replace."""
    with open(tokenizer, encoding="utf-8") as f:
        spec = f.read()
    model = json.loads(spec)
    if model["model"]["type"] != "BPE" or model["pre_tokenizer"]["type"] != "ByteLevel" or model["normalizer"] or model["pre_tokenizer"]["add_prefix_space"]:
        raise ValueError("not a plain byte-level BPE file")
    special = tuple(t["content"] for t in model["added_tokens"])
    sent = docs.sparkSession.sparkContext.broadcast((spec, classes().tobytes()))  # the file and 1 MB
    schema = docs.drop(text, "n_bytes", "n_tokens").withColumns({"n_bytes": F.lit(0).cast("long"), "n_tokens": F.lit(0).cast("long")}).schema
    names = schema.names[:-2]

    def run(batches):
        merger = _merger(*sent.value)
        for b in batches:
            for lo, hi in slices(b, text, BATCH):
                part = b.slice(lo, hi - lo)
                own = texts(part, text)
                n_bytes = [len(t.encode("utf-8", "surrogatepass")) for t in own]
                columns = [part.column(part.schema.get_field_index(n)) for n in names]
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array(n_bytes, pa.int64()), pa.array(count_batch(merger, own, special))], names=[*names, "n_bytes", "n_tokens"])

    return docs.mapInArrow(run, schema)
