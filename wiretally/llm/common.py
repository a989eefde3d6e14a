"""Helpers of the corpus operators: written intermediates, Arrow text batches, row identity.

Columns that operators add to a caller's rows for a while start with `__llm_`, a reserved prefix."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wiretally.sources.storage import materialise

#: The words of all contracts are maximal runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes to the shared folder and reads back: cuts lineage and survives lost executors."""
    return materialise(df, f"llm-{name}")


def text_key(text: str = "text") -> Column:
    """With doc_id it names a row; rows equal in both are the same document for every operator."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def slices(batch: pa.RecordBatch, column: str, limit: int):
    """(start, stop) row ranges of about `limit` bytes of text, so that one range fits in memory."""
    col = batch.column(batch.schema.get_field_index(column))
    sizes = pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > limit:
            yield start, i
            start, held = i, 0
        held += int(n)
    if start < len(sizes) or not len(sizes):
        yield start, len(sizes)


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The column's strings, null as empty."""
    return [t or "" for t in batch.column(batch.schema.get_field_index(column)).to_pylist()]


def flat(batch: pa.RecordBatch, column: str = "text"):
    """(bytes as uint8 array, offsets) of a whole text column, null as empty."""
    import numpy as np

    col = pc.fill_null(batch.column(batch.schema.get_field_index(column)).cast(pa.large_binary()), b"")
    offsets = np.frombuffer(col.buffers()[1], dtype=np.int64, count=len(col) + 1, offset=8 * col.offset)
    data = col.buffers()[2]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
    return whole[offsets[0]:offsets[-1]], offsets - offsets[0]


MAP_BITS = 22


def _slot(hashed: Column) -> tuple[Column, Column]:
    at = hashed.bitwiseAND(F.lit((1 << MAP_BITS) - 1))
    return F.shiftright(at, 6), at.bitwiseAND(F.lit(63)).cast("int")


def only_with(df: DataFrame, wanted: DataFrame, keys: list[str], negate: bool = False) -> DataFrame:
    """Rows of `df` whose `keys` may be among those of `wanted`; with `negate`, those that are surely
    not. A map of 2**MAP_BITS bits is broadcast, 65,536 words at most whatever the tables hold: rows
    that a join would drop are mostly dropped before they are shuffled."""
    w, b = _slot(F.xxhash64(*keys))
    words = wanted.select(w.alias("__llm_w"), F.expr("1").alias("_one"), b.alias("_b")).groupBy("__llm_w").agg(
        F.bit_or(F.expr("shiftleft(1L, _b)")).alias("__llm_bits"))
    tested = df.withColumns({"__llm_w0": w, "__llm_b0": b}).join(F.broadcast(words), F.col("__llm_w0") == F.col("__llm_w"), "left")
    hit = F.coalesce(F.expr("(shiftrightunsigned(__llm_bits, __llm_b0) & 1L) = 1L"), F.lit(False))
    return tested.filter(~hit if negate else hit).select(*df.columns)
