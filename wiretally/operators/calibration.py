"""Isotonic calibration: pool-adjacent-violators on blocks that merge across partitions.

Scores are counted once per distinct value and cut into ranges. Each range pools its own neighbours
in one streaming pass; neighbouring ranges are then pooled together, a few at a time, until one is
left. Pooling may start from any pooled parts, so the order of merges does not change the result.
With labels of 0 and 1 the means of the blocks are different fractions whose weights add up to the
number of rows, so N rows leave at most about N^(2/3) blocks: that is what the last task holds.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wiretally.sources.storage import materialise

FAN = 8  # neighbouring ranges pooled per step
_NAMES = ("low", "high", "weight", "total")
_SCHEMA = "part long, low double, high double, weight double, total double"


def pool(batches):
    """Columns low, high, weight and total of the blocks left by batches of points in score order."""
    low, high, weight, total = [], [], [], []
    for batch in batches:
        for lo, hi, w, t in zip(*[batch.column(n).to_pylist() for n in _NAMES]):
            while low and total[-1] * w >= t * weight[-1]:  # the block before has no smaller mean
                lo, w, t = low.pop(), w + weight.pop(), t + total.pop()
                high.pop()
            low.append(lo)
            high.append(hi)
            weight.append(w)
            total.append(t)
    return low, high, weight, total


def _batch(part: int, columns) -> pa.RecordBatch:
    parts = pa.array([part] * len(columns[0]), pa.int64())
    return pa.RecordBatch.from_arrays([parts, *[pa.array(c, pa.float64()) for c in columns]], names=["part", *_NAMES])


def _pool_range(batches):
    part = None

    def seen():
        nonlocal part
        for b in batches:
            if len(b):
                part = b.column("part")[0].as_py()
                yield b

    columns = pool(seen())
    if part is not None:
        yield _batch(part, columns)


def _pool_neighbours(table: pa.Table) -> pa.Table:
    table = table.sort_by("low")
    return pa.Table.from_batches([_batch(table.column("part")[0].as_py() // FAN, pool(table.to_batches()))])


def blocks(rows: DataFrame, score: str = "score", label: str = "label", ranges: int | None = None) -> DataFrame:
    """(low, high, weight, mean) of the non-decreasing fit of `label` on `score`, in least squares.

    A block spans the scores from `low` to `high`; `weight` counts its rows and `mean` is their mean
    label, so weights and label sums add up to those of the input. Means strictly increase. Rows
    without a score (null or NaN) or label take no part; without rows there are no blocks."""
    spark = rows.sparkSession
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    s, y = F.col(score).cast("double"), F.col(label).cast("double")
    points = rows.select((s + F.lit(0.0)).alias("low"), y.alias("y")).filter("low IS NOT NULL AND NOT isnan(low) AND y IS NOT NULL")
    points = points.groupBy("low").agg(F.count("*").cast("double").alias("weight"), F.sum("y").alias("total"))
    cut = points.repartitionByRange(ranges, "low").sortWithinPartitions("low")
    cut = cut.select(F.spark_partition_id().cast("long").alias("part"), "low", F.col("low").alias("high"), "weight", "total")
    # written: the ranges must not be drawn again when an executor is lost
    pooled = materialise(cut.mapInArrow(_pool_range, _SCHEMA), "calibration")
    last = pooled.agg(F.max("part")).first()[0] or 0
    while last > 0:
        pooled = pooled.groupBy(F.expr(f"part div {FAN}")).applyInArrow(_pool_neighbours, _SCHEMA)
        last //= FAN
    return pooled.select("low", "high", "weight", (F.col("total") / F.col("weight")).alias("mean"))


def ends(fitted: DataFrame) -> DataFrame:
    """(score, label, weight): both ends of every block, the points between which a model interpolates."""
    two = F.col("low") < F.col("high")
    share = F.when(two, F.col("weight") / 2).otherwise(F.col("weight"))
    at = F.explode(F.when(two, F.array("low", "high")).otherwise(F.array("low")))
    return fitted.select(at.alias("score"), F.col("mean").alias("label"), share.alias("weight"))
