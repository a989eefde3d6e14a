"""Mixing sources to target weights by Pareto order sampling.

Sources get targets in words from their weights, stopped at `most` times their own size, the excess
shared again. Within a source a document's expected copies grow with its importance up to `most`;
their whole part is certain. For the rest, documents are ranked by random odds divided by inclusion
odds, and the first are taken until the source's target is met, so the size of the sample is fixed
and not the chance of each draw. Randomness is a hash of the row, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wiretally.llm.common import WORD, text_key, written

MOST = 3
CELL = 4096
SEED = 20240611


def numbered(sources: DataFrame) -> DataFrame:
    """Adds `pos`, 0-based by source code point, null last. Sorted by ranges; no task sees them all."""
    order = F.col("source").asc_nulls_last()
    rows = written(sources.orderBy(order).withColumn("_i", F.monotonically_increasing_id()), "sources")
    rows = rows.withColumn("_p", F.shiftright("_i", 33))
    per = rows.groupBy("_p").agg(F.count("*").alias("_n"))  # one row per partition
    before = per.select("_p", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"))
    return rows.join(before, "_p").withColumn("pos", F.col("_b") + F.col("_i").bitwiseAND(F.lit((1 << 33) - 1))).drop("_i", "_p", "_b")


def targets(sources: DataFrame, total: float | None = None, most: float = MOST) -> DataFrame:
    """sources (source, source_size, weight) with `target`: shares of the total by weight, none above
    most x source_size. Only sums reach the driver; each round stops more sources at their limit."""
    limit, level = F.col("source_size") * F.lit(float(most)), 0.0
    total = total if total is not None else float(sources.agg(F.sum("source_size")).first()[0] or 0)
    stopped = -1
    while True:
        above = F.col("weight") * F.lit(level) > limit
        n, held, weight = sources.agg(
            F.count(F.when(above, 1)), F.coalesce(F.sum(F.when(above, limit)), F.lit(0.0)), F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0.0))
        ).first()
        if n == stopped or not weight:
            break
        stopped, level = n, (total - held) / weight
    return sources.withColumn("target", F.least(limit, F.col("weight") * F.lit(float(level))))


def copies(sizes: DataFrame, sources: DataFrame, most: int = MOST, seed: int = SEED) -> DataFrame:
    """sizes (doc_id, key, source, size, importance) and sources (source, target) -> sizes with
    `copies`, 0 to `most`. Rows equal in doc_id and key are taken or left together."""
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    level = written(sources.select(F.col("source").alias("_s"), "target", F.lit(0.0).alias("level"), F.lit(False).alias("fixed")), "levels")
    expected = F.least(F.lit(float(most)), F.col("importance") * F.col("level"))
    while True:  # the level at which a source's expected words are its target; more documents are at `most` each round
        full = F.col("importance") * F.col("level") >= F.lit(float(most))
        sums = sizes.join(level, same("source", "_s")).groupBy("source").agg(
            F.sum(F.when(full, F.col("size") * F.lit(float(most))).otherwise(0.0)).alias("held"),
            F.sum(F.when(~full, F.col("size") * F.col("importance")).otherwise(0.0)).alias("open"))
        rest = F.greatest(F.col("target") - F.col("held"), F.lit(0.0))
        fresh = F.when(F.col("open") > 0, rest / F.col("open")).otherwise(F.lit(float("inf")))
        level = written(level.join(sums, same("_s", "source"), "left").select(
            "_s", "target", F.coalesce(fresh, F.lit(0.0)).alias("level"), (F.coalesce(fresh, F.lit(0.0)) <= F.col("level") * (1 + 1e-12)).alias("fixed")), "levels")
        if level.filter("NOT fixed").isEmpty():
            break
    tie = F.xxhash64(F.lit(seed + 1), "doc_id", "key")
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", "key"), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    # an infinite level times importance 0 is not a number: such documents have no words to take
    e = F.when(F.col("size") > 0, expected).otherwise(0.0)
    rows = sizes.join(level.drop("fixed"), same("source", "_s")).withColumn("e", e)
    rows = rows.withColumn("whole", F.floor("e").cast("long")).withColumn("pi", F.col("e") - F.col("whole"))
    odds = u / (1 - u) / (F.col("pi") / (1 - F.col("pi")))
    rows = written(rows.withColumn("rank", F.when(F.col("pi") > 0, odds / (1 + odds))).withColumn("tie", tie).drop("level", "e", "_s"), "ranked")
    rest = rows.groupBy("source").agg((F.max("target") - F.sum(F.col("size") * F.col("whole"))).alias("rest")).withColumnRenamed("source", "_s")
    chance = rows.filter("rank IS NOT NULL").withColumn("c1", F.floor(F.col("rank") * CELL)).withColumn("c2", F.floor(F.col("rank") * CELL * CELL))

    def border(table: DataFrame, cell: str, before: DataFrame) -> DataFrame:
        """The cell of each source in which its sum passes `rest`, with the sum before it."""
        per = table.groupBy("source", cell).agg(F.sum("size").alias("x"))
        run = F.sum("x").over(Window.partitionBy("source").orderBy(cell).rowsBetween(Window.unboundedPreceding, 0))
        j = per.withColumn("run", run).join(before, same("source", "_s")).withColumn("upto", F.col("sum0") + F.col("run"))
        return j.filter("upto > rest AND upto - x <= rest").select("_s", "rest", F.col(cell).alias(f"at_{cell}"), (F.col("upto") - F.col("x")).alias("sum0"))

    b1 = border(chance, "c1", rest.withColumn("sum0", F.lit(0)))
    b2 = border(chance.join(b1.select(F.col("_s").alias("_t"), "at_c1"), same("source", "_t") & (F.col("c1") == F.col("at_c1"))), "c2", b1)
    edge = chance.join(b2, same("source", "_s") & (F.col("c2") == F.col("at_c2")))  # a 16-millionth of a source
    groups = edge.groupBy("_s", "rest", "sum0", "rank", "tie").agg(F.sum("size").alias("x"))
    run = F.sum("x").over(Window.partitionBy("_s").orderBy("rank", "tie").rowsBetween(Window.unboundedPreceding, 0)) + F.col("sum0")
    taken = groups.withColumn("upto", run).filter(2 * (F.col("rest") - F.col("upto")) + F.col("x") >= 0)  # past the middle: leave
    last = written(taken.groupBy("_s").agg(F.max(F.struct("rank", "tie")).alias("last")), "last")
    cut = written(rest.join(b2.select(F.col("_s").alias("_t"), "at_c2"), same("_s", "_t"), "left").join(
        last.withColumnRenamed("_s", "_u"), same("_s", "_u"), "left").select("_s", "rest", "at_c2", "last"), "cut")
    out = rows.join(cut, same("source", "_s"))
    here = F.floor(F.col("rank") * CELL * CELL)
    drawn = F.when(F.col("rank").isNull() | (F.col("rest") <= 0), False).when(
        F.col("at_c2").isNull(), True).when(here != F.col("at_c2"), here < F.col("at_c2")).otherwise(
        F.coalesce(F.struct("rank", "tie") <= F.col("last"), F.lit(False)))
    return out.withColumn("copies", F.col("whole") + drawn.cast("long")).select(*sizes.columns, "copies")


def _sized(docs: DataFrame) -> DataFrame:
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select("doc_id", text_key().alias("key"), "source", size.alias("size"))
    return written(rows.withColumn("importance", F.log1p("size")), "sizes")


def cycling(sources: DataFrame) -> DataFrame:
    """Weights 1, 2, 3, repeating, by position."""
    return numbered(sources).withColumn("weight", (F.col("pos") % 3 + 1).cast("double")).drop("pos")


def mix(docs: DataFrame, weigh=cycling, most: int = MOST, seed: int = SEED, sized: DataFrame | None = None) -> DataFrame:
    """(doc_id, key, source, size, source_size, target, copies, taken), one row per document.

    `weigh` turns (source, source_size) into the same with `weight`. Size is the number of words,
    null and empty 0. A null source is a source of its own. The documents of a source are drawn with
    chances that grow with the logarithm of their size. An empty table gives no rows."""
    sizes = sized if sized is not None else _sized(docs)
    per = written(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "totals")
    goal = written(targets(weigh(per), most=most), "targets")
    rows = copies(sizes, goal, most, seed)
    g = goal.select(F.col("source").alias("_g"), "source_size", "target")
    return rows.join(g, F.col("source").eqNullSafe(F.col("_g"))).drop("_g", "importance").withColumn("taken", F.col("size") * F.col("copies"))


def take_mix(docs: DataFrame, weigh=cycling, most: int = MOST, seed: int = SEED) -> DataFrame:
    """Documents with at least one copy, all their columns and `copies` (how often to read them), which
    replaces an input column of that name."""
    picked = mix(docs, weigh, most, seed).filter("copies > 0").select(
        F.col("doc_id").alias("__llm_id"), F.col("key").alias("__llm_k"), F.col("source").alias("__llm_src"), F.col("copies").alias("__llm_copies")).distinct()
    keyed = docs.withColumn("__llm_key", text_key())
    on = F.col("doc_id").eqNullSafe(F.col("__llm_id")) & (F.col("__llm_key") == F.col("__llm_k")) & F.col("source").eqNullSafe(F.col("__llm_src"))
    return keyed.join(picked, on).select(*[F.col(c) for c in docs.columns if c != "copies"], F.col("__llm_copies").alias("copies"))
