"""Exact ranks and running totals over groups that may be far too large for one task.

A group is cut into ordered value ranges at approximate quantiles; ranges are ranked on their
own and shifted by the totals of the ranges before them. The cut points only decide how evenly
the work is spread: the result is exact wherever they fall.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wiretally.sources.storage import materialise

COARSE = 16
RANGES = COARSE * COARSE


def cumulative(counts: DataFrame, by: list[str], value: str = "value", totals: tuple[str, ...] = ("r", "c")) -> DataFrame:
    """Adds `cum_<t>` (running total up to and including the value) and `all_<t>` per group.

    `counts` has one row per (by, value); groups are feature or detector names, so the table of
    cut points (one row per group) is small enough to broadcast. The range of a value is found in
    two steps of 16 instead of a walk over all cuts."""
    probs = F.array(*[F.lit(i / RANGES) for i in range(1, RANGES)])
    cuts = counts.groupBy(*by).agg(
        F.percentile_approx(value, probs, 2000).alias("_g"), *[F.sum(t).alias(f"all_{t}") for t in totals]
    )
    grid = cuts.select(
        *by, *[f"all_{t}" for t in totals],
        F.transform(F.sequence(F.lit(1), F.lit(COARSE - 1)), lambda i: F.element_at("_g", i * COARSE)).alias("_coarse"),
        F.transform(F.sequence(F.lit(0), F.lit(COARSE - 1)), lambda i: F.slice("_g", i * COARSE + 1, COARSE - 1)).alias("_fine"),
    )
    below = lambda edges: F.size(F.filter(edges, lambda g: g < F.col(value)))
    j = counts.join(F.broadcast(grid), by).withColumn("_c", below(F.col("_coarse")))
    j = j.withColumn("_b", F.col("_c") * COARSE + below(F.element_at("_fine", F.col("_c") + 1))).drop("_coarse", "_fine", "_c")
    order = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    per = j.groupBy(*by, "_b").agg(*[F.sum(t).alias(f"_s_{t}") for t in totals])
    per = per.select(*by, "_b", *[F.coalesce(F.sum(f"_s_{t}").over(order), F.lit(0)).alias(f"_p_{t}") for t in totals])
    inside = Window.partitionBy(*by, "_b").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    local = j.withColumns({f"cum_{t}": F.sum(t).over(inside) for t in totals})
    out = local.join(F.broadcast(per), [*by, "_b"])  # at most 256 rows per group
    return out.withColumns({f"cum_{t}": F.col(f"cum_{t}") + F.col(f"_p_{t}") for t in totals}).drop(
        "_b", *[f"_p_{t}" for t in totals]
    )


def exact_quantiles(cum: DataFrame, by: list[str], qs: list[float], value: str = "value", total: str = "r") -> DataFrame:
    """Linear-interpolation quantiles (by, quantiles array) from `cumulative` rows."""
    n, upto = F.col(f"all_{total}"), F.col(f"cum_{total}")
    here = cum.filter(F.col(total) > 0)
    wanted = F.array_distinct(F.flatten(F.array(*[
        F.array(F.floor((n - 1) * q).cast("bigint"), F.ceil((n - 1) * q).cast("bigint")) for q in qs
    ])))
    held = F.filter(wanted, lambda i: (i < upto) & (i >= upto - F.col(total)))
    picks = here.select(*by, n.alias("_n"), F.col(value).alias("_v"), F.explode(held).alias("_i"))
    m = picks.groupBy(*by).agg(
        F.max("_n").alias("_n"), F.map_from_entries(F.collect_list(F.struct("_i", "_v"))).alias("_m")
    )

    def at(q):
        pos = (F.col("_n") - 1) * F.lit(q)
        low, high = F.floor(pos).cast("bigint"), F.ceil(pos).cast("bigint")
        a, b = F.element_at("_m", low), F.element_at("_m", high)
        return a + (b - a) * (pos - low)

    return m.select(*by, F.array(*[at(q) for q in qs]).alias("quantiles"))


def global_rank(rows: DataFrame, order: list[str], descending: bool = False) -> DataFrame:
    """1-based rank over all rows by the whole tuple of `order` columns, nulls last.

    Ranges are drawn over the tuple and a row number behind it, so one value that all rows share is
    spread like any other; rows equal in all columns rank in any order. Rows are numbered where they
    were sorted, and written, so that a lost executor cannot deal them anew."""
    side = (lambda c: F.desc_nulls_last(c)) if descending else (lambda c: F.asc_nulls_last(c))
    cols = [side(c) for c in order]
    salted = rows.withColumn("_salt", F.xxhash64(F.monotonically_increasing_id()))
    placed = salted.repartitionByRange(*cols, "_salt").sortWithinPartitions(*cols, "_salt").drop("_salt")
    numbered = materialise(placed.withColumn("_at", F.monotonically_increasing_id()), "ranks")
    part, local = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))  # how that number is made
    sizes = numbered.groupBy(part.alias("_p")).agg(F.count("*").alias("_n"))  # one row for each partition
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offset = sizes.select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return numbered.withColumn("_p", part).join(F.broadcast(offset), "_p").withColumn("rank", local + 1 + F.col("_before")).drop("_at", "_p", "_before")


BUCKETS = 2048
FEW = 10_000


def exact_percentiles(rows: DataFrame, value: str, qs: list[float], by: list[str] | None = None) -> DataFrame:
    """(by, n, quantiles) with linear interpolation, exact, for groups of any size; nulls are left out.

    Selection by histogram: each round counts the values of an open interval in BUCKETS buckets, keeps the
    bucket that holds the wanted rank, and narrows the interval to that bucket's own least and largest
    value, until they are one. Rows are only counted where they lie; the tables between rounds have one row
    for each group and wanted rank, and are broadcast while there are no more than FEW."""
    by = list(by or [])
    names = [f"_k{i}" for i in range(len(by))]
    held = rows.filter(F.col(value).isNotNull()).select(*[F.col(b).alias(n) for b, n in zip(by, names)], F.col(value).cast("double").alias("_v"))
    sizes = materialise(held.groupBy(*names).agg(F.count("*").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")).filter("_n > 0"), "sizes")
    place = lambda q, f: f((F.col("_n") - 1) * F.lit(q)).cast("bigint")
    wanted = F.array_distinct(F.flatten(F.array(*[F.array(place(q, F.floor), place(q, F.ceil)) for q in qs])))
    state = materialise(sizes.select(*names, "_lo", "_hi", F.explode(wanted).alias("_rank")).withColumn("_left", F.col("_rank")), "selection")
    rounds = 0
    while (n_open := state.filter("_lo < _hi").count()):
        live = state.filter("_lo < _hi")
        spans = live.select(*[F.col(n).alias(f"i{n}") for n in names], F.col("_lo").alias("_a"), F.col("_hi").alias("_b")).distinct()
        same = reduce(lambda x, y: x & y, [F.col(n).eqNullSafe(F.col(f"i{n}")) for n in names], (F.col("_v") >= F.col("_a")) & (F.col("_v") <= F.col("_b")))
        inside = held.join(F.broadcast(spans) if n_open <= FEW else spans, same)
        # the quotient only has to rise with the value: by magnitude and by difference in turn, halves keep it finite
        by_size = lambda c: F.signum(c) * F.coalesce(F.log(F.abs(F.col(c))) + 746, F.lit(0.0))
        scale = by_size if rounds % 2 == 0 else lambda c: F.col(c) / 2
        share = F.try_divide(scale("_v") - scale("_a"), scale("_b") - scale("_a"))
        share = F.coalesce(share, F.when(F.col("_v") > F.col("_a"), 1.0).otherwise(0.0))  # where the scale tells no difference
        rounds += 1
        bucket = F.least(F.lit(BUCKETS - 1), F.floor(share * BUCKETS)).cast("int")
        keys = [*names, "_a", "_b"]
        counted = inside.groupBy(*keys, bucket.alias("_bucket")).agg(F.count("*").alias("_c"), F.min("_v").alias("_x"), F.max("_v").alias("_y"))
        upto = F.sum("_c").over(Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0))
        counted = counted.withColumn("_upto", upto).withColumnsRenamed({n: f"i{n}" for n in names})
        fits = [F.col(n).eqNullSafe(F.col(f"i{n}")) for n in names] + [
            F.col("_lo") == F.col("_a"), F.col("_hi") == F.col("_b"), F.col("_left") < F.col("_upto"), F.col("_left") >= F.col("_upto") - F.col("_c")]
        narrowed = live.join(counted, reduce(lambda x, y: x & y, fits)).select(
            *names, F.col("_x").alias("_lo"), F.col("_y").alias("_hi"), "_rank", (F.col("_left") - (F.col("_upto") - F.col("_c"))).alias("_left"))
        state = materialise(state.filter("_lo >= _hi").unionByName(narrowed), "selection")
    found = state.groupBy(*names).agg(F.map_from_entries(F.collect_list(F.struct("_rank", "_lo"))).alias("_m"))
    both = reduce(lambda x, y: x & y, [sizes[n].eqNullSafe(found[n]) for n in names], F.lit(True))

    def at(q):
        pos, low, high = (F.col("_n") - 1) * F.lit(q), place(q, F.floor), place(q, F.ceil)
        a, b = F.element_at("_m", low), F.element_at("_m", high)
        return a + (b - a) * (pos - low)

    return sizes.join(found, both).select(*[sizes[n].alias(b) for n, b in zip(names, by)], F.col("_n").alias("n"), F.array(*[at(q) for q in qs]).alias("quantiles"))
