"""EWMA baselines per entity and metric: compare with the past, then fold the value in.

The recursion mean' = (1-a)*mean + a*x is a weighted running sum. It is evaluated inside
blocks of emissions short enough that the weights cannot overflow; the carry into a block is the
weighted total of the blocks before it, of which only the nearest few still matter in double
precision. Values are centred on the entity's first one, so a flat series gives exactly zero
variance. Series hold at most one row per entity and second, whatever the traffic rate.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wiretally.functions import stats
from wiretally.params import DEFAULT, Params

ENTITY = ("entity_kind", "entity_id")


def _block_shape(alpha: float) -> tuple[int, int]:
    """Rows per block and number of earlier blocks that still carry weight."""
    digits = -math.log10(max(1e-12, 1.0 - alpha))
    size = max(2, math.ceil(12 / digits))
    return size, max(1, math.ceil(40 / (size * digits)))


def _folded(rows: DataFrame, keys: list[str], order: Window, metrics: list[str], params: Params) -> DataFrame:
    """EWMA state per row: centre `_c_`, mean/variance after the row (`_m_`, `_s_`) and before it."""
    a = params.ewma_alpha
    q = 1.0 - a
    size, reach = _block_shape(a)
    rows = rows.withColumn("_rn", F.row_number().over(order)).withColumns({
        "_blk": F.floor((F.col("_rn") - 1) / size), "_j": ((F.col("_rn") - 1) % size + 1).cast("double"),
    })
    block = Window.partitionBy(*keys).orderBy("_blk")
    running = Window.partitionBy(*keys, "_blk").orderBy("_rn").rowsBetween(Window.unboundedPreceding, 0)
    grow = F.pow(F.lit(1.0 / q), F.col("_j"))
    decay = F.pow(F.lit(q), F.col("_j"))

    def ewma(weighted: str) -> Column:
        """Decayed total up to and including this row."""
        total = F.sum(weighted).over(running)
        for lag in range(1, reach + 1):
            past = F.sum(weighted).over(block.rangeBetween(-lag, -lag))
            total = total + F.coalesce(past, F.lit(0.0)) * (q ** (size * lag))
        return decay * total

    start = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({f"_c_{m}": F.first(m).over(start) for m in metrics})
    centred = lambda m: F.col(m) - F.col(f"_c_{m}")
    rows = rows.withColumns({
        f"_w_{m}": F.when(F.col("_rn") == 1, centred(m)).otherwise(centred(m) * a) * grow for m in metrics
    })
    rows = rows.withColumns({f"_m_{m}": ewma(f"_w_{m}") for m in metrics})
    rows = rows.withColumns({f"_pm_{m}": F.lag(f"_m_{m}").over(order) for m in metrics})
    moved = lambda m: F.pow(centred(m) - F.col(f"_pm_{m}"), 2) * (a * q)
    rows = rows.withColumns({f"_v_{m}": F.coalesce(moved(m), F.lit(0.0)) * grow for m in metrics})
    rows = rows.withColumns({f"_s_{m}": ewma(f"_v_{m}") for m in metrics})
    return rows.withColumns({f"_pv_{m}": F.lag(f"_s_{m}").over(order) for m in metrics})


def with_baselines(vectors: DataFrame, metrics: list[str], params: Params = DEFAULT, names=None) -> DataFrame:
    """Adds `_zscore`, `_baseline_mean`, `_baseline_p95`, `_baseline_warm` per metric; of the
    95th percentiles, which look at many values for every row, only those in `names` if it is given.

    Only windowed rows (window_seconds > 0) belong to the series; a protocol row is a series of
    its own, so a busy resolver's queries are never gathered."""
    series = F.col("window_seconds") > 0
    own = F.when(series, F.lit("")).otherwise(F.col("event_id")) if "event_id" in vectors.columns else F.lit("")
    keys = [*ENTITY, "_sid"]
    order = Window.partitionBy(*keys).orderBy("ts_us", "read")
    rows = _folded(vectors.withColumn("_sid", own), keys, order, metrics, params)
    recent = order.rowsBetween(-params.baseline_reservoir, -1)
    ranked = [m for m in metrics if names is None or f"{m}_baseline_p95" in names]
    rows = rows.withColumns({f"_l_{m}": F.sort_array(F.collect_list(m).over(recent)) for m in ranked})
    warm = series & (F.col("_rn") - 1 >= params.baseline_min_observations)
    out = {}
    for m in metrics:
        mean = F.col(f"_c_{m}") + F.col(f"_pm_{m}")
        sd = F.sqrt(F.greatest(F.lit(0.0), F.col(f"_pv_{m}")))
        p95 = quantile_of_sorted(F.col(f"_l_{m}"), 0.95) if m in ranked else F.lit(None).cast("double")
        found = comparison(m, mean, sd, p95, warm)
        out |= found if m in ranked else {n: c for n, c in found.items() if not n.endswith("_p95")}
    return rows.select(*vectors.columns, *[c.alias(n) for n, c in out.items()])


def comparison(metric: str, mean: Column, sd: Column, p95: Column, warm: Column) -> dict[str, Column]:
    """What a vector says about a metric and its past; nothing while the baseline is cold."""
    seen = (stats.zscore(F.col(metric), mean, sd), mean, p95, F.lit(1.0))
    return {f"{metric}_{n}": F.when(warm, c).otherwise(0.0) for n, c in zip(("zscore", "baseline_mean", "baseline_p95", "baseline_warm"), seen)}


def quantile_of(values: Column, q: float) -> Column:
    """Linear-interpolation quantile of an array."""
    return quantile_of_sorted(F.sort_array(values), q)


def quantile_of_sorted(values: Column, q: float) -> Column:
    s = values
    pos = (F.size(values) - 1) * F.lit(q)
    low = F.floor(pos).cast("int")
    high = F.least(low + 1, F.size(values) - 1)
    frac = pos - low
    return F.element_at(s, low + 1) * (1 - frac) + F.element_at(s, high + 1) * frac


def final_state(series: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Snapshot of every series (long form: entity, metric, ts_us, value) after its last value:
    mean, variance, count and last value, as written to the baseline table between runs."""
    keys = [*ENTITY, "metric"]
    order = Window.partitionBy(*keys).orderBy("ts_us")
    rows = _folded(series, keys, order, ["value"], params)
    state = F.struct(
        (F.col("_c_value") + F.col("_m_value")).alias("mean"), F.col("_s_value").alias("variance"),
        F.col("_rn").cast("bigint").alias("count"), F.col("value").alias("last_value"),
    )
    return rows.groupBy(*keys).agg(F.max_by(state, "_rn").alias("s")).select(*keys, "s.*")
