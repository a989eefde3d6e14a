"""Count-bounded per-entity statistics: inter-arrival regularity and payload stability."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wiretally.functions import stats
from wiretally.operators.entities import TAIL, EntityEvents

TIMING = (
    "interarrival_mean", "interarrival_stdev", "interarrival_cv", "interarrival_count",
    "periodicity_score", "burstiness", "byte_stability_cv", "duration_stability_cv",
    "mean_flow_bytes", "observed_span", "entity_event_count",
)


def with_timing(ev: EntityEvents, wants: set[str]) -> DataFrame:
    """Adds the timing columns to every entity row; unused ones are pruned by the optimizer."""
    keys = list(ev.keys)
    order = Window.partitionBy(*keys).orderBy("ts_us", "event_id")
    running = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = ev.rows
    own = F.when(F.col("halo"), 0).otherwise(1)
    first = F.first("ts_us").over(running)
    count = F.sum(own).over(running)
    if ev.sliced:
        first = F.coalesce(F.col("first_us"), first)
        count = count + F.coalesce("rows_before", F.lit(0))
    gap = F.col("ts_us") - F.lag("ts_us").over(order)
    rows = rows.withColumns({
        "first_seen": first,
        "event_count": count.cast("bigint"),
        "last_of_time": F.coalesce(F.lead("ts_us").over(order) > F.col("ts_us"), F.lit(True)),
        "_gap": F.when(gap > 0, gap / 1e6),
    })
    last64 = order.rowsBetween(-(TAIL - 1), 0)
    if wants & {"byte_stability_cv", "mean_flow_bytes"}:
        rows = rows.withColumn("_total", (F.col("v_out") + F.col("v_in")).cast("double")).withColumns({
            "_bm": F.avg("_total").over(last64), "_bs": F.stddev_pop("_total").over(last64),
        })
    if wants & {"flow_ids"}:
        rows = rows.withColumn("flow_ids", F.collect_list("flow_id").over(last64))
    if wants & {"interarrival_mean", "interarrival_stdev", "interarrival_cv", "interarrival_count",
                "periodicity_score", "burstiness"}:
        # arrivals are numbered so that repeats of a time do not use up places
        arrival = F.sum(F.when(F.col("_gap").isNotNull() | gap.isNull(), 1).otherwise(0)).over(running)
        rows = rows.withColumn("_a", arrival)
        wa = Window.partitionBy(*keys).orderBy("_a").rangeBetween(-(TAIL - 2), 0)
        rows = rows.withColumns({
            "_gm": F.coalesce(F.avg("_gap").over(wa), F.lit(0.0)),
            "_gs": F.coalesce(F.stddev_pop("_gap").over(wa), F.lit(0.0)),
            "_gn": F.count("_gap").over(wa).cast("double"),
        })
    if "duration_stability_cv" in wants:
        rows = rows.withColumn("_di", F.count("duration").over(running))
        wd = Window.partitionBy(*keys).orderBy("_di").rangeBetween(-(TAIL - 1), 0)
        rows = rows.withColumns({
            "_dm": F.avg("duration").over(wd), "_ds": F.stddev_pop("duration").over(wd),
        })
    if "pcap_references" in wants:
        seen = Window.partitionBy(*keys, "pcap_reference").orderBy("ts_us", "event_id")
        fresh = F.col("pcap_reference").isNotNull() & (F.row_number().over(seen) == 1)
        rows = rows.withColumn("_fresh", F.col("fresh") if ev.sliced else fresh).withColumn(
            "_pi", F.sum(F.when(F.col("_fresh"), 1).otherwise(0)).over(running)
        )
        wp = Window.partitionBy(*keys).orderBy("_pi").rangeBetween(-7, 0)
        rows = rows.withColumn("pcap_references", F.collect_list(F.when(F.col("_fresh"), F.col("pcap_reference"))).over(wp))
    return rows


def timing_columns(rows: DataFrame) -> dict:
    """Expressions over the columns of `with_timing`, only those whose inputs are present."""
    have, out = set(rows.columns), {}
    if "_gm" in have:
        m, s, n = F.col("_gm"), F.col("_gs"), F.col("_gn")
        c = stats.cv(m, s)
        out |= {
            "interarrival_mean": m, "interarrival_stdev": s, "interarrival_cv": c,
            "interarrival_count": n, "periodicity_score": stats.periodicity(c, n),
            "burstiness": stats.burstiness(m, s, n),
        }
    if "_bm" in have:
        out |= {"byte_stability_cv": stats.cv(F.col("_bm"), F.col("_bs")), "mean_flow_bytes": F.col("_bm")}
    if "_dm" in have:
        out["duration_stability_cv"] = F.coalesce(stats.cv(F.col("_dm"), F.col("_ds")), F.lit(0.0))
    out["observed_span"] = (F.col("ts_us") - F.col("first_seen")) / 1e6
    out["entity_event_count"] = F.col("event_count").cast("double")
    return out
