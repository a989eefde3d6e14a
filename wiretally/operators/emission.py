"""When an entity reports: greedy one-per-interval emission, ticks, and the final flush."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wiretally.operators.entities import EntityEvents
from wiretally.sources.storage import materialise


def emission_points(ev: EntityEvents) -> DataFrame:
    """(keys, ts_us) at which each entity emits a vector."""
    p, e = ev.params, ["entity_kind", "entity_id"]
    step = int(p.emit_interval * 1_000_000)
    if p.emission == "tick":
        points = ev.own.groupBy(*e, F.expr(f"ts_us div {step}").alias("_tick")).agg(F.max("ts_us").alias("ts_us")).drop("_tick")
    else:
        # a busy entity goes by pieces of time anyhow, so its chain is not followed from slice to slice
        points = greedy_points(ev.own.select(*e, "ts_us"), e, step, parts=None if ev.sliced else ev.parts)
    return ev.placed(points).repartition(ev.parts, *ev.keys) if ev.sliced else points


FOLD = 4096  # longest run of close events that one ordered fold follows
SPAN = 300  # steps of time in one piece of a longer run
FAN = 64  # pieces whose step functions are composed at a time
NEVER = -(1 << 62)


def greedy_points(rows: DataFrame, keys: list[str], step: int, sliced: bool = False, fold: int = FOLD, span: int = SPAN, parts: int | None = None) -> DataFrame:
    """First event always emits; the next is the first one at least `step` later.

    Entities with more than `fold` rows are cut into pieces of time, see `piece_entries`; nothing is ordered over
    the whole of one. The chain of a smaller entity is one ordered fold. Slices of entities cut elsewhere
    are followed in runs: a gap of `step` or more always restarts the chain, so it is followed inside runs
    of closer events only, and a run above `fold` goes by pieces. `parts` is the number of parts that the rows lie in by their keys:
    all emissions are then dealt alike, so that what they are merged with need not be shuffled again."""
    if sliced:
        runs = _runs(rows, keys, step)
    else:
        busy = materialise(rows.groupBy(*keys).count().filter(F.col("count") > fold).select(*keys), "busy")
        names = busy.count()  # rows / fold at most
        few = F.broadcast(busy) if names <= 10_000 else busy
        runs = (rows.join(few, keys, "left_anti") if names else rows).withColumns({
            "_run": F.lit(0).cast("bigint"), "_length": F.lit(0).cast("bigint"), "entry": F.lit(None).cast("bigint")})
    short = runs.filter(F.col("_length") <= fold).groupBy(*keys, "_run").agg(
        F.sort_array(F.collect_set("ts_us")).alias("ts"), F.max("entry").alias("entry")
    )
    first = F.coalesce(F.col("entry"), F.lit(NEVER)).cast("bigint")
    empty = F.array().cast("array<bigint>")
    folded = F.aggregate(
        "ts",
        F.struct(first.alias("due"), empty.alias("out")),
        lambda acc, t: F.when(
            t >= acc["due"],
            F.struct((t + F.lit(step)).alias("due"), F.concat(acc["out"], F.array(t)).alias("out")),
        ).otherwise(acc),
        lambda acc: acc["out"],
    )
    folded_points = short.select(*keys, F.explode(folded).alias("ts_us"))
    if sliced:
        long = runs.filter(F.col("_length") > fold)
    elif names:
        long = rows.join(few, keys, "left_semi").withColumns({"_run": F.lit(0).cast("bigint"), "entry": F.lit(None).cast("bigint")})
    else:
        return folded_points
    points = _piecewise(long, keys, step, span)
    if parts is None:
        return folded_points.unionByName(points)
    placed = folded_points.repartition(parts, *keys) if sliced or names > 10_000 else folded_points
    return placed.unionByName(points.repartition(parts, *keys))


def _runs(rows: DataFrame, keys: list[str], step: int) -> DataFrame:
    """Rows of slices with their run, its length and, in the first run, the time at which the slice may first emit."""
    order = Window.partitionBy(*keys).orderBy("ts_us")
    gap = F.col("ts_us") - F.lag("ts_us").over(order)
    runs = rows.withColumn("_new", F.when(gap.isNull() | (gap >= step), 1).otherwise(0))
    runs = runs.withColumn("_run", F.sum("_new").over(order.rangeBetween(Window.unboundedPreceding, 0)))
    runs = runs.withColumn("_length", F.count("*").over(Window.partitionBy(*keys, "_run")))
    entity = [k for k in keys if k != "slice"]
    hot = rows.join(rows.select(*keys).filter("slice > 0").select(*entity).distinct(), entity, "left_semi")
    runs = runs.join(piece_entries(hot, entity, "slice", step), keys, "left")
    return runs.withColumn("entry", F.when(F.col("_run") == 1, F.col("entry")))


def _piecewise(runs: DataFrame, keys: list[str], step: int, span: int) -> DataFrame:
    """Emissions of long runs: every piece is walked by itself from the time at which it may first emit."""
    group = [*keys, "_run"]
    rows = runs.select(*group, F.expr(f"ts_us div {span * step}").alias("_piece"), "ts_us", "entry")
    start = rows.groupBy(*group).agg(F.max("entry").alias("start"))
    entries = piece_entries(rows.select(*group, "_piece", "ts_us"), group, "_piece", step, start)

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        t = np.unique(pdf["ts_us"].to_numpy(np.int64))
        after = np.searchsorted(t, t + step)
        at, out = int(np.searchsorted(t, pdf["entry"].iloc[0])), []
        while at < len(t):
            out.append(t[at])
            at = after[at]
        return pdf[keys].iloc[[0] * len(out)].assign(ts_us=np.array(out, np.int64))

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in runs.select(*keys, "ts_us").schema.fields)
    return rows.drop("entry").join(entries, [*group, "_piece"]).groupBy(*group, "_piece").applyInPandas(walk, fields)


def _compact(lim: np.ndarray, exits: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Steps that an entry time can reach (it lies before the first event plus `step`), equal ones once."""
    n = min(len(lim), int(np.searchsorted(lim, lim[0] + step)) + 1)
    keep = np.append(exits[1:n] != exits[: n - 1], True)
    return lim[:n][keep], exits[:n][keep]


def _through(lim: np.ndarray, exits: np.ndarray, due):
    """When the chain may next emit after a piece that it enters being due at `due`."""
    at = np.searchsorted(lim, due)
    return np.where(at < len(lim), exits[np.minimum(at, len(lim) - 1)], due)


def piece_entries(rows: DataFrame, group: list[str], piece: str, step: int, start: DataFrame | None = None) -> DataFrame:
    """(group, piece, entry): the earliest time at which the chain may emit in each piece of a group.

    A piece is a step function from the time at which the chain is due when it enters to that when it
    leaves, found for all entry times at once by pointer doubling. Functions compose, and composing is
    associative: FAN neighbours become one function, level by level, until one task can chain what is
    left; entries are then handed down the same tree. No task holds more than FAN functions, and rows
    meet only within their piece. `start` (group, start) says when the first piece may emit."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    fields = ", ".join(f"{k} {kinds[k]}" for k in group)
    table = f"{fields}, {piece} bigint, lim array<bigint>, exit array<bigint>"

    def summarise(key, pdf: pd.DataFrame) -> pd.DataFrame:
        t = np.unique(pdf["ts_us"].to_numpy(np.int64))
        last, jump = np.arange(len(t)), np.searchsorted(t, t + step)
        while (jump < len(t)).any():
            live = jump < len(t)
            to = np.minimum(jump, len(t) - 1)
            last, jump = np.where(live, last[to], last), np.where(live, jump[to], jump)
        lim, exits = _compact(t, t[last] + step, step)
        return pd.DataFrame({**{k: [v] for k, v in zip([*group, piece], key)}, "lim": [lim], "exit": [exits]})

    def compose(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(piece)
        lim, exits = np.asarray(pdf["lim"].iloc[0]), np.asarray(pdf["exit"].iloc[0])
        for more, out in zip(pdf["lim"].iloc[1:], pdf["exit"].iloc[1:]):
            more, out = np.asarray(more), np.asarray(out)
            lim, exits = _compact(np.append(lim, more), np.append(_through(more, out, exits), out), step)
        return pd.DataFrame({**{k: [v] for k, v in zip([*group, piece], key)}, "lim": [lim], "exit": [exits]})

    def chain(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(piece)
        due, entries = pdf["start"].iloc[0], []
        for lim, out in zip(pdf["lim"], pdf["exit"]):
            entries.append(int(due))
            due = int(_through(np.asarray(lim), np.asarray(out), due))
        return pdf[[*group, piece]].assign(entry=entries)

    def entered(tables: DataFrame) -> DataFrame:
        span = tables.groupBy(*group).agg((F.max(piece) - F.min(piece)).alias("s")).agg(F.max("s")).first()[0]
        if span is None or span < FAN:
            begun = tables.join(start, group, "left") if start is not None else tables.withColumn("start", F.lit(None).cast("bigint"))
            return begun.fillna(NEVER, ["start"]).groupBy(*group).applyInPandas(chain, f"{fields}, {piece} bigint, entry bigint")
        up = F.floor(F.col(piece) / FAN).cast("bigint")
        above = materialise(tables.withColumn("_own", F.col(piece)).withColumn(piece, up).groupBy(*group, piece).applyInPandas(
            lambda key, pdf: compose(key, pdf.drop(columns=piece).rename(columns={"_own": piece})), table), "pieces")
        parents = entered(above).select(*group, F.col(piece).alias("_up"), F.col("entry").alias("start"))
        placed = tables.withColumn("_up", up).join(parents, [*group, "_up"])
        return placed.groupBy(*group, "_up").applyInPandas(chain, f"{fields}, {piece} bigint, entry bigint")

    return entered(materialise(rows.groupBy(*group, piece).applyInPandas(summarise, table), "pieces"))


def flush_points(ev: EntityEvents, flush_ts: int | None) -> DataFrame:
    """One closing read per entity: at the global end, or at the entity's own last event."""
    last = ev.placed(ev.own.groupBy("entity_kind", "entity_id").agg(F.max("ts_us").alias("ts_us")))
    if ev.params.flush_at == "global":
        last = last.withColumn("ts_us", F.lit(flush_ts).cast("bigint"))
    last = last.select(*ev.keys, "ts_us")
    return last.repartition(ev.parts, *ev.keys) if ev.sliced else last  # dealt as the rows are
