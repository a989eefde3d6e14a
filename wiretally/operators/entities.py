"""One event becomes three entity rows, and hot entities are cut into time slices.

An entity that holds a large share of all rows (a flooded target, a busy resolver) must not
become one task. Entities above `hot_rows` are cut at 300-second bucket borders into slices of
about `slice_rows` rows. Every slice also receives the rows its windows can reach back to: the
bucket before it (sliding windows) and the last 64 rows, durations and arrival times before it
(count-bounded windows). Those copies are marked `halo` and never produce output. The result of
a sliced run equals the unsliced one; only the partitioning changes.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wiretally.functions import net
from wiretally.params import Params
from wiretally.sources.storage import materialise

TAIL = 64


def enriched_flows(flows: DataFrame, params: Params) -> DataFrame:
    """Only the columns the windows need, with the per-flow predicates evaluated once."""
    one = lambda c: F.when(c, F.lit(1)).otherwise(F.lit(0)).cast("bigint")
    dns, q = F.col("dns").isNotNull(), F.upper(F.coalesce(F.col("dns.qtype"), F.lit("")))
    rcode = F.upper(F.coalesce(F.col("dns.rcode"), F.lit("")))
    resp = F.coalesce(F.col("dns.response_bytes"), F.lit(0))
    return flows.select(
        "ts_us", "event_id", "src_ip", "dst_ip", "dst_port", "service", "transport", "flow_id",
        "pcap_reference", "duration", "dns", "tls",
        F.lit(1).cast("bigint").alias("v_flows"),
        net.total_packets().alias("v_packets"),
        F.col("orig_bytes").alias("v_out"),
        F.coalesce("resp_bytes", F.lit(0)).cast("bigint").alias("v_in"),
        F.col("orig_packets").alias("v_opkt"),
        F.coalesce("resp_packets", F.lit(0)).cast("bigint").alias("v_rpkt"),
        one(net.is_syn_only()).alias("v_syn"),
        one(net.is_failed(params.unknown_resp_is_failed)).alias("v_failed"),
        F.coalesce(F.round(F.col("duration") * 1e6).cast("bigint"), F.lit(0)).alias("v_dur"),
        one(F.col("duration").isNotNull()).alias("v_durn"),
        one(F.col("transport") == "tcp").alias("v_tcp"),
        one(F.col("transport") == "udp").alias("v_udp"),
        one(F.col("transport") == "icmp").alias("v_icmp"),
        one(F.col("dst_port").isNotNull()).alias("v_port"),
        one(dns).alias("v_dns"),
        one(dns & q.isin("TXT", "NULL", "CNAME")).alias("v_txt"),
        one(dns & rcode.isin("NXDOMAIN", "3")).alias("v_nx"),
        F.coalesce(resp, F.lit(0)).cast("bigint").alias("v_dresp"),
        one(dns & (F.coalesce(resp, F.lit(0)) > 0)).alias("v_drespn"),
        net.in_networks(F.col("src_ip"), params.home_networks).alias("src_internal"),
        net.in_networks(F.col("dst_ip"), params.home_networks).alias("dst_internal"),
    )


COUNTERS = (
    "v_flows", "v_packets", "v_out", "v_in", "v_opkt", "v_rpkt", "v_syn", "v_failed", "v_dur",
    "v_durn", "v_tcp", "v_udp", "v_icmp", "v_port", "v_dns", "v_txt", "v_nx", "v_dresp", "v_drespn",
)


KINDS = ("HOST", "DESTINATION", "PAIR")
TASK_ROWS = 150_000  # entity rows that one task orders, about


def entity_rows(rows: DataFrame, kinds: tuple[str, ...] | None = None) -> DataFrame:
    """HOST (source), DESTINATION and PAIR rows of every event, or those of some kinds."""
    ids = {"HOST": F.col("src_ip"), "DESTINATION": F.col("dst_ip"), "PAIR": F.concat_ws("->", "src_ip", "dst_ip")}
    views = F.array(*[
        F.struct(F.lit(k).alias("entity_kind"), ids[k].alias("entity_id")) for k in KINDS if kinds is None or k in kinds
    ])
    return rows.select(F.inline(views), *rows.columns)


def hot_entities(flows: DataFrame, params: Params, kinds: tuple[str, ...] | None = None) -> DataFrame | None:
    """Entities with more than `hot_rows` rows, or None when there are none.

    At most 3 * rows / hot_rows entities can be hot, whatever the data looks like."""
    if flows.count() <= params.hot_rows:
        return None
    hot = (
        entity_rows(flows.select("src_ip", "dst_ip"), kinds)
        .groupBy("entity_kind", "entity_id").count()
        .filter(F.col("count") > params.hot_rows)
        .select("entity_kind", "entity_id")
    )
    hot = materialise(hot, "hot")
    return None if hot.isEmpty() else hot


def partitions(flows: DataFrame, kinds: tuple[str, ...] | None = None) -> int:
    """Parts that entity rows are dealt into: what a task orders stays the same, however many rows there are."""
    least = int(flows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, -(-flows.count() * len(kinds or KINDS) // TASK_ROWS))


@dataclass
class EntityEvents:
    """`rows` carries everything, `narrow` only addresses, keys and time; same partitioning into `parts`.

    `own` are the entities' rows without halo, not cut into slices; `slices` says which slice a hot entity's bucket is in."""

    rows: DataFrame
    narrow: DataFrame
    keys: tuple[str, ...]
    sliced: bool
    params: Params
    parts: int
    own: DataFrame
    slices: DataFrame | None = None

    def placed(self, points: DataFrame) -> DataFrame:
        """Points (entity, ts_us) of the entities' own events with the slice that they fall into."""
        if not self.sliced:
            return points
        width = max(self.params.sizes) * 1_000_000
        of = self.slices.select("entity_kind", "entity_id", "bucket", "slice")
        found = points.withColumn("bucket", F.expr(f"ts_us div {width}")).join(_small(of), ["entity_kind", "entity_id", "bucket"], "left")
        return found.select("entity_kind", "entity_id", F.coalesce("slice", F.lit(0)).cast("bigint").alias("slice"), "ts_us")


def slice_map(hot_rows: DataFrame, params: Params) -> DataFrame:
    """Bucket -> slice for hot entities. One row per entity and 300-second bucket with data."""
    e = ("entity_kind", "entity_id")
    width = max(params.sizes) * 1_000_000
    buckets = hot_rows.groupBy(*e, F.expr(f"ts_us div {width}").alias("bucket")).agg(
        F.count("*").alias("n"), F.min("ts_us").alias("first_us")
    )
    order = Window.partitionBy(*e).orderBy("bucket")
    before = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    m = buckets.withColumn("before", before).withColumn("slice", F.floor(F.col("before") / params.slice_rows))
    per_slice = Window.partitionBy(*e, "slice")
    return m.select(
        *e, "bucket", F.col("slice").cast("bigint").alias("slice"),
        F.min("before").over(per_slice).alias("rows_before"),
        F.min("first_us").over(Window.partitionBy(*e)).alias("first_us"),
        F.lead("slice").over(order).cast("bigint").alias("next_slice"),
        F.lead("bucket").over(order).alias("next_bucket"),
    )


def _tails(rows: DataFrame, value_filter, slices: DataFrame) -> DataFrame:
    """The last 64 qualifying rows before every slice, as halo rows of that slice."""
    e = ("entity_kind", "entity_id")
    payload = [c for c in rows.columns if c not in (*e, "slice", "rows_before", "halo")]
    inside = Window.partitionBy(*e, "slice").orderBy(F.desc("ts_us"), F.desc("event_id"))
    upto = Window.partitionBy(*e).orderBy("slice", "ts_us", "event_id").rowsBetween(-(TAIL - 1), 0)
    tail = (
        rows.filter(value_filter)
        .withColumn("_r", F.row_number().over(inside))
        .filter(F.col("_r") <= TAIL)
        .withColumn("tail", F.collect_list(F.struct(*payload)).over(upto))
        .filter(F.col("_r") == 1).select(*e, "slice", "tail")
    )
    before = Window.partitionBy(*e).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        slices.select(*e, "slice", "rows_before").distinct()
        .join(tail, [*e, "slice"], "left")
        .withColumn("last", F.last("tail", ignorenulls=True).over(before))
    )
    return carried.select(*e, "slice", "rows_before", F.inline("last")).select(
        *e, "slice", "rows_before", *payload, F.lit(True).alias("halo")
    )


def with_first_captures(rows: DataFrame) -> DataFrame:
    """`fresh`: whether an event is the first of its capture file for the entity, over all slices.
    Files are reduced to their first event inside the map tasks before anything is shuffled."""
    e = ["entity_kind", "entity_id"]
    first = (
        rows.filter("pcap_reference IS NOT NULL").groupBy(*e, "pcap_reference").agg(F.min(F.struct("ts_us", "event_id")).alias("_f"))
        .select(*e, F.col("_f.event_id").alias("event_id"), F.lit(True).alias("fresh"))
    )
    return rows.join(first, [*e, "event_id"], "left").fillna(False, ["fresh"])


@dataclass(frozen=True)
class Reach:
    """What vectors look at: the columns of an event (None: all), seconds back, and kinds of its last rows
    (`rows`, `durations`, `arrivals`, `captures`)."""

    columns: frozenset[str] | None = None
    seconds: int | None = None
    tails: frozenset[str] = frozenset({"rows", "durations", "arrivals"})


def entity_events(flows: DataFrame, params: Params, hot: DataFrame | None, reach: Reach = Reach(), kinds: tuple[str, ...] | None = None) -> EntityEvents:
    """Entity rows partitioned by their keys; `reach` limits them to what is asked for.

    The statistics of an event, the keys it counts towards and the times at which an entity
    reports are three scans of the same rows, each shuffled with only its own columns."""
    base = enriched_flows(flows, params)
    n = partitions(flows, kinds)
    if hot is None:
        keys = ("entity_kind", "entity_id")
        placed = entity_rows(base, kinds).withColumn("halo", F.lit(False)).repartition(n, *keys)
        contacts = Window.partitionBy(*keys, "src_ip", "dst_ip").orderBy("ts_us", "event_id")
        rows = placed.withColumn("rarity", _rarity(F.row_number().over(contacts)))
        return EntityEvents(rows, placed, keys, False, params, n, placed)

    e = ["entity_kind", "entity_id"]
    if reach.columns is None:
        rows = entity_rows(with_rarity(base), kinds)
    else:
        rows = entity_rows(base, kinds).select(*e, *sorted(reach.columns | {"ts_us", "event_id"}))
    if "captures" in reach.tails:
        rows = with_first_captures(rows)
    width = max(params.sizes) * 1_000_000
    times = entity_rows(flows.select("ts_us", "src_ip", "dst_ip"), kinds).select(*e, "ts_us")
    hot_rows = times.join(_small(hot), e, "left_semi")
    slices = materialise(slice_map(hot_rows, params), "slices")  # an entity's buckets, few beside its rows
    mapped = rows.withColumn("bucket", F.expr(f"ts_us div {width}")).join(_small(slices), [*e, "bucket"], "left")
    base = mapped.withColumn("halo", F.lit(False))
    drop = ("bucket", "next_slice", "next_bucket")
    tagged = base.filter(F.col("slice").isNotNull())
    plain = tagged.drop(*drop)
    halos = []
    seconds = max(params.sizes) if reach.seconds is None else reach.seconds
    if seconds:
        halos.append(tagged.filter(
            (F.col("next_slice") > F.col("slice")) & (F.col("next_bucket") == F.col("bucket") + 1)
            & (F.col("ts_us") >= F.col("next_bucket") * width - seconds * 1_000_000)
        ).withColumn("slice", F.col("next_slice")).withColumn("halo", F.lit(True)).drop(*drop))
    if "rows" in reach.tails:
        halos.append(_tails(plain, F.lit(True), slices))
    if "durations" in reach.tails:
        halos.append(_tails(plain, F.col("duration").isNotNull(), slices))
    if "arrivals" in reach.tails:
        firsts = plain.groupBy(*e, "slice", "ts_us").agg(F.min_by(F.struct(*[c for c in plain.columns if c not in (*e, "slice", "ts_us")]), "event_id").alias("_f"))
        halos.append(_tails(firsts.select(*e, "slice", "ts_us", "_f.*"), F.lit(True), slices))
    if "captures" in reach.tails:
        halos.append(_tails(plain, F.col("fresh"), slices))
    rows = base.drop(*drop)
    if halos:
        halo = halos[0]
        for more in halos[1:]:
            halo = halo.unionByName(more)
        if len(halos) > 1:
            halo = halo.dropDuplicates([*e, "slice", "event_id"])
        # the halo of slice k must not contain rows of slice k itself; rows_before is per slice
        before = slices.select(*e, "slice", F.col("rows_before").alias("rb")).distinct()
        rows = rows.unionByName(halo.drop("rows_before").join(_small(before, slices), [*e, "slice"]).withColumnRenamed("rb", "rows_before"))
    keys = ("entity_kind", "entity_id", "slice")
    placed = rows.withColumn("slice", F.coalesce("slice", F.lit(0))).repartition(n, *keys)
    return EntityEvents(placed, placed, keys, True, params, n, times.repartition(n, *e), slices)


def _small(table: DataFrame, counted: DataFrame | None = None) -> DataFrame:
    """A table that is sent to every task where it is small, so that what it is joined to need not be shuffled."""
    return F.broadcast(table) if (table if counted is None else counted).count() <= 100_000 else table


def _rarity(contact: Column) -> Column:
    """1.0 at the first contact, falling to 0 at the 21st."""
    return F.greatest(F.lit(0.0), 1.0 - F.least(F.lit(1.0), (contact - 1) / 20.0))


def with_rarity(rows: DataFrame) -> DataFrame:
    """Destination rarity when pairs may be hot: only the first 20 contacts of a pair are ranked
    (the rank limit is applied before the shuffle) and joined back by event; the rest is 0."""
    order = Window.partitionBy("src_ip", "dst_ip").orderBy("ts_us", "event_id")
    first = (
        rows.select("src_ip", "dst_ip", "ts_us", "event_id")
        .withColumn("_rn", F.row_number().over(order)).filter(F.col("_rn") <= 20)
        .select("src_ip", "dst_ip", "event_id", _rarity(F.col("_rn")).alias("rarity"))
    )
    return rows.join(first, ["src_ip", "dst_ip", "event_id"], "left").fillna(0.0, ["rarity"])
