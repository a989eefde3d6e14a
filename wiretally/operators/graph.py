"""Topology from flows: edges, nodes, totals, capped top-k view."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wiretally.functions.net import is_private
from wiretally.functions.stats import severity_name, severity_rank


def edges(flows: DataFrame, alerts: DataFrame | None = None) -> DataFrame:
    """Directed edges: flows, bytes, alert ids and highest severity. Both sides are aggregated
    per pair before they are joined."""
    e = flows.groupBy("src_ip", "dst_ip").agg(
        F.count("*").alias("flows"), F.sum(F.col("orig_bytes") + F.coalesce("resp_bytes", F.lit(0))).alias("bytes")
    )
    if alerts is None:
        return e.withColumns({"alerts": F.lit(0).cast("bigint"), "severity": F.lit(None).cast("string")})
    a = alerts.filter(F.col("src_ip").isNotNull() & F.col("dst_ip").isNotNull()).groupBy("src_ip", "dst_ip").agg(
        F.count_distinct("alert_id").alias("alerts"), severity_name(F.max(severity_rank(F.col("severity")))).alias("severity"),
    )
    return e.join(a, ["src_ip", "dst_ip"], "left").fillna(0, ["alerts"])


def alert_ids_of_edges(alerts: DataFrame) -> DataFrame:
    """The alerts of each edge as rows (src, dst, alert_id); never gathered into one list."""
    return alerts.filter(F.col("src_ip").isNotNull() & F.col("dst_ip").isNotNull()).select("src_ip", "dst_ip", "alert_id").distinct()


def nodes(edge_table: DataFrame, flows: DataFrame) -> DataFrame:
    """Both endpoints of every flow: connections, bytes, alerts, services. Built on the edge
    table, so a hub's flows are summed per pair first."""
    ends = F.explode(F.array("src_ip", "dst_ip")).alias("id")
    n = edge_table.select(ends, "flows", "bytes", (F.col("alerts") * F.col("flows")).alias("alerts")).groupBy("id").agg(
        F.sum("flows").alias("connections"), F.sum("bytes").alias("bytes"), F.sum("alerts").alias("alerts")
    )
    services = (
        flows.filter(F.coalesce("service", F.lit("")) != "").select(ends, "service").distinct()
        .groupBy("id").agg(F.array_join(F.array_sort(F.collect_list("service")), ",").alias("services"))
    )
    kind = F.when(is_private(F.col("id")), "internal").otherwise("external")
    return n.join(services, "id", "left").withColumn("kind", kind).fillna("", ["services"])


def capped(edge_table: DataFrame, node_table: DataFrame, max_nodes: int = 200, max_edges: int = 500):
    """(nodes, edges) of the drawn graph: the busiest ones, edges only between drawn nodes."""
    top_nodes = node_table.orderBy(F.desc("connections"), "id").limit(max_nodes)
    top_edges = edge_table.orderBy(F.desc("flows"), "src_ip", "dst_ip").limit(max_edges)
    ids = F.broadcast(top_nodes.select("id"))  # at most max_nodes rows
    kept = top_edges.join(ids.withColumnRenamed("id", "src_ip"), "src_ip", "left_semi").join(
        ids.withColumnRenamed("id", "dst_ip"), "dst_ip", "left_semi"
    )
    return top_nodes, kept


def totals(edge_table: DataFrame, node_table: DataFrame, max_nodes: int = 200, max_edges: int = 500) -> DataFrame:
    e = edge_table.agg(
        F.sum("flows").alias("flows"), F.sum("bytes").alias("bytes"), F.count_if(F.col("alerts") > 0).alias("alerted_edges"),
        F.count("*").alias("total_edges"),
    )
    n = node_table.agg(
        F.count_if(F.col("kind") == "internal").alias("internal"), F.count_if(F.col("kind") == "external").alias("external"),
        F.count("*").alias("total_nodes"),
    )
    both = e.withColumn("_k", F.lit(1)).join(n.withColumn("_k", F.lit(1)), "_k").drop("_k")
    return both.withColumn("truncated", (F.col("total_nodes") > max_nodes) | (F.col("total_edges") > max_edges))


def counterparts(edge_table: DataFrame) -> DataFrame:
    """Every node's distinct peers as rows."""
    out = edge_table.select(F.col("src_ip").alias("id"), F.col("dst_ip").alias("peer"))
    back = edge_table.select(F.col("dst_ip").alias("id"), F.col("src_ip").alias("peer"))
    return out.unionByName(back).distinct()
