"""The whole batch plan: flows -> vectors -> detector results -> alerts and incidents."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wiretally.operators import features as ft
from wiretally.operators.detectors import DETECTORS, detect, kinds_of, needed_features
from wiretally.operators.fusion import Fused, fuse
from wiretally.params import DEFAULT, Params
from wiretally.sources.storage import materialise


def tune(spark: SparkSession) -> None:
    """Runtime settings the plans rely on (all are plain Spark SQL settings)."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.sessionWindow.merge.sessions.in.local.partition", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")


@dataclass
class Detection:
    reads: DataFrame
    results: DataFrame
    fused: Fused


def run_detection(
    flows: DataFrame, params: Params = DEFAULT, champions=None, challengers=None,
    flow_ids: bool = True, detectors=DETECTORS, run_id: str | None = None, flush_ts: int | None = None,
    materialised: bool = True,
) -> Detection:
    """`materialised` writes features and detector results once to the shared folder: detectors
    and fusion read them several times, and both are tables the store keeps anyway. Entities of each kind get the
    features that the detectors of that kind look at; those of other kinds are null."""
    tune(flows.sparkSession)
    if flush_ts is None and params.flush_at == "global":
        flush_ts = flows.agg(F.max("ts_us")).first()[0]
    reads = None
    for kind in kinds_of(detectors):
        picked = [d for d in detectors if kind in d.kinds]
        own = ft.vectors(
            flows, params, needed_features(picked), protocol=any(d.source != "windowed" for d in picked),
            extras=("flow_ids",) if flow_ids else (), flush_ts=flush_ts, dns_sizes=(60,), kinds=(kind,),
        )
        reads = own if reads is None else reads.unionByName(own, allowMissingColumns=True)
    if materialised:
        reads = materialise(reads, "features")
    results = detect(reads, params, detectors, champions, challengers)
    if materialised:
        results = materialise(results, "results")
    return Detection(reads, results, fuse(results, params, run_id))
