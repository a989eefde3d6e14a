"""Error boundaries: a detector or model that fails takes no other detector with it.

Three places can fail. A detector that cannot be planned is left out. A model written in Python is asked
again with halves of a batch it raises on, so that only the rows it cannot score lack a score. An expression
that raises while it runs fails its job; then every detector gets a job of its own, and those that end
keep their results. Whatever failed is told in a table of errors."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wiretally.operators import features as ft
from wiretally.operators.detectors.mesh import DETECTORS, detect
from wiretally.params import DEFAULT, Params
from wiretally.sources.storage import materialise

ERRORS = "detector_name string, stage string, error string, rows bigint"
SCORED = "p double, error string"


def scored_in_halves(predict: Callable, batch: pd.DataFrame) -> pd.DataFrame:
    """p and error of every row; a batch that raises is halved until single rows raise."""
    out = pd.DataFrame({"p": pd.Series(float("nan"), batch.index), "error": pd.Series(None, batch.index, dtype=object)})
    todo = [(0, len(batch))]
    while todo:
        lo, hi = todo.pop()
        if lo == hi:
            continue
        try:
            found = list(predict(batch.iloc[lo:hi]))
            if len(found) != hi - lo:
                raise ValueError(f"{len(found)} scores of {hi - lo} rows")
            out.iloc[lo:hi, 0] = [float("nan") if v is None else float(v) for v in found]
        except Exception as ex:  # noqa: BLE001 -- the boundary: the row is reported and the batch goes on
            if hi - lo == 1:
                out.iloc[lo, 1] = f"{type(ex).__name__}: {ex}"[:200]
            else:
                mid = (lo + hi) // 2
                todo += [(lo, mid), (mid, hi)]
    return out


@dataclass
class PythonModel:
    """A model of any library: `predict` takes a pandas frame of the features and gives a score per row.

    `score` adds the score and `<out>_error`; a row that raises has no score and so no result."""

    version: str
    predict: Callable
    features: tuple[str, ...]

    def score(self, df: DataFrame, out: str) -> DataFrame:
        predict = self.predict

        @F.pandas_udf(SCORED)
        def guarded(batch: pd.DataFrame) -> pd.DataFrame:
            return scored_in_halves(predict, batch)

        rows = df.withColumn("_scored", guarded(F.struct(*self.features)))
        return rows.withColumns({out: F.nanvl("_scored.p", F.lit(None).cast("double")), f"{out}_error": F.col("_scored.error")}).drop("_scored")


@dataclass
class Guarded:
    results: DataFrame | None
    errors: DataFrame


def _message(ex: Exception) -> str:
    return f"{type(ex).__name__}: {str(ex).strip().splitlines()[0] if str(ex).strip() else ''}"[:200]


def detect_guarded(reads: DataFrame, params: Params = DEFAULT, detectors=DETECTORS, champions=None, challengers=None) -> Guarded:
    """`detect` behind error boundaries: results of the detectors that ran, written once, and the errors
    of the others. `results` is None if none ran. Healthy detectors cost one job together."""
    spark, parts, errors = reads.sparkSession, {}, []
    for d in detectors:
        if d.source != "windowed" and d.technique == "SUPERVISED" and d.name not in (champions or {}):
            continue  # not ready: silent, no error
        try:
            parts[d.name] = detect(reads, params, (d,), champions, challengers)
        except Exception as ex:  # noqa: BLE001
            errors.append((d.name, "plan", _message(ex), None))
    results = None
    if parts:
        try:
            results = materialise(_union(parts.values()), "results")
        except Exception:  # noqa: BLE001 -- one of them: each on its own
            done = []
            for name, part in parts.items():
                try:
                    done.append(materialise(part, "results"))
                except Exception as ex:  # noqa: BLE001
                    errors.append((name, "run", _message(ex), None))
            results = _union(done) if done else None
    table = spark.createDataFrame(errors, ERRORS)
    for d in detectors:
        own = _model_errors(reads, params, d, champions or {}) if d.name in parts else None
        table = table if own is None else table.unionByName(own)
    return Guarded(results, table)


def _union(parts) -> DataFrame:
    parts = list(parts)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _model_errors(reads: DataFrame, params: Params, d, champions: dict) -> DataFrame | None:
    model = champions.get(d.name)
    if not isinstance(model, PythonModel) or d.source == "windowed":
        return None
    rows = ft.dns_vectors(reads, params) if d.source == "dns" else ft.tls_vectors(reads)
    return model.score(rows, "_p").filter(F.col("_p_error").isNotNull()).groupBy(F.col("_p_error").alias("error")).agg(F.count("*").alias("rows")).select(
        F.lit(d.name).alias("detector_name"), F.lit("model").alias("stage"), "error", "rows")
