"""What a detector is: which rows it accepts, when it fires, and what it then says."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from wiretally.functions.stats import clamp01
from wiretally.params import SCHEMA_VERSION, Params


@dataclass
class Verdict:
    """Column expressions of one detector for the current row; `fires` decides if it speaks."""

    fires: Column
    score: Column
    confidence: Column
    severity: Column
    reasons: Column  # array<string>
    supporting: dict[str, Column]


@dataclass(frozen=True)
class Detector:
    name: str
    threat_class: str
    technique: str
    basis: str
    kinds: tuple[str, ...]
    evaluate: Callable[[Params], Verdict]
    features: tuple[str, ...] = ()
    source: str = "windowed"  # or "dns", "tls"
    version: str = "1.0.0"
    rank: int = 99
    model_version: str | None = None
    extra: dict = field(default_factory=dict)

    def result(self, params: Params) -> Column:
        """Nullable result struct: null where the detector has nothing to report."""
        v = self.evaluate(params)
        accepted = F.col("entity_kind").isin(*self.kinds)
        support = F.map_filter(F.map_from_arrays(
            F.array(*[F.lit(n) for n in v.supporting]),
            F.array(*[c.cast("double") for c in v.supporting.values()]),
        ), lambda k, x: x.isNotNull())
        struct = F.struct(
            F.lit(self.name).alias("detector_name"), F.lit(self.version).alias("detector_version"),
            F.lit(self.threat_class).alias("threat_class"), F.lit(self.technique).alias("technique"),
            v.score.cast("double").alias("score"), clamp01(v.confidence).alias("confidence"),
            F.lit(self.basis).alias("confidence_basis"), v.severity.alias("severity_hint"),
            support.alias("supporting_features"), F.slice(v.reasons, 1, 32).alias("reason_codes"),
            F.lit(self.model_version).cast("string").alias("model_version"),
            F.lit(SCHEMA_VERSION).alias("feature_schema_version"), F.lit(False).alias("shadow"),
            F.lit(self.rank).alias("det_rank"),
        )
        return F.when(accepted & F.coalesce(v.fires, F.lit(False)), struct)


def codes(*pairs: tuple[Column, str]) -> Column:
    """The names whose condition holds, in the given order."""
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for c, n in pairs]))


def severity(*ladder: tuple[Column, str], default: str) -> Column:
    out = None
    for cond, name in ladder:
        out = F.when(cond, name) if out is None else out.when(cond, name)
    return out.otherwise(default)
