"""Supervised models behind the name and TLS detectors, and their comparison."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wiretally.operators import calibration, drift
from wiretally.params import DEFAULT, Params


@dataclass
class LinearModel:
    """Logistic score from fixed weights; a transparent model that stays one expression."""

    version: str
    weights: dict[str, float]
    bias: float = 0.0

    def column(self) -> Column:
        z = F.lit(float(self.bias))
        for n, w in self.weights.items():
            z = z + F.col(n) * float(w)
        return 1.0 / (1.0 + F.exp(-z))

    def score(self, df: DataFrame, out: str) -> DataFrame:
        return df.withColumn(out, self.column())


@dataclass
class TreeModel:
    """Boosted trees with isotonic calibration, applied as one spark.ml pipeline."""

    version: str
    base: PipelineModel
    calibration: object

    def score(self, df: DataFrame, out: str) -> DataFrame:
        scored = self.base.transform(df).withColumn("_raw", vector_to_array("probability")[1])
        scored = self.calibration.transform(scored)
        drop = ("_features", "rawPrediction", "probability", "prediction", "_raw", "_cal")
        return scored.withColumn(out, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("_cal")))).drop(*drop)


def train(train_rows: DataFrame, validation: DataFrame, features: list[str], version: str, seed: int = 20260905,
          max_iter: int = 120) -> TreeModel:
    """Gradient-boosted trees on the training split, calibrated on the validation split."""
    stages = Pipeline(stages=[
        VectorAssembler(inputCols=features, outputCol="_features"),
        GBTClassifier(
            featuresCol="_features", labelCol="label", maxIter=max_iter, stepSize=0.08, maxDepth=4,
            minInstancesPerNode=40, seed=seed,
        ),
    ])
    base = stages.fit(train_rows.select(*features, F.col("label").cast("double").alias("label")))
    val = base.transform(validation.select(*features, F.col("label").cast("double").alias("label"))).select(
        vector_to_array("probability")[1].alias("_raw"), "label"
    )
    # the pooled blocks stand for all rows: the driver sees their ends, not the validation split
    points = calibration.ends(calibration.blocks(val, "_raw")).withColumnRenamed("score", "_raw")
    iso = IsotonicRegression(featuresCol="_raw", labelCol="label", weightCol="weight", predictionCol="_cal").fit(points)
    return TreeModel(version, base, iso)


def compare(results: DataFrame, metrics: DataFrame, params: Params = DEFAULT, min_samples: int = 20) -> DataFrame:
    """Champion against challenger per detector: live score spread and held-out metrics.

    `results` has detector_name, shadow, confidence; `metrics` has detector, role, version, f1,
    false_positive_rate."""
    live = results.groupBy(F.col("detector_name").alias("detector")).agg(
        F.count_if(~F.col("shadow")).alias("champion_samples"), F.count_if(F.col("shadow")).alias("challenger_samples"),
        F.coalesce(F.avg(F.when(~F.col("shadow"), F.col("confidence"))), F.lit(0.0)).alias("champion_mean_confidence"),
        F.coalesce(F.avg(F.when(F.col("shadow"), F.col("confidence"))), F.lit(0.0)).alias("challenger_mean_confidence"),
    )
    long = results.select(F.col("detector_name").alias("detector"), F.col("confidence").alias("value"), "shadow")
    p = drift.psi(long.filter("not shadow").drop("shadow"), long.filter("shadow").drop("shadow"), params.drift_bins, "detector")
    role = lambda r: metrics.filter(F.col("role") == r).select(
        "detector", F.col("version").alias(f"{r}_version"), F.col("f1").alias(f"{r}_f1"), F.col("false_positive_rate").alias(f"{r}_fpr")
    )
    j = live.join(p.select("detector", "psi"), "detector", "left").join(role("champion"), "detector", "left").join(role("challenger"), "detector", "left")
    enough = (F.col("champion_samples") >= min_samples) & (F.col("challenger_samples") >= min_samples)
    j = j.withColumn("confidence_psi", F.when(enough, F.coalesce("psi", F.lit(0.0))).otherwise(0.0)).drop("psi")
    return j.withColumn("verdict", verdict())


def verdict() -> Column:
    f1 = lambda r: F.coalesce(F.col(f"{r}_f1"), F.lit(0.0))
    fpr = lambda r: F.coalesce(F.col(f"{r}_fpr"), F.lit(1.0))
    better = f1("challenger") > f1("champion")
    base = (
        F.when(better & (fpr("challenger") <= fpr("champion")), "challenger better on held-out F1 and no worse on false positives")
        .when(better, "challenger better on F1 but worse on false positives -- weigh alert load")
        .otherwise("challenger does not beat champion; keep the incumbent")
    )
    note = F.when(
        F.col("confidence_psi") >= 0.2,
        F.concat(F.lit(" (live score distributions differ substantially, PSI="), F.format_string("%.2f", "confidence_psi"), F.lit(")")),
    ).otherwise("")
    return (
        F.when(F.col("challenger_version").isNull(), "no challenger registered")
        .when(F.col("champion_version").isNull(), "no champion; challenger cannot be compared and must not be promoted blind")
        .otherwise(F.concat(base, note))
    )


GATES = (
    "precision", "recall", "false_positive_rate", "inference_latency", "feature_schema", "artifact_integrity",
    "dataset_recorded", "regression_tests", "improves_on_champion", "generalises_to_independent_generator",
    "independent_benign_fpr", "not_implausibly_perfect",
)


def promotion_gates(candidates: DataFrame, champions: DataFrame | None = None, params: Params = DEFAULT,
                    acknowledge: tuple[str, ...] = ()) -> DataFrame:
    """Twelve checks per candidate: true, false, or null where a check does not apply.

    Candidate columns: detector, model_version, precision, recall, f1, false_positive_rate,
    inference_latency_ms, feature_schema_version, artifact_hash, dataset_id,
    regression_tests_passed, independent_generator_recall, independent_benign_fpr. `champions`
    holds (detector, f1); it has one row per detector."""
    c = candidates
    if champions is not None and params.require_champion_improvement:
        best = champions.select("detector", F.coalesce("f1", F.lit(0.0)).alias("champion_f1"))
        c = c.join(best, "detector", "left")
    else:
        c = c.withColumn("champion_f1", F.lit(None).cast("double"))
    have = lambda x, test: F.coalesce(test, F.lit(False)) if x is None else F.coalesce(F.col(x).isNotNull() & test, F.lit(False))
    col = F.col
    when = lambda cond, test: F.when(cond, F.coalesce(test, F.lit(False)))
    checks = {
        "precision": have("precision", col("precision") >= params.min_precision),
        "recall": have("recall", col("recall") >= params.min_recall),
        "false_positive_rate": have("false_positive_rate", col("false_positive_rate") <= params.max_false_positive_rate),
        "inference_latency": have("inference_latency_ms", col("inference_latency_ms") <= params.max_inference_latency_ms),
        "feature_schema": F.coalesce(col("feature_schema_version") == "1.0.0", F.lit(False)),
        "artifact_integrity": F.coalesce(F.length("artifact_hash") == 64, F.lit(False)),
        "dataset_recorded": when(F.lit(params.require_dataset), F.coalesce("dataset_id", F.lit("")) != ""),
        "regression_tests": when(col("regression_tests_passed").isNotNull(), col("regression_tests_passed")),
        "improves_on_champion": when(col("champion_f1").isNotNull(), F.coalesce("f1", F.lit(0.0)) >= col("champion_f1")),
        "generalises_to_independent_generator": when(
            col("independent_generator_recall").isNotNull(), col("independent_generator_recall") >= params.min_transfer_recall),
        "independent_benign_fpr": when(
            col("independent_benign_fpr").isNotNull(), col("independent_benign_fpr") <= params.max_false_positive_rate * 5),
        "not_implausibly_perfect": ~F.coalesce((col("precision") == 1.0) & (col("recall") == 1.0), F.lit(False)),
    }
    out = c.select("detector", "model_version", *[x.alias(f"gate_{n}") for n, x in checks.items()])
    failed = F.array_compact(F.array(*[F.when(~F.coalesce(F.col(f"gate_{n}"), F.lit(True)), F.lit(n)) for n in GATES]))
    known = F.array(*[F.lit(a) for a in acknowledge]).cast("array<string>")
    return out.withColumns({
        "failures": F.array_except(failed, known), "acknowledged": F.array_intersect(failed, known),
    }).withColumn("passed", F.size("failures") == 0)
