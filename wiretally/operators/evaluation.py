"""Model evaluation as aggregations over (score, label) rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wiretally.operators.ranks import cumulative


def _safe(a, b):
    return F.when(b > 0, a / b).otherwise(0.0)


def confusion(df: DataFrame, threshold: float = 0.5, by: list[str] | None = None) -> DataFrame:
    """Confusion counts and the ratios from them, Brier score and positive rate, in one pass."""
    y, p = F.col("label") == 1, F.col("score") >= threshold
    g = df.groupBy(*(by or [])).agg(
        F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"),
        F.count_if(~y & ~p).alias("tn"), F.count_if(y & ~p).alias("fn"),
        F.avg(F.pow(F.col("score") - F.col("label"), 2)).alias("brier_score"),
        F.avg(F.col("label").cast("double")).alias("positive_rate"),
    )
    tp, fp, tn, fn = (F.col(x) for x in ("tp", "fp", "tn", "fn"))
    return g.withColumns({
        "precision": _safe(tp, tp + fp), "recall": _safe(tp, tp + fn), "f1": _safe(2 * tp, 2 * tp + fp + fn),
        "accuracy": _safe(tp + tn, tp + fp + tn + fn),
        "false_positive_rate": _safe(fp, fp + tn), "false_negative_rate": _safe(fn, fn + tp),
    })


def _by_score(df: DataFrame, by: list[str]) -> DataFrame:
    """Positives and negatives per distinct score; large samples shrink to their score grid."""
    return df.groupBy(*by, "score").agg(
        F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") != 1).alias("neg")
    )


def ranking(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """ROC-AUC (average ranks) and step-wise average precision; 0 with a single class."""
    by = by or ["_all"]
    src = df.withColumn("_all", F.lit(0)) if by == ["_all"] else df
    t = cumulative(_by_score(src, by), by, "score", ("pos", "neg"))
    pos, neg, P, N = (F.col(x) for x in ("pos", "neg", "all_pos", "all_neg"))
    above = P - F.col("cum_pos")  # positives with a higher score
    tp = above + pos
    seen = tp + N - F.col("cum_neg") + neg
    auc = F.sum(neg * (above + 0.5 * pos) / (P * N))
    ap = F.sum(pos / P * tp / seen)
    out = t.filter((P > 0) & (N > 0)).groupBy(*by).agg(auc.alias("roc_auc"), ap.alias("pr_auc"))
    groups = src.select(*by).distinct()
    return groups.join(out, by, "left").fillna(0.0, ["roc_auc", "pr_auc"]).drop("_all")


def transfer_check(df: DataFrame, threshold: float) -> DataFrame:
    """Recall, false-positive rate and mean probability on probe names from outside the corpus."""
    hit = (F.col("score") >= threshold).cast("double")
    of = lambda v, y: F.coalesce(F.avg(F.when(F.col("label") == y, v)), F.lit(0.0))
    return df.agg(
        of(hit, 1).alias("independent_generator_recall"), of(hit, 0).alias("independent_benign_fpr"),
        of(F.col("score"), 1).alias("independent_dga_mean_probability"),
        of(F.col("score"), 0).alias("independent_benign_mean_probability"),
    )


def score_means(results: DataFrame) -> DataFrame:
    """Sample count and mean confidence per detector and role (champion / challenger)."""
    return results.groupBy("detector_name", F.when(F.col("shadow"), "challenger").otherwise("champion").alias("role")).agg(
        F.count("*").alias("samples"), F.avg("confidence").alias("mean_confidence")
    )
