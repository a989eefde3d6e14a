"""Distribution drift between a reference and a current sample, for all features at once.

Inputs are long tables (feature, value). Each statistic is one grouped plan whatever the number
of features: values are counted per (feature, value) first, so the shuffle carries distinct
values, and a feature that holds most rows does not become one task until it is that small.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wiretally.operators.ranks import cumulative, exact_quantiles, global_rank
from wiretally.params import DEFAULT, Params
from wiretally.sources.storage import materialise

EPS = 1e-6


def value_counts(ref: DataFrame, cur: DataFrame, by: str = "feature") -> DataFrame:
    """(feature, value, r, c): occurrences in either sample."""
    both = ref.select(by, "value", F.lit(1).alias("r"), F.lit(0).alias("c")).unionByName(
        cur.select(by, "value", F.lit(0).alias("r"), F.lit(1).alias("c"))
    )
    return both.groupBy(by, "value").agg(F.sum("r").alias("r"), F.sum("c").alias("c"))


def ranked_counts(ref: DataFrame, cur: DataFrame, by: str = "feature") -> DataFrame:
    """value_counts with running totals and sums per feature. Counts and totals are written once each,
    so the samples are read once whatever is derived from them."""
    return materialise(cumulative(materialise(value_counts(ref, cur, by), "drift-counts"), [by]), "drift-ranks")


def psi(ref: DataFrame, cur: DataFrame, bins: int = 10, by: str = "feature", open_ends: bool = False) -> DataFrame:
    """Population stability index on exact reference quantile bins, last bin closed.

    Values outside the reference range are left out unless `open_ends`. A (nearly) constant
    reference gives the share of current values that differ from it."""
    return psi_of(ranked_counts(ref, cur, by), bins, by, open_ends)


def psi_of(counts: DataFrame, bins: int = 10, by: str = "feature", open_ends: bool = False) -> DataFrame:
    """psi() from `ranked_counts`."""
    qs = [i / bins for i in range(bins + 1)]
    edges = exact_quantiles(counts, [by], qs).select(by, F.array_distinct("quantiles").alias("edges"))
    sizes = counts.groupBy(by).agg(F.sum("r").alias("n_ref"), F.sum("c").alias("n_cur"))
    meta = edges.join(sizes, by)
    k = F.size("edges")
    at = F.size(F.filter("edges", lambda e: e <= F.col("value")))
    last = F.col("value") == F.element_at("edges", -1)
    bin_no = F.when(last, k - 1).otherwise(at)
    if open_ends:
        bin_no = F.greatest(F.lit(1), F.least(k - 1, bin_no))
    placed = counts.select(by, "value", "r", "c").join(F.broadcast(meta), by).withColumn("bin", bin_no)
    inside = placed.filter((F.col("bin") >= 1) & (F.col("bin") <= k - 1) & (k >= 3)).groupBy(by, "bin", "edges").agg(
        F.sum("r").alias("r"), F.sum("c").alias("c")
    )
    total = Window.partitionBy(by)
    share = lambda c: F.greatest(F.col(c) / F.greatest(F.lit(1), F.sum(c).over(total)), F.lit(EPS))
    terms = inside.withColumns({"pr": share("r"), "pc": share("c")})
    summed = terms.groupBy(by).agg(F.sum((F.col("pc") - F.col("pr")) * F.log(F.col("pc") / F.col("pr"))).alias("binned"))
    constant = placed.filter(k < 3).groupBy(by).agg(
        (F.sum(F.when(F.col("value") != F.col("edges")[0], F.col("c")).otherwise(0)) / F.nullif(F.sum("c"), F.lit(0))).alias("outside")
    )
    return meta.join(summed, by, "left").join(constant, by, "left").select(
        by, "n_ref", "n_cur",
        F.when((F.col("n_ref") < 2) | (F.col("n_cur") < 1), 0.0).otherwise(F.coalesce("binned", "outside", F.lit(0.0))).alias("psi"),
    )


def ks(ref: DataFrame, cur: DataFrame, by: str = "feature") -> DataFrame:
    """Two-sample Kolmogorov-Smirnov D over the running shares of the distinct values; 0 where a
    sample has fewer than two values."""
    return ks_of(ranked_counts(ref, cur, by), by)


def ks_of(counts: DataFrame, by: str = "feature") -> DataFrame:
    """ks() from `ranked_counts`."""
    gap = F.abs(F.try_divide("cum_r", "all_r") - F.try_divide("cum_c", "all_c"))
    few = (F.max("all_r") < 2) | (F.max("all_c") < 2)
    return counts.groupBy(by).agg(F.when(few, 0.0).otherwise(F.max(gap)).alias("ks"))


def js_from_counts(counts: DataFrame, by: list[str]) -> DataFrame:
    """Jensen-Shannon divergence in bits from (by, category, r, c) counts of few categories; 0 where
    either sample is empty."""
    w = Window.partitionBy(*by)
    p, q = F.try_divide("r", F.sum("r").over(w)), F.try_divide("c", F.sum("c").over(w))
    shares = counts.select(*by, p.alias("p"), q.alias("q"))
    m = 0.5 * (F.col("p") + F.col("q"))
    term = lambda x: F.when(F.col(x) > 0, F.col(x) * F.log2(F.col(x) / F.greatest(m, F.lit(EPS)))).otherwise(0.0)
    whole = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.5 * F.sum(term("p")) + 0.5 * F.sum(term("q"))))
    return shares.groupBy(*by).agg(F.when((F.count("p") > 0) & (F.count("q") > 0), whole).otherwise(0.0).alias("js"))


def js(ref: DataFrame, cur: DataFrame, category: str) -> DataFrame:
    """Divergence of two categorical samples (full outer join of their counts); 0 if either is empty."""
    r = ref.groupBy(category).agg(F.count("*").alias("r"))
    c = cur.groupBy(category).agg(F.count("*").alias("c"))
    both = r.join(c, category, "full_outer").fillna(0, ["r", "c"]).withColumn("_k", F.lit(1))
    total = both.groupBy("_k").agg(F.sum("r").alias("tr"), F.sum("c").alias("tc"))  # one row
    shares = both.join(F.broadcast(total), "_k").filter("tr > 0 and tc > 0").select((F.col("r") / F.col("tr")).alias("p"), (F.col("c") / F.col("tc")).alias("q"))
    m = 0.5 * (F.col("p") + F.col("q"))
    term = lambda x: F.when(F.col(x) > 0, F.col(x) * F.log2(F.col(x) / F.greatest(m, F.lit(EPS)))).otherwise(0.0)
    whole = 0.5 * F.sum(term("p")) + 0.5 * F.sum(term("q"))
    return shares.agg(F.when(F.count("p") > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), whole))).otherwise(0.0).alias("js"))


def is_discrete(ref: DataFrame, by: str = "feature", limit: int = 4) -> DataFrame:
    return ref.groupBy(by).agg(F.count_distinct("value").alias("n_distinct")).withColumn(
        "discrete", F.col("n_distinct") <= limit
    )


RECOMMENDATION = {
    "jensen_shannon": "the mix of categories moved: look at what the sensors send, then decide on retraining",
    "psi": "values left their former ranges: collect training data that covers them and evaluate before any promotion",
    "ks": "the shape moved within its ranges: keep watching",
    "score": "the scores of the model moved: compare sensors and the latest analyst judgements",
    "class": "the mix of alert classes moved: tell a change of traffic from a fault of the detector",
}


def feature_drift(ref: DataFrame, cur: DataFrame, params: Params = DEFAULT, by: str = "feature") -> DataFrame:
    """Only breaching features: JS for discrete ones, else PSI, else KS; one row per feature."""
    counts = ranked_counts(ref, cur, by)
    kinds = is_discrete(counts.filter("r > 0"), by)
    few = counts.join(F.broadcast(kinds.filter("discrete").select(by)), by, "left_semi")
    all_ = psi_of(counts, params.drift_bins, by).join(ks_of(counts, by), by).join(js_from_counts(few, [by]), by, "left").join(kinds, by)
    enough = (F.col("n_ref") >= params.drift_min_samples) & (F.col("n_cur") >= params.drift_min_samples)
    metric = (
        F.when(F.col("discrete"), F.when(F.col("js") >= params.js_threshold, "jensen_shannon"))
        .when(F.col("psi") >= params.psi_threshold, "psi")
        .when(F.col("ks") >= params.ks_threshold, "ks")
    )
    pick = lambda a, b, c: F.when(F.col("metric") == "jensen_shannon", a).when(F.col("metric") == "psi", b).otherwise(c)
    return all_.filter(enough).withColumn("metric", metric).filter("metric is not null").select(
        by, F.lit("FEATURE_DISTRIBUTION").alias("drift_type"), "metric",
        pick(F.col("js"), F.col("psi"), F.col("ks")).alias("score"),
        pick(F.lit(params.js_threshold), F.lit(params.psi_threshold), F.lit(params.ks_threshold)).alias("threshold"),
        F.col("n_ref").alias("reference_size"), F.col("n_cur").alias("current_size"),
        pick(*[F.lit(RECOMMENDATION[m]) for m in ("jensen_shannon", "psi", "ks")]).alias("recommendation"),
    )


def score_drift(ref: DataFrame, cur: DataFrame, params: Params = DEFAULT, by: str = "detector") -> DataFrame:
    """Detectors whose own scores moved (PSI); one row per breach."""
    p = psi(ref, cur, params.drift_bins, by)
    ok = (F.col("n_ref") >= params.drift_min_samples) & (F.col("n_cur") >= params.drift_min_samples)
    return p.filter(ok & (F.col("psi") >= params.psi_threshold)).select(
        by, F.lit("CONFIDENCE_DISTRIBUTION").alias("drift_type"), F.lit("psi").alias("metric"),
        F.col("psi").alias("score"), F.lit(params.psi_threshold).alias("threshold"),
        F.col("n_ref").alias("reference_size"), F.col("n_cur").alias("current_size"),
        F.lit(RECOMMENDATION["score"]).alias("recommendation"),
    )


def class_drift(ref: DataFrame, cur: DataFrame, category: str, params: Params = DEFAULT, by: str = "detector") -> DataFrame:
    """Detectors whose mix of classes moved (JS); one row per breach."""
    counts = materialise(value_counts(ref.withColumn("value", F.col(category)), cur.withColumn("value", F.col(category)), by), "class-counts")
    sizes = counts.groupBy(by).agg(F.sum("r").alias("reference_size"), F.sum("c").alias("current_size"))
    return js_from_counts(counts, [by]).filter(F.col("js") >= params.js_threshold).join(sizes, by).select(
        by, F.lit("CLASS_DISTRIBUTION").alias("drift_type"), F.lit("jensen_shannon").alias("metric"),
        F.col("js").alias("score"), F.lit(params.js_threshold).alias("threshold"), "reference_size", "current_size",
        F.lit(RECOMMENDATION["class"]).alias("recommendation"),
    )


def precision_decay(judged: DataFrame, by: str = "detector", max_drop: float = 0.1, min_samples: int = 10) -> DataFrame:
    """Drop of analyst-confirmed precision between periods.

    `judged` has (by, period in reference/current, label)."""
    p = judged.groupBy(by).agg(
        *[
            x.alias(f"{name}_{period}")
            for period in ("reference", "current")
            for name, x in (
                ("tp", F.count_if((F.col("period") == period) & (F.col("label") == "TRUE_POSITIVE"))),
                ("n", F.count_if((F.col("period") == period) & F.col("label").isin("TRUE_POSITIVE", "FALSE_POSITIVE"))),
            )
        ]
    )
    prec = lambda x: F.when(F.col(f"n_{x}") > 0, F.col(f"tp_{x}") / F.col(f"n_{x}")).otherwise(0.0)
    drop = prec("reference") - prec("current")
    return p.select(by, prec("reference").alias("precision_reference"), prec("current").alias("precision_current"),
                    drop.alias("drop"), F.col("n_current").alias("sample_size")).filter(
        (F.col("drop") >= max_drop) & (F.col("sample_size") >= min_samples)
    )


def halves(rows: DataFrame, order: list[str], n_newest: int | None = None) -> DataFrame:
    """Newest half `current`, older half `reference`, of the newest N rows."""
    total = rows.count()
    n = total if n_newest is None else min(n_newest, total)
    return global_rank(rows, order, descending=True).filter(F.col("rank") <= n).withColumn(
        "half", F.when(F.col("rank") <= n // 2, "current").otherwise("reference")
    ).drop("rank")
