"""Training datasets: stratified and temporal splits, feedback joins, content hash."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wiretally.functions.text import lexical_of, name_parts
from wiretally.operators.ranks import global_rank
from wiretally.sources.storage import materialise


def _split_of(rank, n):
    return F.when(rank <= F.floor(n * 0.7), "train").when(rank <= F.floor(n * 0.85), "validation").otherwise("test")


def stratified_split(rows: DataFrame, strata: list[str], key: str) -> DataFrame:
    """70/15/15 inside every stratum, in hash order of the key.

    A stratum may hold most of the rows, so ranks come from (stratum, hash bucket) pieces whose
    sizes are added up, not from one sort per stratum."""
    h = F.conv(F.substring(F.sha2(F.col(key).cast("string"), 256), 1, 8), 16, 10).cast("bigint")
    digest = F.sha2(F.col(key).cast("string"), 256)
    r = rows.withColumns({"_h": digest, "_b": F.floor(h / (1 << 20))})  # 4096 ordered buckets
    sizes = r.groupBy(*strata, "_b").agg(F.count("*").alias("_n"))
    order = Window.partitionBy(*strata).orderBy("_b")
    sizes = sizes.select(
        *strata, "_b",
        F.coalesce(F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
        F.sum("_n").over(Window.partitionBy(*strata)).alias("_total"),
    )
    local = F.row_number().over(Window.partitionBy(*strata, "_b").orderBy("_h", key))
    ranked = r.withColumn("_r", local).join(sizes, [*strata, "_b"])
    return ranked.withColumn("split", _split_of(F.col("_r") + F.col("_before"), F.col("_total"))).drop(
        "_h", "_b", "_r", "_before", "_total"
    )


def temporal_split(rows: DataFrame, order: list[str]) -> DataFrame:
    """Oldest 70 % train, next 15 % validation, newest 15 % test."""
    n = rows.count()
    return global_rank(rows, order).withColumn("split", _split_of(F.col("rank"), F.lit(n))).drop("rank")


def name_dataset(names: DataFrame, holdout_family: str | None = None) -> DataFrame:
    """Lexical rows from labelled names (domain, label, family): distinct names first, so no copy
    can sit on both sides of a split; the held-out family becomes `unseen_family` and is scored
    against the benign test names."""
    first = F.min(F.struct("label", "family"))  # of one row, so the two belong together
    # written: splits and their sizes read the names several times, and each time would read all that they come from
    distinct = materialise(names.groupBy("domain").agg(first.alias("f")).select("domain", "f.label", "f.family"), "names")
    held = (F.col("family") == holdout_family) & (F.col("label") == 1) if holdout_family else F.lit(False)
    parts = stratified_split(distinct.filter(~held), ["label", "family"], "domain")
    if holdout_family:
        unseen = distinct.filter(held).withColumn("split", F.lit("unseen_family"))
        benign = parts.filter("split = 'test' and label = 0").withColumn("split", F.lit("unseen_family"))
        parts = parts.unionByName(unseen).unionByName(benign)
    shared = name_parts(F.col("domain"))
    lex = lexical_of(F.col("domain"), **{n: F.col(f"_{n}") for n in shared})
    return parts.withColumns({f"_{n}": c for n, c in shared.items()}).select("domain", "label", "family", "split", *[c.alias(n) for n, c in lex.items()])


def feedback_dataset(feedback: DataFrame, alerts: DataFrame, detector: str, features: list[str], min_rows: int = 20) -> DataFrame:
    """Judged alerts of one detector with the evidence values the verdict used.

    `alerts` needs alert_id, detector_name, ts_us, observations, comparisons. The latest label
    of an alert counts; fewer than `min_rows` rows give an empty dataset."""
    w = Window.partitionBy("alert_id").orderBy(F.desc("ts_us"), "feedback_id")
    usable = (
        feedback.filter(F.col("label").isin("TRUE_POSITIVE", "FALSE_POSITIVE"))
        .withColumn("_r", F.row_number().over(w)).filter("_r = 1")
        .select("feedback_id", "alert_id", F.when(F.col("label") == "TRUE_POSITIVE", 1).otherwise(0).alias("label"))
    )
    a = alerts.filter(F.col("detector_name") == detector).select(
        "alert_id", "ts_us", F.map_concat("observations", "comparisons").alias("v")
    )
    j = usable.join(a, "alert_id")
    complete = F.lit(True)
    for n in features:
        complete = complete & F.map_contains_key("v", n)
    rows = j.filter(complete).select(
        "feedback_id", "alert_id", "ts_us", "label", *[F.element_at("v", n).alias(n) for n in features]
    )
    if rows.limit(min_rows).count() < min_rows:
        return rows.limit(0).withColumn("split", F.lit(""))
    return temporal_split(rows, ["ts_us", "alert_id"])


def known_and_unknown(feedback: DataFrame, alerts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Feedback that names an existing alert, and the rest."""
    ids = alerts.select("alert_id")
    return feedback.join(ids, "alert_id", "left_semi"), feedback.join(ids, "alert_id", "left_anti")


def unconsumed(feedback: DataFrame, consumed: DataFrame) -> DataFrame:
    return feedback.join(consumed.select("feedback_id"), "feedback_id", "left_anti")


def consumption(dataset: DataFrame, dataset_id: str) -> DataFrame:
    """Rows for the consumption table: only the feedback that was used."""
    return dataset.select("feedback_id", F.lit(dataset_id).alias("dataset_id"))


def content_hash(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Order-independent hash: row hashes are folded with sums, so it combines across tasks.

    Values carry their length, so neither nulls nor separators inside values make rows look alike."""
    value = lambda c: F.coalesce(F.concat(F.length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-"))
    h = F.sha2(F.concat_ws("|", *[value(F.col(c)) for c in columns]), 256)
    piece = lambda i: F.conv(F.substring(h, 1 + 8 * i, 8), 16, 10).cast("bigint")
    sums = [F.sum(piece(i)).alias(f"p{i}") for i in range(8)]
    return rows.agg(F.count("*").alias("row_count"), *sums).select(
        "row_count", F.sha2(F.concat_ws("|", "row_count", *[f"p{i}" for i in range(8)]), 256).alias("content_hash")
    )


def metadata(dataset: DataFrame, dataset_id: str, detector: str, features: list[str], strategy: str) -> DataFrame:
    """One metadata row: split sizes, class distribution, content hash."""
    label, split = F.col("label").cast("string"), F.col("split")
    g = dataset.groupBy(split.alias("split"), label.alias("label")).agg(F.count("*").alias("n"))
    m = g.agg(
        F.map_from_entries(F.collect_list(F.struct(F.concat_ws(":", "split", "label").alias("k"), F.col("n").alias("v")))).alias("split_sizes"),
        F.sum("n").alias("rows"),
    )
    key = [c for c in ("domain", "alert_id") if c in dataset.columns]
    h = content_hash(dataset, [*key, "label"])
    return m.withColumn("_k", F.lit(1)).join(h.withColumn("_k", F.lit(1)), "_k").select(
        F.lit(dataset_id).alias("dataset_id"), F.lit(detector).alias("detector"), "split_sizes", "row_count", "content_hash",
        F.array(*[F.lit(f) for f in features]).alias("feature_names"), F.lit(strategy).alias("split_strategy"),
        F.lit("1.0.0").alias("feature_schema_version"),
    )
