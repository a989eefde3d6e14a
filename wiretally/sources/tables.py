"""Analytical tables: appends, insert-or-ignore, newest version per key, audit log, retention.

Tables are Parquet folders partitioned by event date. Nothing is updated in place: versions and
log rows are appended, and reads pick the current one.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# name -> (key columns or None, event time column in microseconds or timestamp)
TABLES = {
    "events": ("event_id", "ts_us"),
    "features": (None, "ts_us"),
    "detector_results": (None, "ts_us"),
    "alerts": ("alert_id", "ts_us"),
    "alert_events": (None, "ts_us"),
    "incidents": ("incident_id", "last_seen_us"),
    "feedback": ("feedback_id", "ts_us"),
    "drift_events": ("drift_id", "ts_us"),
    "benchmarks": ("benchmark_id", "ts_us"),
}
PRUNED = ("events", "features", "detector_results")


def exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def with_date(df: DataFrame, time: str) -> DataFrame:
    return df.withColumn("date", F.to_date(F.timestamp_micros(time)))


def append(df: DataFrame, root: str, name: str) -> None:
    with_date(df, TABLES[name][1]).write.mode("append").partitionBy("date").parquet(f"{root}/{name}")


def read(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}")


def insert_or_ignore(df: DataFrame, existing: DataFrame | None, key: str) -> DataFrame:
    """Rows of `df` whose key is new, one per key."""
    fresh = df.dropDuplicates([key])
    return fresh if existing is None else fresh.join(existing.select(key), key, "left_anti")


def insert_new(df: DataFrame, root: str, name: str) -> None:
    """Idempotent append: only the dates being written are compared."""
    key, time = TABLES[name]
    spark = df.sparkSession
    old = None
    if exists(spark, f"{root}/{name}"):
        dates = with_date(df, time).select("date").distinct()
        # a first batch without rows leaves a folder without files to take a schema from
        known = spark.read.schema(with_date(df, time).select(key, "date").schema).parquet(f"{root}/{name}")
        old = known.join(F.broadcast(dates) if _few(dates) else dates, "date", "left_semi")
    append(insert_or_ignore(df, old, key), root, name)


def _few(dates: DataFrame, limit: int = 10_000) -> bool:
    return dates.limit(limit + 1).count() <= limit


def latest(versions: DataFrame, key: str, version: str) -> DataFrame:
    """Newest version of every key (insert-or-replace, read side)."""
    w = Window.partitionBy(key).orderBy(F.desc(version))
    return versions.withColumn("_v", F.row_number().over(w)).filter("_v = 1").drop("_v")


def current_alerts(alerts: DataFrame, log: DataFrame) -> DataFrame:
    """Alerts with status, last-seen and counters replayed from the audit log.

    Log rows: alert_id, ts_us, kind (CREATED / DEDUPED / STATUS), status, last_seen_us, dedup_count."""
    state = log.groupBy("alert_id").agg(
        F.max_by("status", F.when(F.col("kind") == "STATUS", F.col("ts_us"))).alias("log_status"),
        F.max("last_seen_us").alias("log_seen"), F.max("dedup_count").alias("log_count"),
    )
    j = alerts.join(state, "alert_id", "left")
    return j.withColumns({
        "status": F.coalesce(F.when(F.col("log_status").isNotNull(), F.col("log_status")), F.col("status")),
        "last_seen_us": F.greatest("last_seen_us", "log_seen"),
        "dedup_count": F.greatest("dedup_count", "log_count"),
    }).drop("log_status", "log_seen", "log_count")


def alert_log(alerts: DataFrame, touches: DataFrame) -> DataFrame:
    """CREATED and DEDUPED rows of a fused batch."""
    created = alerts.select(
        "alert_id", "ts_us", F.lit("CREATED").alias("kind"), F.lit("NEW").alias("status"),
        F.col("ts_us").alias("last_seen_us"), F.lit(1).cast("bigint").alias("dedup_count"),
    )
    deduped = touches.select(
        "alert_id", F.col("last_seen_us").alias("ts_us"), F.lit("DEDUPED").alias("kind"),
        F.lit(None).cast("string").alias("status"), "last_seen_us", "dedup_count",
    )
    return created.unionByName(deduped)


def split_by_age(df: DataFrame, cutoff_us: int, time: str = "ts_us") -> tuple[DataFrame, DataFrame]:
    """(kept, dropped) at a retention cutoff."""
    return df.filter(F.col(time) >= cutoff_us), df.filter(F.col(time) < cutoff_us)


def prune(spark: SparkSession, root: str, cutoff_us: int) -> dict[str, int]:
    """Drop old rows of events, features and results; alerts and incidents stay.

    Whole dates before the cutoff are deleted as folders; only the cutoff's own date is rewritten."""
    day = datetime.fromtimestamp(cutoff_us / 1e6, tz=timezone.utc).date().isoformat()
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    dropped = {}
    for name in PRUNED:
        path = f"{root}/{name}"
        if not exists(spark, path):
            dropped[name] = 0
            continue
        time = TABLES[name][1]
        df = read(spark, root, name)
        dropped[name] = df.filter((F.col("date") <= day) & (F.col(time) < cutoff_us)).count()
        old_days = [r[0].isoformat() for r in df.filter(F.col("date") < day).select("date").distinct().collect()]
        fs = fs_path(path).getFileSystem(spark._jsc.hadoopConfiguration())
        edge = df.filter((F.col("date") == day) & (F.col(time) >= cutoff_us)).drop("date")
        staged = f"{path}_edge"
        edge.write.mode("overwrite").parquet(staged)
        for d in [*old_days, day]:
            fs.delete(fs_path(f"{path}/date={d}"), True)
        spark.read.parquet(staged).write.mode("append").parquet(f"{path}/date={day}")
        fs.delete(fs_path(staged), True)
    return dropped


def counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Row count of every table."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table_name"), "rows")
        out = one if out is None else out.unionByName(one)
    return out


def save_dataset(df: DataFrame, metadata: DataFrame, folder: str) -> None:
    """One CSV folder per split and the metadata row as JSON."""
    df.write.mode("errorifexists").partitionBy("split").option("header", True).csv(f"{folder}/rows")
    metadata.write.mode("errorifexists").json(f"{folder}/metadata")


def dataset_catalogue(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.json(f"{root}/*/metadata").orderBy("dataset_id")
