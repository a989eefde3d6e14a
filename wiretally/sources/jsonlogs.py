"""JSON-lines logs and the correlation of protocol logs onto connections by uid."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wiretally.params import DEFAULT, Params
from wiretally.sources.records import Normalised, all_aliases, normalise


def parse_lines(lines: DataFrame, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """(records, bad): blank and `#` lines and non-object JSON are skipped, bad JSON is kept.

    A line is one JSON value: it is read as the only element of a list, so anything after the value
    is an error. Of a repeated key the last value counts. A `capture_file` column of the lines
    replaces the field of that name, and `_pos`, the lines' order, is passed on."""
    text = F.trim(F.col(column))
    used = lines.withColumn("_line", text).filter((F.col("_line") != "") & ~F.col("_line").startswith("#"))
    schema = T.ArrayType(T.StructType([T.StructField(a, T.StringType()) for a in all_aliases()]))
    listed = F.concat(F.lit("["), F.col("_line"), F.lit("]"))
    used = used.withColumn("_r", F.from_json(listed, schema, {"allowSingleQuotes": "false"}))
    is_object = F.col("_line").startswith("{")
    one = F.coalesce(F.size("_r") == 1, F.lit(False))
    parsed = F.when(is_object, one).otherwise(F.try_parse_json(listed).isNotNull())
    bad = used.filter(~parsed).select(F.col("_line").alias("raw"), F.lit("bad_json").alias("reason"))
    tagged = lambda a: a == "capture_file" and a in lines.columns
    records = used.filter(parsed & is_object).withColumn("r", F.element_at("_r", 1))
    order = ["_pos"] if "_pos" in lines.columns else []
    return records.select(F.col("_line").alias("_raw"), *order, *[
        (F.col(a) if tagged(a) else F.col(f"r.`{a}`")).alias(a) for a in all_aliases()]), bad


def read_lines(spark: SparkSession, path: str, tag_capture: bool = False) -> tuple[DataFrame, DataFrame]:
    folder, _, name = path.rpartition("/")
    # a name filter instead of a path: a log that is not there has no lines
    lines = spark.read.option("pathGlobFilter", name).text(folder)
    lines = lines.withColumn("_pos", F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("line")))
    if tag_capture:
        lines = lines.withColumn("capture_file", F.element_at(F.split(F.input_file_name(), "/"), -1))
    return parse_lines(lines)


def merge_by_uid(protocol: list[DataFrame], key: str = "uid") -> DataFrame:
    """Later logs win field by field: the last non-null value per uid, in source order."""
    both = None
    for i, df in enumerate(protocol):
        part = df.withColumn("_src", F.lit(i))
        both = part if both is None else both.unionByName(part, allowMissingColumns=True)
    cols = [c for c in both.columns if c not in (key, "_src")]
    position = F.struct("_src", "_pos") if "_pos" in both.columns else F.col("_src")
    last = [F.max_by(F.col(f"`{c}`"), F.when(F.col(f"`{c}`").isNotNull(), position)).alias(c) for c in cols if c != "_pos"]
    return both.filter(F.coalesce(F.col(key), F.lit("")) != "").groupBy(key).agg(*last)


def correlate(conn: DataFrame, merged: DataFrame, key: str = "uid", time: str = "ts") -> DataFrame:
    """Connections with their protocol fields, plus protocol records without a connection."""
    q = lambda c: f"`{c}`"
    right = merged.select([F.col(q(c)).alias(f"r_{c}" if c != key else key) for c in merged.columns])
    shared = [c for c in conn.columns if c != key]
    joined = conn.join(right, key, "left").select(
        key,
        *[F.col(q(c)).alias(c) if c == time or f"r_{c}" not in right.columns
          else F.coalesce(F.col(q("r_" + c)), F.col(q(c))).alias(c) for c in shared],
        *[F.col(q("r_" + c)).alias(c) for c in merged.columns if c != key and c not in conn.columns],
    )
    orphans = merged.join(conn.select(key).distinct(), key, "left_anti")
    return joined.unionByName(orphans, allowMissingColumns=True)


def read_log_dir(spark: SparkSession, folder: str, source_type: str = "ZEEK_LOG", params: Params = DEFAULT, ordered: bool = False) -> Normalised:
    """conn.log, dns.log and ssl.log of one folder as validated flows."""
    conn, bad0 = read_lines(spark, f"{folder}/conn.log")
    dns, bad1 = read_lines(spark, f"{folder}/dns.log")
    ssl, bad2 = read_lines(spark, f"{folder}/ssl.log")
    records = correlate(conn.drop("_pos"), merge_by_uid([dns, ssl]))
    out = normalise(records, source_type, params, raw="_raw")
    bad = bad0.unionByName(bad1).unionByName(bad2).select("raw", F.lit(source_type).alias("source_type"), "reason")
    flows = out.flows.orderBy("ts_us") if ordered else out.flows
    return Normalised(flows, out.rejects.unionByName(bad))
