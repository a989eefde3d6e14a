"""Registry of checked queries: a Spark plan and, where SQL can say it, the same in SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Query:
    name: str
    ids: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(ids: str, sql: str | None = None):
    """Register a query under its function name; `ids` lists the operators it exercises."""

    def wrap(fn):
        assert fn.__name__ not in QUERIES, fn.__name__
        QUERIES[fn.__name__] = Query(fn.__name__, ids, fn, sql)
        return fn

    return wrap


def r6(name, alias: str | None = None):
    """Six decimals, nudged like the SQL side."""
    c = F.col(name) if isinstance(name, str) else name
    return F.round(c.cast("double") + 1e-9, 6).alias(alias or name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
