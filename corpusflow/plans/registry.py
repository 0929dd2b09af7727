"""Query registry: name -> (spark_fn(spark, sf_dir) -> DataFrame, DuckDB SQL or None)."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession

REGISTRY: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``name`` with its DuckDB twin ``sql``."""
    def deco(fn):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = (fn, sql)
        return fn
    return deco


def partitions(spark: SparkSession) -> int | None:
    """Tasks for CPU-heavy row work as the session's ``spark.corpusflow.partitions`` asks for; unset: the scan's own.

    Large tables have more splits than cores and need no exchange; a table in
    one row group is read by one task, and a caller may want it dealt out.
    """
    n = spark.conf.get("spark.corpusflow.partitions", "")
    return int(n) if n else None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table (Parquet) of a scale-factor folder."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
