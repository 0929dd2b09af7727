"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.session import scratch_root

# One Arrow batch handed to Python holds at most this many rows; whole texts can be
# long, so the batch is small enough to bound a worker's memory.
ARROW_ROWS = 256


def prepare(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session (rows, and bytes where Spark has the setting)."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 * 1024 * 1024))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table (Parquet) of a scale-factor folder."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def staged(df: DataFrame, purpose: str) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back (cuts the lineage)."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{purpose}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fold(id_col: str, folds: int = 3) -> Column:
    """crc32 of the id written as text, modulo ``folds`` (NULL ids count as the empty text)."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def salt(id_col: str, buckets: int) -> Column:
    """Deterministic salt of a row: a hash of its id in [0, buckets)."""
    return F.pmod(F.xxhash64(F.col(id_col)), F.lit(buckets)).cast("int")


def salted_lookup(left: DataFrame, right: DataFrame, key: str, salt_col: str) -> DataFrame:
    """Join ``left`` to the unique-key table ``right`` on ``key`` without gathering a hot key.

    ``left`` carries ``salt_col``.  Its distinct (key, salt) pairs, at most one
    row per key and salt, meet ``right`` first; the rows themselves then join on
    (key, salt), so one key's rows are spread over as many tasks as salts.
    """
    pairs = left.select(key, salt_col).distinct()
    keyed = pairs.join(right, key)
    return left.join(keyed, [key, salt_col]).drop(salt_col)
