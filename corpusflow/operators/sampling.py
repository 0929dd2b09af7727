"""Keyed shuffles, caps and batch slicing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.functions.keys import keyed_hash
from corpusflow.operators.positions import batch_ids, exact_positions, first_by_key


def shuffle_positions(df: DataFrame, id_col: str, seed: int = 42, purpose: str = "shuffle", out: str = "pos") -> DataFrame:
    """L1/L2: exact position in the keyed shuffle md5(seed|purpose|id)."""
    d = df.withColumn("_k", keyed_hash(seed, purpose, F.col(id_col)))
    return exact_positions(d, "_k", id_col, out=out).drop("_k")


def first_n(df: DataFrame, id_col: str, n: int, seed: int = 42, purpose: str = "shuffle") -> DataFrame:
    """The first ``n`` rows of the keyed shuffle (only rows below the key threshold are exchanged)."""
    d = df.withColumn("_k", keyed_hash(seed, purpose, F.col(id_col)))
    return first_by_key(d, "_k", id_col, F.lit(n)).drop("_k", "_pos")


def assign_batches(df: DataFrame, id_col: str, batch_size: int, seed: int = 42, purpose: str = "shuffle") -> DataFrame:
    """Shuffle, then consecutive slices of ``batch_size`` rows."""
    return shuffle_positions(df, id_col, seed, purpose).withColumn("batch_id", batch_ids(F.col("pos"), batch_size))
