"""Row filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.functions.text import more_words_than


def min_words(df: DataFrame, text: str = "text", n: int = 100) -> DataFrame:
    """keep rows with strictly more than ``n`` words; NULL/empty text drops.

    A row filter without a shuffle: the text is split at most ``n`` times.
    """
    return df.where(more_words_than(text, n))


def equals(df: DataFrame, column: str, value) -> DataFrame:
    """equality filter (pushed into the Parquet scan when on a stored column)."""
    return df.where(F.col(column) == F.lit(value))


def first_turn_attribute(turns: DataFrame, group_col: str, order_col: str, attr: str,
                         out: str = "first_value") -> DataFrame:
    """Value of ``attr`` on the first turn of each group (``min_by``, partial-aggregated)."""
    return turns.groupBy(group_col).agg(F.min_by(F.col(attr), F.col(order_col)).alias(out))


def first_turn_in(turns: DataFrame, group_col: str, order_col: str, attr: str,
                  allowed: DataFrame, allowed_col: str = "value") -> DataFrame:
    """Groups whose first-turn ``attr``, lower-cased, is in ``allowed``.

    ``allowed`` is a vocabulary (country or language lists); AQE broadcasts it
    when its measured size is small.  NULL attributes never match.
    """
    firsts = first_turn_attribute(turns, group_col, order_col, attr)
    vocab = allowed.select(F.lower(F.col(allowed_col)).alias("_v")).distinct()
    return (firsts.withColumn("_v", F.lower(F.col("first_value")))
                  .join(vocab, "_v", "left_semi")
                  .drop("_v"))


def trainable(labels: Column) -> Column:
    """F8: at least one label is not -100."""
    return F.exists(labels, lambda x: x != F.lit(-100))


def require_columns(df: DataFrame, needed: list[str]) -> None:
    """error when a needed column is missing (driver-side schema check)."""
    missing = [c for c in needed if c not in df.columns]
    if missing:
        raise ValueError(f"input lacks {missing}; it has {df.columns}")


def split_kind(split: str) -> str:
    """'train' or 'test' by substring, else an error."""
    if "train" in split:
        return "train"
    if "test" in split:
        return "test"
    raise ValueError(f"cannot tell from its name whether split {split!r} is for training or testing")


class StageCounts:
    """A1: row counts of the stages of a plan, observed in the job that runs it (no pass of their own)."""

    def __init__(self):
        self._seen: dict = {}

    def stage(self, df: DataFrame, name: str) -> DataFrame:
        """``df``, whose rows are counted under ``name`` when an action runs it."""
        from pyspark.sql import Observation
        self._seen[name] = Observation(name)
        return df.observe(self._seen[name], F.count(F.lit(1)).alias("n"))

    def get(self) -> dict[str, int]:
        """The counts; waits for the first action on the plan to end.  Empty if no stage was named."""
        return {name: o.get["n"] for name, o in self._seen.items()}
