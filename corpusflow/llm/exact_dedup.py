"""Exact deduplication by skew-safe combining (DataFrame functions only).

Rows with identical text form a group.  Groups are built in three steps, and
the full text is part of the grouping key in each of them, so two texts are
merged only when they are equal, whatever their digests:

1. local: the partial aggregate in front of the first exchange merges the
   copies inside each task;
2. salted: (digest, salt, text) groups are merged, the salt being a hash of the
   row id, so a group that holds a third of all rows is spread over ``salts``
   tasks;
3. global: at most ``salts`` winners per text are combined.

Defined results: a NULL text counts as the empty text; a NULL id never beats
an id and stays only if its whole group has none; identical (id, text) rows are
one row for :func:`dedup` and equal rows with the same answer for
:func:`assign`, the first of which is kept; an empty table gives an empty
result.  Extra columns travel with the row that stays, under any name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.llm.common import salt, salted_lookup

SALTS = 128


def _text(col: str):
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def combine(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """One row per different text: (digest, text, keep_id = largest id, group_size)."""
    rows = docs.select(F.col(id_col).alias("_id"), _text(text_col).alias("text"))
    rows = rows.select(F.unhex(F.sha2("text", 256)).alias("digest"), salt("_id", salts).alias("_salt"), "text", "_id")
    per_salt = rows.groupBy("digest", "_salt", "text").agg(F.max("_id").alias("_id"), F.count(F.lit(1)).alias("_n"))
    return per_salt.groupBy("digest", "text").agg(F.max("_id").alias("keep_id"), F.sum("_n").alias("group_size"))


def assign(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Only (id, digest) pairs are joined back to the groups.  That step relies on
    one text per digest; were two different texts ever to share a SHA-256
    digest, the job fails instead of merging them.
    """
    groups = combine(docs, id_col, text_col, salts)
    by_digest = groups.groupBy("digest").agg(
        F.count(F.lit(1)).alias("_texts"), F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    # A filter, not a column: it runs whatever columns the reader selects.
    error = F.raise_error(F.lit("two different texts share one SHA-256 digest")).cast("boolean")
    by_digest = by_digest.where(F.when(F.col("_texts") > 1, error).otherwise(F.lit(True))).drop("_texts")
    rows = docs.select(F.col(id_col).alias("_id"), F.unhex(F.sha2(_text(text_col), 256)).alias("digest"))
    # Equal (id, text) rows are counted and dealt out again, so that only the first is kept.
    rows = (rows.groupBy("_id", "digest").agg(F.count(F.lit(1)).alias("_copies"))
                .withColumn("_salt", salt("_id", salts)))
    out = salted_lookup(rows, by_digest, "digest", "_salt")
    out = out.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
    return out.select(F.col("_id").alias(id_col), "keep_id", "group_size",
                      (F.col("_id").eqNullSafe(F.col("keep_id")) & (F.col("_copy") == 1)).alias("kept"),
                      F.lower(F.hex("digest")).alias("text_sha256"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """The rows that stay, with all their columns: per text the row with the largest id.

    The rest of the row is carried through the combining steps, so there is no
    join back and exactly one row per text remains.  Rows with equal id and text
    that differ elsewhere are told apart by a hash of their other columns.
    """
    rest = [c for c in docs.columns if c != text_col]
    hashable = [c for c, t in docs.dtypes if c != text_col and "map<" not in t and "variant" not in t]
    rows = docs.select(_text(text_col).alias("_text"), F.col(text_col).isNull().alias("_null"),
                       F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(rest)]).alias("_rest"),
                       F.struct(F.col(id_col).alias("i"),
                                F.xxhash64(*[F.col(f"`{c}`") for c in hashable]).alias("h")).alias("_rank"))
    rows = rows.select(F.unhex(F.sha2("_text", 256)).alias("_digest"), salt("_rank.i", salts).alias("_salt"), "_text",
                       F.struct("_null", "_rest").alias("_row"), "_rank")
    best = (F.max_by("_row", "_rank").alias("_row"), F.max("_rank").alias("_rank"))
    won = rows.groupBy("_digest", "_salt", "_text").agg(*best).groupBy("_digest", "_text").agg(*best)
    at = {c: i for i, c in enumerate(rest)}
    return won.select(*[F.when(~F.col("_row._null"), F.col("_text")).alias(c) if c == text_col
                        else F.col(f"_row._rest.c{at[c]}").alias(c) for c in docs.columns])
