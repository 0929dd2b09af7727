"""Exact set similarity of texts, as an audit of the LSH dedup (§2.10).

:func:`earlier_near` finds the rows that have an *earlier* row with a Jaccard
similarity of ``threshold`` or more between their word k-shingle sets, by an
inverted index instead of pairs of rows:

* equal sets, told by the SHA-256 digest of the sorted shingles, are one set
  (their first row stands for them);
* shingles are ordered by how many share their hash bucket (:func:`bucket_counts`),
  rare ones first.  Any order of all shingles gives the same result; this one
  keeps the frequent ones out of the index;
* two sets with the similarity share a shingle among the first
  ``n - ceil(threshold * n) + 1`` of each (prefix filter), neither is larger than
  the other by more than the threshold allows (length filter), and what their
  prefixes share must leave no more to the rest than it can hold (:func:`_enough`);
* a set needs one earlier partner only.  Each is compared with the first set of
  the prefix shingles it has; those that find none there are compared with the
  other earlier sets of their prefixes.  A group of near copies so takes one
  comparison a row and is never listed as pairs.

Only prefixes (a fifth of the shingles at 0.8, as 64-bit hashes) are stored and
exchanged.  A pair that passes the filters is decided on the shingles of its
texts.  Rows without a shingle are one group of equal sets, as in the dedup.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.functions.text import shingles
from corpusflow.session import new_scratch_dir

# Shingles are counted in so many buckets of their hash: a list of fixed size, whatever the rows.
BUCKETS = 1 << 20


def _written(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` through the shared scratch folder (it is used several times)."""
    path = new_scratch_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _set(text: str | Column, k: int) -> Column:
    return F.coalesce(shingles(text, k), F.array().cast("array<string>"))


def bucket_counts(df: DataFrame, text: str | Column, k: int) -> np.ndarray:
    """How many shingles of all rows fall into each of the buckets (4 MB, by one aggregation with a partial count before)."""
    x = df.select(F.explode(_set(text, k)).alias("t")).select(F.xxhash64("t").bitwiseAND(F.lit(BUCKETS - 1)).cast("int").alias("bucket"))
    got = x.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).toArrow()
    counts = np.zeros(BUCKETS, dtype=np.int32)
    counts[got["bucket"].to_numpy()] = np.minimum(got["n"].to_numpy(), 2**31 - 1)
    return counts


def _prefix_size(n: Column, threshold: float) -> Column:
    return n - F.ceil(n * F.lit(threshold) - F.lit(1e-9)).cast("int") + 1


def set_prefixes(df: DataFrame, ord_col: str, text: str | Column, k: int, threshold: float) -> DataFrame:
    """(o, d, n, p) per row: the digest of its shingle set, its size and the hashes of its prefix, rare shingles first."""
    counts = bucket_counts(df, text, k)

    @F.pandas_udf("array<bigint>")
    def first_rare(hashes: pd.Series, size: pd.Series) -> pd.Series:
        out = []
        for h, m in zip(hashes, size):
            h = np.asarray(h, dtype=np.int64)
            out.append(h[np.lexsort((h, counts[h & (BUCKETS - 1)]))[:m]])
        return pd.Series(out, dtype=object)
    s = df.select(F.col(ord_col).alias("o"), _set(text, k).alias("s"))
    s = s.select("o", F.unhex(F.sha2(F.array_join(F.array_sort("s"), "\n"), 256)).alias("d"), F.size("s").alias("n"),
                 F.transform("s", lambda t: F.xxhash64(t)).alias("h"))
    return s.select("o", "d", "n", first_rare("h", F.when(F.col("n") > 0, _prefix_size(F.col("n"), threshold)).otherwise(0)).alias("p"))


def _enough(shared: Column, a: Column, b: Column, threshold: float) -> Column:
    """Whether sets of sizes a and b whose prefixes share that many shingles may have the similarity.

    The set whose prefix ends first in the order shares no other shingle of its prefix, so beyond
    ``shared`` it has the rest of its own set at most.
    """
    rest = F.greatest(a - _prefix_size(a, threshold), b - _prefix_size(b, threshold))
    return shared + rest >= F.lit(threshold / (1 + threshold)) * (a + b) - 1e-6


def _alike(pairs: DataFrame, df: DataFrame, ord_col: str, text: str | Column, k: int, threshold: float) -> DataFrame:
    """The later row (b) of every pair (a, b) whose sets have the similarity, decided on their shingles."""
    own = df.select(F.col(ord_col).alias("o"), F.col(text).alias("t") if isinstance(text, str) else text.alias("t"))
    both = pairs.join(own.select(F.col("o").alias("a"), F.col("t").alias("ta")), "a").join(own.select(F.col("o").alias("b"), F.col("t").alias("tb")), "b")
    both = both.select("b", _set("ta", k).alias("sa"), _set("tb", k).alias("sb"))
    common = F.size(F.array_intersect("sa", "sb"))
    return both.where(common >= F.lit(threshold) * (F.size("sa") + F.size("sb") - common) - 1e-9).select("b").distinct()


def earlier_near(df: DataFrame, ord_col: str, text: str | Column, threshold: float = 0.8, k: int = 3) -> DataFrame:
    """The ``ord`` values of the rows with an earlier row of the similarity, exactly."""
    rows = _written(set_prefixes(df, ord_col, text, k, threshold), "set-prefixes")
    firsts = rows.groupBy("d").agg(F.min("o").alias("first"))
    index = _written(rows.where("n > 0").join(firsts.select(F.col("first").alias("o")), "o", "left_semi")
                         .select(F.explode("p").alias("x"), F.col("o").alias("first"), "n"), "prefixes")

    def fits(a: Column, b: Column) -> Column:
        return F.least(a, b) >= F.lit(threshold) * F.greatest(a, b) - 1e-9

    def candidates(hits: DataFrame) -> DataFrame:
        """Pairs (a, b) of the rows (x, a, n, b, m), one for every shared hash, that share enough."""
        pairs = hits.where((F.col("a") < F.col("b")) & fits(F.col("n"), F.col("m"))).groupBy("a", "b", "n", "m").agg(F.count(F.lit(1)).alias("c"))
        return pairs.where(_enough(F.col("c"), F.col("n"), F.col("m"), threshold)).select("a", "b")
    later = index.select("x", F.col("first").alias("b"), F.col("n").alias("m"))
    hubs = index.groupBy("x").agg(F.min(F.struct(F.col("first").alias("a"), "n")).alias("h")).select("x", "h.a", "h.n")
    found = _written(_alike(candidates(later.join(hubs, "x")), df, ord_col, text, k, threshold), "near")
    # Sets that their hubs do not cover, also where a hub shares too few of the hashes it is first in: against all earlier sets.
    rest = later.join(found, "b", "left_anti").join(index.select("x", F.col("first").alias("a"), "n"), "x")
    near = found.union(_alike(candidates(rest), df, ord_col, text, k, threshold)).select(F.col("b").alias("first"), F.lit(True).alias("near"))
    # Every row but the first of an equal set has an earlier one; the first is near if its set is.
    of = firsts.join(near, "first", "left")
    return (rows.select("o", "d").join(of, "d").where((F.col("o") > F.col("first")) | F.col("near"))
                .select(F.col("o").alias(ord_col)))
