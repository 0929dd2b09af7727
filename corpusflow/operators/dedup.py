"""First-row-wins near-duplicate removal with MinHash + LSH banding.

Semantics (insert-then-query over rows in ``ord`` order): a row is kept iff no
earlier row shares its bucket in *any* band.  Dropped rows stay in the index,
and there is no Jaccard verification.  Rows with fewer than ``k`` words have
an empty shingle set; all of them share one signature, so only the first one
survives (``short="first"``), unless ``short="keep"``.

Spark plan (no pair join, no collect):
  1. shingles -> 28-bit hashes -> 117 minimums (per row, no shuffle)
  2. 9 band keys per row
  3. ``groupBy(band, key).min(ord)``: partial aggregation collapses hot keys
     (empty signature, groups of copies) map-side before the shuffle
  4. ``groupBy(first).count()``: a row is kept iff it is first in every band
  5. left-semi join of the input with the kept ``ord`` values (unique keys).
"""


import random
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.functions.keys import SHINGLE_HEX_DIGITS
from corpusflow.functions.text import col_, more_words_than, packed_hashes, shingle_hashes, shingles, sql_words
from corpusflow.session import FREED_SHUFFLES, session_conf

# The hash family modulus (Mersenne prime 2**31 - 1), the
# default permutation count, and the coefficient generator seed.
PRIME = 2147483647
NUM_PERM = 128
COEFF_SEED = 7
# A set of kept ``ord`` values of up to that many words (16 bytes each) is broadcast.
MOST_WORDS = 1 << 20


def _integral(f, a: float, b: float, n: int = 2001) -> float:
    xs = np.linspace(a, b, n)
    ys = f(xs)
    h = (b - a) / (n - 1)
    return float(h / 3 * (ys[0] + ys[-1] + 4 * ys[1:-1:2].sum() + 2 * ys[2:-1:2].sum()))


@lru_cache(maxsize=64)
def lsh_params(threshold: float = 0.8, num_perm: int = NUM_PERM,
               fp_weight: float = 0.5, fn_weight: float = 0.5) -> tuple[int, int]:
    """(bands, rows) minimising the weighted false-positive/negative areas."""
    best, best_err = (1, 1), float("inf")
    for b in range(1, num_perm + 1):
        for r in range(1, num_perm // b + 1):
            fp = _integral(lambda s: 1 - (1 - s ** r) ** b, 0.0, threshold)
            fn = _integral(lambda s: 1 - (1 - (1 - s ** r) ** b), threshold, 1.0)
            err = fp * fp_weight + fn * fn_weight
            if err < best_err - 1e-15:
                best, best_err = (b, r), err
    return best


def minhash_coefficients(n: int, seed: int = COEFF_SEED) -> list[tuple[int, int]]:
    """``n`` hash functions h -> (a*h + b) mod PRIME, drawn from a seeded generator."""
    rng = random.Random(seed)
    return [(rng.randrange(1, PRIME), rng.randrange(0, PRIME)) for _ in range(n)]


def _coeff_literal(coeffs):
    return F.array(*[F.struct(F.lit(a).cast("bigint").alias("a"), F.lit(b).cast("bigint").alias("b"))
                     for a, b in coeffs])


def _minhash_udf(coeffs):
    """Arrow-batched min-hash kernel: packed shingle hashes (:func:`packed_hashes`) -> ARRAY<BIGINT> signature.

    Per row, (h * a + b) mod PRIME is evaluated for all hash functions at once
    as a numpy matrix (in blocks of 128 hashes, which stay in the core's cache) and reduced with ``min``.  The
    hashes have at most 28 bits, so h * a + b < 2**60; PRIME is 2**31 - 1, so
    x mod PRIME is the sum of the two 31-bit halves of x, less PRIME where it
    reaches that: shifts and sums instead of a 64-bit division per value.
    """
    import numpy as np
    import pandas as pd

    a = np.array([x for x, _ in coeffs], dtype=np.int64)[:, None]
    b = np.array([y for _, y in coeffs], dtype=np.int64)[:, None]
    empty = np.full(len(coeffs), PRIME, dtype=np.int64)

    @F.pandas_udf("array<bigint>")
    def minhash(hashes: pd.Series) -> pd.Series:
        out = []
        for h in hashes:
            if h is None or len(h) == 0:
                out.append(empty)
                continue
            h = (np.frombuffer(h, dtype=">u4") >> 4).astype(np.int64)   # the leading 28 bits
            m = empty.astype(np.uint32)
            for s in range(0, len(h), 128):
                x = a * h[None, s:s + 128]
                x += b
                high = (x >> 31).astype(np.uint32)
                x = x.astype(np.uint32)
                x &= np.uint32(PRIME)
                x += high   # below 2**32; the difference wraps to a larger value where x < PRIME
                np.minimum(x, x - np.uint32(PRIME), out=x)
                m = np.minimum(m, x.min(axis=1))
            out.append(m.astype(np.int64))
        return pd.Series(out)
    return minhash


def signatures(df: DataFrame, ord_col: str, text, k: int, coeffs, method: str = "vectorized",
               partitions: int | None = None) -> DataFrame:
    """(ord, sig ARRAY<BIGINT>): per-row minimum of every hash function.

    Shingling and shingle hashing are native expressions.  The minimums are
    computed either by the vectorized kernel inside the row (default: no
    shuffle) or, with ``method="aggregate"``, by exploding the hashes into a
    hash aggregate of ``min`` per function (one shuffle by ``ord``; partial
    aggregation leaves one row per input row before it).  The empty set maps
    to PRIME in every slot, so all empty rows collide.  ``partitions`` deals the
    rows out first (only where the caller asks for it: it shuffles the text).
    """
    base = df.select(F.col(ord_col), col_(text).alias("_t"))
    base = base.repartition(partitions) if partitions else base
    if method == "vectorized":
        return base.select(F.col(ord_col), _minhash_udf(coeffs)(packed_hashes(shingles("_t", k))).alias("sig"))
    hs = base.select(F.col(ord_col), F.explode_outer(shingle_hashes(shingles("_t", k))).alias("_h"))
    mins = [F.coalesce(F.min((F.col("_h") * F.lit(a) + F.lit(b)) % F.lit(PRIME)), F.lit(PRIME)).alias(f"_m{i}")
            for i, (a, b) in enumerate(coeffs)]
    agg = hs.groupBy(ord_col).agg(*mins)
    return agg.select(F.col(ord_col), F.array(*[F.col(f"_m{i}") for i in range(len(coeffs))]).alias("sig"))


def band_keys(sig_df: DataFrame, ord_col: str, bands: int, rows: int) -> DataFrame:
    """(ord, band, key): one exact key (ARRAY<INT> of ``rows`` minimums) per band.

    Every minimum is at most PRIME = 2**31 - 1 = INT_MAX, so the keys are
    stored as 32-bit ints: exact, and half the bytes in the band shuffle.
    """
    keys = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)),
                       lambda i: F.slice(F.col("sig"), i * rows + 1, rows).cast("array<int>"))
    return sig_df.select(F.col(ord_col), F.posexplode(keys).alias("band", "key"))


def kept_ords(df: DataFrame, ord_col: str, text, threshold: float = 0.8, k: int = 3,
              num_perm: int = NUM_PERM, seed: int = COEFF_SEED,
              params: tuple[int, int] | None = None, method: str = "vectorized", partitions: int | None = None) -> DataFrame:
    """Single-column DataFrame of the ``ord`` values that survive."""
    b, r = params or lsh_params(threshold, num_perm)
    coeffs = minhash_coefficients(b * r, seed)
    keys = band_keys(signatures(df, ord_col, text, k, coeffs, method, partitions), ord_col, b, r)
    firsts = keys.groupBy("band", "key").agg(F.min(ord_col).alias("_first"))
    return (firsts.groupBy("_first").agg(F.count(F.lit(1)).alias("_nb"))
                  .where(F.col("_nb") == b)
                  .select(F.col("_first").alias(ord_col))
                  .join(unique_ords(df, ord_col), ord_col, "left_semi"))


def unique_ords(df: DataFrame, ord_col: str) -> DataFrame:
    """The ``ord`` values; the job fails on a repeated one, which would not say which row is first.

    Only the narrow column is shuffled, with a partial count before.
    """
    bad = F.raise_error(F.concat(F.lit(f"{ord_col} must be unique and not NULL: "), F.col(ord_col).cast("string")))
    # A filter, not a column: column pruning cannot remove it.
    return (df.groupBy(ord_col).agg(F.count(F.lit(1)).alias("_n"))
              .where(F.when(F.col("_n") == 1, F.lit(True)).otherwise(bad.cast("boolean")))
              .select(ord_col))


def with_ord(df: DataFrame, ord_col: str) -> DataFrame:
    """``df`` whose ``ord`` fails the job where it is NULL (joins would drop such a row in silence)."""
    bad = F.raise_error(F.lit(f"{ord_col} must be unique and not NULL: NULL")).cast(dict(df.dtypes)[ord_col])
    return df.withColumn(ord_col, F.coalesce(F.col(ord_col), bad))


def with_kept(df: DataFrame, kept: DataFrame, ord_col: str, words_dir: str | None = None) -> DataFrame:
    """The rows of ``df`` whose ``ord`` is in ``kept``.

    With ``words_dir`` (for integers that follow one another, as row numbers do) the kept values are written
    there as a bit set, 64 to a word, and broadcast: the rows, which hold the text, are not exchanged.
    A set of more than ``MOST_WORDS`` words is left to Spark's choice of a join.
    """
    if words_dir is None:
        return df.join(kept, ord_col, "left_semi")
    word, bit = F.shiftright(F.col(ord_col), 6), F.col(ord_col).bitwiseAND(F.lit(63)).cast("int")
    mask = F.call_function("shiftleft", F.lit(1).cast("bigint"), bit)
    with session_conf(df.sparkSession, FREED_SHUFFLES):
        kept.groupBy(word.alias("_word")).agg(F.bit_or(mask).alias("_bits")).write.mode("overwrite").parquet(words_dir)
    words = df.sparkSession.read.schema("_word bigint, _bits bigint").parquet(words_dir)
    words = F.broadcast(words) if words.count() <= MOST_WORDS else words
    return df.join(words, (word == F.col("_word")) & (F.getbit("_bits", bit) == 1), "left_semi")


def first_wins_dedup(df: DataFrame, ord_col: str, text, threshold: float = 0.8, k: int = 3,
                     num_perm: int = NUM_PERM, seed: int = COEFF_SEED, short: str = "first",
                     params: tuple[int, int] | None = None, method: str = "vectorized",
                     partitions: int | None = None, words_dir: str | None = None) -> DataFrame:
    """Rows of ``df`` that survive first-wins LSH dedup in ``ord_col`` order.

    ``ord_col`` must be unique (e.g. (file, line) folded into one BIGINT, or a
    document id); ``text`` is a column name or expression; ``words_dir`` is that of :func:`with_kept`.
    """
    if short not in ("first", "keep"):
        raise ValueError("short must be 'first' or 'keep'")
    df, text_c = with_ord(df, ord_col), col_(text)
    if short == "keep":
        is_long = more_words_than(text_c, k - 1)
        long_rows = df.where(is_long)
        kept = kept_ords(long_rows, ord_col, text_c, threshold, k, num_perm, seed, params, method, partitions)
        return with_kept(df, kept, ord_col, words_dir).unionByName(df.where(~is_long))
    kept = kept_ords(df, ord_col, text_c, threshold, k, num_perm, seed, params, method, partitions)
    return with_kept(df, kept, ord_col, words_dir)


def sql_band_ctes(table_sql: str, ord_col: str, text_sql: str, threshold: float = 0.8,
                  k: int = 3, num_perm: int = NUM_PERM, seed: int = COEFF_SEED,
                  params: tuple[int, int] | None = None) -> tuple[str, int]:
    """DuckDB CTEs ``w, sh, hx, sig, bands(o, band, key)`` and the band count."""
    b, r = params or lsh_params(threshold, num_perm)
    coeffs = minhash_coefficients(b * r, seed)
    mins = ",\n    ".join(f"coalesce(min((h * {a} + {c}) % {PRIME}), {PRIME}) AS m{i}"
                          for i, (a, c) in enumerate(coeffs))
    band_sel = "\n  UNION ALL ".join(
        f"SELECT o, {j} AS band, concat_ws('-', {', '.join(f'm{j * r + t}' for t in range(r))}) AS key FROM sig"
        for j in range(b))
    last = f"i + {k - 1}"
    ctes = f"""w AS (SELECT {ord_col} AS o, {sql_words(f'lower({text_sql})')} AS w FROM {table_sql}),
sh AS (SELECT o, CASE WHEN len(w) >= {k}
                 THEN list_distinct([array_to_string(w[i:{last}], ' ') FOR i IN range(1, len(w) - {k - 2})])
                 ELSE [] END AS s FROM w),
hx AS (SELECT o, ('0x' || substr(md5(x), 1, {SHINGLE_HEX_DIGITS}))::BIGINT AS h
       FROM sh, unnest(CASE WHEN len(s) = 0 THEN [NULL::VARCHAR] ELSE s END) AS t(x)),
sig AS (SELECT o,
    {mins}
  FROM hx GROUP BY o),
bands AS ({band_sel})"""
    return ctes, b


def sql_first_wins(table_sql: str, ord_col: str, text_sql: str, threshold: float = 0.8,
                   k: int = 3, num_perm: int = NUM_PERM, seed: int = COEFF_SEED,
                   params: tuple[int, int] | None = None) -> str:
    """DuckDB twin returning the kept ``ord`` values (column ``ord_col``)."""
    ctes, b = sql_band_ctes(table_sql, ord_col, text_sql, threshold, k, num_perm, seed, params)
    return f"""
WITH {ctes},
firsts AS (SELECT band, key, min(o) AS f FROM bands GROUP BY band, key),
kept AS (SELECT f AS {ord_col} FROM firsts GROUP BY f HAVING count(*) = {b})
SELECT {ord_col} FROM kept"""
