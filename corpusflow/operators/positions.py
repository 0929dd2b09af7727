"""Exact row positions and running sums without a single-partition window.

``row_number() over (order by k)`` with no partition moves every row into one
task.  Here rows are cut into ordered buckets: a small count table gives each
bucket its offset, and the row number is only computed inside each bucket.  The
result equals the global row number exactly.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusflow.functions.keys import KEY_HEX_DIGITS

# At 10^11 rows a bucket holds about 1.5 million; the offset table has at most this many rows.
BUCKETS = 1 << 16


def _bucket(order_key: str, key_bits: int, buckets: int) -> Column:
    """High bits of a uniform key.

    Never NULL: otherwise the optimizer would infer a filter on one of the two
    uses of the input, and the scan and shuffle below would no longer be shared.
    """
    bits = max(0, min(key_bits, int(math.log2(buckets))))
    return F.shiftrightunsigned(F.coalesce(F.col(order_key), F.lit(0).cast("bigint")), key_bits - bits)


def _offsets(d: DataFrame, pcols: list[str]) -> DataFrame:
    """(pcols, _bkt, _off, _tot): rows before each bucket, and in all buckets of the group."""
    counts = d.groupBy(*pcols, "_bkt").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*pcols).orderBy("_bkt").rowsBetween(Window.unboundedPreceding, -1)
    return counts.select(*pcols, "_bkt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"),
                         F.sum("_n").over(Window.partitionBy(*pcols)).alias("_tot"))


def _numbered(d: DataFrame, pcols: list[str], order: list[Column], out: str, total_out: str | None) -> DataFrame:
    offs = _offsets(d, pcols)
    # Without groups the offset table has at most one row per bucket: a proven
    # bound, so it is broadcast.  With groups its size is groups x buckets and
    # the join strategy is left to AQE's runtime statistics.
    offs = F.broadcast(offs) if not pcols else offs
    local = F.row_number().over(Window.partitionBy(*pcols, "_bkt").orderBy(*order))
    res = d.join(offs, [*pcols, "_bkt"]).withColumn(out, F.col("_off") + local - 1)
    if total_out:
        res = res.withColumnRenamed("_tot", total_out)
    return res.drop("_bkt", "_off", "_tot")


def exact_positions(df: DataFrame, order_key: str, tiebreak: str | list[str],
                    partition_cols: list[str] | tuple = (), out: str = "pos",
                    total_out: str | None = None, key_bits: int = 4 * KEY_HEX_DIGITS,
                    buckets: int = BUCKETS) -> DataFrame:
    """Add ``out`` = 0-based position in (order_key, tiebreak) order per partition.

    ``order_key`` must be a BIGINT spread uniformly over [0, 2**key_bits) (see
    :func:`corpusflow.functions.keys.keyed_hash`); rows with equal keys should
    be few (callers with many equal rows number the different rows once and
    deal out their copies).  ``total_out`` adds the group size, taken from the
    same count table.
    """
    ties = [tiebreak] if isinstance(tiebreak, str) else list(tiebreak)
    d = df.withColumn("_bkt", _bucket(order_key, key_bits, buckets))
    return _numbered(d, list(partition_cols), [F.col(order_key), *[F.col(t) for t in ties]], out, total_out)


def first_by_key(df: DataFrame, order_key: str, tiebreak: str, limit: Column, out: str = "_pos",
                 key_bits: int = 4 * KEY_HEX_DIGITS, buckets: int = BUCKETS) -> DataFrame:
    """The first ``limit`` rows in (order_key, tiebreak) order, with their position ``out``.

    ``limit`` may use ``_tot``, the number of rows.  A count per bucket of the
    key (a scan of the key's columns alone) says in which bucket the last row
    lies; rows of later buckets are dropped by a filter in front of the exchange,
    so only about ``limit`` rows are shuffled and sorted.
    """
    d = df.withColumn("_bkt", _bucket(order_key, key_bits, buckets))
    last = _offsets(d, []).where(F.col("_off") < limit).agg(F.max("_bkt").alias("m"))
    total = d.agg(F.count(F.lit(1)).alias("n"))
    # One-row tables as scalar subqueries: evaluated before the scan, used as plain filter values.
    below = d.where(F.col("_bkt") <= last.scalar())
    res = _numbered(below, [], [F.col(order_key), F.col(tiebreak)], out, None)
    return res.withColumn("_tot", total.scalar()).where(F.col(out) < limit).drop("_tot")


# Rows of one key histogram over all parts (they come to the driver and are broadcast): about 6 MB at most.
HISTOGRAM_ROWS = 1 << 18


def key_histograms(parts: list[DataFrame], order_key: str, key_bits: int = 4 * KEY_HEX_DIGITS) -> tuple[int, list[list[tuple[int, int]]]]:
    """(buckets, per part the (bucket, rows) pairs in order): one job over the keys of all parts.

    The more parts, the fewer buckets each has, so that the table stays within ``HISTOGRAM_ROWS``.
    """
    from functools import reduce
    buckets = max(1, min(BUCKETS, 1 << int(math.log2(max(1, HISTOGRAM_ROWS // len(parts))))))
    keys = [d.select(F.lit(i).alias("_p"), _bucket(order_key, key_bits, buckets).alias("_bkt")) for i, d in enumerate(parts)]
    got = reduce(lambda a, b: a.union(b), keys).groupBy("_p", "_bkt").agg(F.count(F.lit(1)).alias("_n")).toArrow().to_pydict()
    out: list[list[tuple[int, int]]] = [[] for _ in parts]
    for i, b, n in sorted(zip(got["_p"], got["_bkt"], got["_n"])):
        out[i].append((b, n))
    return buckets, out


def first_of_parts(rows: DataFrame, buckets: int, histograms: list[list[tuple[int, int]]], limits: list[int], order_key: str,
                   tiebreak: str, out: str = "pos", key_bits: int = 4 * KEY_HEX_DIGITS) -> DataFrame:
    """The first ``limits[i]`` rows of every part i (column ``_p``) in (order_key, tiebreak) order, with their position ``out``.

    The histograms (:func:`key_histograms`) say in which bucket the last row of
    a part lies and where each bucket starts.  They are broadcast (a fixed
    bound); rows of later buckets drop out of that join, in front of the one
    exchange, which brings the rows of a bucket together to be ranked.
    """
    starts = []
    for i, (pairs, limit) in enumerate(zip(histograms, limits)):
        at = 0
        for b, n in pairs:
            if at >= limit:
                break
            starts.append((i, b, at, limit))
            at += n
    offs = rows.sparkSession.createDataFrame(starts, "_p int, _bkt bigint, _off bigint, _lim bigint")
    d = rows.withColumn("_bkt", _bucket(order_key, key_bits, buckets)).join(F.broadcast(offs), ["_p", "_bkt"])
    local = F.row_number().over(Window.partitionBy("_p", "_bkt").orderBy(F.col(order_key), F.col(tiebreak)))
    return d.withColumn(out, F.col("_off") + local - 1).where(F.col(out) < F.col("_lim")).drop("_bkt", "_off", "_lim")


def running_sum(df: DataFrame, order_col: str, value_col: str, out: str,
                chunk: int = 4096, inclusive: bool = True, levels: int = 2) -> DataFrame:
    """Running total of ``value_col`` in ``order_col`` order (dense BIGINT order).

    Rows are cut into chunks of ``chunk`` consecutive order values; the chunk
    totals are summed up the same way, ``levels`` times, so the window at the
    top sees rows / chunk^levels rows.  No other task sees more than one chunk.
    """
    c, t, o = (f"_{x}{levels}" for x in ("chunk", "total", "before"))
    d = df.withColumn(c, F.floor(F.col(order_col) / chunk))
    tot = d.groupBy(c).agg(F.sum(value_col).alias(t))
    if levels > 1:
        offs = running_sum(tot, c, t, o, chunk, False, levels - 1).select(c, o)
    else:
        before = Window.orderBy(c).rowsBetween(Window.unboundedPreceding, -1)
        offs = tot.select(c, F.coalesce(F.sum(t).over(before), F.lit(0)).alias(o))
    frame_end = Window.currentRow if inclusive else -1
    w = Window.partitionBy(c).orderBy(order_col).rowsBetween(Window.unboundedPreceding, frame_end)
    return (d.join(offs, c)
             .withColumn(out, (F.col(o) + F.coalesce(F.sum(value_col).over(w), F.lit(0))).cast("bigint"))
             .drop(c, o))


def sql_position(order_sql: str, partition_sql: str | None = None) -> str:
    """DuckDB twin: 0-based row number."""
    part = f"partition by {partition_sql} " if partition_sql else ""
    return f"(row_number() over ({part}order by {order_sql}) - 1)"


def batch_ids(pos: Column, batch_size: int) -> Column:
    """Consecutive slices of ``batch_size`` positions."""
    return F.floor(pos / F.lit(batch_size)).cast("bigint")


def sorted_positions(df: DataFrame, order_col: str, out: str = "pos", total_out: str | None = None,
                     buckets: int | None = None) -> DataFrame:
    """0-based position in the order of a unique column, whatever its spread.

    A range exchange cuts the rows at sampled quantiles, so outliers and gaps
    do not matter; the partition number is the bucket.  The partitioned rows are
    written once to the shared scratch folder, because both uses of them must
    see the same cuts.
    """
    from corpusflow.session import new_scratch_dir
    spark = df.sparkSession
    path = new_scratch_dir(spark, "ordered")
    cut = df.repartitionByRange(buckets, order_col) if buckets else df.repartitionByRange(order_col)
    cut.withColumn("_bkt", F.spark_partition_id()).write.parquet(path)
    return _numbered(spark.read.parquet(path), [], [F.col(order_col)], out, total_out)
