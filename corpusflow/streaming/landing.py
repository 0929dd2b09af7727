"""Landing folders for file-source streams, and running a stream over what has landed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def land_in_order(df: DataFrame, ord_col: str, path: str, chunks: int = 4, after: Callable[[], object] | None = None) -> list:
    """Append ``df`` to ``path`` in ``chunks`` ranges of ``ord_col``, oldest first; returns the cut points.

    Each range is written by as many tasks as its rows need; rows with a NULL order value come first.  ``after`` runs
    after each append, e.g. the stream over the folder, so that a range is one
    micro-batch whatever its number of files.  Test harness for arrivals; a
    production landing folder is filled by producers.
    """
    probs = [i / chunks for i in range(1, chunks)]
    cuts = df.approxQuantile(ord_col, probs, 0.001) if chunks > 1 else []
    bounds = [None] + cuts + [None]
    for lo, hi in zip(bounds[:-1], bounds[1:]):
        # NULL compares with no cut: it belongs to the first range.
        above = F.lit(True) if lo is None else F.coalesce(F.col(ord_col) > F.lit(lo), F.lit(False))
        below = F.lit(True) if hi is None else F.coalesce(F.col(ord_col) <= F.lit(hi), F.lit(True))
        part = df.where(above & below)
        part.write.mode("append").parquet(path)
        if after:
            after()
    return cuts


def read_files(spark, path: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    """Stream of the Parquet files under ``path``; all that is new, or a number of files, per micro-batch."""
    r = spark.readStream.schema(schema)
    if files_per_trigger:
        r = r.option("maxFilesPerTrigger", files_per_trigger)
    return r.parquet(path)


def run_to_end(writer):
    """Start a stream over everything available and wait until it has ended, however long that takes; returns the query.

    ``awaitTermination`` raises the query's error, so a result is never read from a stream that failed.
    """
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def run_available(stream_df: DataFrame, fn, checkpoint: str, name: str | None = None) -> None:
    """Process everything available now through ``foreachBatch(fn)``."""
    w = stream_df.writeStream.foreachBatch(fn).option("checkpointLocation", checkpoint)
    run_to_end(w.queryName(name) if name else w)
