"""ST2: incremental first-row-wins dedup across micro-batches.

State is a ``seen(band, key, first)`` Parquet table partitioned by batch.
For a micro-batch: band keys of its rows, the batch's own ``min(ord)`` per
(band, key), an anti-join with ``seen`` (keys an earlier batch owns), and
the same count rule as the batch job: a row is kept iff it is first in all
bands.  The order is (micro-batch, ``ord``): a late row competes with the rows
that came before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.operators.dedup import COEFF_SEED, NUM_PERM, band_keys, lsh_params, minhash_coefficients, signatures, unique_ords
from corpusflow.sources.ledger import path_exists
from corpusflow.streaming.landing import read_files, run_available


def compact_seen(spark: SparkSession, seen_path: str, before_batch: int) -> None:
    """Merge the state partitions of the batches that no earlier merge holds (0 <= id < ``before_batch``).

    The merged rows become partition ``batch_id = -before_batch`` and the
    merged partitions are deleted afterwards.  Earlier merges (negative ids) are
    left alone, so each row is rewritten once.  A crash in between leaves
    duplicate keys, which cannot change an anti-join; a replay simply merges
    again.  Fewer, larger files keep the per-batch probe scan cheap.
    """
    old = spark.read.parquet(seen_path).where((F.col("batch_id") < before_batch) & (F.col("batch_id") >= 0))
    ids = [r["batch_id"] for r in old.select("batch_id").distinct().collect()]   # one id per batch since the last merge
    if len(ids) < 2:
        return
    (old.select("band", "key", "first").distinct()
        .withColumn("batch_id", F.lit(-before_batch).cast("bigint"))
        .write.mode("append").partitionBy("batch_id").parquet(seen_path))
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for i in ids:
        path = jvm.org.apache.hadoop.fs.Path(f"{seen_path}/batch_id={i}")
        path.getFileSystem(conf).delete(path, True)


def dedup_batch_fn(spark: SparkSession, ord_col: str, text_col: str, seen_path: str, out_path: str,
                   threshold: float = 0.8, k: int = 3, num_perm: int = NUM_PERM, seed: int = COEFF_SEED,
                   compact_every: int = 0):
    """``foreachBatch`` function of the table-probe incremental dedup."""
    b, r = lsh_params(threshold, num_perm)
    coeffs = minhash_coefficients(b * r, seed)

    def fn(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        keys = band_keys(signatures(batch, ord_col, text_col, k, coeffs), ord_col, b, r)
        # One row per (band, key) of this micro-batch: small, reused by the
        # size check, the state probe and both writes, so it is cached once.
        bfirst = keys.groupBy("band", "key").agg(F.min(ord_col).alias("first")).persist()
        new = None
        try:
            if path_exists(spark, seen_path):
                seen = spark.read.parquet(seen_path).where(F.col("batch_id") != batch_id).select("band", "key")
                # An equi-join on (band, key): AQE broadcasts the batch's side when it measures small.
                new = bfirst.join(seen, ["band", "key"], "left_anti")
            else:
                new = bfirst
            new = new.persist()
            kept = (new.groupBy("first").agg(F.count(F.lit(1)).alias("_nb")).where(F.col("_nb") == b)
                       .select(F.col("first").alias(ord_col)).join(unique_ords(batch, ord_col), ord_col, "left_semi"))
            (batch.join(kept, ord_col, "left_semi").write.mode("overwrite")
                  .parquet(f"{out_path}/batch_id={batch_id}"))
            (new.withColumn("batch_id", F.lit(batch_id).cast("bigint")).write.mode("overwrite")
                .option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(seen_path))
            if compact_every and batch_id > 0 and batch_id % compact_every == 0:
                compact_seen(spark, seen_path, batch_id)
        finally:
            if new is not None:
                new.unpersist()
            bfirst.unpersist()
            batch.unpersist()
    return fn


def stream_dedup(spark: SparkSession, source_path: str, schema, ord_col: str, text_col: str, work_dir: str,
                 files_per_trigger: int | None = None, **kw) -> DataFrame:
    """Run the incremental dedup over everything in ``source_path``; return the kept rows.

    ``kw``: dedup parameters and ``compact_every`` (merge committed state every N batches).
    """
    stream = read_files(spark, source_path, schema, files_per_trigger)
    fn = dedup_batch_fn(spark, ord_col, text_col, f"{work_dir}/seen", f"{work_dir}/out", **kw)
    run_available(stream, fn, f"{work_dir}/checkpoint", None)
    return spark.read.schema(schema).parquet(f"{work_dir}/out")
