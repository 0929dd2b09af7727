"""ST2 with range-partitioned state: a micro-batch reads only the state it can meet.

The ``seen(band, key, first)`` table is split into ``bands * ranges`` parts: a
part holds one band's keys of one range of their hash.  A micro-batch finds the
parts its own keys fall into (at most ``bands * ranges`` numbers), and the scan
of the state is pruned to those folders before the anti-join.  Equal parts meet
equal parts only, so no key of another part could match.

A part that has collected ``compact_every`` batches is merged into one, alone;
the others are not rewritten.

The ``ord`` values themselves are kept in the same way (``ords``): one that an
earlier batch has brought fails the job, as it fails inside a batch (T4).

Every batch writes below its own ``batch_id`` with overwrite, so a replay
replaces its own state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.operators.dedup import COEFF_SEED, NUM_PERM, band_keys, lsh_params, minhash_coefficients, signatures, unique_ords
from corpusflow.sources.ledger import path_exists
from corpusflow.streaming.landing import read_files, run_available

RANGES = 16
SEEN = "band int, key array<int>, first {ord}, part int, batch_id bigint"
ORDS = "value {ord}, part int, batch_id bigint"


def key_part(band: Column, key: Column, ranges: int) -> Column:
    """The part of a band key: the band, and the range of the key's hash."""
    return (band * ranges + F.shiftrightunsigned(F.xxhash64(key), 33) % ranges).cast("int")


def touched(rows: DataFrame) -> list[int]:
    """The parts that occur in ``rows``: never more than there are parts."""
    return sorted(r["part"] for r in rows.select("part").distinct().collect())


def pruned(spark: SparkSession, path: str, schema: str, parts: list[int], batch_id: int) -> DataFrame | None:
    """The state of some parts, without what this batch itself may have left; None before the first batch.

    Both conditions are on partition columns: only the folders of those parts are listed and read.
    """
    if not path_exists(spark, path):
        return None
    return spark.read.schema(schema).parquet(path).where(F.col("part").isin(parts) & (F.col("batch_id") != batch_id))


def write_parts(rows: DataFrame, path: str, batch_id: int) -> None:
    """Rows of one batch, one file a part."""
    (rows.withColumn("batch_id", F.lit(batch_id).cast("bigint")).repartition("part").write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("part", "batch_id").parquet(path))


def compact_parts(spark: SparkSession, path: str, schema: str, parts: list[int], before_batch: int, compact_every: int) -> list[int]:
    """Merge those of ``parts`` that hold ``compact_every`` unmerged batches before ``before_batch``; returns them.

    The merged rows become ``batch_id = -before_batch``.  A crash before the
    deletes leaves rows twice, which cannot change an anti-join.
    """
    own = spark.read.schema(schema).parquet(path).where(F.col("part").isin(parts) & (F.col("batch_id") >= 0) & (F.col("batch_id") < before_batch))
    batches: dict[int, list[int]] = {}
    for r in own.select("part", "batch_id").distinct().collect():   # at most compact_every a part
        batches.setdefault(r["part"], []).append(r["batch_id"])
    full = sorted(p for p, b in batches.items() if len(b) >= compact_every)
    if full:
        write_parts(own.where(F.col("part").isin(full)).drop("batch_id").distinct(), path, -before_batch)
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        for p in full:
            for b in batches[p]:
                folder = jvm.org.apache.hadoop.fs.Path(f"{path}/part={p}/batch_id={b}")
                folder.getFileSystem(conf).delete(folder, True)
    return full


def check_new_ords(spark: SparkSession, batch: DataFrame, ord_col: str, path: str, batch_id: int, ranges: int) -> None:
    """Fail if an earlier batch has brought one of the batch's ``ord`` values, else record them."""
    kind = dict(batch.dtypes)[ord_col]
    ords = batch.select(F.col(ord_col).alias("value"), F.pmod(F.xxhash64(ord_col), F.lit(ranges)).cast("int").alias("part"))
    before = pruned(spark, path, ORDS.format(ord=kind), touched(ords), batch_id)
    if before is not None and (again := ords.join(before, ["part", "value"], "left_semi").limit(1).collect()):
        raise ValueError(f"{ord_col} {again[0]['value']} is in an earlier batch already")
    write_parts(ords, path, batch_id)


def dedup_ranges_fn(spark: SparkSession, ord_col: str, text_col: str, work_dir: str, threshold: float = 0.8, k: int = 3,
                    num_perm: int = NUM_PERM, seed: int = COEFF_SEED, ranges: int = RANGES, compact_every: int = 8):
    """``foreachBatch`` function of the range-partitioned incremental dedup."""
    b, r = lsh_params(threshold, num_perm)
    coeffs = minhash_coefficients(b * r, seed)

    def fn(batch: DataFrame, batch_id: int) -> None:
        batch, kind, new = batch.persist(), dict(batch.dtypes)[ord_col], None
        keys = band_keys(signatures(batch, ord_col, text_col, k, coeffs), ord_col, b, r)
        firsts = (keys.groupBy("band", "key").agg(F.min(ord_col).alias("first"))
                      .withColumn("part", key_part(F.col("band"), F.col("key"), ranges)).persist())
        try:
            check_new_ords(spark, batch, ord_col, f"{work_dir}/ords", batch_id, ranges)
            parts = touched(firsts)
            seen = pruned(spark, f"{work_dir}/seen", SEEN.format(ord=kind), parts, batch_id)
            new = (firsts if seen is None else firsts.join(seen.select("part", "band", "key"), ["part", "band", "key"], "left_anti")).persist()
            kept = (new.groupBy("first").agg(F.count(F.lit(1)).alias("_nb")).where(F.col("_nb") == b)
                       .select(F.col("first").alias(ord_col)).join(unique_ords(batch, ord_col), ord_col, "left_semi"))
            batch.join(kept, ord_col, "left_semi").write.mode("overwrite").parquet(f"{work_dir}/out/batch_id={batch_id}")
            write_parts(new, f"{work_dir}/seen", batch_id)
            if parts:
                compact_parts(spark, f"{work_dir}/seen", SEEN.format(ord=kind), parts, batch_id, compact_every)
        finally:
            for x in (new, firsts, batch):
                if x is not None:
                    x.unpersist()
    return fn


def stream_dedup_ranges(spark: SparkSession, source_path: str, schema, ord_col: str, text_col: str, work_dir: str,
                        files_per_trigger: int | None = None, **kw) -> DataFrame:
    """Run the incremental dedup over everything in ``source_path``; return the kept rows."""
    stream = read_files(spark, source_path, schema, files_per_trigger)
    run_available(stream, dedup_ranges_fn(spark, ord_col, text_col, work_dir, **kw), f"{work_dir}/checkpoint")
    return spark.read.schema(schema).parquet(f"{work_dir}/out")
