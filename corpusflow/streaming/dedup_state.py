"""ST2, keyed-state form: incremental first-wins dedup on the streaming state store.

``groupBy(band, key)`` keeps, per band key, the first row by (arrival, ``ord``)
and the last arrival, as a stateful streaming aggregation (JVM, partial
aggregation before the shuffle, one state row per band key, keyed lookups: no
scan of all state per batch).  The arrival of a row is its micro-batch's
timestamp, which Spark records in the checkpoint, so a replay sees the same one.
In update mode a micro-batch emits the keys it touched; a key is new when its
first and last arrival are equal.  A row is kept iff it is first in all its band
keys.  Rows may arrive in any order of ``ord``: a late row competes with those
that came before it and is kept when it is new.  An ``ord`` that an earlier
micro-batch has brought fails the job: each has a state row of its own.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.functions.text import packed_hashes, shingles
from corpusflow.operators.dedup import COEFF_SEED, NUM_PERM, _minhash_udf, lsh_params, minhash_coefficients
from corpusflow.session import session_conf
from corpusflow.streaming.landing import read_files, run_to_end

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STORE = "spark.sql.streaming.stateStore"
# State off the heap: all stores of an executor share one cache and write buffer of that many MB. Stores stay open until
# Spark's maintenance closes them: with unloadOnCommit it takes those of running tasks away once another stream has started it.
BOUNDED_STORE = {
    f"{STORE}.providerClass": ROCKSDB,
    f"{STORE}.rocksdb.boundedMemoryUsage": "true",
    f"{STORE}.rocksdb.maxMemoryUsageMB": "128",
    f"{STORE}.rocksdb.trackTotalNumberOfRows": "false",
    f"{STORE}.rocksdb.allowFAllocate": "false",   # else every store takes some MB of disk in advance
}


def ord_key(value) -> Column:
    """An ``ord`` value of any type as a key of its own: the code points of its text."""
    return F.transform(F.split(value.cast("string"), ""), F.ascii)


def band_rows(stream: DataFrame, ord_col: str, text_col: str, carry: list, k: int, coeffs, bands: int, rows: int):
    """(ord, carry..., band, key) rows of a (streaming) frame; band number ``bands`` holds the ``ord`` itself."""
    sig = _minhash_udf(coeffs)(packed_hashes(shingles(F.col(text_col), k)))
    keys = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)),
                       lambda i: F.slice(F.col("_sig"), i * rows + 1, rows).cast("array<int>"))
    keys = F.concat(keys, F.array(ord_key(F.col(ord_col))))
    return (stream.select(ord_col, *carry, sig.alias("_sig"))
                  .select(ord_col, *carry, F.posexplode(keys).alias("band", "key")))


def stream_dedup_state(spark: SparkSession, source_path: str, schema, ord_col: str, text_col: str, work_dir: str,
                       carry: tuple = (), files_per_trigger: int | None = None, threshold: float = 0.8, k: int = 3,
                       num_perm: int = NUM_PERM, seed: int = COEFF_SEED, rocksdb: bool = False) -> DataFrame:
    """Run over everything available in ``source_path``; return kept (ord, carry...) rows.

    ``rocksdb=True`` runs it on the RocksDB state store with the bounds of ``BOUNDED_STORE`` (state on
    local disk of each executor, checkpointed), for this stream only; otherwise the session's
    configured provider is used, which a cluster normally sets.  Spark's default provider keeps all
    state of an executor on its heap.  A checkpoint keeps the provider that it began with.
    """
    b, r = lsh_params(threshold, num_perm)
    coeffs = minhash_coefficients(b * r, seed)
    carry = list(carry)
    stream = read_files(spark, source_path, schema, files_per_trigger).withColumn("_at", F.current_timestamp())
    rows = band_rows(stream, ord_col, text_col, ["_at", *carry], k, coeffs, b, r)
    order = F.struct(F.col("_at").alias("at"), F.col(ord_col).alias("o"))
    firsts = rows.groupBy("band", "key").agg(
        F.min(order).alias("_first"), F.max("_at").alias("_last"),
        *[F.min_by(c, order).alias(c) for c in carry])
    out = f"{work_dir}/out"

    def fn(batch: DataFrame, batch_id: int) -> None:
        # A repeated ord touches its own key again, in this micro-batch or in a later one.
        again = F.raise_error(F.concat(F.lit(f"{ord_col} is in an earlier batch already: "), F.col("_first.o").cast("string"))).cast("boolean")
        fresh = batch.where(F.when((F.col("band") == b) & (F.col("_first.at") != F.col("_last")), again)
                             .otherwise((F.col("_first.at") == F.col("_last")) & (F.col("band") < b)))
        kept = (fresh.groupBy(F.col("_first.o").alias(ord_col), *carry).agg(F.count(F.lit(1)).alias("_wins"))
                     .where(F.when(F.col("_wins") <= b, F.col("_wins") == b)
                             .otherwise(F.raise_error(F.lit(f"{ord_col} is repeated inside a micro-batch")).cast("boolean")))
                     .select(ord_col, *carry))
        kept.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    with session_conf(spark, BOUNDED_STORE if rocksdb else {}):
        run_to_end(firsts.writeStream.outputMode("update").foreachBatch(fn)
                         .option("checkpointLocation", f"{work_dir}/checkpoint"))
    return spark.read.parquet(out).select(ord_col, *carry)
