"""Processed-key ledgers.

A ledger is a Parquet table ``(key STRING, op, run, batch_id)`` partitioned
by ``op/run/batch_id``: a replayed batch of one run overwrites its own keys,
and runs from different checkpoints never collide.  Keys are compared as strings (ids are cast at the
boundary).  Exclusion is a left-anti join: AQE turns it into a broadcast only
when the ledger's runtime size is small, and keeps a shuffle join otherwise,
so the ledger is never forced into memory.

Jobs that write several tables a batch keep their keys under
``_keys`` and make them visible through :mod:`corpusflow.sources.commits`;
:func:`read_ledger` returns both kinds.

Every batch of keys has a Bloom filter beside it (``<path>.filter``, the same
partitions): rows (slot, bits) of one fixed size, so the filters of all batches
are combined by ``bit_or``.  :func:`exclude_processed_filtered` lets the rows
that miss it pass without an exchange; only hits meet the ledger.  A filter is
written before its keys, so it never lacks one that is visible.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

LEDGER_SCHEMA = StructType([StructField("key", StringType()), StructField("op", StringType()),
                            StructField("run", StringType()), StructField("batch_id", LongType())])


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    jpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(jpath)


def keys_folder(path: str, op: str) -> str:
    """Where committed jobs keep their keys."""
    return f"{path.rstrip('/')}/_keys/op={op}"


def _plain(spark: SparkSession, path: str, op: str | None, exclude: tuple[str, int] | None) -> DataFrame | None:
    """Keys of batches written by :func:`append_ledger`, with their partition columns."""
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = fs_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(fs_path) or not any(s.getPath().getName().startswith("op=") for s in fs.listStatus(fs_path)):
        return None
    df = spark.read.schema(LEDGER_SCHEMA).parquet(path)
    if op is not None:
        df = df.where(F.col("op") == op)
    if exclude is not None:
        df = df.where(~((F.col("run") == exclude[0]) & (F.col("batch_id") == exclude[1])))
    return df


def read_ledger(spark: SparkSession, path: str, op: str | None = None,
                exclude: tuple[str, int] | None = None) -> DataFrame:
    """Keys already processed (an empty frame when the ledger is absent).

    ``exclude=(run, batch_id)`` hides the keys a failed attempt of that same
    batch may have left, so its replay sees the ledger as it was before.
    """
    from corpusflow.sources.commits import CommitLog
    plain = _plain(spark, path, op, exclude)
    found = [plain.select("key")] if plain is not None else []
    logs = CommitLog(spark, path, "x")
    ops = [op] if op is not None else logs._names(f"{path.rstrip('/')}/_commits")
    found += [CommitLog(spark, path, o).read("keys", "key string") for o in ops if path_exists(spark, f"{path.rstrip('/')}/_commits/{o}")]
    return reduce(lambda a, b: a.union(b), found) if found else spark.createDataFrame([], "key string")


def exclude_processed(df: DataFrame, ledger: DataFrame, key) -> DataFrame:
    """Rows whose key (as a string) is not in the ledger."""
    key_c = F.col(key) if isinstance(key, str) else key
    keyed = df.withColumn("_lkey", key_c.cast("string"))
    led = ledger.select(F.col("key").alias("_lkey"))
    return keyed.join(led, "_lkey", "left_anti").drop("_lkey")


# --- Bloom filters ----------------------------------------------------------

# One filter of 2^24 bits (2 MB) whatever the ledger's size: beyond a million or two of keys it fills up, and
# more rows take the exact way.  A key sets PROBES bits.
FILTER_BITS, PROBES = 1 << 24, 4


def _places(key: Column, bits: int) -> list[Column]:
    """The bits of a key, from as many hashes."""
    return [F.pmod(F.xxhash64(F.lit(i), key), F.lit(bits)) for i in range(PROBES)]


def filter_rows(keys: DataFrame, key_col: str = "key", bits: int = FILTER_BITS) -> DataFrame:
    """(slot, bits): the set 64-bit words of the filter of some keys."""
    with_sums = keys.select(F.explode(F.array(*_places(F.col(key_col), bits))).alias("_at"))
    return _combined(with_sums.select(F.shiftright("_at", 6).cast("int").alias("slot"), _bit(F.col("_at")).alias("bits")))


def _bit(at: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), (at % 64).cast("int"))


def _combined(rows: DataFrame) -> DataFrame:
    return rows.groupBy("slot").agg(F.bit_or("bits").alias("bits"))


def filter_words(rows: DataFrame, bits: int = FILTER_BITS) -> Column:
    """The combined filter as one array of 64-bit words (a scalar subquery of ``bits`` / 8 bytes, evaluated once)."""
    spark = rows.sparkSession
    every = spark.range(bits // 64).select(F.col("id").cast("int").alias("slot"), F.lit(0).cast("bigint").alias("bits"))
    # Zero words for all slots: the sorted list is the array itself.
    dense = _combined(rows.select("slot", "bits").union(every))
    return dense.agg(F.transform(F.sort_array(F.collect_list(F.struct("slot", "bits"))), lambda w: w["bits"]).alias("words")).scalar()


def may_contain(words: Column, key: Column, bits: int = FILTER_BITS) -> Column:
    """Whether a key may be in the filter: never false for one that is."""
    hits = [F.get(words, F.shiftright(at, 6).cast("int")).bitwiseAND(_bit(at)) != 0 for at in _places(key, bits)]
    return reduce(lambda a, b: a & b, hits)


def read_filter(spark: SparkSession, path: str, op: str | None = None, bits: int = FILTER_BITS) -> DataFrame:
    """(slot, bits) rows whose combination covers every visible key of the ledger.

    Batches without a filter of their own (written by earlier versions) are hashed here.
    """
    folder, found = f"{path.rstrip('/')}.filter", []
    if path_exists(spark, folder):
        stored = spark.read.schema("slot int, bits bigint, op string, run string, batch_id bigint").parquet(folder)
        stored = stored.where(F.col("op") == op) if op is not None else stored
        found.append(stored.select("slot", "bits"))
        plain = _plain(spark, path, op, None)
        if plain is not None:
            have = stored.select("op", "run", "batch_id").distinct()
            bare = plain.join(have, ["op", "run", "batch_id"], "left_anti")
            found.append(filter_rows(bare, "key", bits))
    else:
        found.append(filter_rows(read_ledger(spark, path, op), "key", bits))
    return reduce(lambda a, b: a.union(b), found)


def exclude_processed_filtered(df: DataFrame, ledger: DataFrame, filter_: DataFrame, key, bits: int = FILTER_BITS) -> DataFrame:
    """As :func:`exclude_processed`, but only rows that hit the Bloom filter ``filter_`` meet the ledger.

    Rows that miss it cannot be processed: they pass in the tasks of their scan.
    NULL keys are in no ledger.
    """
    key_c = (F.col(key) if isinstance(key, str) else key).cast("string")
    hit = F.coalesce(may_contain(filter_words(filter_, bits), key_c, bits), F.lit(False))
    return df.where(~hit).unionByName(exclude_processed(df.where(hit), ledger, key))


def write_filter(keys: DataFrame, path: str, op: str, batch_id: int, key_col: str = "key", run: str = "0") -> None:
    """The Bloom filter of one batch of keys, to be written before they become visible."""
    named = keys.select(F.col(key_col).cast("string").alias("key"))
    filter_rows(named).write.mode("overwrite").parquet(f"{path.rstrip('/')}.filter/op={op}/run={run}/batch_id={batch_id}")


def append_ledger(keys: DataFrame, path: str, op: str, batch_id: int, key_col: str = "key",
                  run: str = "0") -> None:
    """K2: record distinct keys of one batch, and their Bloom filter.

    The batch's own partition folder is overwritten, also by a batch without
    keys, so a replay never leaves keys of an earlier attempt behind.
    """
    write_filter(keys, path, op, batch_id, key_col, run)
    (keys.select(F.col(key_col).cast("string").alias("key")).distinct()
         .write.mode("overwrite").parquet(f"{path.rstrip('/')}/op={op}/run={run}/batch_id={batch_id}"))
