"""ST3: step-block means maintained incrementally.

``groupBy(block)`` keeps (sum, count) per block in the state store.  In update
mode a micro-batch hands out only the blocks it changed; they are written under
the batch's own folder (a replay overwrites it), and the newest row of a block
is its value.  Only complete blocks are reported.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.streaming.landing import read_files, run_to_end


def stream_step_mean(spark: SparkSession, source_path: str, schema, step_col: str, value_col: str, every: int,
                     work_dir: str, files_per_trigger: int | None = None) -> DataFrame:
    """Run the stateful block aggregation over ``source_path``; return complete blocks with their mean."""
    stream = read_files(spark, source_path, schema, files_per_trigger)
    agg = (stream.groupBy(F.floor(F.col(step_col) / every).cast("bigint").alias("block"))
                 .agg(F.sum(value_col).alias("s"), F.count(F.lit(1)).alias("n")))
    out = f"{work_dir}/blocks"

    def fn(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    run_to_end(agg.writeStream.outputMode("update").foreachBatch(fn).option("checkpointLocation", f"{work_dir}/checkpoint"))
    newest = (spark.read.schema("block bigint, s double, n bigint, batch_id bigint").parquet(out)
                   .groupBy("block").agg(F.max_by(F.struct("s", "n"), "batch_id").alias("v")))
    res = newest.where(F.col("v.n") == every)
    return res.select("block", ((F.col("block") + 1) * every).cast("bigint").alias("step"),
                      F.round(F.col("v.s") / F.col("v.n"), 6).alias("mean_value"))
