import __spark_entry__ as E
from pyspark.sql import functions as F

from corpusflow.operators.dedup import first_wins_dedup

from conftest import SF0001


def test_entry_and_registry(spark):
    df = E.entry(spark)
    assert df.columns == ["doc_id", "lang"]
    assert df.count() > 0
    assert set(E.oracle_sql()) <= set(E.queries())


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_dedup_plan_pre_aggregates_hot_keys(spark):
    """A third of the rows are copies of one text: the band groups are reduced map-side."""
    base = spark.read.parquet(f"{SF0001}/documents.parquet").select("doc_id", "text")
    hot = base.limit(1).select("text").first().text
    n = base.count()
    copies = spark.range(10_000, 10_000 + n // 2).select(F.col("id").alias("doc_id"), F.lit(hot).alias("text"))
    docs = base.unionByName(copies)
    out = first_wins_dedup(docs, "doc_id", "text")
    plan = _plan(out)
    assert "partial_min" in plan and "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    kept = {r.doc_id for r in out.collect()}
    assert not any(i >= 10_000 for i in kept)


def test_positions_plan_has_no_single_partition_over_rows(spark):
    q = E.queries()["shuffle_rank"](spark, SF0001)
    plan = _plan(q)
    # The only single-partition exchange is over the (<= buckets rows) count table.
    assert plan.count("SinglePartition") <= 1
