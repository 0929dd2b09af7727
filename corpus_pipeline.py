"""Corpus pipeline: quality filter, exact dedup, near dedup, decontamination, packing.

``STAGES`` lists (name, function); every function takes (spark, docs, sf_dir)
and returns a DataFrame.  ``run`` writes each result as Parquet to the shared
scratch folder and hands it to the next stage.  All but the last stage return
the columns of ``documents``; the last returns the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusflow.llm import decontaminate, exact_dedup, near_dedup, packing, quality
from corpusflow.llm.common import prepare, staged, table
from corpusflow.session import ship_package


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier (fitted on the labels) does not reject."""
    _ready(spark)
    return quality.reject(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text: the largest doc_id."""
    _ready(spark)
    return exact_dedup.dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group (5-word shingles, similarity of 0.8 or more): the least doc_id."""
    _ready(spark)
    return near_dedup.dedup(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    _ready(spark)
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"), least=1)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in training sequences of the permitted lengths."""
    _ready(spark)
    return packing.best_fit(docs)


STAGES = [("quality", quality_filter), ("exact_dedup", drop_copies), ("near_dedup", drop_near_copies),
          ("decontaminate", drop_contaminated), ("packing", pack)]

# Neither the fitted classifier nor best-fit packing has an SQL form; tests/llm compares run() with a brute-force version.
ORACLE_SQL = None


def _ready(spark: SparkSession) -> None:
    prepare(spark)
    ship_package(spark)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
