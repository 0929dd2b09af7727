"""ST1: resumable enrichment (ledger, commit log, checkpoint).

Per micro-batch: length filter, anti-join with the ledger, prompt, model call,
parse, explode; rows, rejects and ledger keys become visible by one commit of
(run, batch).  A batch that failed before it is run again from its stored
replies; a committed one is passed over; a fresh run with a new checkpoint
skips every key the ledger already holds.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.plans import personas as P
from corpusflow.sources.commits import CommitLog
from corpusflow.sources.ledger import read_ledger
from corpusflow.streaming.landing import read_files, run_available


ROWS = "{id} {kind}, pos int, item_key string, model string, persona string, country string, language string"


def resume_batch_fn(spark: SparkSession, id_col: str, text_col: str, ledger_path: str, out_path: str,
                    run: str, op: str = "persona", client_factory=None):
    """``foreachBatch`` function of the resumable enrichment (rows, rejects, ledger per batch)."""
    log = CommitLog(spark, ledger_path, op)

    def shape(rows: DataFrame, rejects: DataFrame) -> tuple[DataFrame, DataFrame]:
        return rows.select(id_col, "pos", "item_key", "model", F.col("item.persona").alias("persona"),
                           F.get("item.countries", 0).alias("country"), F.get("item.languages", 0).alias("language")), rejects.select(id_col, "reason")

    def fn(batch: DataFrame, batch_id: int) -> None:
        P.write_batch(spark, log, run, batch_id, lambda: P.persona_prompts(batch, id_col, text_col, read_ledger(spark, ledger_path, op)),
                      id_col, out_path, ledger_path, client_factory, shape)
    return fn


def resumed_rows(spark: SparkSession, work_dir: str, id_col: str, id_type: str = "bigint", op: str = "persona") -> DataFrame:
    """The rows of all committed batches of :func:`stream_resume`."""
    return P.job_rows(spark, f"{work_dir}/ledger", ROWS.format(id=id_col, kind=id_type), op)


def stream_resume(spark: SparkSession, source_path: str, schema, id_col: str, text_col: str, work_dir: str,
                  checkpoint: str, files_per_trigger: int | None = None, client_factory=None) -> None:
    """One run of the resumable job over everything available in ``source_path``."""
    run = hashlib.md5(checkpoint.encode()).hexdigest()[:12]
    stream = read_files(spark, source_path, schema, files_per_trigger)
    fn = resume_batch_fn(spark, id_col, text_col, f"{work_dir}/ledger", f"{work_dir}/out", run,
                         client_factory=client_factory)
    run_available(stream, fn, checkpoint)
