"""Catalog: streaming jobs over landing folders derived from the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusflow.plans import catalog_chat  # noqa: F401  (registers step_window_mean)
from corpusflow.plans.catalog_enrich import _PERSONAS_SQL
from corpusflow.plans import catalog_text  # noqa: F401  (registers lsh_dedup)
from corpusflow.operators.dedup import sql_first_wins
from corpusflow.plans.registry import REGISTRY, query, table
from corpusflow.session import new_scratch_dir
from corpusflow.streaming.dedup import stream_dedup as _stream_dedup
from corpusflow.streaming.landing import land_in_order
from corpusflow.streaming.resume import resumed_rows, stream_resume as _stream_resume
from corpusflow.streaming.step_mean import stream_step_mean as _stream_step_mean

DOC_SCHEMA = "doc_id bigint, text string, lang string"


@query("stream_dedup", REGISTRY["lsh_dedup"][1])
def stream_dedup(spark, sf):
    """ST2: first-wins dedup over 4 ordered arrivals (state compacted every 2 batches) equals the batch result."""
    work = new_scratch_dir(spark, "stream-dedup")
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    run = lambda: _stream_dedup(spark, f"{work}/landing", DOC_SCHEMA, "doc_id", "text", work, compact_every=2)
    land_in_order(docs, "doc_id", f"{work}/landing", 4, after=run)
    return run().select("doc_id", "lang")


@query("stream_resume", _PERSONAS_SQL)
def stream_resume(spark, sf):
    """ST1: resumable enrichment; a re-run and a fresh-checkpoint run add nothing."""
    work = new_scratch_dir(spark, "stream-resume")
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    run = lambda c: _stream_resume(spark, f"{work}/landing", DOC_SCHEMA, "doc_id", "text", work, f"{work}/{c}")
    land_in_order(docs, "doc_id", f"{work}/landing", 4, after=lambda: run("checkpoint-a"))
    run("checkpoint-a")
    run("checkpoint-b")
    return resumed_rows(spark, work, "doc_id").select("doc_id", F.col("pos").cast("bigint").alias("pos"), "persona", "country", "language")


@query("stream_step_mean", REGISTRY["step_window_mean"][1])
def stream_step_mean(spark, sf):
    """ST3: step-block means in a stateful streaming aggregation."""
    work = new_scratch_dir(spark, "stream-steps")
    ev = table(spark, sf, "events").select("event_id", "value")
    run = lambda: _stream_step_mean(spark, f"{work}/landing", "event_id bigint, value double", "event_id", "value", 300, work)
    land_in_order(ev, "event_id", f"{work}/landing", 4, after=run)
    return run()


@query("stream_dedup_state", REGISTRY["lsh_dedup"][1])
def stream_dedup_state(spark, sf):
    """ST2 (keyed state): band-key minimums in a stateful streaming aggregation; equals the batch result."""
    from corpusflow.streaming.dedup_state import stream_dedup_state as _run
    work = new_scratch_dir(spark, "stream-dedup-state")
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    run = lambda: _run(spark, f"{work}/landing", DOC_SCHEMA, "doc_id", "text", work, carry=("lang",))
    land_in_order(docs, "doc_id", f"{work}/landing", 4, after=run)
    return run()


# Every third document arrives in a second, late micro-batch.
_LATE_ORD = "(CASE WHEN doc_id % 3 = 1 THEN 1000000000000 ELSE 0 END + doc_id)"


@query("stream_late_rows", f"""SELECT k.o % 1000000000000 AS doc_id, d.lang FROM
  ({sql_first_wins(f"(SELECT {_LATE_ORD} AS o, text FROM documents)", 'o', 'text')}) k
  JOIN documents d ON d.doc_id = k.o % 1000000000000""")
def stream_late_rows(spark, sf):
    """ST2: rows that arrive late (smaller ord than rows before them) are kept when they are new, in both forms."""
    from corpusflow.streaming.dedup_state import stream_dedup_state as _run
    work = new_scratch_dir(spark, "stream-late")
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    late = F.col("doc_id") % 3 == 1
    for part in (docs.where(~late), docs.where(late)):
        part.write.mode("append").parquet(f"{work}/landing")
        by_state = _run(spark, f"{work}/landing", DOC_SCHEMA, "doc_id", "text", f"{work}/state", carry=("lang",), rocksdb=True)
        by_table = _stream_dedup(spark, f"{work}/landing", DOC_SCHEMA, "doc_id", "text", f"{work}/table")
    return by_state.join(by_table.select("doc_id"), "doc_id").select("doc_id", "lang")


@query("persona_job", _PERSONAS_SQL)
def persona_job_q(spark, sf):
    """Stage 1 as a batch job (K1/K2): replies staged, rows and rejects written, ledger keys recorded; a re-run adds nothing."""
    from corpusflow.plans.personas import job_rows, persona_job
    work = new_scratch_dir(spark, "persona-job")
    pages = table(spark, sf, "documents").select("doc_id", "text")
    first = persona_job(spark, pages, "doc_id", "text", f"{work}/out", f"{work}/ledger", 0)
    persona_job(spark, pages, "doc_id", "text", f"{work}/out", f"{work}/ledger", 1)   # resumed run: only unparsed keys retried
    rows = job_rows(spark, f"{work}/ledger", first.schema)
    return rows.select("doc_id", F.col("pos").cast("bigint").alias("pos"), F.col("item.persona").alias("persona"),
                       F.get(F.col("item.countries"), 0).alias("country"), F.get(F.col("item.languages"), 0).alias("language"))


@query("stream_dedup_ranges", REGISTRY["lsh_dedup"][1])
def stream_dedup_ranges(spark, sf):
    """ST2: first-wins dedup over 4 arrivals with range-partitioned state, of which a micro-batch reads the parts it meets."""
    from corpusflow.streaming.dedup_ranges import stream_dedup_ranges as _run
    work = new_scratch_dir(spark, "stream-ranges")
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    run = lambda: _run(spark, f"{work}/landing", DOC_SCHEMA, "doc_id", "text", work, ranges=4, compact_every=3)
    land_in_order(docs, "doc_id", f"{work}/landing", 4, after=run)
    return run().select("doc_id", "lang")


@query("stream_step_mean_append", REGISTRY["step_window_mean"][1])
def stream_step_mean_append(spark, sf):
    """ST3: step-block means in append mode: a watermark hands out each block once and drops its state."""
    from corpusflow.streaming.step_append import stream_step_mean_append as _run
    work = new_scratch_dir(spark, "stream-steps-append")
    ev = table(spark, sf, "events").select("event_id", "value")
    run = lambda: _run(spark, f"{work}/landing", "event_id bigint, value double", "event_id", "value", 300, work)
    land_in_order(ev, "event_id", f"{work}/landing", 4, after=run)
    return run()
