from pyspark.sql import functions as F

from corpusflow.operators.dedup import first_wins_dedup
from corpusflow.streaming.dedup import stream_dedup
from corpusflow.streaming.landing import land_in_order
from corpusflow.streaming.resume import stream_resume

from conftest import SF0001

SCHEMA = "doc_id bigint, text string, lang string"


def test_stream_dedup_equals_batch(spark, tmp_path):
    docs = spark.read.parquet(f"{SF0001}/documents.parquet").select("doc_id", "text", "lang")
    def run():
        return stream_dedup(spark, str(tmp_path / "landing"), SCHEMA, "doc_id", "text", str(tmp_path / "work"))
    land_in_order(docs, "doc_id", str(tmp_path / "landing"), 3, after=run)
    got = run()
    want = first_wins_dedup(docs, "doc_id", "text")
    assert sorted(r.doc_id for r in got.collect()) == sorted(r.doc_id for r in want.collect())


def test_stream_resume_is_exactly_once(spark, tmp_path):
    docs = spark.read.parquet(f"{SF0001}/documents.parquet").select("doc_id", "text", "lang")
    src, work = str(tmp_path / "landing"), str(tmp_path / "work")
    land_in_order(docs, "doc_id", src, 2)
    stream_resume(spark, src, SCHEMA, "doc_id", "text", work, f"{work}/ckpt-a")
    n1 = spark.read.parquet(f"{work}/out/rows").count()
    stream_resume(spark, src, SCHEMA, "doc_id", "text", work, f"{work}/ckpt-a")   # nothing new
    stream_resume(spark, src, SCHEMA, "doc_id", "text", work, f"{work}/ckpt-b")   # fresh checkpoint: ledger skips all
    rows = spark.read.parquet(f"{work}/out/rows")
    assert rows.count() == n1 > 0
    assert rows.groupBy("item_key").count().where(F.col("count") > 1).count() == 0


def test_keyed_state_dedup_equals_batch(spark, tmp_path):
    from corpusflow.streaming.dedup_state import stream_dedup_state
    docs = spark.read.parquet(f"{SF0001}/documents.parquet").select("doc_id", "text", "lang")
    def run():
        return stream_dedup_state(spark, str(tmp_path / "landing"), SCHEMA, "doc_id", "text", str(tmp_path / "work"), carry=("lang",))
    land_in_order(docs, "doc_id", str(tmp_path / "landing"), 3, after=run)
    got = run()
    want = first_wins_dedup(docs, "doc_id", "text")
    assert sorted(tuple(r) for r in got.collect()) == sorted((r.doc_id, r.lang) for r in want.select("doc_id", "lang").collect())


def _fail_once_after(fn, failing_batch):
    state = {"failed": False}

    def wrapped(batch, batch_id):
        fn(batch, batch_id)                      # all writes of the batch are done ...
        if batch_id == failing_batch and not state["failed"]:
            state["failed"] = True
            raise RuntimeError("injected failure after the batch's writes")
    return wrapped


def test_stream_dedup_replays_a_failed_batch(spark, tmp_path):
    from corpusflow.streaming.dedup import dedup_batch_fn
    from corpusflow.streaming.landing import read_files, run_available
    docs = spark.read.parquet(f"{SF0001}/documents.parquet").select("doc_id", "text", "lang")
    src, work = str(tmp_path / "landing"), str(tmp_path / "work")
    fn = _fail_once_after(dedup_batch_fn(spark, "doc_id", "text", f"{work}/seen", f"{work}/out"), 1)
    failed = []

    def run():
        try:
            run_available(read_files(spark, src, SCHEMA), fn, f"{work}/ckpt")
        except Exception as e:  # the injected one; the next run replays the batch
            failed.append("injected" in str(e))
            run_available(read_files(spark, src, SCHEMA), fn, f"{work}/ckpt")
    land_in_order(docs, "doc_id", src, 3, after=run)
    assert failed == [True]
    got = sorted(r.doc_id for r in spark.read.schema(SCHEMA).parquet(f"{work}/out").collect())
    want = sorted(r.doc_id for r in first_wins_dedup(docs, "doc_id", "text").collect())
    assert got == want


def test_stream_resume_replays_a_failed_batch(spark, tmp_path):
    import hashlib

    from corpusflow.operators.enrich import mock_client
    from corpusflow.streaming.landing import read_files, run_available
    from corpusflow.streaming.resume import resume_batch_fn
    docs = spark.read.parquet(f"{SF0001}/documents.parquet").select("doc_id", "text", "lang")
    src, work = str(tmp_path / "landing"), str(tmp_path / "work")
    ckpt = f"{work}/ckpt"
    run = hashlib.md5(ckpt.encode()).hexdigest()[:12]
    asked = spark.sparkContext.accumulator(0)

    def counting():
        client = mock_client("persona")

        def call(prompts):
            asked.add(len(prompts))
            return client(prompts)
        return call
    fn = _fail_once_after(resume_batch_fn(spark, "doc_id", "text", f"{work}/ledger", f"{work}/out", run, client_factory=counting), 1)
    failed = []

    def arrive():
        try:
            run_available(read_files(spark, src, SCHEMA), fn, ckpt)
        except Exception as e:  # the injected one; the next run replays the batch
            failed.append("injected" in str(e))
            run_available(read_files(spark, src, SCHEMA), fn, ckpt)
    land_in_order(docs, "doc_id", src, 3, after=arrive)
    assert failed == [True]
    long_docs = sum(len((r.text or "").split()) > 100 for r in docs.collect())
    assert asked.value == long_docs                      # the replay used the stored replies
    rows = spark.read.parquet(f"{work}/out/rows")
    clean = str(tmp_path / "clean")
    stream_resume(spark, src, SCHEMA, "doc_id", "text", clean, f"{clean}/ckpt")
    want = spark.read.parquet(f"{clean}/out/rows")
    assert rows.groupBy("item_key").count().where(F.col("count") > 1).count() == 0
    assert sorted(r.item_key for r in rows.collect()) == sorted(r.item_key for r in want.collect())


def test_stream_dedup_with_state_compaction(spark, tmp_path):
    docs = spark.read.parquet(f"{SF0001}/documents.parquet").select("doc_id", "text", "lang")
    def run():
        return stream_dedup(spark, str(tmp_path / "landing"), SCHEMA, "doc_id", "text", str(tmp_path / "work"), compact_every=2)
    land_in_order(docs, "doc_id", str(tmp_path / "landing"), 4, after=run)
    got = run()
    want = first_wins_dedup(docs, "doc_id", "text")
    assert sorted(r.doc_id for r in got.collect()) == sorted(r.doc_id for r in want.collect())
    parts = {r.batch_id for r in spark.read.parquet(str(tmp_path / "work" / "seen")).select("batch_id").distinct().collect()}
    assert -2 in parts and 0 not in parts and 1 not in parts


def test_compaction_replay_is_harmless(spark, tmp_path):
    from corpusflow.streaming.dedup import compact_seen
    seen = str(tmp_path / "seen")
    rows = [(b, i % 3, [i, i + 1], 10 * b + i) for b in range(4) for i in range(5)]
    df = spark.createDataFrame(rows, "batch_id bigint, band int, key array<int>, first bigint")
    df.write.partitionBy("batch_id").parquet(seen)
    before = {(r.band, tuple(r.key), r.first) for r in spark.read.parquet(seen).collect()}
    compact_seen(spark, seen, 3)
    compact_seen(spark, seen, 3)          # a replayed batch compacts again
    after = spark.read.parquet(seen)
    assert {(r.band, tuple(r.key), r.first) for r in after.collect()} == before
    assert {r.batch_id for r in after.select("batch_id").distinct().collect()} == {-3, 3}
    more = spark.createDataFrame([(4, 0, [9, 9], 90), (5, 1, [8, 8], 91)], "batch_id bigint, band int, key array<int>, first bigint")
    more.write.mode("append").partitionBy("batch_id").parquet(seen)
    compact_seen(spark, seen, 6)          # merges 3, 4 and 5 only; the earlier merge is not rewritten
    assert {r.batch_id for r in spark.read.parquet(seen).select("batch_id").distinct().collect()} == {-3, -6}


def test_a_failed_stream_raises_and_step_means_are_complete(spark, tmp_path):
    import pytest
    from corpusflow.streaming.landing import read_files, run_available
    from corpusflow.streaming.step_mean import stream_step_mean
    src, schema = str(tmp_path / "steps"), "step bigint, v double"
    df = spark.createDataFrame([(i, float(i)) for i in range(95)], schema)

    def run():
        return stream_step_mean(spark, src, schema, "step", "v", 10, str(tmp_path / "work"))
    land_in_order(df, "step", src, 3, after=run)
    assert sorted(tuple(r) for r in run().collect()) == [(b, 10 * b + 10, 10 * b + 4.5) for b in range(9)]

    def broken(batch, batch_id):
        raise RuntimeError("writer failed")
    with pytest.raises(Exception, match="writer failed"):
        run_available(read_files(spark, src, schema), broken, str(tmp_path / "ckpt"))
