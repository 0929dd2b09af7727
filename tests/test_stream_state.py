"""Streaming state that is bounded or pruned, and committed batches."""
import pytest
from pyspark.sql import functions as F

from corpusflow.operators.dedup import first_wins_dedup
from corpusflow.plans import personas as P
from corpusflow.sources.commits import CommitLog
from corpusflow.sources.ledger import (append_ledger, exclude_processed, exclude_processed_filtered, filter_rows, read_filter, read_ledger)
from corpusflow.streaming import dedup_ranges as R
from corpusflow.streaming.landing import land_in_order, read_files, run_available
from corpusflow.streaming.step_append import stream_step_mean_append

from conftest import SF0001

SCHEMA = "doc_id bigint, text string, lang string"


def documents(spark):
    return spark.read.parquet(f"{SF0001}/documents.parquet").select("doc_id", "text", "lang")


def files_read(df):
    """Files that the scan of a plan without exchanges opens (its own metric, after a run)."""
    plan = df._jdf.queryExecution().executedPlan()
    plan.execute().count()
    return plan.collectLeaves().apply(0).metrics().apply("numFiles").value()


def test_ranges_equal_batch_and_compact_alone(spark, tmp_path):
    src, work = str(tmp_path / "landing"), str(tmp_path / "work")

    def run():
        return R.stream_dedup_ranges(spark, src, SCHEMA, "doc_id", "text", work, ranges=2, compact_every=2)
    land_in_order(documents(spark), "doc_id", src, 4, after=run)
    want = sorted(r.doc_id for r in first_wins_dedup(documents(spark), "doc_id", "text").collect())
    assert sorted(r.doc_id for r in run().collect()) == want
    batches = {r.batch_id for r in spark.read.parquet(f"{work}/seen").select("batch_id").distinct().collect()}
    assert any(b < 0 for b in batches) and 3 in batches


def test_a_batch_reads_the_parts_it_touches(spark, tmp_path):
    """State of 40 parts; the scan of one batch lists only the files of its own parts."""
    path, schema = str(tmp_path / "seen"), R.SEEN.format(ord="bigint")
    rows = spark.createDataFrame([(i % 4, [i], i) for i in range(4000)], "band int, key array<int>, first bigint")
    rows = rows.withColumn("part", R.key_part(F.col("band"), F.col("key"), 10))
    for b in range(3):
        R.write_parts(rows.where(F.col("first") % 3 == b), path, b)
    one = rows.where("first = 77")
    parts = R.touched(one)
    scan = R.pruned(spark, path, schema, parts, 99)
    assert len(parts) == 1 and files_read(scan) == 3 and files_read(spark.read.parquet(path)) == 120
    assert one.join(scan, ["part", "band", "key"], "left_semi").count() == 1
    assert R.pruned(spark, path, schema, parts, 77 % 3).join(one, ["band", "key"], "left_semi").count() == 0  # the batch's own rows are hidden
    assert R.compact_parts(spark, path, schema, parts, 3, 3) == parts and R.compact_parts(spark, path, schema, parts, 3, 3) == []
    assert files_read(R.pruned(spark, path, schema, parts, 99)) == 1 and files_read(spark.read.parquet(path)) == 118
    assert spark.read.schema(schema).parquet(path).count() == 4000


def test_replay_and_repeated_ord(spark, tmp_path):
    src, work = str(tmp_path / "landing"), str(tmp_path / "work")
    fn, state = R.dedup_ranges_fn(spark, "doc_id", "text", work, ranges=2), {"failed": 0}

    def flaky(batch, batch_id):
        fn(batch, batch_id)
        if batch_id == 1 and not state["failed"]:
            state["failed"] = 1
            raise RuntimeError("injected failure after the batch's writes")

    def run():
        try:
            run_available(read_files(spark, src, SCHEMA), flaky, f"{work}/checkpoint")
        except Exception as e:
            assert "injected" in str(e)
            run_available(read_files(spark, src, SCHEMA), flaky, f"{work}/checkpoint")
    land_in_order(documents(spark), "doc_id", src, 3, after=run)
    want = sorted(r.doc_id for r in first_wins_dedup(documents(spark), "doc_id", "text").collect())
    assert state["failed"] and sorted(r.doc_id for r in spark.read.schema(SCHEMA).parquet(f"{work}/out").collect()) == want
    documents(spark).limit(1).write.mode("append").parquet(src)
    with pytest.raises(Exception, match="earlier batch"):
        run_available(read_files(spark, src, SCHEMA), fn, f"{work}/checkpoint")


def test_keyed_state_reports_a_repeated_ord(spark, tmp_path):
    from corpusflow.streaming.dedup_state import stream_dedup_state
    src, work = str(tmp_path / "landing"), str(tmp_path / "work")
    run = lambda: stream_dedup_state(spark, src, SCHEMA, "doc_id", "text", work)
    docs = documents(spark).limit(20).cache()
    docs.write.parquet(src)
    assert run().count() > 0
    docs.limit(1).withColumn("text", F.lit("other words here altogether")).write.mode("append").parquet(src)
    with pytest.raises(Exception, match="earlier batch"):
        run()


def test_append_mode_hands_out_blocks_once_and_drops_them(spark, tmp_path):
    src, work = str(tmp_path / "steps"), str(tmp_path / "work")
    df = spark.createDataFrame([(i, float(i)) for i in range(95)], "step bigint, v double")
    progress, counts = [], []

    def run():
        got = stream_step_mean_append(spark, src, "step bigint, v double", "step", "v", 10, work, progress=progress)
        counts.append(got.count())
        return got
    land_in_order(df, "step", src, 3, after=run)
    assert sorted(tuple(r) for r in run().collect()) == [(b, 10 * b + 10, 10 * b + 4.5) for b in range(9)]
    assert counts == sorted(counts) and 0 < counts[0] < 9
    states = [p.stateOperators[0].numRowsTotal for p in progress if p.stateOperators]
    assert states[-1] == 1 and max(states) <= 5                    # the open block; inside a batch, its own blocks
    spark.createDataFrame([(3, 1.0), (95, 95.0)], "step bigint, v double").write.mode("append").parquet(src)
    assert run().count() == 9                                      # a block is never handed out again


def test_null_order_values_land(spark, tmp_path):
    df = spark.createDataFrame([(None, "a"), (1, "b"), (2, "c"), (3, "d"), (None, "e")], "o bigint, t string")
    for chunks in (1, 3):
        path = str(tmp_path / f"land{chunks}")
        land_in_order(df, "o", path, chunks)
        assert sorted(r.t for r in spark.read.parquet(path).collect()) == list("abcde")


def test_rows_that_miss_the_filter_are_not_exchanged(spark, tmp_path):
    path = str(tmp_path / "ledger")
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(2000)] + [(None, "none")], "id bigint, text string")
    assert exclude_processed_filtered(docs, read_ledger(spark, path), read_filter(spark, path), "id").count() == 2001
    for b in range(3):
        append_ledger(spark.range(b * 100, b * 100 + 100).select("id"), path, "op", b, key_col="id")
    append_ledger(spark.range(50).select("id"), path, "other", 0, key_col="id")
    ledger, want = read_ledger(spark, path, "op"), list(range(300, 2000))

    def left(rows, bits, df=docs):
        return exclude_processed_filtered(df, ledger, rows, "id", bits)
    good = read_filter(spark, path, "op")
    got = left(good, 1 << 24)
    assert sorted(r.id for r in got.collect() if r.id is not None) == want and got.where("id is null").count() == 1
    # a filter that is full, or almost: more rows take the exact way, with equal results
    for bits in (64, 1024):
        full = filter_rows(ledger, "key", bits)
        assert sorted(r.id for r in left(full, bits).collect() if r.id is not None) == want
    # the branch of the missing rows has no exchange between scan and union
    stored = str(tmp_path / "docs")
    docs.write.parquet(stored)
    plan = left(good, 1 << 24, spark.read.parquet(stored))
    tree = plan._jdf.queryExecution().sparkPlan()

    def nodes(n):  # the branch itself, without the plan of its scalar subquery
        yield n.nodeName()
        for i in range(n.children().size()):
            yield from nodes(n.children().apply(i))
    miss, hit = (list(nodes(tree.children().apply(i))) for i in range(2))
    assert tree.nodeName() == "Union" and not any("Exchange" in n or "Join" in n for n in miss) and any("Join" in n for n in hit)
    assert "id" in plan.columns and "text" in plan.columns


def test_filter_of_older_ledgers(spark, tmp_path):
    """Keys of batches without a filter of their own are covered too."""
    path = str(tmp_path / "ledger")
    spark.range(5).selectExpr("cast(id as string) as key").write.parquet(f"{path}/op=op/run=0/batch_id=0")
    docs = spark.range(20).select("id")
    bits = 1 << 24
    assert exclude_processed_filtered(docs, read_ledger(spark, path), read_filter(spark, path), "id", bits).count() == 15
    append_ledger(spark.range(5, 8).select("id"), path, "op", 1, key_col="id")
    assert exclude_processed_filtered(docs, read_ledger(spark, path), read_filter(spark, path), "id", bits).count() == 12


@pytest.mark.parametrize("broken", ["rows", "rejects", "write_filter", "keys", "commit"])
def test_a_failure_between_two_writes_shows_the_earlier_snapshot(spark, tmp_path, monkeypatch, broken):
    """persona_job fails in each of its writes: readers see batch 0 only; the replay asks the model nothing."""
    from corpusflow.operators.enrich import mock_client
    from corpusflow.sources import ledger as L
    pages = spark.createDataFrame([(i, " ".join(f"w{i}x{j}" for j in range(120))) for i in range(12)], "id bigint, text string")
    out, ledger = str(tmp_path / "out"), str(tmp_path / "ledger")
    asked = spark.sparkContext.accumulator(0)

    def counting():
        client = mock_client("persona")

        def call(prompts):
            asked.add(len(prompts))
            return client(prompts)
        return call
    first = P.persona_job(spark, pages.where("id < 6"), "id", "text", out, ledger, 0, client_factory=counting)
    schema, n0 = first.schema, first.count()
    keys0 = sorted(r.key for r in read_ledger(spark, ledger, "persona").collect())
    assert n0 and keys0 and asked.value == 6
    assert P.job_counts(spark, ledger, 0) == {"pages": 6, "long": 6, "todo": 6}

    def fail(*a, **b):
        raise RuntimeError("injected")
    with monkeypatch.context() as m:
        if broken == "commit":
            m.setattr(CommitLog, "commit", fail)
        elif broken == "write_filter":
            m.setattr(L, "write_filter", fail)
        else:
            begin = CommitLog.begin
            m.setattr(CommitLog, "begin", lambda self, *a: begin(self, *a) | {broken: "nofs://x/y"})
        with pytest.raises(Exception):
            P.persona_job(spark, pages, "id", "text", out, ledger, 1, client_factory=counting)
    calls = asked.value
    assert calls > 6 and P.job_rows(spark, ledger, schema).count() == n0
    assert sorted(r.key for r in read_ledger(spark, ledger, "persona").collect()) == keys0
    n1 = P.persona_job(spark, pages, "id", "text", out, ledger, 1, client_factory=counting).count()
    assert asked.value == calls and P.job_rows(spark, ledger, schema).count() == n0 + n1 and n1 > 0
    rows = spark.read.parquet(f"{out}/rows")
    assert rows.count() == n0 + n1                                  # nothing of the failed attempt is left behind
    P.persona_job(spark, pages, "id", "text", out, ledger, 1, client_factory=counting)
    assert asked.value == calls
    done = read_ledger(spark, ledger, "persona")
    left = exclude_processed(pages, done, "id")
    assert sorted(r.id for r in exclude_processed_filtered(pages, done, read_filter(spark, ledger, "persona"), "id").collect()) == sorted(r.id for r in left.collect())


def test_commit_log_snapshots(spark, tmp_path):
    log = CommitLog(spark, str(tmp_path / "log"), "op")
    assert log.entries() == [] and log.read("t", "v int").count() == 0 and log.entry("r", 0) is None
    for b in range(4):
        at = log.begin("r", b, {"t": str(tmp_path / "t")})
        spark.createDataFrame([(b,)], "v int").write.parquet(at["t"])
        log.commit("r", b, at)
    with pytest.raises(RuntimeError, match="already"):
        log.commit("r", 1, {})
    log.compact("t", "v int", str(tmp_path / "t"))
    assert log.vacuum("t") == 4 and sorted(r.v for r in log.read("t", "v int").collect()) == [0, 1, 2, 3]
    at = log.begin("r", 4, {"t": str(tmp_path / "t")})
    spark.createDataFrame([(4,)], "v int").write.parquet(at["t"])
    assert log.read("t", "v int").count() == 4
    log.commit("r", 4, at)
    log.compact("t", "v int", str(tmp_path / "t"))
    assert sorted(r.v for r in log.read("t", "v int").collect()) == [0, 1, 2, 3, 4] and len(log.entries()) == 5


def test_late_rows_keep_their_state_off_the_heap(spark, tmp_path, monkeypatch):
    """stream_late_rows: the state of both arrivals is in RocksDB files, not in maps of Spark's default store; the session is left as it was."""
    from corpusflow.plans import catalog_stream as C
    from corpusflow.streaming.dedup_state import BOUNDED_STORE
    rows = [(0, "one two three four", "en"), (1, "one two three four", "fr"), (2, "five six seven eight", "de"),
            (3, "one two three four", "it"), (4, "nine ten eleven twelve", "en"), (5, "seven", "de"), (7, None, "fr")]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(C, "new_scratch_dir", lambda spark, purpose: str(tmp_path / purpose))
    before = {k: spark.conf.get(k, None) for k in BOUNDED_STORE}
    got = C.stream_late_rows(spark, str(tmp_path)).collect()
    assert sorted(tuple(r) for r in got) == [(0, "en"), (2, "de"), (4, "en"), (5, "de")]
    files = [p.suffix for p in (tmp_path / "stream-late/state/checkpoint/state").rglob("[0-9]*.*")]
    assert ".zip" in files and ".delta" not in files
    assert {k: spark.conf.get(k, None) for k in BOUNDED_STORE} == before
