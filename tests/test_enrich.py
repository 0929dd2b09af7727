import pytest
from pyspark.sql import functions as F

from corpusflow.operators.enrich import enrich, mock_client, mock_reply, split_parsed, with_retry, parsed_list, PERSONA_ITEM
from corpusflow.operators.prompts import fill_template, two_role


def test_retry_and_errors(spark):
    calls = {"n": 0}

    def flaky(prompts):
        calls["n"] += 1
        if calls["n"] < 3:
            raise IOError("down")
        return [("{}", "m")] * len(prompts)
    assert with_retry(flaky, attempts=3)([1]) == [("{}", "m")]
    with pytest.raises(IOError):
        with_retry(lambda p: (_ for _ in ()).throw(IOError("x")), attempts=2)([1])

    df = spark.createDataFrame([(1, "a"), (2, "b")], "id bigint, t string").select("id", two_role(F.lit("s"), F.col("t")).alias("p"))

    def broken():
        def call(prompts):
            raise RuntimeError("model unavailable")
        return call
    out = enrich(df, broken, "p", ["id"], attempts=2).withColumn("items", parsed_list("raw", "persona_list", PERSONA_ITEM))
    ok, rej = split_parsed(out, "items")
    assert ok.count() == 0 and {r.reason for r in rej.collect()} == {"error"}


def test_mock_enrich_keeps_keys(spark):
    df = spark.createDataFrame([(i, f"text {i}") for i in range(50)], "id bigint, t string") \
              .select("id", two_role(F.lit("s"), F.col("t")).alias("p")).repartition(3)
    out = enrich(df, lambda: mock_client("persona"), "p", ["id"], batch_size=7, concurrency=2)
    got = {r.id: r.raw for r in out.collect()}
    assert got == {i: mock_reply(f"text {i}") for i in range(50)}


def test_template_order(spark):
    df = spark.createDataFrame([("fr", "say {seed_language}")], "l string, p string")
    got = df.select(fill_template("A {seed_language} B {seed_prompt}", F.col("l"), F.col("p")).alias("x")).first().x
    assert got == "A fr B say {seed_language}"


def test_one_bad_prompt_fails_alone(spark):
    from corpusflow.operators.enrich import answer
    df = spark.createDataFrame([(i, f"text {i}") for i in range(20)], "id bigint, t string") \
              .select("id", two_role(F.lit("s"), F.col("t")).alias("p")).coalesce(1)

    def picky(**options):
        assert options == {"temperature": 0.1}

        def call(prompts):
            if any(m["content"] == "text 7" for p in prompts for m in p):
                raise ValueError("refused")
            return [("{}", "m")] * len(prompts)
        return call
    out = {r.id: r.error for r in enrich(df, picky, "p", ["id"], attempts=1, options={"temperature": 0.1}).collect()}
    assert {i for i, e in out.items() if e} == {7} and "refused" in out[7]
    assert answer(lambda p: [("x", "m")], ["a", "b"]) == [("x", "m", None)] * 2 and answer(lambda p: [], ["a"])[0][2]
    with pytest.raises(ValueError, match="partitions"):
        enrich(df, picky, "p", ["id"], calls_per_s=5.0)


def test_upstream_rows_run_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def touch(t):
        seen.add(1)
        return t
    df = spark.range(0, 200, 1, 3).select("id", touch(F.col("id").cast("string")).alias("t")).groupBy("id").agg(F.max("t").alias("t"))
    prompted = df.select("id", two_role(F.lit("s"), F.col("t")).alias("p"))
    out = enrich(prompted, lambda: mock_client("persona"), "p", ["id"], partitions=5)
    assert seen.value == 0 and out.count() == 200 and seen.value == 200


def test_unused_shares_go_to_the_tasks_that_still_run(tmp_path):
    """One long and three short tasks: never above the limit, and within a tenth of the ideal time."""
    import threading
    import time

    from corpusflow.operators.enrich import RateLimiter, SharedRate
    limit, calls, lock = 40.0, [], threading.Lock()
    work = [120, 4, 4, 4]

    def task(i):
        shared = SharedRate(f"file://{tmp_path}/rate", len(work), i, limit, check_s=0.05)
        limiter = RateLimiter(shared.interval)
        for _ in range(work[i]):
            limiter.wait()
            with lock:
                calls.append(time.monotonic())
        shared.end()
    t0 = time.monotonic()
    threads = [threading.Thread(target=task, args=(i,)) for i in range(len(work))]
    [t.start() for t in threads]
    [t.join() for t in threads]
    took, ideal = time.monotonic() - t0, sum(work) / limit
    assert took < 1.1 * ideal + 0.15, (took, ideal)
    calls.sort()
    for i in range(len(calls)):  # in any second at most the limit, and the first calls of the tasks
        assert sum(calls[i] <= c < calls[i] + 1 for c in calls) <= limit + len(work)
    again = SharedRate(f"file://{tmp_path}/rate", len(work), 1, limit)  # a task that is run again takes its share back
    assert again.interval() == 1 / limit and SharedRate(f"file://{tmp_path}/rate", len(work), 0, limit).interval() == 2 / limit


def test_rate_of_a_job(spark):
    df = spark.createDataFrame([(i, f"text {i}") for i in range(12)], "id bigint, t string") \
              .select("id", two_role(F.lit("s"), F.col("t")).alias("p"))
    import time
    t0 = time.monotonic()
    out = enrich(df, lambda: mock_client("persona"), "p", ["id"], batch_size=1, partitions=3, calls_per_s=6.0).collect()
    assert len(out) == 12 and time.monotonic() - t0 >= 9 / 6.0 and not any(r.error for r in out)


def test_enrich_holds_few_prompts_of_an_arrow_batch(spark):
    """One Arrow batch of 3,000 prompts: all were Python objects before the first call."""
    from corpusflow.operators.enrich import enrich

    def counting(**_):
        import gc
        return lambda prompts: [(str(sum(type(x) is list and len(x) > 0 and type(x[0]) is dict and "role" in x[0] for x in gc.get_objects())), "m")
                                for _ in prompts[:1]] * len(prompts)
    prompt = F.array(F.struct(F.lit("user").alias("role"), F.col("id").cast("string").alias("content")))
    got = enrich(spark.range(3000).coalesce(1).withColumn("prompt", prompt), counting, "prompt", ["id"]).collect()
    assert sorted(r["id"] for r in got) == list(range(3000)) and not any(r["error"] for r in got)
    assert 0 < max(int(r["raw"]) for r in got) <= 1100
