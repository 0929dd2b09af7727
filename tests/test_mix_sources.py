import pytest
from pyspark.sql import functions as F

from corpusflow.operators import mix as MX
from corpusflow.sources.ledger import append_ledger, exclude_processed, read_ledger
from corpusflow.sources.tables import resolve_source


def parts(spark):
    a = spark.createDataFrame([(i, f"a{i}") for i in range(100)], "k bigint, text string")
    b = spark.createDataFrame([(i, f"b{i}", 1.5) for i in range(10)], "k bigint, text string, extra double")
    return lambda name, split: a if name == "A" else b


def test_parse_mixer_and_modes():
    assert MX.parse_mixer(["A", "10", "B", "0.5"]) == {"A": 10, "B": 0.5}
    assert MX.parse_mixer(["A", 3, "B", 0.5]) == {"A": 3, "B": 0.5}
    with pytest.raises(ValueError):
        MX.parse_mixer(["A"])
    assert MX.amount_mode([1]) is False and MX.amount_mode([1, 1000]) is True
    with pytest.raises(ValueError):
        MX.amount_mode([-1, 0.5])
    with pytest.raises(NotImplementedError):
        MX.amount_mode([0.5, 10])


def test_fraction_count_ids_and_alignment(spark):
    out = MX.mix(parts(spark), {"A": 0.29, "B": 1}, splits=("train",), columns_to_keep=["text", "extra"],
                 keep_ids=True, add_source_col=True, order_col="k")["train"]
    counts = {r.source: r.n for r in out.groupBy("source").agg(F.count("*").alias("n")).collect()}
    assert counts == {"A": int(0.29 * 100), "B": 10}
    assert out.where(F.col("source") == "A").where(F.col("extra").isNotNull()).count() == 0
    ids = {r.id for r in out.collect()}
    assert "A_0" in ids and "B_9" in ids and len(ids) == 38
    again = MX.mix(lambda n, s: parts(spark)(n, s).repartition(5), {"A": 0.29, "B": 1}, splits=("train",),
                   columns_to_keep=["text"], keep_ids=True, order_col="k")["train"]
    assert sorted(r.id + r.text for r in again.collect()) == sorted(r.id + r.text for r in out.collect())


def test_count_above_size_raises(spark):
    with pytest.raises(ValueError):
        MX.mix(parts(spark), {"A": 50, "B": 11}, splits=("train",), columns_to_keep=["text"], order_col="k")


def test_test_split_unsampled_and_bad_split(spark):
    out = MX.mix(parts(spark), {"A": 0.1, "B": 0.1}, splits=("train", "test"), columns_to_keep=["text"], order_col="k")
    assert out["test"].count() == 110 and out["train"].count() == 11
    with pytest.raises(ValueError):
        MX.mix(parts(spark), {"A": 0.1}, splits=("dev",), columns_to_keep=["text"], order_col="k")


def test_resolve_source():
    assert resolve_source(train_file="x.jsonl") == ("file", "x.jsonl")
    for bad in ({}, {"dataset_name": "a", "train_file": "b.json"}, {"train_file": "x.csv"}):
        with pytest.raises(ValueError):
            resolve_source(**bad)


def test_ledger_absent_string_keys_and_replay(spark, tmp_path):
    path = str(tmp_path / "ledger")
    assert read_ledger(spark, path).count() == 0
    df = spark.createDataFrame([(1,), (2,), (3,)], "id bigint")
    append_ledger(spark.createDataFrame([("1",), ("1",)], "key string"), path, "op", 0)
    append_ledger(spark.createDataFrame([("2",)], "key string"), path, "op", 1)
    append_ledger(spark.createDataFrame([("3",)], "key string"), path, "op", 1)   # replay of batch 1 overwrites
    assert sorted(r.key for r in read_ledger(spark, path, "op").collect()) == ["1", "3"]
    assert [r.id for r in exclude_processed(df, read_ledger(spark, path, "op"), "id").collect()] == [2]
    assert sorted(r.key for r in read_ledger(spark, path, "op", exclude=("0", 1)).collect()) == ["1"]


def test_required_columns(spark):
    from corpusflow.operators.filters import require_columns
    df = spark.createDataFrame([(1, "x")], "a int, b string")
    require_columns(df, ["a"])
    with pytest.raises(ValueError):
        require_columns(df, ["a", "messages"])


def test_persona_job_resumes(spark, tmp_path):
    from corpusflow.plans.personas import persona_job
    pages = spark.createDataFrame([(i, " ".join(f"w{i}x{j}" for j in range(120))) for i in range(30)] + [(99, "short")],
                                  "id bigint, text string")
    out, ledger = str(tmp_path / "out"), str(tmp_path / "ledger")
    n_first = persona_job(spark, pages, "id", "text", out, ledger, 0).count()
    n_ok = read_ledger(spark, ledger, "persona").count()
    assert n_first > 0 and 0 < n_ok <= 30
    again = persona_job(spark, pages, "id", "text", out, ledger, 1)      # next batch: only unparsed keys retried
    assert again.select("id").distinct().count() == 0
    replay = persona_job(spark, pages, "id", "text", out, ledger, 0)     # replay of batch 0 rewrites itself
    assert replay.count() == n_first


def test_read_any_dispatch(spark, tmp_path):
    from corpusflow.sources.tables import read_any
    df = spark.createDataFrame([(1, "a,b"), (2, "c")], "k int, v string")
    df.write.json(str(tmp_path / "x.jsonl"))
    df.write.option("header", True).csv(str(tmp_path / "x.csv"))
    df.write.parquet(str(tmp_path / "saved"))
    assert sorted(tuple(r) for r in read_any(spark, str(tmp_path / "x.jsonl"), "k int, v string").collect()) == [(1, "a,b"), (2, "c")]
    assert sorted(r.v for r in read_any(spark, str(tmp_path / "x.csv")).collect()) == ["a,b", "c"]
    assert read_any(spark, str(tmp_path / "saved")).count() == 2


def test_line_numbers_across_splits(spark, tmp_path):
    from corpusflow.sources.jsonl import read_jsonl
    d = tmp_path / "lines"
    d.mkdir()
    for name, n in (("a.jsonl", 700), ("b.jsonl", 3)):
        (d / name).write_text("".join('{"v": "%s-%d"}\n' % (name, i) for i in range(n)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2048")   # many splits per file
    try:
        df = read_jsonl(spark, str(d), "v string", with_position=True)
        splits = spark.read.schema("v string").json(str(d)).select("_metadata.file_block_start").distinct().count()
        assert splits > 3
        got = {(r.file_name, r.line): r.v for r in df.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == {(f, i): f"{f}-{i}" for f, n in (("a.jsonl", 700), ("b.jsonl", 3)) for i in range(n)}


def test_empty_replay_clears_the_batch(spark, tmp_path):
    path = str(tmp_path / "ledger")
    append_ledger(spark.createDataFrame([("a",), ("b",)], "key string"), path, "op", 0)
    append_ledger(spark.createDataFrame([], "key string"), path, "op", 0)
    assert read_ledger(spark, path, "op").count() == 0
    append_ledger(spark.createDataFrame([("c",)], "key string"), path, "op", 1)
    assert [r.key for r in read_ledger(spark, path).collect()] == ["c"]


def test_alignment_by_name_and_type(spark):
    f = spark.createDataFrame
    a = f([(1,)], "k bigint")
    b = f([(2, [("hello", "user")])], "k int, messages array<struct<content: string, role: string>>")
    c = f([(3, [("user", "hi")])], "k int, messages array<struct<role: string, content: string>>")
    load = {"a": a, "b": b, "c": c}
    out = MX.mix(lambda n, s: load[n], {"a": 1.0, "b": 1.0, "c": 1.0}, splits=("train",), columns_to_keep=["k", "messages"], order_col="k")["train"]
    got = {r.k: [(m.role, m.content) for m in r.messages] if r.messages else None for r in out.collect()}
    assert got == {1: None, 2: [("user", "hello")], 3: [("user", "hi")]}
    bad = {"a": f([(1, "x")], "k int, v string"), "b": f([(2, [1])], "k int, v array<int>")}
    with pytest.raises(ValueError, match="do not agree"):
        MX.mix(lambda n, s: bad[n], {"a": 1.0, "b": 1.0}, splits=("train",), columns_to_keep=["k", "v"], order_col="k")


def test_copies_share_no_key(spark):
    rows = [("same",)] * 500 + [(f"t{i}",) for i in range(500)]
    df = spark.createDataFrame(rows, "text string").repartition(5)
    keyed = MX._keyed(df, "A", "train", 42, None)
    assert keyed.groupBy("_k").count().agg(F.max("count")).first()[0] == 1 and keyed.count() == 1000
    out = MX.mix(lambda n, s: df, {"A": 1000}, splits=("train",), columns_to_keep=["text"], keep_ids=True)["train"]
    assert out.where(F.col("text") == "same").count() == 500 and out.select("id").distinct().count() == 1000


def test_cut_reads_text_only_below_the_threshold(spark):
    df = spark.range(0, 20_000, 1, 4).withColumn("text", F.concat(F.lit("t"), "id"))
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def touch(t):
        seen.add(1)
        return t
    from corpusflow.operators.sampling import first_n
    got = first_n(df, "id", 300).withColumn("text", touch("text")).collect()
    want = first_n(df, "id", 20_000).select("id").count()
    assert len(got) == 300 and want == 20_000 and seen.value == 300


def test_loader_and_configs(spark, tmp_path):
    for cfg, v in (("x", 1), ("y", 2)):
        spark.createDataFrame([(v, "t")], "k int, text string").write.parquet(str(tmp_path / "part" / cfg / "train"))
    load = MX.table_loader(spark)
    name = str(tmp_path / "part")
    assert load(name, "train", "y").first().k == 2
    out = MX.mix(load, {name: 1.0}, splits=("train",), columns_to_keep=["k"], order_col="k", configs=["x"])["train"]
    assert [r.k for r in out.collect()] == [1]
    with pytest.raises(ValueError, match="configurations"):
        MX.mix(load, {name: 1.0}, splits=("train",), columns_to_keep=["k"], order_col="k", configs=["x", "y"])
    with pytest.raises(ValueError, match="no split"):
        load(name, "test", "x")


def test_manifest_lists_declared_parts(spark, tmp_path):
    import json
    mixed = spark.createDataFrame([("a",), ("a",)], "source string")
    MX.save_manifest(MX.manifest(mixed, "m", datasets=["b", "a"], base_model="base"), str(tmp_path / "manifest"))
    text = [p.read_text() for p in (tmp_path / "manifest").iterdir() if p.name.startswith("part-") and p.stat().st_size]
    assert json.loads(text[0]) == {"datasets": ["a", "b"], "rows": 2, "rows_by_source": '{"a":2,"b":0}', "model_name": "m", "model_type": "sft", "base_model": "base"}


def test_same_file_name_in_two_folders(spark, tmp_path):
    from corpusflow.sources.jsonl import read_jsonl
    for d in ("one", "two"):
        (tmp_path / d).mkdir()
        (tmp_path / d / "a.jsonl").write_text("".join('{"v": "%s%d"}\n' % (d, i) for i in range(4)))
    df = read_jsonl(spark, str(tmp_path) + "/*", "v string", with_position=True)
    assert sorted((r.v, r.line) for r in df.collect()) == sorted((f"{d}{i}", i) for d in ("one", "two") for i in range(4))


def test_scratch_needs_a_shared_folder_off_local(monkeypatch):
    from types import SimpleNamespace
    from corpusflow.session import scratch_root
    fake = SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: None),
                           sparkContext=SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077"))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch_root(fake)


def test_csv_with_line_breaks_is_not_broken_in_silence(spark, tmp_path):
    import csv
    from pyspark.errors import PySparkException
    from corpusflow.sources.jsonl import read_csv_records
    from corpusflow.sources.tables import read_any
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("text is not null").limit(50).collect()]
    flat = [t.replace("\r", " ").replace("\n", " ") for t in texts] + ['say "hi", "", ok', '",', '"', "a,b", ",\"\",", "x" * 100_000 + '"' * 1000]
    bad = ["one\ntwo", 'a "b",\n"c"', '",\n', "a\n\nb"]

    def save(name, rows):
        path = tmp_path / name
        path.mkdir()
        for k in range(2):  # several files
            with open(path / f"part-{k}.csv", "w", newline="", encoding="utf-8") as f:
                w = csv.writer(f, lineterminator="\n")
                w.writerows([("v", "w"), *[(t, i) for i, t in enumerate(rows) if i % 2 == k]])
        return str(path)
    good = save("good.csv", flat)
    assert sorted(r.v for r in read_any(spark, good).collect()) == sorted(flat)
    assert read_csv_records(spark, good).count() == read_any(spark, good).count() == len(flat)
    for n, t in enumerate(bad):
        path = save(f"bad{n}.csv", [*flat, t])
        for act in (lambda: read_any(spark, path).collect(), lambda: read_csv_records(spark, path).count()):
            try:
                act()
            except PySparkException as e:
                assert "multi_line" in str(e)
            else:
                raise AssertionError(t)
        assert sorted(r.v for r in read_any(spark, path, multi_line=True).collect()) == sorted([*flat, t])


def test_mixing_reads_a_part_twice_and_counts_all_parts_at_once(spark, tmp_path, monkeypatch):
    """One job for the key histograms of all parts; the plan reads a part once and has one exchange."""
    from corpusflow.operators import positions
    for n in ("A", "B", "C"):
        spark.range(0, 400, 1, 4).select(F.col("id").alias("k"), F.concat(F.lit(n), "id").alias("text")).write.parquet(str(tmp_path / n))
    jobs = []
    real = MX.key_histograms
    monkeypatch.setattr(MX, "key_histograms", lambda parts, *a, **b: jobs.append(len(parts)) or real(parts, *a, **b))
    load = lambda name, split: spark.read.parquet(str(tmp_path / name))
    out = MX.mix(load, {"A": 40, "B": 400, "C": 7}, splits=("train",), columns_to_keep=["k", "text"], keep_ids=True, order_col="k")["train"]
    plan = out._jdf.queryExecution().sparkPlan().toString() + out._jdf.queryExecution().executedPlan().toString()
    assert jobs == [3] and out._jdf.queryExecution().executedPlan().toString().count("FileScan") == 3
    assert plan.count("Exchange hashpartitioning") == 1 and "rangepartitioning" not in plan
    assert out.count() == 447
    whole = MX.mix(load, {"A": 1.0, "B": 1.0}, splits=("train",), columns_to_keep=["text"], order_col="k")["train"]
    assert "Exchange" not in whole._jdf.queryExecution().executedPlan().toString() and whole.count() == 800
    # many parts share the bound of the histogram table
    monkeypatch.setattr(positions, "HISTOGRAM_ROWS", 16)
    small = MX.mix(load, {"A": 40, "B": 400, "C": 7}, splits=("train",), columns_to_keep=["k", "text"], keep_ids=True, order_col="k")["train"]
    assert sorted(tuple(r) for r in small.collect()) == sorted(tuple(r) for r in out.collect())
