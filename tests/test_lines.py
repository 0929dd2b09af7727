"""Line numbers without an exchange, malformed lines, CSV in one scan, and the recall audit of the dedup."""
import pytest
from pyspark.sql import functions as F

from corpusflow.sources.jsonl import read_jsonl, read_jsonl_rejects
from corpusflow.sources.tables import read_any, read_csv

from conftest import SF0001


def leaves(plan):
    out = plan.collectLeaves()
    return [out.apply(i).nodeName() for i in range(out.size())]


@pytest.fixture()
def folder(spark, tmp_path):
    d = tmp_path / "files"
    d.mkdir()
    (d / "a.jsonl").write_text('{"id": "p1", "n": 1}\n\n{"id": "p2", "n": "x"}\n{"id": "p3", "n": 3\n  \n{"id": "p4"}\nnot json\n')
    (d / "b.jsonl").write_text("".join('{"id": "q%d", "n": %d}\n' % (i, i) for i in range(500)) + '{"id": "q500", "n": 50')
    return str(d)


def test_rejects_have_file_and_line(spark, folder):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1024")   # many splits a file
    try:
        rows, rejects = read_jsonl_rejects(spark, folder, "id string, n int")
        bad = {(r.file_path.rsplit("/", 1)[1], r.line, r.raw[:12]) for r in rejects.collect()}
        assert bad == {("a.jsonl", 2, '{"id": "p2",'), ("a.jsonl", 3, '{"id": "p3",'), ("a.jsonl", 6, "not json"), ("b.jsonl", 500, '{"id": "q500')}
        got = {(r.file_name, r.line): (r.id, r.n, r.file_rank) for r in rows.collect()}
        assert got[("a.jsonl", 0)] == ("p1", 1, 0) and got[("a.jsonl", 5)] == ("p4", None, 0) and len(got) == 502
        assert all(got[("b.jsonl", i)] == (f"q{i}", i, 1) for i in range(500))
        # whatever a reader selects, the same lines are malformed
        assert rows.select("id").count() == 502 and rejects.select("line").count() == 4 and rows.select("line").count() == 502
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_malformed_lines_fail_by_default(spark, folder, tmp_path):
    for read in (lambda: read_jsonl(spark, folder, "id string, n int").collect(), lambda: read_jsonl(spark, folder, "id string, n int").select("id").collect(),
                 lambda: read_any(spark, f"{folder}/a.jsonl", "id string, n int").collect()):
        with pytest.raises(Exception, match="(?i)malformed"):
            read()
    with pytest.raises(Exception, match=r"a.jsonl line 2"):
        read_jsonl(spark, f"{folder}/a.jsonl", "id string, n int", with_position=True, glob=None).collect()


def test_lines_are_numbered_without_an_exchange_of_the_rows(spark, folder):
    rows, _ = read_jsonl_rejects(spark, folder, "id string, n int")
    plan = rows._jdf.queryExecution().sparkPlan().toString()
    executed = rows._jdf.queryExecution().executedPlan().toString()
    wide = [x for x in executed.splitlines() if "Exchange hashpartitioning" in x or "Exchange rangepartitioning" in x or "Exchange SinglePartition" in x]
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and wide
    # every exchange lies below the broadcast of the split table, and none of their inputs has the record text
    after = executed[executed.index("BroadcastExchange"):]
    assert all(x in after for x in wide) and not any("value" in x for x in wide)


def test_persona_files_with_cut_lines(spark, tmp_path):
    from corpusflow.plans.dedup_job import dedup_persona_files
    src = tmp_path / "personas"
    src.mkdir()
    (src / "a.jsonl").write_text('{"id": "p1", "persona": "alpha beta gamma delta"}\n{"id": "p2", "persona": "al\n{"id": "p3", "persona": "other words are here"}\n')
    with pytest.raises(Exception, match="malformed"):
        dedup_persona_files(spark, str(src)).collect()
    kept = dedup_persona_files(spark, str(src), str(tmp_path / "out"), rejects_dir=str(tmp_path / "bad"))
    assert sorted(r.id for r in kept.collect()) == ["p1#0", "p3#2"]
    bad = spark.read.json(str(tmp_path / "bad")).collect()
    assert [(r.line, r.raw) for r in bad] == [(1, '{"id": "p2", "persona": "al')] and bad[0].file_path.endswith("a.jsonl")


def test_csv_is_read_in_one_scan(spark, tmp_path):
    rows = [(1, 'say "hi", ok', 1.5), (2, "", None), (3, "k,label,x", -2.0), (4, "label", 0.0)]
    path = str(tmp_path / "x.csv")
    spark.createDataFrame(rows, "k int, label string, x double").repartition(2).write.option("header", True).option("escape", '"').csv(path)
    df = read_csv(spark, path, "k int, label string, x double")
    assert leaves(df._jdf.queryExecution().executedPlan()) == ["Scan csv "]
    assert sorted((r.k, r.label or "", r.x) for r in df.collect()) == rows
    assert sorted(read_csv(spark, path).columns) == ["k", "label", "x"] and read_csv(spark, path).count() == 4


def brute(rows, k=3, threshold=0.8):
    sets = []
    for o, t in sorted(rows):
        w = (t or "").lower().split()
        sets.append((o, {tuple(w[i:i + k]) for i in range(len(w) - k + 1)}))
    near = set()
    for i, (o, a) in enumerate(sets):
        if any((not a and not b) or (a and b and len(a & b) >= threshold * len(a | b)) for _, b in sets[:i]):
            near.add(o)
    return near


def test_exact_near_rows_equal_brute_force(spark):
    import random

    from corpusflow.operators.similarity import earlier_near
    rng = random.Random(6)
    rows = [(i, t) for i, t in enumerate([None, "", "a b", "a b c", "A b  c", "a b c d", "x y z"])]
    for g in range(15):
        words = [f"g{g}w{i}" for i in range(rng.choice((6, 20, 60)))]
        for _ in range(12):
            out = list(words)
            for _ in range(rng.randrange(5)):
                out[rng.randrange(len(out))] = f"r{rng.randrange(9)}"
            rows.append((len(rows), " ".join(out)))
    rows += [(len(rows) + i, rows[-1][1]) for i in range(30)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "o bigint, t string")
    for threshold in (0.8, 0.6):
        got = [r.o for r in earlier_near(df, "o", "t", threshold, 3).collect()]
        assert len(got) == len(set(got)) and set(got) == brute(rows, 3, threshold)
    assert earlier_near(df.limit(0), "o", "t").count() == 0


def test_recall_audit_stores_prefixes_only(spark, monkeypatch):
    """No intermediate table holds whole shingle sets, and only sets that share much of their prefixes are compared."""
    from corpusflow.operators import similarity
    stored, compared = [], []
    keep, alike = similarity._written, similarity._alike
    monkeypatch.setattr(similarity, "_written", lambda df, purpose: stored.append(keep(df, purpose)) or stored[-1])
    monkeypatch.setattr(similarity, "_alike", lambda pairs, *a: compared.append(pairs.count()) or alike(pairs, *a))
    base = [" ".join(f"d{i}w{j}" for j in range(60)) + " the same last words" for i in range(40)]
    rows = list(enumerate(base + [t + " more" for t in base[:10]] + base[:5]))
    df = spark.createDataFrame(rows, "o bigint, t string")
    assert {r.o for r in similarity.earlier_near(df, "o", "t").collect()} == brute(rows, 3, 0.8) == set(range(40, 55))
    assert all("string" not in kind for t in stored for _, kind in t.dtypes)
    for r in stored[0].collect():
        assert len(r["p"]) <= 0.2 * r["n"] + 2
    assert sum(compared) <= 20


def _files(spark, monkeypatch, tmp_path, name, suffix):
    """(result, records of each intermediate file) of a query of catalog_io whose files hold 50 rows at most."""
    from corpusflow.plans import catalog_io
    monkeypatch.setattr(catalog_io, "FILE_ROWS", 50, raising=False)
    root = str(tmp_path / name)
    monkeypatch.setattr(catalog_io, "new_scratch_dir", lambda spark, purpose: f"{root}/{purpose}")
    got = getattr(catalog_io, name)(spark, SF0001).collect()
    files = [str(f) for f in (tmp_path / name).rglob(f"part-*{suffix}")]
    return got, files


def test_jsonl_rejects_files_are_bounded(spark, monkeypatch, tmp_path):
    got, files = _files(spark, monkeypatch, tmp_path, "jsonl_rejects", ".txt")
    sizes = [sum(1 for _ in open(f)) for f in files]
    assert max(sizes) <= 50 and sum(sizes) == len(got)     # one file per language before
    docs = {r["doc_id"]: r["lang"] or "" for r in spark.read.parquet(f"{SF0001}/documents.parquet").collect()}
    for lang in set(docs.values()):
        ids = sorted(i for i, x in docs.items() if x == lang)
        assert sorted((r["doc_id"], r["line"]) for r in got if docs[r["doc_id"]] == lang) == [(i, n) for n, i in enumerate(ids)]


def test_csv_to_json_records_files_are_bounded(spark, monkeypatch, tmp_path):
    got, files = _files(spark, monkeypatch, tmp_path, "csv_to_json_records", ".csv")
    sizes = [spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(f).count() for f in files]
    assert max(sizes) <= 50 and sum(sizes) == len(got) == 200     # three files, whatever the rows, before


def test_lines_through_a_folder(spark, tmp_path):
    for name, lines in (("a/x.jsonl", 3), ("a/y.jsonl", 2), ("b/x.jsonl", 2)):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("".join('{"id": "%s%d"}\n' % (name, i) for i in range(lines)) + "{cut\n")
    rows, rejects = read_jsonl_rejects(spark, str(tmp_path / "*"), "id string", per="folder")
    assert sorted((r["id"], r["line"]) for r in rows.collect()) == [
        ("a/x.jsonl0", 0), ("a/x.jsonl1", 1), ("a/x.jsonl2", 2), ("a/y.jsonl0", 4), ("a/y.jsonl1", 5), ("b/x.jsonl0", 0), ("b/x.jsonl1", 1)]
    assert sorted(r["line"] for r in rejects.collect()) == [2, 3, 6]
    with pytest.raises(ValueError):
        read_jsonl_rejects(spark, str(tmp_path), "id string", per="task")
