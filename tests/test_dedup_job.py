import random
import time

import pytest
from pyspark.sql import functions as F

from corpusflow.operators.enrich import enrich, mock_client
from corpusflow.operators.prompts import two_role
from corpusflow.plans.dedup_job import dedup_persona_files


def test_persona_files_rules(spark, tmp_path):
    src = tmp_path / "personas"
    src.mkdir()
    (src / "a.jsonl").write_text("\n".join([
        '{"id": "p1", "persona": "alpha beta gamma delta epsilon"}',
        '{"id": "p2", "persona": ""}',
        '{"id": "p3", "persona": {"persona": ""}}',
        '{"id": "p4", "persona": {"persona": 7}}',
        '{"id": "p5", "persona": ["x"]}']) + "\n")
    (src / "b.jsonl").write_text("\n".join([
        '{"id": "p6", "persona": {"persona": "Alpha  beta gamma delta epsilon", "countries": ["c"]}}',
        '{"id": "p7", "persona": "tiny"}',
        '{"id": "p8", "persona": "zeta eta theta iota kappa"}']) + "\n")
    (src / "notes.txt").write_text("not a persona file\n")
    out = tmp_path / "out"
    kept = dedup_persona_files(spark, str(src), str(out))
    assert sorted(r.id for r in kept.collect()) == ["p1#0", "p3#2", "p8#2"]
    back = spark.read.schema("id string, shingles array<string>").json(str(out))
    sh = {r.id: r.shingles for r in back.collect()}
    assert sh["p1#0"] == ["alpha beta gamma", "beta gamma delta", "gamma delta epsilon"] and sh["p3#2"] == []


def test_rate_limit_spaces_calls():
    from corpusflow.operators.enrich import RateLimiter
    lim = RateLimiter(0.2)
    t0 = time.monotonic()
    for _ in range(4):
        lim.wait()
    assert time.monotonic() - t0 >= 0.6
    free = RateLimiter(0.0)
    t0 = time.monotonic()
    for _ in range(100):
        free.wait()
    assert time.monotonic() - t0 < 0.1


def _bytes(path, suffix=""):
    return sum(p.stat().st_size for p in path.rglob(f"part-*{suffix}"))


def test_persona_files_take_a_few_times_the_input(spark, tmp_path, monkeypatch):
    """Input files, staged rows and output (texts and shingle lists) of persona_dedup_files together, against the table's bytes."""
    from corpusflow import session
    from corpusflow.plans import catalog_io as C
    rnd = random.Random(5)
    vocabulary = ["".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=rnd.randint(2, 9))) for _ in range(3000)]
    rows = [(i, " ".join(rnd.choices(vocabulary, k=300)), "en") for i in range(400)]
    rows += [(400 + i, rows[i][1], "fr") for i in range(20)] + [(420, None, "de"), (421, "", "de")]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    folder = lambda spark, purpose: str(tmp_path / "work" / purpose)
    monkeypatch.setattr(C, "new_scratch_dir", folder)
    monkeypatch.setattr(session, "new_scratch_dir", folder)
    before = {k: spark.conf.get(k, None) for k in session.FREED_SHUFFLES}
    kept = C.persona_dedup_files(spark, str(tmp_path)).collect()
    assert {r.doc_id: r.lang for r in kept if r.doc_id < 420} == {i: "en" for i in range(400)}
    out = spark.read.json(str(tmp_path / "work/persona-dedup")).where("id like '7#%'").first()
    assert len(out.shingles) == 298 and out.shingles[0] == " ".join(rows[7][1].split()[:3])
    assert _bytes(tmp_path / "work") < 4 * _bytes(tmp_path / "documents.parquet")
    assert {k: spark.conf.get(k, None) for k in session.FREED_SHUFFLES} == before


@pytest.mark.parametrize("most", [1 << 20, 2])
def test_kept_rows_by_bit_set(spark, tmp_path, monkeypatch, most):
    """Rows kept by a bit set equal those of the semi join; up to the bound the rows are not exchanged."""
    from corpusflow.operators import dedup as D
    monkeypatch.setattr(D, "MOST_WORDS", most)
    values = [*range(-70, 200), (5 << 32) + 63, (5 << 32) + 64, (1 << 62) + 1, -(1 << 62)]
    spark.createDataFrame([(v, f"text {v}") for v in values], "o bigint, t string").write.parquet(str(tmp_path / "rows"))
    df = spark.read.parquet(str(tmp_path / "rows"))
    kept = df.where("o % 3 = 0 or o in (63, 64, -64, -65) or abs(o) > 1000").select("o")
    got = D.with_kept(df, kept, "o", str(tmp_path / "words"))
    assert sorted(r.o for r in got.collect()) == sorted(r.o for r in D.with_kept(df, kept, "o").collect())
    assert spark.read.parquet(str(tmp_path / "words")).count() == 10
    if most > 2:
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan
