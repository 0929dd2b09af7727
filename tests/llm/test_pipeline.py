"""The corpus pipeline against a brute-force version of its stages, and the entry point without the subpackage."""
import subprocess
import sys
from pathlib import Path

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from corpusflow.llm import decontaminate, quality

ROOT = Path(__file__).resolve().parents[2]
SF = "/root/testdata/sf0.001"


def shingles(text, k=5):
    w = text.encode().lower().split()
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def test_pipeline_equals_brute_force(spark):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.fit(quality.describe(spark.read.parquet(f"{SF}/documents.parquet")), labels, "quality")
    ids = sorted(docs)
    scores = model.score(quality.statistics([docs[i].encode() for i in ids]).astype(np.float64))
    left = {i: docs[i] for i, s in zip(ids, scores) if s >= 0.5}
    best = {}
    for i, t in left.items():
        best[t] = max(i, best.get(t, i))
    left = {i: t for t, i in best.items()}
    sets, up = {i: shingles(t) for i, t in left.items()}, {i: i for i in left}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x
    order = sorted(left)
    for n, a in enumerate(order):
        for b in order[:n]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    left = {i: t for i, t in left.items() if find(i) == i}
    bench = [decontaminate.normal(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    left = {i: t for i, t in left.items() if not any(b in decontaminate.normal(t) for b in bench)}
    got = corpus_pipeline.run(spark, SF).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert {r.doc_id: r.n for r in got} == {i: len(t.encode().split()) + 1 for i, t in left.items()}


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(30)
    extra = docs.withColumn("_id", F.lit(1)).withColumn("rep", F.lit("x"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "near_dedup", "decontaminate", "packing"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, extra, SF)
        assert out.columns == extra.columns, name
    empty = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0, name


def test_entry_without_the_subpackage(tmp_path):
    code = ("import sys; sys.modules['corpusflow.llm'] = None; import importlib.util as u; "
            f"sys.path.insert(0, {str(ROOT)!r}); import __spark_entry__ as e; q = e.queries(); "
            "assert 'lsh_dedup' in q and 'pipeline' not in q and not any(k.startswith('op') for k in q), list(q)")
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True).returncode == 0


def test_every_operator_is_registered():
    sys.path.insert(0, str(ROOT))
    import __spark_entry__ as e
    names = list(e.queries())
    assert [sum(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)] == [1] * 10 and "pipeline" in names
    assert {"op1_chat_format", "op4_exact_dedup"} <= set(e.oracle_sql())
