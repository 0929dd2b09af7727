"""Exact and near deduplication against brute force, with the edge rows of every operator."""
import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusflow.llm import exact_dedup, near_dedup
from corpusflow.llm.words import word_hashes

# Extra columns carry names that the operators use inside.
SCHEMA = "doc_id bigint, text string, lang string, digest string, _id bigint, set_key string, _text string, rep int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "en", "d", 7, "k", "t", 1) for r in rows], SCHEMA)


def edge_rows():
    long_ = " ".join(f"w{i % 997}x{i % 13}" for i in range(60_000))
    return [(1, None), (2, ""), (3, " \n "), (4, "one"), (5, "one"), (5, "one"), (6, "One  two"), (7, "one\ttwo"),
            (8, long_), (9, long_ + " end"), (None, "one"), (None, None), (10, "é ß 汉字"), (11, "é ß 汉字")]


def test_assign_edges(spark):
    got = defaultdict(list)
    for r in exact_dedup.assign(frame(spark, edge_rows())).collect():
        got[r.doc_id].append(r)
    assert sum(map(len, got.values())) == len(edge_rows())
    assert [got[1][0].keep_id, got[1][0].group_size, got[2][0].kept] == [2, 3, True]
    assert got[4][0].keep_id == 5 and got[4][0].group_size == 4
    assert sorted(r.kept for r in got[5]) == [False, True] and not any(r.kept for r in got[None])
    assert got[3][0].kept and got[6][0].text_sha256 == hashlib.sha256(b"One  two").hexdigest()
    assert exact_dedup.assign(frame(spark, [])).count() == 0


def test_dedup_keeps_one_row_with_its_columns(spark):
    docs = frame(spark, edge_rows())
    got = exact_dedup.dedup(docs, salts=4)
    assert got.columns == docs.columns
    rows = {r.text: r for r in got.collect()}
    assert len(rows) == len(got.collect()) == 8 and rows["one"].doc_id == 5 and rows["é ß 汉字"].doc_id == 11
    assert exact_dedup.dedup(docs.limit(0)).count() == 0


def test_digests_never_merge_texts(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup.F, "sha2", lambda c, n: F.lit("00"))
    docs = frame(spark, [(i, f"t{i % 5}") for i in range(40)])
    got = {r.text: r.group_size for r in exact_dedup.combine(docs, salts=3).collect()}
    assert got == {f"t{i}": 8 for i in range(5)}
    with pytest.raises(Exception, match="share one SHA-256"):
        exact_dedup.assign(docs, salts=3).collect()
    with pytest.raises(Exception, match="share one SHA-256"):
        exact_dedup.assign(docs, salts=3).select("doc_id", "keep_id").collect()


def brute(rows, k, percent=80):
    sets = {}
    for d, t in rows:
        w = (t or "").encode().lower().split()
        sets[d] = {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    up = {d: d for d in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x
    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            n = len(sets[a] & sets[b])
            if n and 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d), find(d) == d) for d in sets}


def edited(rng, words, n):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"x{rng.randrange(10**6)}"
    return " ".join(out)


@pytest.mark.parametrize("block", [near_dedup.BLOCK, 20_000])
def test_near_groups_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    rng = random.Random(4)
    rows = [(i, t) for i, t in enumerate([None, "", "  \n", "a", "A", "b", "a b", "a B", "a b c", "c a b"])]
    for g in range(12):  # groups whose pairs lie on both sides of the threshold, and chains
        words = [f"g{g}w{i}" for i in range(rng.choice((4, 12, 60, 200)))]
        for _ in range(14):
            rows.append((len(rows), edited(rng, words, rng.randrange(max(1, len(words) // 10) + 1))))
    words = [f"hot{i}" for i in range(80)]
    for _ in range(700):  # a hot group: one block or several, most pairs just below the threshold
        rows.append((len(rows), edited(rng, words, 5)))
    rows += [(len(rows) + i, rows[-1][1].upper()) for i in range(20)]
    want = brute(rows, 2)
    got = near_dedup.groups(frame(spark, rows), k=2).collect()
    bad = [(r, want[r.doc_id]) for r in got if (r.n_shingles, r.component_id, r.kept) != want[r.doc_id]]
    assert len(got) == len(rows) and not bad, bad[:5]


def test_near_links_of_rows_that_share_an_id(spark):
    rng = random.Random(7)
    one, two = [f"a{i}" for i in range(60)], [f"b{i}" for i in range(60)]
    rows = [(9, " ".join(one)), (9, " ".join(two)), (2, edited(rng, one, 1)), (3, edited(rng, two, 1)), (4, edited(rng, two, 1)), (5, "c d e f")]
    got = sorted((r.doc_id, r.component_id, r.kept) for r in near_dedup.groups(frame(spark, rows), k=2).collect())
    assert got == [(2, 2, True), (3, 3, True), (4, 3, False), (5, 5, True), (9, 2, False), (9, 3, False)]


def test_near_edges(spark):
    got = defaultdict(list)
    for r in near_dedup.groups(frame(spark, edge_rows())).collect():
        got[r.doc_id].append((r.n_shingles, r.component_id, r.kept))
    assert got[1] == [(0, 1, True)] and got[2] == [(0, 2, True)] and got[3] == [(0, 3, True)]
    assert got[4] == [(1, 4, True)] and got[5] == [(1, 4, False)] * 2 and got[7] == [(1, 6, False)]
    assert got[9][0][1:] == (8, False) and got[None] == [(1, None, True), (0, None, True)] or len(got[None]) == 2
    docs = frame(spark, edge_rows())
    kept = near_dedup.dedup(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id) == [1, 2, 3, 4, 6, 8, 10]
    assert near_dedup.groups(frame(spark, [])).count() == 0


def test_sketch_fills_every_coordinate_and_estimates():
    rng = np.random.default_rng(2)
    for n in (1, 2, 7, 40, 700, 6000):
        x = np.unique(rng.integers(0, 2**63, 2 * n).astype(np.uint64))
        a, b = x[:len(x) * 3 // 4], x[len(x) // 4:]
        s = near_dedup.sketches([a, np.empty(0, np.uint64), b], 240)
        assert s[0].max() < 1 << 44 and (s[1] == 2**64 - 1).all()
        true = len(np.intersect1d(a, b)) / len(x)
        assert abs((s[0] == s[2]).mean() - true) < 5 * max(0.01, (true * (1 - true) / 240) ** 0.5)


def test_word_hashes():
    starts, lengths, h = word_hashes(b" ab\tcd\n\nab \x0bx")
    assert starts.tolist() == [1, 4, 8, 12] and lengths.tolist() == [2, 2, 2, 1]
    assert h[0] == h[2] and len(set(h.tolist())) == 3
    text = (b"aa bb  cc " * 500_000)
    near = near_dedup.shingle_sets([text, None, text[:-1]], 3)
    assert [len(x) for x in near] == [3, 0, 3]
