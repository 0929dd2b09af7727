"""SimHash groups against brute force."""
import random

import numpy as np
import pytest
import xxhash

from corpusflow.llm import simhash

from test_exact_near import edge_rows, edited, frame


def plain(text, k=3):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    parts = [b" ".join(words[i:i + k]) for i in range(max(1, len(words) - k + 1))]
    h = [xxhash.xxh64_intdigest(p, seed=42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(pairs, nodes):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x
    for a, b in pairs:
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def brute(rows):
    marks = [(d, plain(t)) for d, t in rows if d is not None]
    pairs = [(d, e) for i, (d, x) in enumerate(marks) for e, y in marks[:i] if (x ^ y).bit_count() <= 2]
    root = components(pairs, {d for d, _ in marks})
    return {(d, f"{x:016x}", root[d]) for d, x in marks}


def noisy(rng, n):
    """Random fingerprints, chains and dense balls."""
    out = {rng.getrandbits(64) for _ in range(n)}
    for c in list(out)[:20]:
        x = c
        for _ in range(30):
            x ^= 1 << rng.randrange(64)
            out.add(x)
        out |= {c ^ (1 << rng.randrange(16)) ^ (1 << rng.randrange(16)) ^ (1 << rng.randrange(16)) for _ in range(300)}
    return np.array(sorted(out), np.uint64)


def test_fingerprint_equals_the_definition(monkeypatch):
    rng = random.Random(1)
    texts = [None, "", " \n", "One", "a B", "a\tb  c", "É é a", "  x 　 y", " ".join(rng.choices("abcdef", k=5000))]
    for step in (1 << 15, 7):
        monkeypatch.setattr(simhash, "STEP", step)
        assert [simhash.fingerprint((t or "").encode()) for t in texts] == [plain(t) for t in texts]


@pytest.mark.parametrize("block", [256, 16])
def test_shards_find_every_link(monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    points = noisy(random.Random(3), 1500)
    pairs = [(int(points[i]), int(points[j])) for i in range(len(points))
             for j in np.flatnonzero(simhash.distance(points[:i], points[i]) <= 2)]
    want = components(pairs, points.tolist())
    a, b = simhash.shard_edges(points)
    assert len(a) < len(points) and components(zip(map(int, a), map(int, b)), points.tolist()) == want
    tree = simhash.fit_tree(points[::5], 12)
    at, leaf = simhash.leaves_of(tree, points)
    assert len(set(leaf.tolist())) > 6 and set(at.tolist()) == set(range(len(points)))
    found = [p for x in set(leaf.tolist()) for p in zip(*(e.tolist() for e in simhash.shard_edges(points[np.sort(at[leaf == x])])))]
    assert components(found, points.tolist()) == want


def test_points_that_no_cut_divides(monkeypatch):
    """All pairs at one distance: the search falls back to comparing every point, and misses nothing."""
    monkeypatch.setattr(simhash, "BLOCK", 4)
    points = np.array([1 << i for i in range(40)], np.uint64)
    a, _ = simhash.shard_edges(points)
    assert len(a) == 39
    far = np.array([0xFFFF << 4 * i for i in range(0, 12, 4)] + [0], np.uint64)
    assert len(simhash.shard_edges(far)[0]) == 0
    assert len(simhash.shard_edges(np.empty(0, np.uint64))[0]) == 0


@pytest.mark.parametrize("shard", [simhash.SHARD, 40])
def test_groups_equal_brute_force(spark, monkeypatch, shard):
    monkeypatch.setattr(simhash, "SHARD", shard)
    rng = random.Random(5)
    rows = [(i, t) for i, t in enumerate([None, "", "  \n", "a", "A", "b", "a b", "a B c", "c a b"])]
    for g in range(8):
        words = [f"g{g}w{i}" for i in range(400)]
        rows += [(len(rows) + i, edited(rng, words, rng.randrange(4))) for i in range(20)]
    rows += [(1000 - i, rows[-1][1].upper()) for i in range(60)]
    got = simhash.groups(frame(spark, rows)).collect()
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in got} == brute(rows) and len(got) == len(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_edges(spark):
    got = simhash.groups(frame(spark, edge_rows())).collect()
    assert len(got) == len(edge_rows())
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in got if r.doc_id is not None} == brute(edge_rows())
    assert all(r.component_id is None for r in got if r.doc_id is None)
    docs = frame(spark, edge_rows())
    kept = simhash.dedup(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect() if r.doc_id) == [1, 4, 6, 8, 10]
    assert simhash.groups(frame(spark, [])).count() == 0


def test_the_query(spark):
    from corpusflow.llm.queries import QUERIES
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = QUERIES["op11_simhash_near_dedup"](spark, sf).collect()
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in got} == brute(rows) and len(got) == len(rows)
