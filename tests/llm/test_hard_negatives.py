"""Hard negatives against brute force."""
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusflow.llm import hard_negatives as H

SCHEMA = "vec_id bigint, embedding array<double>, label int, id int, v string, number int, rank int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2, 3) for r in rows], SCHEMA)


def mined(spark, rows, every=10):
    vec = H.vectors(frame(spark, rows), "vec_id", F.col("label"), "embedding")
    got = H.mine(vec, vec.where(F.col("id") % every == 0)).collect()
    return sorted((r.anchor_id, r.positive_id, r.rank, r.negative_id, r.positive_score, r.negative_score) for r in got)


def brute(rows, every=10):
    own = []
    for i, x, label in rows:
        if i is None or x is None or label is None or any(c is None or not math.isfinite(c) for c in x):
            continue
        own.append((i, label, [math.floor(256 * c) for c in x]))
    out = []
    for a, la, q in own:
        if a % every:
            continue
        scored = [(-sum(x * y for x, y in zip(q, v)), i, label) for i, label, v in own if i != a]
        for p, pid, _ in sorted(x for x in scored if x[2] == la)[:5]:
            inside = sorted(x for x in scored if x[2] != la and -30 * p <= -100 * x[0] <= -90 * p)[:10]
            out += [(a, pid, r, nid, -p, -s) for r, (s, nid, _) in enumerate(inside, 1)]
    return sorted(out)


def made_up(seed, n, width, spread=0.3):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(width)] for _ in range(4)]
    out = [(i, [spread * rng.gauss(0, 1) + c for c in centres[rng.randrange(4)]], rng.randrange(4)) for i in range(n)]
    return out


@pytest.mark.parametrize("block,chunk,width", [(H.BLOCK, H.CHUNK, 20), (64, 7, 40), (33, 3, 3)])
def test_mine_equals_brute_force(spark, monkeypatch, block, chunk, width):
    monkeypatch.setattr(H, "CHUNK", chunk)
    rows = made_up(block, 400, width)
    rows += [(1000 + i, rows[3][1], 1) for i in range(150)] + [(2000 + i, rows[3][1], 2) for i in range(60)]  # one vector, many rows
    assert mined(spark, rows) == brute(rows)
    small = made_up(9, 25, 2)
    assert mined(spark, small, 5) == brute(small, 5)


def test_blocks_and_bounds(monkeypatch):
    """Searches over small blocks in this process: running bounds, ties and every window equal a full sort."""
    rng = np.random.default_rng(3)
    for step in (1, 5, 16):
        monkeypatch.setattr(H, "STEP", step)
        x = rng.integers(-3, 4, (300, 18))
        x[100:180] = x[7]
        labels, ids = rng.integers(0, 3, 300), rng.permutation(300)
        windows = [(-np.inf, np.inf), (5, 40), (40, 40), (0, 0), (10_000, 20_000)]
        a = {"number": np.arange(4), "id": ids[:4], "label": labels[:4], "v": x[:4], "windows": [windows] * 4}
        for same in (True, False):
            s = H.Search(a, 6, same)
            for at in range(0, 300, 37):
                s.add(H.Block(ids[at:at + 37], labels[at:at + 37], x[at:at + 37]))
            for i in range(4):
                score = x @ x[i]
                fit = (labels == labels[i]) == same
                fit &= ids != ids[i]
                for j, (lo, hi) in enumerate(windows):
                    want = sorted((-int(score[r]), int(ids[r])) for r in np.flatnonzero(fit & (score >= lo) & (score <= hi)))[:6]
                    assert [(-int(p), int(q)) for p, q in zip(*s.best[i][j])] == want


def test_candidates_shrink_before_the_last_dimension():
    rng = np.random.default_rng(1)
    x = rng.integers(-9, 10, (4000, 64))
    x[:, 0] += np.arange(4000) % 200
    q = np.r_[300, rng.integers(-3, 4, 63)]
    reads = []

    class Counted(np.ndarray):
        def __getitem__(self, at):
            out = super().__getitem__(at)
            if isinstance(at, np.ndarray) and at.dtype.kind == "i":
                reads.append(out.shape)
            return out
    block = H.Block(np.arange(4000), np.zeros(4000, np.int64), x)
    block.x = block.x.astype(float).view(Counted)
    at, score = H.scan(q.astype(float), block, slice(0, 4000), np.ones(4000, bool), [(-np.inf, np.inf, -np.inf)], 5)
    assert [n for _, n in reads][-1] < 200 and set(np.argsort(-(x @ q), kind="stable")[:5]) <= set(block.ids[at].tolist())
    assert np.array_equal(score, (x @ q)[block.ids[at]])


def test_edges(spark):
    rows = [(0, [1.0, 1.0], 1), (10, [0.5, -0.5], 1), (20, [0.0, 0.0], 1), (1, [1.0, 0.9], 1), (1, [1.0, 0.8], 1), (2, [0.4, 0.5], 2), (2, [0.4, 0.5], 2),
            (3, None, 2), (4, [None, 1.0], 2), (5, [float("nan"), 1.0], 2), (6, [float("inf"), 0.1], 2), (7, [0.5, 0.4], None), (None, [0.5, 0.5], 2),
            (8, [0.6], 2), (9, [], 2), (11, [0.3, 0.3, 9.0], 3), (0, [0.9, 1.0], 1), (30, [-1.0, -1.0], 5)]
    got = mined(spark, rows)
    assert got == brute(rows) and any(r[3] == 8 for r in got) and sum(r[:2] == (0, 1) for r in got) > 4
    assert mined(spark, []) == [] and mined(spark, [(0, [1.0], 1)]) == []
    with pytest.raises(Exception, match="too large"):
        mined(spark, [(0, [1e200], 1), (1, [1.0], 1)])
    assert H.score_type(64, 300) is np.float64 and H.score_type(64, 1 << 28) is np.int64
    with pytest.raises(ValueError):
        H.score_type(1 << 20, 1 << 31)
