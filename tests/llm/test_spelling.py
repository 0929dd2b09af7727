"""Spelling variants against brute force."""
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from corpusflow.llm import spelling

from test_exact_near import edge_rows, frame


def plain_vocabulary(rows, every=199):
    n = Counter()
    for d, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if every and h % every == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= 6:
                n[run] += 1
    return {w: c for w, c in n.items() if c >= 5}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(n):
    # Words that share a deletion (or are one another's) are the only ones that can be near.
    at = {}
    for w in n:
        for x in {w, *(w[:i] + w[i + 1:] for i in range(len(w)))}:
            at.setdefault(x, set()).add(w)
    near = {w: set() for w in n}
    for own in at.values():
        for a in own:
            near[a] |= {b for b in own if b != a and one_edit(a, b)}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= 5 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near[w]), n.get(form[w])))
    return out


def rows_of(df):
    return [(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()]


def made_up(seed):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdeèÿ", k=rng.randrange(6, 9))) for _ in range(30)]
    words += ["x" * n for n in (5, 6, 7, 8)] + ["é" * 6, "×" * 6 + "÷", "k" * 300, "k" * 299 + "m", "k" * 301, "abc" * 400]
    out = []
    for w in words:
        c = rng.choice((1, 2, 8, 40))
        for _ in range(c * rng.choice((1, 5))):
            out.append(w)
        for _ in range(6):
            i = rng.randrange(len(w))
            v = rng.choice((w[:i] + w[i + 1:], w[:i] + rng.choice("abzéÀ") + w[i + 1:], w[:i] + rng.choice("abzéÀ") + w[i:]))
            out += [v] * rng.choice((1, 5, 6, 30))
    out += ["chainaaa"] * 7 + ["chainaab"] * 50 + ["chainabb"] * 350 + ["chainbbb"] * 2500  # forms of forms
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("small", [False, True])
def test_variants_equal_brute_force(spark, monkeypatch, small):
    if small:  # many filter parts and passes, probes in small steps; the functions that hold the sizes run in this process
        monkeypatch.setattr(spelling, "SHARD", 128)
        monkeypatch.setattr(spelling, "BROADCAST", 1024)
    words = made_up(2)
    rows = [(i, " ".join(words[i::40])) for i in range(40)] + [(None, "aaaaaa " * 900), (None, None), (7, ""), (7, "AAAAAA," * 9 + "ÀÀÀÀÀÀ-àààààà")]
    n = plain_vocabulary(rows)
    got = rows_of(spelling.variants(spelling.vocabulary(frame(spark, rows), drop_every=199)))
    assert len(got) == len(n) > 60 and set(got) == brute(n)
    assert ("chainaaa", "chainaab", "chainbbb") in {r[:3] for r in got}


def test_edges(spark):
    assert spelling.variants(spelling.vocabulary(frame(spark, []))).count() == 0
    n = plain_vocabulary(edge_rows() * 5, 0)
    assert set(rows_of(spelling.variants(spelling.vocabulary(frame(spark, edge_rows() * 5))))) == brute(n)


def test_filters_have_no_false_negatives_and_few_positives(spark, monkeypatch):
    rng = random.Random(4)
    words = sorted({"".join(rng.choices("abcdefghij", k=rng.randrange(6, 10))) for _ in range(4000)})
    vocab = spark.createDataFrame([(w, 5) for w in words], "word string, n bigint").cache()
    for shard, whole in ((spelling.SHARD, spelling.BROADCAST), (256, 2048)):
        monkeypatch.setattr(spelling, "SHARD", shard)
        monkeypatch.setattr(spelling, "BROADCAST", whole)
        found, wrong, most = set(), 0, 0
        for f in spelling.passes(vocab):
            most = max(most, sum(x.nbytes for x in f.held.values()))
            for n, at, letters in spelling.by_length(words):
                found |= {words[at[i]] for i in f.seen(n, spelling.hashes(letters))}
                other = np.random.default_rng(n).integers(30, 60, letters.shape)
                wrong += len(f.seen(n, spelling.hashes(other)))
        assert found == set(words) and wrong < 0.02 * len(words) and most <= whole


def test_an_edit_hashes_like_its_text(monkeypatch):
    class All:
        def seen(self, cls, h):
            asked.append((cls, h))
            return np.arange(len(h))
    words = ["aabbcc", "zzzzzzz", "éaéaéa", "a" * 70]
    for probes in (spelling.PROBES, 500):
        monkeypatch.setattr(spelling, "PROBES", probes)
        asked, got = [], []
        for index, edits in spelling.probe(words, All(), 6):
            got += [(words[i], e) for i, e in zip(index, edits)]
            by_text = {e: int(spelling.hashes(spelling.ranks([e]))[0]) for e in edits}
            assert [by_text[e] for e in edits] == asked[-1][1].tolist()
        want = {(w, w[:i] + w[i + 1:]) for w in words for i in range(len(w)) if len(w) > 6}
        want |= {(w, w[:i] + chr(c) + w[i + 1:]) for w in words for i in range(len(w)) for c in spelling.LETTERS if chr(c) > w[i]}
        assert len(got) == len(set(got)) and set(got) == want


def test_the_query(spark):
    from corpusflow.llm.queries import QUERIES
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = rows_of(QUERIES["op12_spelling_variants"](spark, sf))
    assert len(got) == len(set(got)) and set(got) == brute(plain_vocabulary(rows))
