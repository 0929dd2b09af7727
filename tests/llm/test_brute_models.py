"""Language identification and the toxicity chain against plain recomputations."""
import math
import re
import struct
import zlib

import numpy as np
import xxhash
import zstandard
from pyspark.sql import functions as F

from corpusflow.llm import lang_id, toxicity
from corpusflow.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def fold(i):
    return zlib.crc32(str(i).encode()) % 3


def test_languages_equal_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").collect()]

    def words(t):
        return " ".join(re.findall(r"[^\W\d_]+", t.lower())).encode()

    def key(i):
        h = xxhash.xxh64_intdigest(struct.pack("<q", i), seed=xxhash.xxh64_intdigest(b"dictionary", seed=42))
        return h - (1 << 64) if h >> 63 else h
    known = {}
    for i, t, lang in sorted(rows, key=lambda r: key(r[0])):
        if fold(i) != 1 and lang is not None and t and any(map(str.isalpha, t)) and len(known.setdefault(lang, [])) < 96:
            known[lang].append((key(i), t))
    contents = {}
    for lang, own in known.items():
        for h, t in own:
            data = words(t)
            at = h % max(1, len(data) - 1024 + 1)
            contents[lang] = contents.get(lang, b"") + b" " + data[at:at + 1024]
    want = {}
    for i, t, _ in rows:
        if not t or not any(map(str.isalpha, t)):
            want[i] = "und"
            continue
        data, sizes = words(t), {}
        for lang in sorted(contents):
            d = zstandard.ZstdCompressionDict(contents[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            coder = zstandard.ZstdCompressor(level=5, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)
            sizes[lang] = sum(len(coder.compress(data[a:a + 2048])) for a in range(0, len(data), 2048))
        want[i] = min(sizes, key=lambda x: (sizes[x], x))
    got = {r.doc_id: r for r in QUERIES["op7_language_id"](spark, SF).collect()}
    # Prepared dictionaries choose their tables themselves, so a few close texts may fall to the other side.
    differ = [i for i in want if got[i].lang_pred != want[i]]
    assert len(got) == len(rows) and len(differ) <= 0.01 * len(rows) and all(not got[i].accepted for i in differ)
    assert all(got[i].held_out == (fold(i) == 1) and 0 <= got[i].score <= 1 for i in got)


def test_chain_equals_brute_force():
    """Every category's weights are the ridge optimum over the features and the out-of-fold chances of the earlier ones."""
    rng = np.random.default_rng(3)
    k, n = 5, 160
    found = [set(np.flatnonzero(rng.random(k) < 0.4).tolist()) for _ in range(n)]
    folds = rng.integers(0, 4, n)
    insult = np.array([float(0 in f or rng.random() < 0.1) for f in found])
    toxic = np.array([float((a and rng.random() < 0.9) or (2 in f and 3 in f)) for a, f in zip(insult, found)])
    labels = {"insult": insult, "toxic": toxic}
    chain = toxicity.fit_chain(found, {str(i): i for i in range(k)}, labels, folds)

    def chance(w, x):
        return 1 / (1 + math.exp(-sum(a * b for a, b in zip(w, x))))

    def slope(w, rows, y):
        """Gradient of the ridge loss, row by row; the constant is not shrunk."""
        g = [toxicity.RIDGE * v for v in w[:-1]] + [0.0]
        for x, t in zip(rows, y):
            p = chance(w, x)
            for j, v in enumerate(x):
                g[j] += (p - t) * v
        return max(map(abs, g))
    earlier = [[] for _ in range(n)]
    for name, y in labels.items():
        rows = [[float(j in f) for j in range(k)] + e + [1.0] for f, e in zip(found, earlier)]
        assert slope(chain.weights[name].tolist(), rows, y) < 1e-2
        out = np.zeros(n)
        for c in range(4):
            w = toxicity.logistic(np.array([r for r, f in zip(rows, folds) if f != c]), np.array([t for t, f in zip(y, folds) if f != c]))
            assert slope(w.tolist(), [r for r, f in zip(rows, folds) if f != c], [t for t, f in zip(y, folds) if f != c]) < 1e-2
            for i in np.flatnonzero(folds == c):
                out[i] = chance(w.tolist(), rows[i])
        earlier = [e + [float(p)] for e, p in zip(earlier, out)]
    # prediction feeds the chances of earlier categories on
    got = chain.probabilities(found)
    for f, p in zip(found, got):
        x = [float(j in f) for j in range(k)]
        first = chance(chain.weights["insult"].tolist(), [*x, 1.0])
        assert abs(p[0] - first) < 1e-9 and abs(p[1] - chance(chain.weights["toxic"].tolist(), [*x, first, 1.0])) < 1e-9


def test_toxicity_query_scores_like_its_chain(spark):
    """Scores of the query against a chain refitted here and applied row by row in plain Python."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "toxic")
    chain = toxicity.fit(docs, labels, {"toxic": F.col("toxic")}, "toxic")
    assert len(chain.words) <= toxicity.WORDS
    got = {r.doc_id: r.p_toxic for r in toxicity.score(docs, chain).collect()}
    w = chain.weights["toxic"]
    for r in docs.collect():
        z = sum(w[chain.words[f]] for f in toxicity.features(r.text) if f in chain.words) + w[-1]
        assert abs(got[r.doc_id] - 1 / (1 + math.exp(-max(-40, min(40, z))))) < 1e-9
    assert len(QUERIES["op8_toxicity_chain"](spark, SF).collect()) == docs.count()
