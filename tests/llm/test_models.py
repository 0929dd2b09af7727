"""Quality, language, toxicity and personal data: held-out accuracy, brute force, edge rows."""
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusflow.llm import lang_id, pii, quality, toxicity
from corpusflow.llm.common import fold

from test_exact_near import edge_rows, frame

SF = "/root/testdata/sf0.01"


def load(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


def test_fold_is_crc32(spark):
    got = spark.range(200).select("id", fold("id").alias("f")).collect()
    assert all(r.f == zlib.crc32(str(r.id).encode()) % 3 for r in got)


def test_statistics():
    x = quality.statistics([b"", None, b"Ab, cd cd!! 12\n|x", b"a" * 3_000_000])
    assert x.shape == (4, quality.STATISTICS) and np.isfinite(x).all() and (x[0] == x[1]).all()
    share = dict(zip(range(quality.CLASSES), x[2][3:3 + quality.CLASSES] * 17))
    assert [round(v) for v in share.values()] == [0, 6, 1, 2, 4, 1, 1, 2, 0]
    assert np.isclose(x[2][1], np.log1p(5)) and np.isclose(x[2][-4], 1) and np.isclose(x[2][-3], 0)


def test_isotonic_is_the_least_squares_monotone_fit():
    rng = np.random.default_rng(1)
    for _ in range(20):
        n = 6
        y, w = rng.random(n), rng.random(n) + 0.1
        xs, v = quality.isotonic(np.arange(n, dtype=float), y, w)
        fit = np.interp(np.arange(n), xs, v)
        assert (np.diff(v) > 0).all()
        best = min((sum(wi * (yi - fi) ** 2 for wi, yi, fi in zip(w, y, f)) for f in _pooled(y, w)))
        blocks, total, at = [], 0.0, 0
        for value in v:  # the fitted step function over the pooled blocks
            blocks.append(value)
        assert len(blocks) <= n and fit.min() >= y.min() - 1e-9 and fit.max() <= y.max() + 1e-9 and best >= total


def _pooled(y, w):
    for cuts in itertools.product((0, 1), repeat=len(y) - 1):
        out, start = [], 0
        for i in range(1, len(y) + 1):
            if i == len(y) or cuts[i - 1]:
                out += [np.average(y[start:i], weights=w[start:i])] * (i - start)
                start = i
        if all(a <= b + 1e-12 for a, b in zip(out, out[1:])):
            yield out


def test_quality_on_held_out_rows(spark):
    docs, labels = load(spark, "documents"), load(spark, "labels")
    described = quality.describe(docs)
    model = quality.fit(described, labels, "quality")
    got = {r.doc_id: r for r in quality.score(described, model).collect()}
    want = {r.doc_id: r.quality for r in labels.collect()}
    held = [(r.predicted, want[d]) for d, r in got.items() if r.held_out and d in want]
    assert len(held) > 80 and sum(p == y for p, y in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 for r in got.values())
    kept = {r.doc_id for r in quality.reject(docs, labels).collect()}
    assert kept == {d for d, r in got.items() if r.predicted}
    # the normal equations of the partitions add up to those of all rows at once
    rows = [r for r in described.where("_fold <> 1").join(labels.select(F.col("doc_id").alias("_id"), "quality"), "_id").collect()]
    z = model.features(np.array([r.stats for r in rows], float))
    a = z.T @ z + quality.RIDGE * len(z) * np.diag([*np.ones(quality.FEATURES), 0]) + 1e-9 * np.eye(quality.FEATURES + 1)
    assert np.allclose(z @ np.linalg.solve(a, z.T @ np.array([r.quality for r in rows])), z @ model.beta, atol=1e-6)


def test_quality_edges(spark):
    docs = frame(spark, edge_rows())
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    blank = quality.score(quality.describe(docs), quality.fit(quality.describe(docs), none, "quality")).collect()
    assert len(blank) == len(edge_rows()) and {r.score for r in blank} == {0.5}
    few = spark.createDataFrame([(2, 1), (2, 0), (4, None), (5, 1), (6, 0), (8, 1), (None, 1)], "doc_id bigint, quality int")
    rows = quality.score(quality.describe(docs), quality.fit(quality.describe(docs), few, "quality")).collect()
    assert len(rows) == len(edge_rows()) and all(0 <= r.score <= 1 for r in rows)
    assert quality.score(quality.describe(frame(spark, [])), quality.fit(quality.describe(docs), few, "quality")).count() == 0


def test_languages_on_held_out_rows(spark):
    docs = load(spark, "documents")
    got = lang_id.predict(docs, lang_id.dictionaries(docs)).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang_pred == r.lang for r in got) / len(got) > 0.97


def test_language_edges(spark):
    docs = frame(spark, edge_rows() + [(20, "123 !!"), (21, "x")])
    d = {"aa": b"one two three " * 20, "bb": b"uno dos tres " * 20}
    got = {r.doc_id: r for r in lang_id.predict(docs, d).collect()}
    assert got[1].lang_pred == got[2].lang_pred == got[20].lang_pred == "und" and got[20].score == 0
    assert got[4].lang_pred == "aa" and 0 < got[4].score <= 1 and not got[21].accepted and got[21].margin == 0
    assert lang_id.predict(docs, {}).where("lang_pred <> 'und'").count() == 0
    assert lang_id.dictionaries(docs.withColumn("lang", F.lit(None).cast("string"))) == {}
    assert set(lang_id.dictionaries(docs)) == {"en"} and lang_id.predict(frame(spark, []), d).count() == 0


def test_whole_text_decides():
    c = lang_id.Classifier({"aa": b" ".join(b"alpha%c beta%c" % (65 + i, 65 + i) for i in range(20)), "bb": b"gamma delta epsilon zeta eta " * 9})
    assert c("gamma delta " * 3 + "zzz " * 2 + "alpha beta alphax betaq " * 4000)[0] == "aa"


def test_chain_feeds_earlier_probabilities():
    rng = np.random.default_rng(0)
    x = rng.random((600, 6)) < 0.3
    first = x[:, 0]
    second = first ^ (rng.random(600) < 0.02)
    found = [set(np.flatnonzero(r[1:]).tolist()) for r in x]  # the first feature is hidden from the words
    for i, f in enumerate(found):
        if first[i]:
            f.add(5)
    words = {f"w{i}": i for i in range(6)}
    chain = toxicity.fit_chain(found, words, {"a": first.astype(float), "b": second.astype(float)}, np.arange(600) % 4)
    assert chain.weights["b"].shape == (6 + 1 + 1,) and chain.weights["b"][6] > 0.5
    p = chain.probabilities(found)
    assert ((p[:, 1] > 0.5) == second).mean() > 0.95


def test_toxicity_on_held_out_rows(spark):
    docs, labels = load(spark, "documents"), load(spark, "labels").select("doc_id", "toxic")
    said = lambda w: ((F.col("toxic") == 1) & F.lower("_text").contains(w)).cast("int")
    chain = toxicity.fit(docs, labels, {"moron": said("moron"), "never": F.lit(0), "toxic": F.col("toxic")}, "toxic")
    got = {r.doc_id: r for r in toxicity.score(docs, chain).collect()}
    want = {r.doc_id: r.toxic for r in labels.collect()}
    train = [(got[d].p_toxic >= 0.5, y == 1) for d, y in want.items() if zlib.crc32(str(d).encode()) % 3 != 1]
    held = [(got[d].p_toxic >= 0.5, y == 1) for d, y in want.items() if zlib.crc32(str(d).encode()) % 3 == 1]
    assert sum(a == b for a, b in train) / len(train) > 0.97 and sum(a and not b for a, b in held) <= 0.05 * len(held)
    assert all(r.p_never < 1e-6 for r in got.values())


def test_toxicity_edges(spark):
    docs = frame(spark, edge_rows())
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    chain = toxicity.fit(docs, none, {"a": F.col("toxic"), "toxic": F.col("toxic")}, "toxic")
    rows = toxicity.score(docs, chain).collect()
    assert len(rows) == len(edge_rows()) and all(r.p_toxic < 1e-6 for r in rows)
    one = spark.createDataFrame([(1, 1), (7, 1), (None, 1), (8, None)], "doc_id bigint, toxic int")
    assert toxicity.score(docs, toxicity.fit(docs, one, {"toxic": F.col("toxic")}, "toxic")).where("p_toxic > 0.9").count() == len(edge_rows())
    assert toxicity.score(frame(spark, []), chain).count() == 0


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain(t):
    out = []
    for k, p in PATTERNS.items():
        for m in re.finditer(p, t):
            d = re.sub("[^0-9]", "", m[0])
            if not (k == "ip" and any(int(q) > 255 for q in m[0].split(".")) or k == "card" and not (12 <= len(d) <= 19 and pii.luhn(d))
                    or k == "phone" and not 9 <= len(d) <= 15):
                out.append((k, m.start(), m.end()))
    return pii.in_order(out)


def test_base_spans_equal_the_patterns():
    rng = random.Random(3)
    for _ in range(5000):
        t = "".join(rng.choice("aZ@.@1234 +-()%_b.5\nü") for _ in range(rng.randrange(45)))
        assert plain(t) == pii.base_spans(t), t
    t = "x 4425414259157784, +1 (319) 555-5132; bob.a@m-1.example.com 1.2.3.4.5.6.7.8 256.1.1.1"
    assert plain(t) == pii.base_spans(t) and {k for k, _, _ in pii.base_spans(t)} == set(pii.KINDS)
    for huge in ("a" * 200_000, "1" * 200_000, "a@" * 50_000, "1." * 50_000, "+1" + "(" * 100_000):
        pii.base_spans(huge)


def test_gradient_and_viterbi():
    rng = np.random.default_rng(0)
    m = pii.BiLstmCrf(hidden=3)
    ids, tags = rng.integers(1, 100, (6, 3)), np.zeros((6, 3), int)
    tags[2:5, 0], tags[3:, 1] = 1, 2
    _, g = m.loss(ids, tags)
    for k in g:
        for _ in range(5):
            ix = tuple(rng.integers(0, s) for s in m.p[k].shape)
            if k in ("fx", "bx"):
                ix = (ix[0], ids[rng.integers(0, 6), rng.integers(0, 3)])
            if k == "trans" and ix[0] != ix[1] and 0 not in ix:
                continue
            at = m.p[k][ix]
            m.p[k][ix] = at + 1e-2
            up = m.loss(ids, tags)[0]
            m.p[k][ix] = at - 1e-2
            num = (up - m.loss(ids, tags)[0]) / 2e-2
            m.p[k][ix] = at
            assert abs(num - g[k][ix]) < 2e-3 + 0.02 * abs(num), k
    e, tr = m.emissions(ids[:5]).astype(float), m.p["trans"] + pii._allowed()
    got = m.decode(ids[:5])
    for b in range(3):
        best = max(itertools.product(range(pii.TAGS), repeat=5),
                   key=lambda p: sum(e[t, p[t], b] for t in range(5)) + sum(tr[p[t], p[t + 1]] for t in range(4)))
        assert list(best) == got[:, b].tolist()


def texts():
    rng = random.Random(5)

    def words(n):
        return " ".join("".join(rng.choice("aeionrst") for _ in range(rng.randrange(2, 8))) for _ in range(n))
    out = []
    for i in range(160):
        span = [f"user{i}.{rng.randrange(90)}@mail{i % 9}.example.com", f"{rng.randrange(255)}.{i % 250}.{rng.randrange(9)}.7",
                "4425414259157784", f"+1 ({rng.randrange(200, 999)}) 555-{rng.randrange(1000, 9999)}"][i % 4]
        out.append(f"{words(25)} {span} {words(60)}")
    return out


def test_the_bound_never_changes_a_path():
    """Windows in which no run of a kind pays are left outside; the full search agrees, and so do the gains."""
    rng = np.random.default_rng(4)
    for scale in (0.1, 0.5, 2.0):
        m = pii.BiLstmCrf(hidden=4, seed=int(10 * scale))
        m.p["out"] *= scale
        m.p["bias"][1:] -= 1.0
        ids = rng.integers(0, pii.CHARS, (40, 300))
        tags, cols, gains = m.best(ids)
        e, tr = m.emissions(ids), (m.p["trans"] + pii._allowed()).astype(np.float32)
        assert np.array_equal(tags, m._viterbi(e, tr)) and np.array_equal(cols, np.flatnonzero(tags.any(0)))
        want = np.take_along_axis(e, tags.astype(int)[:, None], 1)[:, 0] - e[:, 0]
        assert np.allclose(gains, want[:, cols], atol=1e-3)


@pytest.fixture(scope="module")
def trained():
    model = pii.BiLstmCrf()
    model.train(*pii.windows(texts(), limit=1500), epochs=12)
    return model


def test_model_finds_base_spans_and_other_spellings(trained):
    every = texts()
    tags = pii.tags_of(every, trained)
    hit = [(t[s:e] == pii.KINDS.index(k) + 1).mean() > 0.7 for x, t in zip(every, tags) for k, s, e in pii.base_spans(x)]
    assert np.mean(hit) > 0.9
    x = "naro test sino call (319) 555-5132 tero nase rino sato"
    assert ("phone", 20, 34) in pii.all_spans(x, pii.marks_of([x], trained)[0], trained)[1]


def test_spans_beside_the_rules():
    """What a rule has refused as a whole is not added, what it saw parts of may be; base spans stay."""
    class Fixed:
        least, most = dict.fromkeys(pii.KINDS, 1.0), dict.fromkeys(pii.KINDS, 99.0)

        def span_score(self, kind, gains):
            return float(gains.sum())

    def added(text, kind, piece, gain=9.0):
        tags, gains, s = np.zeros(len(text), np.int8), np.zeros(len(text)), text.index(piece)
        tags[s:s + len(piece)], gains[s:s + len(piece)] = pii.KINDS.index(kind) + 1, gain / len(piece)
        base, every = pii.all_spans(text, (tags, gains), Fixed())
        return [x for x in every if x not in base]
    assert added("a 4425.4142.5915.7784 b", "card", "4425.4142.5915.7784") == [("card", 2, 21)]
    assert added("a 4425414259157785 b", "card", "4425414259157785") == [] and added("a 4425414259157784 b", "card", "4425414259157784") == []
    assert added("a 300.1.2.3 b", "ip", "300.1.2.3") == [] and added("a 3[.]1[.]2[.]3 b", "ip", "3[.]1[.]2[.]3") == [("ip", 2, 15)]
    merged = "to +1 (843) 555-7672 170.106.47.218"
    assert pii.base_spans(merged) == [("ip", 21, 35)] and added(merged, "phone", "+1 (843) 555-7672") == [("phone", 3, 20)]
    assert added("a b at c dot d e", "email", "b at c dot d", gain=0.5) == []
    assert (pii.classes("4425414259157785") == 101).all() and not (pii.classes("4425414259157784") == 101).any()


@pytest.fixture(scope="module")
def fitted(spark):
    return pii.fit(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"))


def test_held_out_precision_and_recall(spark, fitted):
    """Spellings that the rules miss, on documents that the model has not seen; and few spans on plain texts."""
    for k in pii.KINDS:
        precision, recall, n = fitted.report[k]
        assert precision >= 0.9 and recall >= 0.5 and n >= 100, (k, fitted.report)
    docs = [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    pieces = pii.respelled_spans(docs, seed=17, times=3)
    right, wrong = 0, 0
    for (text, span), marks in zip(pieces, pii.marks_of([p for p, _ in pieces], fitted)):
        every = pii.all_spans(text, marks, fitted)[1]
        right += any(pii.same_span(x, span) for x in every)
        wrong += sum(x not in pii.base_spans(text) and not pii.same_span(x, span) and 48 <= x[1] and x[2] <= len(text) - 48 for x in every)
    assert right > 0.8 * len(pieces) > 150 and wrong < 0.1 * right
    docs = [r.text for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("text rlike '[0-9]{12}'").collect()]
    raw = [(x in pii.base_spans(t)) for t, marks in zip(docs, pii.marks_of(docs, fitted)) for x in pii.model_spans(t, marks[0]) if x[0] == "card"]
    assert np.mean(raw) > 0.9 and len(raw) > 100


def test_windows_do_not_change_what_lies_inside(trained):
    pad = "sator arepo tenet opera rotas " * 60
    for shift in range(0, 400, 23):
        t = pad[:shift] + " user7.12@mail3.example.com " + pad
        base, every = pii.all_spans(t, pii.marks_of([t], trained, window=128, overlap=48)[0], trained)
        assert base == pii.base_spans(t) and set(base) <= set(every)
    assert [len(x) for x in pii.tags_of(["", "a", pad * 3], trained)] == [0, 1, len(pad) * 3]


def test_pii_frames(spark, trained):
    docs = frame(spark, edge_rows() + [(30, "mail a.b@c.de or 1.2.3.4"), (30, "mail a.b@c.de or 1.2.3.4")])
    for model in (None, trained):
        got = pii.find(docs, model).collect()
        assert len(got) == len(edge_rows()) + 2
        for r in got:
            if r.doc_id == 30:
                assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == (1, 1, 0, 0) and "email:5:13,ip:17:24" in r.spans
            if r.doc_id in (1, 2):
                assert r.spans == "" and r.base_sha256.startswith("e3b0c442")
    assert pii.find(frame(spark, []), trained).count() == 0
    assert pii.fit(frame(spark, [(1, "nothing here"), (2, None)])) is None


def test_labels_with_the_names_used_inside(spark):
    docs = frame(spark, [(i, "you idiot scum" if i % 3 == 0 else f"a calm text {i}") for i in range(60)])
    labels = spark.createDataFrame([(i, int(i % 3 == 0), 5, "x") for i in range(60)], "doc_id bigint, toxic int, _id int, _text string")
    chain = toxicity.fit(docs, labels, {"toxic": F.col("toxic")}, "toxic")
    got = {r.doc_id: r.p_toxic for r in toxicity.score(docs, chain).collect()}
    assert all((got[i] > 0.5) == (i % 3 == 0) for i in range(60))
