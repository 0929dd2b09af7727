"""Toxicity by a classifier chain.

Categories are predicted one after the other by linear (logistic) models.  A
later model sees, beside the text features, the probabilities of the earlier
categories; for training these are out-of-fold predictions, so a model never
learns from probabilities fitted on the same rows.

Features are the different lower-cased words of a whole text and the stems of
``STEMS`` letters of longer words (inflected forms share them).  The ``WORDS`` features that
tell the labelled documents apart best are chosen by their z-score.  The models
are fitted on a bounded sample: the ``SAMPLE_ROWS`` labelled documents with the
least hash of their id, outside the held-out third; scoring covers every row.

Defined results: NULL and empty texts have no features and get the base rate; a
NULL label is no label, of several labels of an id the largest counts; a
category without both kinds of labels gets its base rate (0.0 without any
labels); repeated rows get equal answers; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.llm.common import fold, staged

SAMPLE_ROWS, WORDS, FOLDS, RIDGE, STEMS = 20_000, 256, 4, 1.0, (4, 5)
HELD_OUT = 1
_WORD = re.compile(r"[^\W\d_]+")


def features(text: str | None) -> set[str]:
    """Different words of a whole text, and stems (marked with ``*``) of longer ones."""
    words = set(_WORD.findall(text.lower())) if text else set()
    return words.union(*({w[:n] + "*" for w in words if len(w) > n} for n in STEMS))


@dataclass
class Chain:
    """Feature numbers and, per category, the weights of [features, earlier probabilities, 1]."""

    words: dict[str, int]
    weights: dict[str, np.ndarray]

    def __post_init__(self):
        self.whole = {w: i for w, i in self.words.items() if not w.endswith("*")}
        self.stems = {n: {w[:-1]: i for w, i in self.words.items() if w.endswith("*") and len(w) == n + 1} for n in STEMS}

    def found(self, text: str | None) -> set[int]:
        """Numbers of the features of a whole text."""
        if not text:
            return set()
        words = set(_WORD.findall(text.lower()))
        out = {self.whole[w] for w in words & self.whole.keys()}
        for n, own in self.stems.items():
            if own:
                out.update(own[s] for s in {w[:n] for w in words if len(w) > n} & own.keys())
        return out

    def probabilities(self, found: list[set[int]]) -> np.ndarray:
        """(rows, categories) along the chain."""
        k = len(self.words)
        out = np.zeros((len(found), len(self.weights)))
        for j, w in enumerate(self.weights.values()):
            z = np.array([w[list(f)].sum() if f else 0.0 for f in found]) + out[:, :j] @ w[k:k + j] + w[-1]
            out[:, j] = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        return out


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = RIDGE, steps: int = 15) -> np.ndarray:
    """Ridge logistic regression by Newton steps (the last column, the constant, is not shrunk)."""
    w = np.zeros(x.shape[1])
    rate = y.mean() if len(y) else 0.0
    if rate in (0.0, 1.0):
        w[-1] = 40.0 if rate else -40.0
        return w
    w[-1] = np.log(rate / (1 - rate))
    shrink = ridge * np.r_[np.ones(len(w) - 1), 0]
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        s = np.maximum(p * (1 - p), 1e-6)
        move = np.linalg.solve((x * s[:, None]).T @ x + np.diag(shrink + 1e-9), x.T @ (y - p) - shrink * w)
        w += np.clip(move, -4, 4)
        if np.abs(move).max() < 1e-4:
            break
    return w


def fit_chain(found: list[set[int]], words: dict[str, int], labels: dict[str, np.ndarray], folds: np.ndarray) -> Chain:
    """Fit the categories in order, with out-of-fold probabilities of the earlier ones as inputs."""
    base = np.zeros((len(found), len(words)))
    for i, f in enumerate(found):
        base[i, list(f)] = 1
    one, earlier, weights = np.ones((len(found), 1)), np.zeros((len(found), 0)), {}
    for name, y in labels.items():
        x = np.hstack([base, earlier, one])
        weights[name] = logistic(x, y)
        p = np.zeros(len(y))
        for f in np.unique(folds):
            out = folds == f
            w = logistic(x[~out], y[~out]) if (~out).any() else weights[name]
            p[out] = 1 / (1 + np.exp(-np.clip(x[out] @ w, -40, 40)))
        earlier = np.hstack([earlier, p[:, None]])
    return Chain(words, weights)


def fit(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], main: str, id_col: str = "doc_id",
        text_col: str = "text", sample: int = SAMPLE_ROWS, words: int = WORDS) -> Chain:
    """Fit a chain.  ``categories`` maps names, in chain order, to 0/1 columns over the label columns and ``_text``."""
    names = [c for c in labels.columns if c not in (id_col, "_id", "_text")]  # the names used here are no labels
    known = (labels.select(id_col, *names).where(F.col(main).isNotNull() & (fold(id_col) != HELD_OUT)).groupBy(F.col(f"`{id_col}`").alias("_id"))
                   .agg(*[F.max(c).alias(c) for c in names]).orderBy(F.xxhash64("_id"), "_id").limit(sample))
    src = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").cast("string").alias("_text"))
    # The sample bounds the broadcast; documents are scanned once and never shuffled.
    # Of repeated ids one text counts, so the sample bounds the rows too.
    rows = staged(src.join(F.broadcast(known), "_id").groupBy("_id", *names).agg(F.max("_text").alias("_text"))
                     .select("_text", F.pmod(F.xxhash64("_id"), F.lit(FOLDS)).cast("int").alias("_cv"), F.col(main).cast("int").alias("_y"),
                             *[F.coalesce(c.cast("int"), F.lit(0)).alias(n) for n, c in categories.items()]), "labelled")

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, pos = Counter(), Counter()
        for b in batches:
            for text, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                f = features(text)
                n.update(f)
                if y:
                    pos.update(f)
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64()),
                                          pa.array([pos[w] for w in n], pa.int64())], ["w", "n", "pos"])
    total = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("_y").alias("pos")).first()
    if not total["n"]:
        return Chain({}, {c: np.array([0.0] * i + [-40.0]) for i, c in enumerate(categories)})
    rate = (total["pos"] + 0.5) / (total["n"] + 1)
    seen = rows.select("_text", "_y").mapInArrow(counts, "w string, n bigint, pos bigint").groupBy("w").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))
    z = (F.col("pos") - F.col("n") * rate) / F.sqrt(F.col("n") * rate * (1 - rate) + 1)
    best = [r["w"] for r in seen.where("n >= 3").orderBy(F.abs(z).desc(), "w").limit(words).collect()]
    chain = Chain({w: i for i, w in enumerate(best)}, {})

    def designs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [sorted(chain.found(t)) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.int32())), *b.columns[1:]], ["found", *b.schema.names[1:]])
    kinds = "found array<int>, _cv int, " + ", ".join(f"`{c}` int" for c in categories)
    # At most ``sample`` rows of at most ``words`` small integers come to the driver.
    got = rows.select("_text", "_cv", *categories).mapInArrow(designs, kinds).toArrow()
    found = [set(f) for f in got.column("found").to_pylist()]
    return fit_chain(found, chain.words, {c: got.column(c).to_numpy().astype(float) for c in categories}, got.column("_cv").to_numpy())


def score(docs: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id and the probability ``p_<category>`` of every category."""
    kind, names = dict(docs.dtypes)[id_col], [f"p_{c}" for c in chain.weights]
    src = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").cast("string").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = chain.probabilities([chain.found(t) for t in b.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(p[:, j]) for j in range(len(names))]], ["_id", *names])
    return src.mapInArrow(run, f"_id {kind}, " + ", ".join(f"`{n}` double" for n in names)).withColumnRenamed("_id", id_col)
