"""Quality classifier: random Fourier features, ridge by normal equations, isotonic calibration.

A document is described by statistics of its whole text (``statistics``; no
label, language, source or id among them).  ``FEATURES`` random cosines of the
standardised statistics approximate a Gaussian kernel; each partition of the
labelled rows sums its part of the normal equations per fold, Spark adds the
parts, and the driver solves systems of ``FEATURES + 1`` unknowns.  Because the
sums are additive, leaving a fold out is a subtraction: the out-of-fold scores
of all labelled rows calibrate the final ridge scores by isotonic regression
(over at most ``BINS`` score bins).

Every labelled row outside the held-out third takes part; what reaches the
driver is bounded by FEATURES, FOLDS and BINS, not by the rows.

Defined results: NULL text counts as empty and gets a score like any other; a
NULL label is no label, several labels of one id are averaged; without labelled
rows the score is 0.5; repeated rows get equal scores; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.llm.common import fold, staged
from corpusflow.llm.words import SLICE, word_hashes

FEATURES, FOLDS, BINS, RIDGE, SEED = 256, 4, 1024, 1e-3, 17
HELD_OUT = 1

# Byte classes: 0 other symbols, 1 lower case, 2 upper case, 3 digit, 4 white space, 5 '.' or ',', 6 '|', 7 '!', 8 non-ASCII.
_CLASS = np.zeros(256, np.int64)
for _c, _chars in ((1, range(97, 123)), (2, range(65, 91)), (3, range(48, 58)), (4, [32, *range(9, 14)]),
                   (5, b".,"), (6, b"|"), (7, b"!"), (8, range(128, 256))):
    _CLASS[list(_chars)] = _c
CLASSES = 9
STATISTICS = 3 + CLASSES + 6


def _part(texts: list[bytes]) -> np.ndarray:
    sizes = np.array([len(t) for t in texts])
    buf = b"\n".join(texts) + b"\n"
    raw = np.frombuffer(buf, np.uint8)
    n = len(texts)
    kinds = _CLASS[raw]
    doc = np.repeat(np.arange(n), sizes + 1)
    counts = np.bincount(doc * CLASSES + kinds, minlength=n * CLASSES).reshape(n, CLASSES).astype(float)
    counts[:, 4] -= 1  # the line break added between texts
    starts, lengths, hashes = word_hashes(buf)
    bounds = np.searchsorted(starts, np.concatenate(([0], np.cumsum(sizes + 1))))
    words = np.diff(bounds)
    some = np.maximum(words, 1)

    def summed(x):
        return np.diff(np.concatenate(([0], np.cumsum(x, dtype=float)))[bounds])

    mean = summed(lengths) / some
    spread = np.sqrt(np.maximum(0, summed(lengths.astype(float) ** 2) / some - mean ** 2))
    ends = kinds[starts + lengths - 1]
    same = np.concatenate(([False], hashes[1:] == hashes[:-1])) if len(hashes) else np.empty(0, bool)
    same[bounds[:-1][bounds[:-1] < len(same)]] = False
    different = np.array([len(np.unique(hashes[s:e])) for s, e in zip(bounds, bounds[1:])]) / some
    lines = [t.split(b"\n") for t in texts]
    fresh = np.array([len(set(x)) / len(x) for x in lines])
    share = counts / np.maximum(sizes, 1)[:, None]
    return np.column_stack([np.log1p(sizes), np.log1p(words), np.log1p([len(x) for x in lines]), share, mean, spread,
                            different, summed(same) / some, summed(np.isin(ends, (0, 6, 7))) / some, fresh])


def statistics(texts: list) -> np.ndarray:
    """One row of ``STATISTICS`` numbers per whole text (bytes or None)."""
    out, at = [np.empty((0, STATISTICS))], 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end] or b"") <= SLICE):
            size += len(texts[end] or b"")
            end += 1
        out.append(_part([t or b"" for t in texts[at:end]]))
        at = end
    return np.concatenate(out)


def describe(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_id, _fold, stats) of every row; ``_fold`` is the crc32 remainder that marks held-out rows."""
    kind = dict(docs.dtypes)[id_col]
    src = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").cast("string").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = statistics(b.column(1).cast(pa.binary()).to_pylist()).astype(np.float32)
            ends = pa.array(np.arange(0, x.size + 1, STATISTICS, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(ends, pa.array(x.ravel()))], ["_id", "stats"])
    return src.mapInArrow(run, f"_id {kind}, stats array<float>").select("_id", fold("_id").alias("_fold"), "stats")


@dataclass
class Model:
    """Standardisation, random features, ridge weights and the isotonic map."""

    mean: np.ndarray
    std: np.ndarray
    weights: np.ndarray
    shift: np.ndarray
    beta: np.ndarray
    steps: tuple[np.ndarray, np.ndarray]

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.std, -6, 6)
        return np.column_stack([np.cos(z @ self.weights + self.shift) * np.sqrt(2 / len(self.shift)), np.ones(len(x))])

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.features(x) @ self.beta, *self.steps), 0, 1)


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: non-decreasing fit of ``y`` (weights ``w``) on sorted ``x``."""
    blocks: list[list[float]] = []
    for xi, yi, wi in zip(x, y, w):
        blocks.append([yi, wi, xi * wi])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            b, a = blocks.pop(), blocks.pop()
            blocks.append([(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], a[2] + b[2]])
    v = np.array(blocks)
    return v[:, 2] / v[:, 1], v[:, 0]


def _stacked(b: pa.RecordBatch) -> np.ndarray:
    return b.column("stats").flatten().to_numpy().astype(float).reshape(-1, STATISTICS)


def fit(described: DataFrame, labels: DataFrame, label_col: str, id_col: str = "doc_id", seed: int = SEED) -> Model:
    """Fit on the labelled rows outside the held-out fold."""
    y = (labels.where(F.col(f"`{label_col}`").isNotNull()).groupBy(F.col(f"`{id_col}`").alias("_id"))
               .agg(F.avg(f"`{label_col}`").alias("y")))
    train = staged(described.where(F.col("_fold") != HELD_OUT).join(y, "_id")
                            .select("stats", "y", F.pmod(F.xxhash64("_id"), F.lit(FOLDS)).cast("int").alias("cv")), "labelled")
    moments = (train.select(F.posexplode("stats")).groupBy("pos")
                    .agg(F.avg("col").alias("m"), F.stddev_pop("col").alias("s")).orderBy("pos").toPandas())
    rng = np.random.default_rng(seed)
    weights = rng.normal(size=(STATISTICS, FEATURES)) / np.sqrt(STATISTICS)
    shift = rng.uniform(0, 2 * np.pi, FEATURES)
    zero = Model(np.zeros(STATISTICS), np.ones(STATISTICS), weights, shift, np.zeros(FEATURES + 1),
                 (np.zeros(1), np.full(1, 0.5)))
    if not len(moments):
        return zero
    base = Model(moments["m"].to_numpy(), np.maximum(moments["s"].to_numpy(), 1e-6), weights, shift, zero.beta, zero.steps)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {}
        for b in batches:
            z, target, cv = base.features(_stacked(b)), b.column("y").to_numpy(), b.column("cv").to_numpy()
            for f in np.unique(cv):
                own = z[cv == f]
                total[f] = total.get(f, 0) + np.column_stack([own.T @ own, own.T @ target[cv == f]])
        for f, m in total.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(m), f, np.int32)), pa.array(np.arange(len(m), dtype=np.int32)),
                                              pa.array([r.tobytes() for r in m], pa.binary())], ["cv", "i", "part"])

    def add(g: pd.DataFrame) -> pd.DataFrame:
        row = sum(np.frombuffer(x) for x in g["part"])
        return pd.DataFrame({"cv": g["cv"].iloc[:1], "i": g["i"].iloc[:1], "part": [row.tobytes()]})

    kind = "cv int, i int, part binary"
    got = train.mapInArrow(sums, kind).groupBy("cv", "i").applyInPandas(add, kind).toPandas().sort_values(["cv", "i"])
    per_fold = {f: np.stack([np.frombuffer(x) for x in g["part"]]) for f, g in got.groupby("cv")}
    whole = sum(per_fold.values())

    def solve(m: np.ndarray) -> np.ndarray:
        a = m[:, :-1] + RIDGE * max(m[-1, -2], 1) * np.diag([*np.ones(FEATURES), 0]) + 1e-9 * np.eye(FEATURES + 1)
        return np.linalg.solve(a, m[:, -1])

    betas = {f: solve(whole - m) if len(per_fold) > 1 else solve(m) for f, m in per_fold.items()}

    def out_of_fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            z, cv = base.features(_stacked(b)), b.column("cv").to_numpy()
            s = np.array([z[i] @ betas[f] for i, f in enumerate(cv)])
            bin_ = np.floor(np.clip((s + 0.5) / 2, 0, 1 - 1e-9) * BINS).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(bin_), pa.array(s), b.column("y")], ["bin", "s", "y"])

    bins = (train.mapInArrow(out_of_fold, "bin int, s double, y double").groupBy("bin")
                 .agg(F.avg("s").alias("s"), F.avg("y").alias("y"), F.count(F.lit(1)).alias("n")).toPandas().sort_values("s"))
    base.beta = solve(whole)
    base.steps = isotonic(bins["s"].to_numpy(), bins["y"].to_numpy(), bins["n"].to_numpy(float))
    return base


def score(described: DataFrame, model: Model, id_col: str = "doc_id") -> DataFrame:
    """Per row: id, held_out, score, predicted."""
    kind = dict(described.dtypes)["_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("_id"), b.column("_fold"), pa.array(model.score(_stacked(b)))],
                                             ["_id", "_fold", "score"])
    out = described.mapInArrow(run, f"_id {kind}, _fold bigint, score double")
    return out.select(F.col("_id").alias(id_col), (F.col("_fold") == HELD_OUT).alias("held_out"), "score",
                      (F.col("score") >= 0.5).cast("int").alias("predicted"))


def score_text(model: Model, text: Column) -> Column:
    """The score of a text column, for filters that keep whole rows without a join."""
    @F.pandas_udf("double")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(statistics([None if t is None else t.encode() for t in texts])))
    return of(text)


def reject(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose score is at least 0.5, with all their columns."""
    model = fit(staged(describe(docs, id_col, text_col), "statistics"), labels, label_col, id_col)
    return docs.where(score_text(model, F.col(f"`{text_col}`").cast("string")) >= 0.5)
