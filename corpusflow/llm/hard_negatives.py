"""Hard negatives by BOND vertical scans.

For every anchor and each of its ``positives`` best rows of the same label, the
best ``negatives`` rows of other labels whose score lies between two shares of
the positive's score.  A score is the inner product of integer vectors; higher
scores come first, ties by the smaller id.

Method
  1. Anchors are the query set.  They are dealt into chunks of about ``CHUNK``
     by a hash, and each chunk is broadcast (a bound, whatever their number)
     and meets all rows in one pass.
  2. A task lays ``BLOCK`` rows at a time out by dimension.  An anchor reads the
     dimensions in descending magnitude of its own components.  After every
     ``STEP`` of them a row's score is known up to what the remaining dimensions
     can add, from each dimension's least and largest value in the block.  The
     candidate bitmap loses the rows that no window can take: outside of it, or
     below ``k`` rows that are surely inside, or below the ``k``-th best of
     earlier blocks.  What is left has exact scores.
  3. A task returns at most ``k`` rows per window; Spark ranks them.

The first pass has one open window, the rows of the anchor's label; the second
has one window per positive, over the rows of other labels.

Defined results: rows with a NULL id, label or vector, or with a NULL, NaN or
infinite component take no part; a shorter vector is as good as one padded with
zeros; rows that share an id are rows of their own, but not *other* rows for
one another; an anchor without positives, and a positive without rows in its
window, give no rows; an empty table gives an empty result; other columns are
ignored.  Components or scores beyond 64 bits are an error.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusflow.llm.common import staged

POSITIVES, NEGATIVES, LOW, HIGH = 5, 10, 30, 90
CHUNK, BLOCK, STEP = 8192, 8192, 16


def vectors(df: DataFrame, id_col: str, label: Column, vec_col: str, scale: int = 256) -> DataFrame:
    """(id, label, v): the rows that take part, components scaled and floored to whole numbers."""
    x = F.transform(F.col(f"`{vec_col}`"), lambda c: c.cast("double"))
    rows = df.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), label.cast("bigint").alias("label"), x.alias("x"))
    limit = float(2 ** 31)
    whole = F.transform("x", lambda c: F.floor(c * scale))
    large = F.exists("x", lambda c: F.abs(c * scale) >= limit)
    error = F.raise_error(F.lit("a component is too large for exact scores")).cast("array<bigint>")
    bad = F.exists("x", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return (rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull()).where(~bad)
                .select("id", "label", F.when(large, error).otherwise(whole).alias("v")))


# --- one block --------------------------------------------------------------

class Block:
    """Rows by dimension, in order of their label; ``lo`` and ``hi`` bound every dimension."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray):
        order = np.argsort(labels, kind="stable")
        self.ids, self.labels = ids[order], labels[order]
        self.x = np.ascontiguousarray(x[order].T)
        self.lo, self.hi = self.x.min(axis=1), self.x.max(axis=1)

    def of_label(self, label: int) -> slice:
        return slice(*np.searchsorted(self.labels, [label, label + 1]).tolist())


def score_type(width: int, largest: int) -> type:
    """A type in which every score of such vectors is exact."""
    if width * largest * largest < 1 << 53:
        return np.float64
    if width * largest * largest < 1 << 63:
        return np.int64
    raise ValueError("vectors are too large for 64-bit scores")


def scan(q: np.ndarray, block: Block, rows: slice, alive: np.ndarray, windows: list[tuple[float, float, float]], k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row indexes, exact scores) of all rows that may be among the best ``k`` of a window (low, high, score to reach).

    ``rows`` is the part of the block that is read, ``alive`` its candidate bitmap.
    """
    order = np.argsort(-np.abs(q), kind="stable")
    both = np.stack([q * block.lo, q * block.hi])[:, order]
    least = np.append(np.cumsum(both.min(0)[::-1])[::-1], 0)  # what the dimensions from a place on add at least
    most = np.append(np.cumsum(both.max(0)[::-1])[::-1], 0)
    x, at = block.x[:, rows], np.arange(rows.start, rows.stop)
    score = np.zeros(len(at), q.dtype)
    for s in range(0, len(order), STEP):
        dims = order[s:s + STEP]
        score = score + q[dims] @ x[dims]
        end = s + len(dims)
        low, high = score + least[end], score + most[end]
        kept = np.zeros(len(at), bool)
        for lo, hi, reach in windows:
            sure = low[alive & (low >= lo) & (high <= hi)]
            bound = max(lo, reach, np.partition(sure, -k)[-k]) if len(sure) >= k else max(lo, reach)
            kept |= (high >= bound) & (low <= hi)
        alive = alive & kept
        if 2 * np.count_nonzero(alive) < len(at):
            x, at, score = x[:, alive], at[alive], score[alive]
            alive = np.ones(len(at), bool)
        if not len(at):
            break
    return at[alive], score[alive]


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``k`` by score (high to low) and id."""
    if len(scores) > 4 * k:  # rows below the k-th score are not sorted
        enough = scores >= np.partition(scores, -k)[-k]
        scores, ids = scores[enough], ids[enough]
    order = np.lexsort((ids, -scores))[:k]
    return scores[order], ids[order]


class Search:
    """The running best rows of every window of a chunk of anchors."""

    def __init__(self, anchors: dict, k: int, same: bool):
        self.a, self.k, self.same = anchors, k, same
        empty = np.empty(0, np.int64)
        self.best = [[(empty, empty) for _ in w] for w in anchors["windows"]]

    def add(self, block: Block) -> None:
        kind = score_type(max(len(block.x), self.a["v"].shape[1]), int(max(np.abs(block.x).max(initial=0), np.abs(self.a["v"]).max(initial=0))))
        width = len(block.x)
        q = np.zeros((len(self.a["id"]), width), kind)
        q[:, :self.a["v"].shape[1]] = self.a["v"][:, :width]
        block.x, block.lo, block.hi = block.x.astype(kind), block.lo.astype(kind), block.hi.astype(kind)
        for i, windows in enumerate(self.a["windows"]):
            if not windows:
                continue
            own = block.of_label(self.a["label"][i])
            rows = own if self.same else slice(0, len(block.ids))
            if rows.start == rows.stop:
                continue
            alive = block.ids[rows] != self.a["id"][i]
            if not self.same:
                alive[own] = False
            held = self.best[i]
            limits = [(lo, hi, held[j][0][-1] if len(held[j][0]) == self.k else -math.inf) for j, (lo, hi) in enumerate(windows)]
            at, score = scan(q[i], block, rows, alive, limits, self.k)
            score, ids = score.astype(np.int64), block.ids[at]
            for j, (lo, hi) in enumerate(windows):
                inside = (score >= lo) & (score <= hi)
                if inside.any():
                    held[j] = best(np.concatenate([held[j][0], score[inside]]), np.concatenate([held[j][1], ids[inside]]), self.k)

    def rows(self) -> Iterator[pa.RecordBatch]:
        for s in range(0, len(self.best), 256):
            out = [(self.a["number"][i], j, score, ids) for i in range(s, min(s + 256, len(self.best))) for j, (score, ids) in enumerate(self.best[i])]
            if any(len(x[3]) for x in out):
                sizes = [len(x[3]) for x in out]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(np.array([x[0] for x in out], np.int64), sizes)), pa.array(np.repeat(np.array([x[1] for x in out], np.int32), sizes)),
                     pa.array(np.concatenate([x[3] for x in out])), pa.array(np.concatenate([x[2] for x in out]))], ["number", "w", "id", "score"])


def matrix(col: pa.ListArray | pa.ChunkedArray, width: int = 0) -> np.ndarray:
    """Vectors as rows of one width (at least ``width``), short ones padded with zeros."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    sizes = col.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(col), max(width, int(sizes.max(initial=0)))), np.int64)
    flat = col.flatten().to_numpy(zero_copy_only=False)
    out[np.repeat(np.arange(len(col)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _scan(sent, k: int, same: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search, held, n = Search(sent.value, k, same), [], 0

        def work(parts: list[pa.RecordBatch]) -> None:
            t = pa.Table.from_batches(parts)
            search.add(Block(t.column("id").to_numpy(), t.column("label").to_numpy(), matrix(t.column("v"))))
        for b in batches:
            for s in range(0, b.num_rows, BLOCK):
                part = b.slice(s, BLOCK)
                if n + part.num_rows > BLOCK:
                    work(held)
                    held, n = [], 0
                held.append(part)
                n += part.num_rows
        if n:
            work(held)
        yield from search.rows()
    return run


# --- Spark ------------------------------------------------------------------

def _searched(rows: DataFrame, anchors: list, k: int, same: bool) -> DataFrame:
    """(number, w, id, score, rank): the best ``k`` rows of every window; one pass over ``rows`` per chunk of anchors.

    ``anchors`` holds functions that bring one chunk each, so that only one is on the driver at a time.
    """
    spark, out = rows.sparkSession, None
    for chunk in anchors:
        sent = spark.sparkContext.broadcast(chunk())
        part = staged(rows.mapInArrow(_scan(sent, k, same), "number bigint, w int, id bigint, score bigint"), "scanned")
        sent.unpersist()
        out = part if out is None else out.union(part)
    order = Window.partitionBy("number", "w").orderBy(F.col("score").desc(), "id")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(rows: DataFrame, anchors: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """Hard negatives among ``rows`` for ``anchors``, both (id bigint, label bigint, v array<bigint>; see :func:`vectors`).

    A negative's score is from ``low`` to ``high`` hundredths of the positive's.
    Returns anchor_id, positive_id, rank, negative_id, positive_score, negative_score.
    """
    rows = staged(rows, "vectors")
    named = staged(anchors.withColumn("number", F.monotonically_increasing_id()), "anchors")  # written once: the numbers stay
    chunks = max(1, math.ceil(named.count() / CHUNK))
    at = F.pmod(F.xxhash64("number"), F.lit(chunks))

    def first(i: int):
        def bring() -> dict:
            t = named.where(at == i).toArrow()
            return {"number": t.column("number").to_numpy(), "id": t.column("id").to_numpy(), "label": t.column("label").to_numpy(),
                    "v": matrix(t.column("v")), "windows": [[(-math.inf, math.inf)]] * t.num_rows}
        return bring
    found = staged(_searched(rows, [first(i) for i in range(chunks)], positives, True), "positives")

    def second(i: int):
        def bring() -> dict:
            out, own = first(i)(), {}
            for r in found.where(at == i).select("number", "rank", "score").orderBy("number", "rank").toLocalIterator():
                own.setdefault(r["number"], []).append((-(-low * r["score"] // 100), high * r["score"] // 100))
            return out | {"windows": [own.get(n, []) for n in out["number"].tolist()]}
        return bring
    hard = _searched(rows, [second(i) for i in range(chunks)], negatives, False)
    near = (found.select("number", (F.col("rank") - 1).alias("w"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
                 .join(named.select("number", F.col("id").alias("anchor_id")), "number"))
    return hard.join(near, ["number", "w"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
