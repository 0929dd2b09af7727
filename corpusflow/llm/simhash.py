"""SimHash near-duplicates with vantage-point trees.

A document is the list of its ``k``-word shingles, repeats included (ASCII
letters lower-cased, words separated by ASCII white space, joined by single
spaces).  A bit of its 64-bit fingerprint is 1 if it is set in over half of the
shingles' XXH64 values.  Fingerprints that differ in at most ``radius`` bits are
linked; a group is a connected component of links.

Method
  1. *Fingerprints* (one pass over whole texts); from here on equal fingerprints
     are one node, so a group of copies is one row.
  2. *Shards.*  A vantage-point tree is fitted on a bounded sample of the
     different fingerprints: a node has a vantage point v and a distance m.  A
     fingerprint at distance d from v goes left if d <= m and right if
     d > m - radius.  By the triangle bound two linked fingerprints of which one
     lies beyond m are both farther than m - radius, so every linked pair meets
     in a leaf although only the fingerprints near a boundary are in two shards.
  3. *Pairs.*  Every shard goes on with a tree of its own down to ``BLOCK``
     fingerprints, prunes branches by the same bound, and compares what is left
     in a leaf exactly.  A search from linked fingerprint to linked fingerprint
     leaves out those already reached, so a dense group is never listed as
     pairs; a shard returns one edge per linked fingerprint at most.
  4. Components of the edges, and the least id of each, by Spark joins.

The result is exact whatever the sample: it only sets where shards are cut.

Defined results: with fewer than ``k`` words the whole word sequence is one
shingle; NULL, empty or blank texts have fingerprint zero and are linked like
any other; NULL ids take no part (component NULL); repeated rows get equal
answers; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.llm.common import salt, salted_lookup, staged
from corpusflow.llm.near_dedup import SALTS, components, least_ids

SHINGLE_WORDS, RADIUS, SEED = 3, 2, 42
# A shard holds about SHARD different fingerprints (and those near its boundary) up to MOST_SHARDS, beyond that more.
SHARD, MOST_SHARDS = 20_000, 1 << 14
# Fingerprints sampled per shard for the tree; at most MOST_SAMPLED come to the driver (2 MB).
SAMPLE, MOST_SAMPLED = 64, 1 << 18
BLOCK, TRIES = 256, 8
STEP = 1 << 15  # shingles hashed at a time


def fingerprint(text: bytes, k: int = SHINGLE_WORDS) -> int:
    """64-bit SimHash of a whole text."""
    words = text.lower().split()  # of bytes: ASCII letters and ASCII white space only
    if not words:
        return 0
    joined = memoryview(b" ".join(words))
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(k, len(words))
    starts, ends = starts[:len(words) - k + 1].tolist(), ends[k - 1:].tolist()
    ones = np.zeros(64, np.int64)
    for at in range(0, len(starts), STEP):
        h = b"".join([xxhash.xxh64_digest(joined[s:e], SEED) for s, e in zip(starts[at:at + STEP], ends[at:at + STEP])])
        ones += np.unpackbits(np.frombuffer(h, np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(starts)).tobytes(), "big")


def distance(a: np.ndarray, b: np.uint64) -> np.ndarray:
    """Hamming distances of fingerprints to one."""
    return np.bitwise_count(a ^ b).astype(np.int16)


# --- the tree ---------------------------------------------------------------

def cut(points: np.ndarray, radius: int, rng: np.random.Generator) -> tuple[np.uint64, int] | None:
    """(vantage point, m) with the least pair work left on both sides; None if no cut takes a tenth of it away."""
    seen = points if len(points) <= 1024 else points[rng.choice(len(points), 1024, replace=False)]
    best = (0.9, None)
    for v in seen[rng.choice(len(seen), min(TRIES, len(seen)), replace=False)]:
        share = np.cumsum(np.bincount(distance(seen, v), minlength=65)) / len(seen)  # of distances up to m
        for m in range(0, 64):
            right = 1 - (share[m - radius] if m >= radius else 0)
            work = share[m] ** 2 + right ** 2
            if work < best[0]:
                best = (work, (v, m))
    return best[1]


def fit_tree(points: np.ndarray, leaves: int, radius: int = RADIUS, seed: int = 1) -> np.ndarray:
    """A tree of about ``leaves`` leaves over sampled fingerprints.

    Rows are (vantage point, m, left, right); a negative child -x - 1 is leaf x.
    The largest set of points is cut next.
    """
    import heapq
    rng = np.random.default_rng(seed)
    rows, done, sets = [], 0, {0: np.unique(points)}
    heap, where = [(-len(sets[0]), 0)], {0: None}  # where: (row, side) that points to a set
    following = 1
    while heap and len(heap) + done < leaves:
        _, s = heapq.heappop(heap)
        own = sets.pop(s)
        found = cut(own, radius, rng) if len(own) > 1 else None
        if found is None:
            sets[s] = own
            done += 1
            continue
        v, m = found
        d = distance(own, v)
        if where[s] is not None:
            rows[where[s][0]][where[s][1]] = len(rows)
        rows.append([int(v), m, 0, 0])
        for side, part in ((2, own[d <= m]), (3, own[d > m - radius])):
            sets[following], where[following] = part, (len(rows) - 1, side)
            heapq.heappush(heap, (-len(part), following))
            following += 1
    for leaf, s in enumerate(sorted(sets)):
        if where[s] is not None:
            rows[where[s][0]][where[s][1]] = -leaf - 1
    return np.array([tuple(r) for r in rows], np.dtype([("v", np.uint64), ("m", np.int16), ("left", np.int32), ("right", np.int32)]))


def leaves_of(tree: np.ndarray, points: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """(index of the point, leaf) of every shard that each point belongs to."""
    if not len(tree):
        return np.arange(len(points)), np.zeros(len(points), np.int64)
    out, todo = [], [(0, np.arange(len(points)))]
    while todo:
        node, own = todo.pop()
        if not len(own):
            continue
        if node < 0:
            out.append((own, np.full(len(own), -node - 1)))
            continue
        v, m, left, right = tree[node]
        d = distance(points[own], v)
        todo += [(left, own[d <= m]), (right, own[d > m - radius])]
    return (np.concatenate([o[i] for o in out]) if out else np.empty(0, np.int64) for i in (0, 1))


# --- pairs of a shard -------------------------------------------------------

def reach(points: np.ndarray, radius: int) -> Iterator[tuple[int, int]]:
    """(index, index from which it was reached first) of every point linked to an earlier one."""
    left = np.arange(len(points))
    while len(left):
        todo, left = [left[0]], left[1:]
        first = todo[0]
        while todo and len(left):
            near = distance(points[left], points[todo.pop()]) <= radius
            found, left = left[near], left[~near]
            yield from ((x, first) for x in found)
            todo.extend(found)


def shard_edges(points: np.ndarray, radius: int = RADIUS, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Edges (a, b) that connect the linked fingerprints among different ``points``, one a point at most."""
    rng, up = np.random.default_rng(seed), np.arange(len(points))

    def head(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x
    todo = [np.arange(len(points))]
    while todo:
        own = todo.pop()
        found = cut(points[own], radius, rng) if len(own) > BLOCK else None
        if found is not None:
            d = distance(points[own], found[0])
            todo += [own[d <= found[1]], own[d > found[1] - radius]]
            continue
        if len(own) <= BLOCK:  # most leaves hold few links: only the points that have one are searched
            p = points[own]
            near = np.bitwise_count(p[:, None] ^ p[None, :]) <= radius
            own = own[near.sum(1) > 1]
        for x, y in reach(points[own], radius):
            a, b = head(own[x]), head(own[y])
            up[max(a, b)] = min(a, b)
    heads = np.array([head(x) for x in range(len(points))], np.int64)
    linked = np.flatnonzero(heads != np.arange(len(points)))
    return points[linked], points[heads[linked]]


# --- Spark ------------------------------------------------------------------

def _fingerprints(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).cast(pa.binary())
            marks = np.array([fingerprint(t.as_py() or b"", k) for t in texts], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(marks.view(np.int64))], ["_id", "mark"])
    return run


def _route(sent, radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, leaf = leaves_of(sent.value, b.column(0).to_numpy().view(np.uint64), radius)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), pa.array(leaf.astype(np.int32))], ["mark", "leaf"])
    return run


def links(marks: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges (a, b) that connect all linked fingerprints of ``marks`` (mark bigint, different values)."""
    spark = marks.sparkSession
    n = marks.count()
    shards = min(MOST_SHARDS, math.ceil(n / SHARD))
    tree = fit_tree(np.empty(0, np.uint64), 1, radius)
    if shards > 1:
        share = min(SAMPLE * shards, MOST_SAMPLED) / n
        cut_at = int(share * 2 ** 62)
        some = marks.where(F.shiftrightunsigned(F.xxhash64("mark"), 2) < cut_at).limit(2 * MOST_SAMPLED).toArrow()
        tree = fit_tree(np.sort(some.column("mark").to_numpy().view(np.uint64)), shards, radius)
    dealt = marks.mapInArrow(_route(spark.sparkContext.broadcast(tree), radius), "mark bigint, leaf int")

    def edges(g: pa.Table) -> pa.Table:
        points = np.sort(g.column("mark").to_numpy().view(np.uint64))
        a, b = shard_edges(points, radius)
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})
    return dealt.groupBy("leaf").applyInArrow(edges, "a bigint, b bigint")


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE_WORDS, radius: int = RADIUS) -> DataFrame:
    """One row per input row: id, fingerprint (16 hex digits), component_id (least id of its group), kept."""
    kind = dict(docs.dtypes)[id_col]
    src = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").cast("string").alias("_text"))
    marks = staged(src.mapInArrow(_fingerprints(k), f"_id {kind}, mark bigint"), "fingerprints")
    nodes = staged(marks.where("_id is not null").groupBy("mark").agg(F.min("_id").alias("least")), "marks")
    found = staged(links(nodes.select("mark"), radius), "mark-links")
    roots = components(found) if found.limit(1).count() else None
    of = least_ids(nodes.select(F.col("mark").alias("rep"), "least"), roots).select(F.col("rep").alias("mark"), "component_id")
    own = marks.where("_id is not null").withColumn("_salt", salt("_id", SALTS))
    rows = (salted_lookup(own, of, "mark", "_salt").select("_id", "mark", "component_id")
            .union(marks.where("_id is null").select("_id", "mark", F.col("_id").alias("component_id"))))
    return rows.select(F.col("_id").alias(id_col), F.lower(F.lpad(F.hex("mark"), 16, "0")).alias("fingerprint"), "component_id",
                       F.col("_id").eqNullSafe(F.col("component_id")).alias("kept"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents that stay: the least id of every group (rows sharing an id share its fate)."""
    gone = groups(docs, id_col, text_col, **options).where("not kept").select(F.col(id_col).alias("_gone")).distinct()
    return docs.join(gone, docs[f"`{id_col}`"] == gone["_gone"], "left_anti")
