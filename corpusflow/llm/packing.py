"""Variable-capacity best-fit packing into training sequences.

Documents become pieces of at most the largest permitted length (long documents
are cut, nothing is dropped); pieces are packed into bins of several permitted
lengths.  Rows are dealt into shards of about ``SHARD_ROWS`` pieces by a hash of
(id, piece), so shards are even whatever the documents are, and each shard is
packed on its own from (id, piece, length) alone:

1. best-fit decreasing with joint capacities: the longest piece left opens a
   bin.  For every permitted length the bin would be filled by best fit from
   the lengths still left, and the length with the least cost per packed token
   is opened; its contents are taken.
2. downsizing: when all bins are closed, each shrinks to the smallest permitted
   length that holds its contents.

The cost of a sequence of length c is ``BASE_COST + c + c * c / QUADRATIC``: a
fixed cost, the linear layers and attention.

Defined results: NULL and empty texts are one piece of one token (the end
token); NULL ids are packed like others; repeated rows are told apart by
``copy``; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import bisect
import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.llm.common import staged

LENGTHS = (512, 1024, 2048, 4096)
SHARD_ROWS = 20_000
BASE_COST, QUADRATIC = 64.0, 16384.0


def cost(length: int) -> float:
    """Cost of one training sequence of the given length."""
    return BASE_COST + length + length * length / QUADRATIC


class Left:
    """The pieces still to pack: a stack of pieces per different length, and the sorted lengths that have any."""

    def __init__(self, lengths: list[int]):
        self.items: dict[int, list[int]] = {}
        for i in sorted(range(len(lengths)), key=lambda i: (lengths[i], i), reverse=True):
            self.items.setdefault(lengths[i], []).append(i)
        self.sorted = sorted(self.items)

    def fill(self, first: int, capacity: int) -> list[int]:
        """Lengths that best fit adds to a bin that holds ``first``: the longest that fits, again and again."""
        room, used, out = capacity - first, {first: 1}, []
        at = bisect.bisect_right(self.sorted, room) - 1
        while at >= 0:
            n = self.sorted[at]
            if n <= room and used.get(n, 0) < len(self.items[n]):
                used[n] = used.get(n, 0) + 1
                out.append(n)
                room -= n
                at = min(at, bisect.bisect_right(self.sorted, room) - 1)
            else:
                at -= 1
        return out

    def take(self, n: int) -> int:
        stack = self.items[n]
        i = stack.pop()
        if not stack:
            del self.items[n]
            self.sorted.pop(bisect.bisect_left(self.sorted, n))
        return i


def pack(lengths: list[int], permitted: tuple[int, ...] = LENGTHS) -> tuple[list[int], list[int], list[int]]:
    """(bin, offset in the bin, bin length) of each piece; every length is at most ``max(permitted)``."""
    permitted = tuple(sorted(permitted))
    bins, offsets, sizes = [0] * len(lengths), [0] * len(lengths), [0] * len(lengths)
    left, bin_ = Left(lengths), 0
    while left.sorted:
        first = left.sorted[-1]
        best = None
        for c in permitted[bisect.bisect_left(permitted, first):]:
            rest = left.fill(first, c)
            per_token = cost(permitted[bisect.bisect_left(permitted, first + sum(rest))]) / (first + sum(rest))
            if best is None or per_token < best[0]:
                best = (per_token, rest)
        held = [first, *best[1]]
        total = permitted[bisect.bisect_left(permitted, sum(held))]  # downsized to its contents
        at = 0
        for n in held:
            i = left.take(n)
            bins[i], offsets[i], sizes[i] = bin_, at, total
            at += n
        bin_ += 1
    return bins, offsets, sizes


def word_tokens(text: Column) -> Column:
    """Words of a whole text and one end token."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^ \t-\r]+")).cast("bigint") + 1


def pieces(docs: DataFrame, id_col: str, tokens: Column, longest: int) -> DataFrame:
    """(_id, copy, piece, start, length): documents cut into pieces of at most ``longest`` tokens."""
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), F.greatest(tokens, F.lit(1)).cast("bigint").alias("_n"))
    # Rows with equal ids and lengths are the same row repeated; their count deals them out as copies.
    rows = rows.groupBy("_id", "_n").agg(F.count(F.lit(1)).alias("_c")).withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("_c").cast("int") - 1)))
    rows = rows.withColumn("piece", F.explode(F.sequence(F.lit(0), F.ceil(F.col("_n") / longest).cast("int") - 1)))
    start = F.col("piece").cast("bigint") * longest
    return rows.select("_id", "copy", "piece", start.alias("start"), F.least(F.lit(longest), F.col("_n") - start).cast("int").alias("length"))


def best_fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokens: Column | None = None,
             permitted: tuple[int, ...] = LENGTHS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row per piece: id, copy, piece, start, length (tokens of the document), shard, bin, bin_length, offset."""
    kind = dict(docs.dtypes)[id_col]
    tokens = word_tokens(F.col(f"`{text_col}`").cast("string")) if tokens is None else tokens
    rows = staged(pieces(docs, id_col, tokens, max(permitted)), "pieces")
    shards = max(1, math.ceil(rows.count() / shard_rows))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("_id", "copy", "piece"), F.lit(shards)).cast("int"))

    def run(g: pa.Table) -> pa.Table:
        g = g.sort_by([(c, "ascending") for c in ("length", "_id", "start", "copy")])
        for name, values in zip(("bin", "offset", "bin_length"), pack(g["length"].to_pylist(), permitted)):
            g = g.append_column(name, pa.array(values, pa.int32()))
        return g
    # Arrow, not pandas: a NULL id would turn a column of large ids to floats.
    out = rows.groupBy("shard").applyInArrow(
        run, f"_id {kind}, copy int, piece int, start bigint, length int, shard int, bin int, offset int, bin_length int")
    return out.withColumnRenamed("_id", id_col)
