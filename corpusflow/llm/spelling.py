"""Spelling variants of a corpus' words by Bloom-guided neighbourhoods.

Words are maximal runs of the letters ``a-z`` and U+00C0-U+00FF of whole texts
(ASCII letters lower-cased).  Two words are near if they differ by exactly one
inserted, deleted or replaced code point.

Method
  1. *Vocabulary.*  Every task counts its words, the counts are summed by word.
  2. *Filters.*  Each length has its own blocked Bloom filter (512-bit blocks, 6
     bits a word; lengths of ``LONG`` and more share one with finer blocks).  A
     large vocabulary is cut further by a hash, and filters are broadcast in
     passes of at most ``BROADCAST`` bytes, whatever the vocabulary.
  3. *Probes.*  For every word all deletions, and all replacements by a letter
     later in code-point order, are probed: each pair is generated from one side
     only, and an insertion is the other word's deletion.  The hash of an edit
     follows from the word's hash (a polynomial, so one term changes or the
     tail is divided by the base); a text is built for positives only.
  4. *Exact join.*  Positives meet the vocabulary by their text, which removes
     false positives; a filter has no false negatives.
  5. A word's form is its near word of largest count (ties: least in code-point
     order) if that count is ``ratio`` times the word's or more.  Forms are
     followed to the last by pointer jumping; counts grow along a chain, so
     there are no cycles.

Defined results: NULL and empty texts have no words; a NULL id is written as the
empty text where ids matter (:func:`vocabulary`'s ``drop_every``); repeated rows
count again; an empty table gives an empty result; other columns are ignored;
words may have any length.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.llm.common import staged
from corpusflow.llm.words import mix

LEAST_LENGTH, LEAST_COUNT, RATIO = 6, 5, 5
LETTERS = [*range(ord("a"), ord("z") + 1), *range(0xC0, 0x100)]
FLUSH = 200_000       # different words a task holds before it hands on their counts
LONG = 64             # words of this length and more share one length class
BITS, LONG_BITS = 16, 256  # filter bits a word; long words have many edits, and their texts are dear
SHARD = 1 << 21       # bytes of one filter
BROADCAST = 1 << 24   # bytes of the filters of one pass
PROBES = 1 << 21      # edits hashed at a time

_BASE = 0xD1342543DE82EF95
_INVERSE = np.uint64(pow(_BASE, -1, 1 << 64))
_VALUE = mix(np.arange(len(LETTERS), dtype=np.uint64) + np.uint64(7 << 40))
_RANK = np.zeros(256, np.int64)
_RANK[LETTERS] = np.arange(len(LETTERS))


# --- vocabulary -------------------------------------------------------------

def _counts(least: int, drop_every: int):
    run_of = re.compile("[a-zÀ-ÿ]{%d,}" % least)

    def words(key, text: str) -> Iterator[tuple[str, int]]:
        text = text.encode().lower().decode()  # of bytes: ASCII letters only
        found = run_of.findall(text) if len(text) < 1 << 20 else (m[0] for m in run_of.finditer(text))
        head = zlib.crc32(f"{'' if key is None else key}:".encode())
        for word, n in Counter(found).items():
            if drop_every and (h := zlib.crc32(word.encode(), head)) % drop_every == 0:
                at = h % len(word)
                word = word[:at] + word[at + 1:]
                if len(word) < least:
                    continue
            yield word, n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            b = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
            held.clear()
            return b
        for b in batches:
            for key, text in zip(b.column(0).to_pylist(), b.column(1)):
                for word, n in words(key, text.as_py() or ""):
                    held[word] += n
                if len(held) >= FLUSH:
                    yield out()
        if held:
            yield out()
    return run


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH,
               least_count: int = LEAST_COUNT, drop_every: int = 0) -> DataFrame:
    """(word, n): words of at least ``least_length`` code points that occur ``least_count`` times or more.

    With ``drop_every``, a run loses one code point before it is counted where crc32(``<id>:<run>``) divides by it.
    """
    src = docs.select(F.col(f"`{id_col}`").cast("string").alias("_id"), F.col(f"`{text_col}`").cast("string").alias("_text"))
    found = src.where("_text is not null").mapInArrow(_counts(least_length, drop_every), "word string, n bigint")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


# --- hashes and filters -----------------------------------------------------

def ranks(words: list[str]) -> np.ndarray:
    """Letters of words of one length as a matrix of alphabet positions."""
    return _RANK[np.frombuffer("".join(words).encode("latin-1"), np.uint8)].reshape(len(words), -1)


def _powers(length: int) -> np.ndarray:
    out = np.full(length, np.uint64(_BASE), np.uint64)
    out[0] = 1
    return np.cumprod(out)


def hashes(words: np.ndarray) -> np.ndarray:
    """Polynomial hashes of words given as a matrix of letters."""
    return (_VALUE[words] * _powers(words.shape[1])).sum(1)


def length_class(length: int) -> int:
    return min(length, LONG)


class Filters:
    """The filters of one pass: per length class the number of parts, words of a filter, and the parts held."""

    def __init__(self, sizes: dict[int, tuple[int, int]]):
        self.sizes = sizes  # class: (parts, blocks of a part)
        self.held: dict[tuple[int, int], np.ndarray] = {}

    def places(self, cls: int, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(part, first 64-bit word of the block, six 9-bit places in it) of hashes."""
        parts, blocks = self.sizes[cls]
        x = mix(h)
        part = (mix(x) % np.uint64(parts)).astype(np.int32)
        return part, (((x >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)).astype(np.int64) * 8, mix(x ^ np.uint64(cls))

    def seen(self, cls: int, h: np.ndarray) -> np.ndarray:
        """Indexes of the hashes that a held filter may contain."""
        if not len(h) or not any(c == cls for c, _ in self.held):
            return np.empty(0, np.int64)
        part, block, places = self.places(cls, h)
        out = []
        for p in range(self.sizes[cls][0]):
            bits = self.held.get((cls, p))
            if bits is None:
                continue
            own = np.flatnonzero(part == p) if self.sizes[cls][0] > 1 else np.arange(len(h))
            for j in range(6):
                at = (places[own] >> np.uint64(9 * j)) & np.uint64(511)
                own = own[(bits[block[own] + (at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1]
            out.append(own)
        return np.concatenate(out) if out else np.empty(0, np.int64)


def by_length(words: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, indexes, letter matrix) of the words of each length."""
    sizes = np.array([len(w) for w in words], np.int64)
    for n in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == n)
        step = max(1, PROBES // n)
        for s in range(0, len(at), step):
            yield n, at[s:s + step], ranks([words[i] for i in at[s:s + step]])


def _bits_of(filters: Filters):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for n, _, letters in by_length(b.column(0).to_pylist()):
                cls = length_class(n)
                part, block, places = filters.places(cls, hashes(letters))
                at = (places[:, None] >> (np.arange(6, dtype=np.uint64) * np.uint64(9))) & np.uint64(511)
                slot = (block[:, None] + (at >> np.uint64(6)).astype(np.int64)).ravel()
                key, where = np.unique(slot * (1 << 20) + np.repeat(part, 6), return_inverse=True)
                bits = np.zeros(len(key), np.uint64)
                np.bitwise_or.at(bits, where, (np.uint64(1) << (at & np.uint64(63))).ravel())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), cls, np.int32)), pa.array((key % (1 << 20)).astype(np.int32)),
                                                  pa.array(key >> 20), pa.array(bits.view(np.int64))], ["cls", "part", "slot", "bits"])
    return run


def passes(vocab: DataFrame) -> Iterator[Filters]:
    """The filters of the vocabulary, at most ``BROADCAST`` bytes at a time (built by Spark, a bounded table a pass)."""
    counts = {r["c"]: r["n"] for r in vocab.groupBy(F.least(F.length("word"), F.lit(LONG)).alias("c")).agg(F.count(F.lit(1)).alias("n")).collect()}
    sizes = {}
    for c, n in counts.items():
        size = n * (LONG_BITS if c == LONG else BITS) // 8
        parts = -(-size // SHARD) or 1
        sizes[c] = (parts, max(1, -(-size // parts // 64)))
    shards = [(c, p) for c in sorted(sizes) for p in range(sizes[c][0])]
    at = 0
    while at < len(shards):
        end, total = at, 0
        while end < len(shards) and (end == at or total + 64 * sizes[shards[end][0]][1] <= BROADCAST):
            total += 64 * sizes[shards[end][0]][1]
            end += 1
        own, out = shards[at:end], Filters(sizes)
        own_classes = sorted({c for c, _ in own})
        got = (vocab.where(F.least(F.length("word"), F.lit(LONG)).isin(own_classes)).select("word")
               .mapInArrow(_bits_of(out), "cls int, part int, slot bigint, bits bigint")
               .where((F.col("cls") * (1 << 20) + F.col("part")).isin([c * (1 << 20) + p for c, p in own]))
               .groupBy("cls", "part", "slot").agg(F.bit_or("bits").alias("bits")).toArrow())
        cls, part, slot, bits = (got.column(c).to_numpy() for c in ("cls", "part", "slot", "bits"))
        for c, p in own:
            mine = (cls == c) & (part == p)
            out.held[c, p] = np.zeros(8 * sizes[c][1], np.uint64)
            out.held[c, p][slot[mine]] = bits[mine].view(np.uint64)
        yield out
        at = end


# --- probes -----------------------------------------------------------------

def probe(words: list[str], filters: Filters, least: int) -> Iterator[tuple[np.ndarray, list[str]]]:
    """(index of the word, edited text) of the edits that the filters may contain."""
    for n, index, letters in by_length(words):
        power, step = _powers(n), max(1, PROBES // (len(LETTERS) * n))
        for s in range(0, len(index), step):
            own, rows = letters[s:s + step], index[s:s + step]
            term = _VALUE[own] * power
            whole = term.sum(1)
            if n > least:
                upto = np.cumsum(term, axis=1)
                # Deleting either of two equal neighbours gives one text: only the first is probed.
                fresh = np.ones(own.shape, bool)
                fresh[:, 1:] = own[:, 1:] != own[:, :-1]
                r, at = np.nonzero(fresh)
                h = ((upto - term) + (whole[:, None] - upto) * _INVERSE)[r, at]
                hit = filters.seen(length_class(n - 1), h)
                yield rows[r[hit]], [words[i][:p] + words[i][p + 1:] for i, p in zip(rows[r[hit]], at[hit])]
            width = max(1, PROBES // (len(LETTERS) * len(own)))
            for a in range(0, n, width):
                part = own[:, a:a + width]
                r, at, to = np.nonzero(part[:, :, None] < np.arange(len(LETTERS)))
                h = whole[r] + (_VALUE[to] - _VALUE[part[r, at]]) * power[a + at]
                hit = filters.seen(length_class(n), h)
                yield rows[r[hit]], [words[i][:p] + chr(LETTERS[x]) + words[i][p + 1:] for i, p, x in zip(rows[r[hit]], a + at[hit], to[hit])]


def _probes(sent, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for index, edits in probe(b.column(0).to_pylist(), sent.value, least):
                if edits:
                    rows = pa.array(index)
                    yield pa.RecordBatch.from_arrays([b.column(0).take(rows), b.column(1).take(rows), pa.array(edits, pa.string())],
                                                     ["word", "n", "near"])
    return run


def near_pairs(vocab: DataFrame, least_length: int = LEAST_LENGTH) -> DataFrame:
    """(word, n, near, near_n): every pair of near words once, from the side that generated it."""
    spark, found = vocab.sparkSession, None
    for filters in passes(vocab):
        classes = {c for c, _ in filters.held}
        probed = sorted({x for c in classes for x in (c, min(c + 1, LONG))})
        own = vocab.where(F.least(F.length("word"), F.lit(LONG)).isin(probed))
        positives = own.mapInArrow(_probes(spark.sparkContext.broadcast(filters), least_length), "word string, n bigint, near string")
        pairs = staged(positives.join(vocab.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
                       .select("word", "n", "near", "near_n"), "near-words")
        found = pairs if found is None else found.union(pairs)
    return found if found is not None else spark.createDataFrame([], "word string, n bigint, near string, near_n bigint")


def last_forms(forms: DataFrame) -> DataFrame:
    """(word, root): forms (word, form) followed to the last; the paths halve in every round."""
    up = staged(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        over = up.select(F.col("word").alias("root"), F.col("root").alias("_over"))
        new = staged(up.join(over, "root", "left").select("word", F.coalesce("_over", "root").alias("root"),
                                                          F.col("_over").isNotNull().alias("moved")), "forms")
        up = new.select("word", "root")
        if not new.where("moved").limit(1).count():
            return up


def variants(vocab: DataFrame, least_length: int = LEAST_LENGTH, ratio: int = RATIO) -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n."""
    vocab = staged(vocab, "vocabulary")
    pairs = near_pairs(vocab, least_length)
    both = pairs.union(pairs.select("near", "near_n", "word", "n"))
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), F.col("near").alias("near"))).alias("b"))
    taken = -F.col("b.m") >= ratio * F.col("n")
    rows = staged(vocab.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"),
        F.when(taken, F.col("b.near")).alias("form"), F.when(taken, -F.col("b.m")).alias("form_n")), "variants")
    roots = last_forms(rows.where("form is not null"))
    return rows.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
