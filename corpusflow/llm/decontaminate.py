"""Benchmark decontamination by CGK embedding and bit-sampling LSH.

A document is contaminated by a benchmark item when some stretch of its text is
within ``floor(rate * length)`` edits of the item (texts lower-cased, white space
collapsed to one space).  Documents are scanned whole, in one pass without a
shuffle:

1. *Windows.*  An item with at most K edits, cut into K + s pieces, keeps s
   pieces unchanged and at one place up to K characters.  An Aho-Corasick
   automaton finds the pieces; places where s pieces of an item agree give the
   item-sized windows.  This loses no match (pigeonhole), it only spares the
   windows that cannot match.
2. *Embedding.*  The CGK random walk reads a window: at step j it writes the
   character under it and goes on or stays by a random bit of (j, character).
   Windows at edit distance k get embeddings at Hamming distance O(k^2).
3. *LSH.*  Each repetition draws its own walk and ``SAMPLES`` coordinates; a
   window whose sampled characters equal the item's is a candidate.  The number
   of repetitions is doubled until items with K random edits are found with
   ``RECALL`` (:func:`repetitions`).  A block that does not reach it with
   ``MOST_REPETITIONS`` goes without steps 2 and 3: all its windows are verified.
4. *Verification.*  The exact least edit distance of the item to any stretch
   around the window, by bit-parallel dynamic programming.

Items are broadcast in blocks of at most ``BLOCK_CHARS`` characters, one pass
over the documents for each block, so what is broadcast is bounded.

Defined results: NULL and empty texts and items match nothing; items below
``MIN_CHARS`` characters match where a document holds them verbatim between word
boundaries (:func:`apart`), not with edits; a caller may leave out items of fewer
than ``least`` characters (by default none is left out); several matches of an
item in a document count once, the closest; items with equal texts all match;
repeated document rows give repeated results; empty tables give an empty result;
other columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RATE, SEEDS, MIN_CHARS = 0.1, 3, 25
SAMPLES, RECALL, START_REPETITIONS, MOST_REPETITIONS = 2, 0.99, 16, 1024
BLOCK_CHARS = 4_000_000


def normal(text: str | None) -> str:
    return " ".join(text.lower().split()) if text else ""


# Scripts without spaces between words (Thai, Lao, Burmese, Khmer, kana, Han): a word can end at any character.
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")


def apart(a: str, b: str) -> bool:
    """Whether there is a word boundary between two neighbouring characters (either may be empty)."""
    return any(not c or unicodedata.category(c)[0] not in "LMN" or bool(_UNSPACED.match(c)) for c in (a, b))


class Walk:
    """CGK embeddings of many strings under many repetitions, at each repetition's sampled coordinates."""

    def __init__(self, repetitions: int, longest: int, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.repetitions, self.rng_words = repetitions, rng.integers(-(1 << 63), 1 << 63, (2 * longest + 1, repetitions), dtype=np.int64)
        # Sampled coordinates as shares of the walk, so that they scale with the window.
        self.shares = np.sort(rng.random((SAMPLES, repetitions)), axis=0)

    def coordinates(self, length: int) -> np.ndarray:
        return (self.shares * (2 * length - 1)).astype(np.int64)

    def __call__(self, strings: list[np.ndarray], length: int) -> np.ndarray:
        """(strings, SAMPLES, repetitions) sampled characters; strings are code points, ``length`` sets the coordinates."""
        width = max(len(s) for s in strings) + 1
        text = np.zeros((len(strings), width), np.int32)  # 0 pads
        for i, s in enumerate(strings):
            text[i, :len(s)] = s
        at = np.zeros((len(strings), self.repetitions), np.int64)
        rows = np.arange(len(strings))[:, None]
        wanted = self.coordinates(length)
        out = np.zeros((len(strings), SAMPLES, self.repetitions), np.int32)
        for j in range(int(wanted.max()) + 1):
            c = text[rows, at]
            for k, r in zip(*np.nonzero(wanted == j)):
                out[:, k, r] = c[:, r]
            step = (self.rng_words[j] >> ((c ^ (c >> 6)) & 63)) & 1
            at = np.minimum(at + step, width - 1)
        return out


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.int32)


def edited(text: str, edits: int, rng: np.random.Generator) -> str:
    """``text`` after random insertions, deletions and substitutions of its own characters."""
    out = list(text)
    for _ in range(edits):
        i, kind = int(rng.integers(0, len(out))), int(rng.integers(0, 3))
        c = text[int(rng.integers(0, len(text)))]
        out[i:i + (kind != 0)] = [] if kind == 1 else [c]
    return "".join(out)


def repetitions(items: list[str], rate: float = RATE, target: float = RECALL, seed: int = 5) -> int:
    """Least power-of-two number of repetitions that finds edited items with the target recall (on at most 100 items).

    0 if ``MOST_REPETITIONS`` do not reach it.
    """
    rng = np.random.default_rng(seed)
    some = [items[i] for i in rng.permutation(len(items))[:100]]
    pairs = [(codes(t), codes(edited(t, int(rate * len(t)), rng))) for t in some for _ in range(3)]
    n = START_REPETITIONS
    while n <= MOST_REPETITIONS:
        walk = Walk(n, max(map(len, some), default=1))
        found = 0
        for a, b in pairs:
            e = walk([a, b], len(a))
            found += bool((e[0] == e[1]).all(axis=0).any())
        if found >= target * len(pairs):
            return n
        n *= 2
    return 0


def distance(item: str, text: str) -> int:
    """Least edit distance of ``item`` to any stretch of ``text`` (bit-parallel)."""
    masks: dict[str, int] = defaultdict(int)
    for i, c in enumerate(item):
        masks[c] |= 1 << i
    m = len(item)
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score, best = full, 0, m, m
    for c in text:
        eq = masks.get(c, 0)
        across = (((eq & up) + up) ^ up) | eq | down
        plus, minus = down | ~(across | up) & full, up & across
        if plus & top:
            score += 1
        elif minus & top:
            score -= 1
        best = min(best, score)
        plus, minus = plus << 1 & full, minus << 1 & full
        right = eq | down
        up, down = minus | ~(right | plus) & full, plus & right
    return best


class Index:
    """The items of one block: pieces, embeddings (none if ``repeat`` is 0) and texts."""

    def __init__(self, items: list[tuple], repeat: int, rate: float = RATE):
        self.ids, self.texts = [i for i, _ in items], [t for _, t in items]
        self.short = [len(t) < MIN_CHARS for t in self.texts]
        self.edits = [0 if short else int(rate * len(t)) for t, short in zip(self.texts, self.short)]
        self.walk = Walk(repeat, max(map(len, self.texts), default=1)) if repeat else None
        self.sampled = [None if short or not repeat else self.walk([codes(t)], len(t))[0] for t, short in zip(self.texts, self.short)]
        self.seeds = []
        places: dict[str, list] = defaultdict(list)
        for n, (t, k) in enumerate(zip(self.texts, self.edits)):
            s = SEEDS if len(t) // (k + SEEDS) >= 6 and not self.short[n] else 1
            self.seeds.append(s)
            cuts = [len(t) * i // (k + s) for i in range(k + s + 1)]
            for a, b in zip(cuts, cuts[1:]):
                places[t[a:b]].append((n, a))
        self.automaton = ahocorasick.Automaton()
        for piece, at in places.items():
            self.automaton.add_word(piece, (len(piece), at))
        self.automaton.make_automaton()

    def windows(self, text: str) -> list[tuple[int, int, int, list[int]]]:
        """(item, first start, last start, starts) where enough pieces of an item agree; a short item's first place."""
        starts: dict[int, set] = defaultdict(set)
        whole: dict[int, int] = {}
        for end, (length, at) in self.automaton.iter(text):
            start = end + 1 - length
            for n, offset in at:
                if not self.short[n]:
                    starts[n].add((start - offset, offset))
                elif n not in whole and apart(text[max(0, start - 1):start], text[start]) and apart(text[end], text[end + 1:end + 2]):
                    whole[n] = start
        out = [(n, start, start, [start]) for n, start in whole.items()]
        for n, found in starts.items():
            k, s = self.edits[n], self.seeds[n]
            if len(found) < s:
                continue
            d = sorted(found)
            near = [False] * len(d)
            for i in range(len(d) - s + 1):
                if d[i + s - 1][0] - d[i][0] <= 2 * k and len({o for _, o in d[i:i + s]}) == s:
                    near[i:i + s] = [True] * s
                elif d[i + s - 1][0] - d[i][0] <= 2 * k:  # a repeated piece hides others: look at all that are near
                    close = [x for x in d[i:] if x[0] - d[i][0] <= 2 * k]
                    if len({o for _, o in close}) >= s:
                        near[i:i + len(close)] = [True] * len(close)
            kept = [x[0] for x, ok in zip(d, near) if ok]
            while kept:
                group = [x for x in kept if x - kept[0] <= 2 * k]
                out.append((n, group[0], group[-1], sorted(set(group))))
                kept = kept[len(group):]
        return out

    def matches(self, text: str | None) -> list[tuple]:
        """(item id, edit distance, item length) of every item found in a whole text."""
        text = normal(text)
        best: dict[int, int] = {}
        for n, first, last, starts in self.windows(text):
            item, k = self.texts[n], self.edits[n]
            length = len(item)
            if best.get(n) == 0:
                continue
            if self.short[n]:
                best[n] = 0
                continue
            if self.walk:
                inside = [text[max(0, s):max(0, s) + length] for s in starts]
                got = self.walk([codes(w) for w in inside], length)
                if not (got == self.sampled[n]).all(axis=1).any():
                    continue
            d = distance(item, text[max(0, first - k):last + length + 2 * k])
            if d <= k:
                best[n] = min(d, best.get(n, d))
        return [(self.ids[n], d, len(self.texts[n])) for n, d in sorted(best.items())]


def blocks(items: DataFrame, id_col: str, text_col: str, least: int = 1) -> Iterator[list[tuple]]:
    """The items (id, normal text) of ``least`` characters or more in id order, in blocks of bounded size."""
    held, size = [], 0
    rows = items.select(F.col(f"`{id_col}`").alias("i"), F.col(f"`{text_col}`").cast("string").alias("t")).orderBy("i", "t")
    for i, t in rows.toLocalIterator():
        t = normal(t)
        if len(t) < max(1, least):
            continue
        if held and size + len(t) > BLOCK_CHARS:
            yield held
            held, size = [], 0
        held.append((i, t))
        size += len(t)
    if held:
        yield held


_INDEXES: dict[str, Index] = {}


def cached_index(key: str, sent) -> Index:
    """The index of a broadcast block, kept by the worker process for its next tasks (the last few blocks)."""
    if key not in _INDEXES:
        while len(_INDEXES) >= 4:
            del _INDEXES[next(iter(_INDEXES))]
        _INDEXES[key] = Index(*sent.value)
    return _INDEXES[key]


def _sent(df: DataFrame, block: list[tuple], rate: float):
    """A function that gives the block's index inside a task."""
    repeat = repetitions([t for _, t in block if len(t) >= MIN_CHARS], rate)
    key, sent = uuid.uuid4().hex, df.sparkSession.sparkContext.broadcast((block, repeat, rate))
    return lambda: cached_index(key, sent)


def find(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
         item_text: str = "text", rate: float = RATE, least: int = 1) -> DataFrame:
    """One row per document and item found in it: id, item id (``item_<name>`` if both ids have one name), edit_distance, item_chars."""
    item_out = f"item_{item_col}" if item_col == id_col else item_col
    kinds = f"{id_col} {dict(docs.dtypes)[id_col]}, {item_out} {dict(items.dtypes)[item_col]}, edit_distance bigint, item_chars bigint"
    src = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").cast("string").alias("_text"))
    kind = items.select(F.col(f"`{item_col}`")).limit(0).toArrow().schema.field(0).type
    out = docs.sparkSession.createDataFrame([], kinds)
    for block in blocks(items, item_col, item_text, least):
        index = _sent(docs, block, rate)

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            own = index()
            for b in batches:
                rows, found = [], []
                for i, t in enumerate(b.column(1).to_pylist()):
                    for m in own.matches(t):
                        rows.append(i)
                        found.append(m)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(rows, pa.int32())), pa.array([m[0] for m in found], kind),
                     pa.array([m[1] for m in found], pa.int64()), pa.array([m[2] for m in found], pa.int64())],
                    [id_col, item_out, "edit_distance", "item_chars"])
        out = out.union(src.mapInArrow(run, kinds))
    return out


def contaminated(text: Column, index) -> Column:
    """Whether a whole text holds an item of the block."""
    @F.pandas_udf("boolean")
    def of(texts: pd.Series) -> pd.Series:
        own = index()
        return pd.Series([bool(own.matches(t)) for t in texts], dtype=bool)
    return of(text)


def clean(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
          rate: float = RATE, least: int = 1) -> DataFrame:
    """The rows of ``docs`` that hold no item, with all their columns (a filter per block, no shuffle)."""
    for block in blocks(items, item_col, item_text, least):
        docs = docs.where(~contaminated(F.col(f"`{text_col}`").cast("string"), _sent(docs, block, rate)))
    return docs
