"""Token ids as Arrow IPC files of equal-length sequences.

Documents are ordered by id with a range exchange (equal ids by a hash of their
text); each partition becomes one *shard*:

* ``<shard>.tokens.arrow``: an Arrow IPC file (stream plus footer) whose batches
  hold ``ids fixed_size_list<uint16 or uint32>[L]`` (the narrower type that holds
  the vocabulary) and ``mask fixed_size_list<bool>[L]`` (one bit a token: true
  for a token, false for the padding of the shard's last sequence).  All batches
  but the last have ``BATCH_ROWS`` sequences, so sequence i is found without a
  scan and its ids and mask are views of the mapped file;
* ``<shard>.docs.arrow``: doc_id, start (in the shard) and n_tokens.

A task writes files under a name of its own and reports them in its rows of the
manifest; the manifest is a Spark table, so only successful attempts count and
files of lost executors are never read.  Memory is bounded by one batch of
sequences and one document.

Tokens: ids are those of the given tokenizers file for the whole text with
``add_special_tokens=False`` (see :class:`Encoder`).  Each document ends with ``end_id``.

Defined results: NULL and empty texts have the end id alone; NULL document ids
come first; repeated rows are written repeatedly; an empty table gives an empty
manifest; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusflow.llm.common import staged
from corpusflow.session import scratch_root

SEQ_LEN, BATCH_ROWS, END_ID = 1024, 64, 1
MEMO_PIECES, MEMO_WORDS, MEMO_CHARS = 300_000, 800_000, 64
# Fixed value: the word pattern of the public lower-case word BPE tokenizer.
WORD_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
# The same split on plain lower-case text, and what makes a text not plain.
_WORD = re.compile("[a-zßà-öø-ÿ]+|[0-9]|[!-&(-/:-@\\[-`{-~]+")
_ODD = re.compile(r"[^ \t\r\n!-&(-~À-ÖØ-öø-ÿ]|<\|")
_PIECE = re.compile(r"[^ \t\r\n]+")


def open_fs(path: str) -> tuple[fs.FileSystem, str]:
    """(file system, path in it) of a URI or a local path."""
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path.removeprefix("file:")


def words_are_independent(spec: dict) -> bool:
    """Whether the tokenizer lower-cases, drops white space, splits as ``WORD_SPLIT`` and ends each word with ``</w>``."""
    norm, pre = spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}
    splits = [p["pattern"].get("Regex") for p in pre.get("pretokenizers", []) if p["type"] == "Split"]
    plain = all(re.fullmatch(r"<\|\w+\|>", a["content"]) and not a["lstrip"] and not a["rstrip"] for a in spec["added_tokens"])
    return (plain and [n["type"] for n in norm.get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]
            and splits == [WORD_SPLIT] and spec["model"].get("end_of_word_suffix") == "</w>")


class Encoder:
    """Whole texts to little-endian uint32 ids, the same as the tokenizer gives for the whole text.

    For tokenizers whose words are independent, texts of plain characters
    (ASCII without the apostrophe, Latin-1 letters) are split into words here and
    each different word is encoded once; every other piece between spaces is
    encoded by the tokenizer as it is.  What is remembered (pieces between white
    space, and words) is bounded: it starts afresh when full.
    """

    def __init__(self, tokenizer_json: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        spec = json.loads(tokenizer_json)
        self.by_word = words_are_independent(spec)
        self.memo: dict[str, bytes] = {}  # by piece
        self.words: dict[str, bytes] = {}
        if self.by_word:
            vocab = spec["model"]["vocab"]
            self.word_end = np.zeros(max(vocab.values()) + 1, bool)
            self.word_end[[i for w, i in vocab.items() if w.endswith("</w>")]] = True

    def id_type(self, *others: int) -> pa.DataType:
        """Narrowest unsigned type that holds every id."""
        return pa.uint16() if max(self.tokenizer.get_vocab_size(with_added_tokens=True) - 1, *others) < 1 << 16 else pa.uint32()

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _pieces(self, text: str) -> list[str]:
        """Text between white space, lower-cased where that is all the tokenizer's normalisation does."""
        if not _ODD.search(text):
            return text.lower().split()
        return [p if _ODD.search(p) else p.lower() for p in _PIECE.findall(text)]

    def _learn(self, pieces: list[str]) -> None:
        split = {p: _WORD.findall(p) for p in pieces if not _ODD.search(p)}
        new = list({w for words in split.values() for w in words}.difference(self.words))
        long = [w for w in new if len(w) > MEMO_CHARS]
        for at in range(0, len(new), 1000):
            part = new[at:at + 1000]
            ids = self._ids(" ".join(part))
            cuts = (np.flatnonzero(self.word_end[ids]) + 1).tolist()
            assert len(cuts) == len(part) and cuts[-1] == len(ids)
            for w, s, e in zip(part, [0, *cuts], cuts):
                self.words[w] = ids[s:e].tobytes()
        for p in pieces:
            self.memo[p] = b"".join(map(self.words.__getitem__, split[p])) if p in split else self._ids(p).tobytes()
        for w in long:
            del self.words[w]

    def __call__(self, texts: list[str]) -> list[bytes]:
        if not self.by_word:
            return [self._ids(t).tobytes() for t in texts]
        if len(self.words) > MEMO_WORDS:
            self.words.clear()
        lists = [self._pieces(t) for t in texts]
        new = set().union(*lists).difference(self.memo)
        full = len(self.memo) > MEMO_PIECES
        self._learn(list(new))
        out = [b"".join(map(self.memo.__getitem__, x)) for x in lists]
        for p in new if full else (p for p in new if len(p) > MEMO_CHARS):
            del self.memo[p]
        return out


_ENCODERS: dict[str, Encoder] = {}


def encoder(tokenizer_json: str) -> Encoder:
    """The encoder of a tokenizer, kept by the worker process for its next tasks."""
    if tokenizer_json not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[tokenizer_json] = Encoder(tokenizer_json)
    return _ENCODERS[tokenizer_json]


class SequenceWriter:
    """Cuts a stream of ids into sequences of ``length`` and writes full batches of them."""

    def __init__(self, sink, length: int, kind: pa.DataType):
        self.length, self.size, self.dtype = length, length * BATCH_ROWS, kind.to_pandas_dtype()
        self.schema = pa.schema([("ids", pa.list_(kind, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.out = pa.ipc.new_file(sink, self.schema)
        self.held, self.count = [], 0

    def add(self, ids: np.ndarray) -> None:
        self.held.append(ids.astype(self.dtype))
        self.count += len(ids)
        if self.count >= self.size:
            ids = np.concatenate(self.held)
            full = len(ids) // self.size * self.size
            for at in range(0, full, self.size):
                self._write(ids[at:at + self.size])
            self.held, self.count = [ids[full:]], len(ids) - full

    def _write(self, ids: np.ndarray) -> None:
        pad = -len(ids) % self.length
        mask = np.arange(len(ids) + pad) < len(ids)
        cols = [pa.array(np.concatenate((ids, np.zeros(pad, self.dtype)))), pa.array(mask)]
        self.out.write_batch(pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(c, self.length) for c in cols],
                                                        schema=self.schema))

    def close(self) -> None:
        if self.count:
            self._write(np.concatenate(self.held))
        self.out.close()


MANIFEST = "shard int, tokens_file string, docs_file string, n_docs bigint, n_tokens bigint"


def write(docs: DataFrame, path: str, tokenizer_file: str, id_col: str = "doc_id", text_col: str = "text",
          seq_len: int = SEQ_LEN, end_id: int = END_ID) -> DataFrame:
    """Write the shards of ``docs`` under ``path``; the manifest, with each shard's first id and base offset.

    The base offset is a running sum over the manifest (one row a shard).
    """
    with open(tokenizer_file, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())
    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("_text"))
    order = [F.col("_id"), F.xxhash64("_text")]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = writer = None
        end = np.array([end_id], "<u4")
        for b in batches:
            if not b.num_rows:
                continue
            if writer is None:
                encode = encoder(spec.value)
                shard = TaskContext.get().partitionId()
                files, place = open_fs(path)
                files.create_dir(place, recursive=True)
                name = f"{shard:06d}-{uuid.uuid4().hex}"
                names = [f"{path}/{name}.tokens.arrow", f"{path}/{name}.docs.arrow"]
                sinks = [files.open_output_stream(open_fs(n)[1]) for n in names]
                writer = SequenceWriter(sinks[0], seq_len, encode.id_type(end_id))
                schema = pa.schema([("doc_id", b.schema.field(0).type), ("start", pa.int64()), ("n_tokens", pa.int64())])
                index, first, n_docs, n_tokens = pa.ipc.new_file(sinks[1], schema), b.column(0)[:1], 0, 0
            starts, sizes = [], []
            for found in encode(b.column(1).to_pylist()):
                ids = np.concatenate((np.frombuffer(found, "<u4"), end))
                writer.add(ids)
                starts.append(n_tokens)
                sizes.append(len(ids))
                n_tokens += len(ids)
            n_docs += b.num_rows
            index.write_batch(pa.RecordBatch.from_arrays([b.column(0), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64())],
                                                         schema=schema))
        if writer is not None:
            writer.close()
            index.close()
            for s in sinks:
                s.close()
            yield pa.RecordBatch.from_arrays(
                [first, pa.array([shard], pa.int32()), *[pa.array([n]) for n in names],
                 pa.array([n_docs], pa.int64()), pa.array([n_tokens], pa.int64())],
                ["first_id", "shard", "tokens_file", "docs_file", "n_docs", "n_tokens"])

    manifest = staged(rows.mapInArrow(run, f"first_id {kind}, {MANIFEST}"), "manifest")
    before = Window.orderBy(F.asc_nulls_first("first_id"), "shard").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0).cast("bigint")))


def open_file(path: str) -> pa.ipc.RecordBatchFileReader:
    """An IPC file; a local one is mapped, so its arrays are views."""
    files, place = open_fs(path)
    if isinstance(files, fs.LocalFileSystem):
        return pa.ipc.open_file(pa.memory_map(place))
    return pa.ipc.open_file(files.open_input_file(place))


def sequence(file: pa.ipc.RecordBatchFileReader, i: int) -> tuple[np.ndarray, pa.BooleanArray]:
    """(ids, mask) of sequence ``i`` of a tokens file, without copying (the mask stays bits)."""
    b, at = file.get_batch(i // BATCH_ROWS), i % BATCH_ROWS
    return b.column("ids")[at].values.to_numpy(zero_copy_only=True), b.column("mask")[at].values


def documents(tokens_file: str, docs_file: str) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Batches of a shard's document index with the ids of each document, read from its sequences in order."""
    tokens, index = open_file(tokens_file), open_file(docs_file)
    batch, held, at = 0, np.empty(0, np.uint16), 0
    for k in range(index.num_record_batches):
        b, out = index.get_batch(k), []
        for start, n in zip(b.column("start").to_pylist(), b.column("n_tokens").to_pylist()):
            parts = [held[start - at:start - at + n]]
            while at + len(held) < start + n:
                at += len(held)
                got = tokens.get_batch(batch)
                batch += 1
                held = got.column("ids").flatten().to_numpy()[:got.column("mask").flatten().true_count]
                parts.append(held[:start + n - at])
            out.append(np.concatenate(parts) if len(parts) > 1 else parts[0])
        yield b, out


def read(manifest: DataFrame, shards: int) -> DataFrame:
    """One row per document from the files: doc_id, start (over all shards), n_tokens, ids_crc32.

    ``shards`` tasks read one shard each.
    """
    kind = dict(manifest.dtypes)["first_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for m in batches:
            for base, tokens_file, docs_file in zip(*(m.column(c).to_pylist() for c in range(3))):
                for b, ids in documents(tokens_file, docs_file):
                    starts = pa.array(np.asarray(b.column("start")) + base)
                    crc = pa.array([zlib.crc32(np.ascontiguousarray(x, "<u4")) for x in ids], pa.int64())
                    yield pa.RecordBatch.from_arrays([b.column("doc_id"), starts, b.column("n_tokens"), crc],
                                                     ["doc_id", "start", "n_tokens", "ids_crc32"])
    files = manifest.select("base", "tokens_file", "docs_file").repartition(max(1, shards))
    return files.mapInArrow(run, f"doc_id {kind}, start bigint, n_tokens bigint, ids_crc32 bigint")


def new_path(spark: SparkSession) -> str:
    """A fresh folder for token files on the shared storage."""
    return f"{scratch_root(spark)}/tokens-{uuid.uuid4().hex}"
