"""Language identification by compression.

For each language a raw-content zstandard dictionary is made of ``SAMPLE_DOCS``
training documents (``SLICE_BYTES`` of each, from an offset given by a hash), a
bounded sample that is the same at every size.  A whole text is lower-cased,
reduced to its words, and compressed in pieces of ``PIECE_BYTES`` with
every dictionary, so the dictionary counts all along a long text; the language
with the smallest total wins.  ``accepted`` is false when the margin to the next
language is narrow (below ``MARGIN`` of its size).

Defined results: NULL text or no letter gives ``und`` with score 0; equal sizes
give the first language in alphabetical order with margin 0; without training rows
everything is ``und``; NULL languages are not learned; repeated rows get equal
answers; an empty table gives an empty result; other columns are ignored.  The
number of different languages is taken to be small (a dictionary for each is broadcast).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusflow.llm.common import fold

HELD_OUT = 1
SAMPLE_DOCS, SLICE_BYTES, PIECE_BYTES = 96, 1024, 2048
LEVEL, MARGIN = 5, 0.01
UNKNOWN = "und"


_WORD = re.compile(r"[^\W\d_]+")


def normal(text: str) -> bytes:
    """The words of a text (letters only), lower-cased, with one space between them."""
    return " ".join(_WORD.findall(text.lower())).encode()


def dictionaries(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                 sample: int = SAMPLE_DOCS) -> dict[str, bytes]:
    """Language -> dictionary content, from rows outside the held-out fold."""
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text"), F.col(f"`{lang_col}`").alias("_lang"))
    rows = (rows.where((fold("_id") != HELD_OUT) & F.col("_lang").isNotNull() & F.col("_text").rlike(r"\p{L}"))
                .withColumn("_h", F.xxhash64(F.lit("dictionary"), "_id")))
    # The cut of each language is found from the hashes alone; only the chosen texts leave their tasks.
    nth = F.row_number().over(Window.partitionBy("_lang").orderBy("_h"))
    cuts = {r["_lang"]: r["c"] for r in rows.select("_lang", "_h").withColumn("_n", nth).where(f"_n <= {sample}")
            .groupBy("_lang").agg(F.max("_h").alias("c")).collect()}
    if not cuts:
        return {}
    cut = F.create_map(*[x for k, v in cuts.items() for x in (F.lit(k), F.lit(v))])[F.col("_lang")]
    out: dict[str, bytes] = {}
    # Numbered again, in case an id is repeated more often than the sample is large.
    nth = F.row_number().over(Window.partitionBy("_lang").orderBy("_h", "_text"))
    chosen = rows.where(F.col("_h") <= cut).withColumn("_n", nth).where(f"_n <= {sample}")
    for lang, h, text in chosen.select("_lang", "_h", "_text").orderBy("_lang", "_n").toLocalIterator():
        data = normal(text)
        at = h % max(1, len(data) - SLICE_BYTES + 1)
        out[lang] = out.get(lang, b"") + b" " + data[at:at + SLICE_BYTES]
    return out


class Classifier:
    """Compressed sizes of a text under every language's dictionary."""

    def __init__(self, contents: dict[str, bytes], level: int = LEVEL):
        self.langs = sorted(contents)
        self.coders = []
        for lang in self.langs:
            d = zstandard.ZstdCompressionDict(contents[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=level)
            self.coders.append(zstandard.ZstdCompressor(level=level, dict_data=d, write_content_size=False,
                                                        write_checksum=False, write_dict_id=False))

    def __call__(self, text: str | None) -> tuple[str, float, bool, float]:
        """(language, score, accepted, margin)."""
        if text is None or not self.langs or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0, False, 0.0
        data = normal(text)
        pieces = [data[i:i + PIECE_BYTES] for i in range(0, len(data), PIECE_BYTES)]
        sizes = [sum(len(c.compress(p)) for p in pieces) for c in self.coders]
        order = sorted(range(len(sizes)), key=sizes.__getitem__)
        best, after = sizes[order[0]], sizes[order[min(1, len(order) - 1)]]
        margin = (after - best) / after if len(order) > 1 else 1.0
        return self.langs[order[0]], (margin + MARGIN / 10) / (margin + MARGIN), margin >= MARGIN, margin


def predict(docs: DataFrame, contents: dict[str, bytes], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, held_out, lang_pred, score, accepted, margin."""
    kind = dict(docs.dtypes)[id_col]
    sent = docs.sparkSession.sparkContext.broadcast(contents)
    src = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").cast("string").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classify = Classifier(sent.value)
        for b in batches:
            found = [classify(t) for t in b.column(1).to_pylist()]
            cols = [pa.array([x[i] for x in found], t) for i, t in enumerate((pa.string(), pa.float64(), pa.bool_(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], ["_id", "lang_pred", "score", "accepted", "margin"])
    out = src.mapInArrow(run, f"_id {kind}, lang_pred string, score double, accepted boolean, margin double")
    return out.select(F.col("_id").alias(id_col), (fold("_id") == HELD_OUT).alias("held_out"), "lang_pred", "score",
                      "accepted", "margin")
