"""Word-level text functions with Python ``str.split()`` semantics.

Python's whitespace is Unicode White_Space plus the ASCII separators
U+001C..U+001F; Java's ``(?U)\\s`` is exactly Unicode White_Space, so the
class below splits like Python (NBSP, U+3000, U+0085 included).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusflow.functions.keys import SHINGLE_HEX_DIGITS, md5_int

# The token pattern (Java regex) and its RE2 twin for DuckDB.
WORD_PATTERN = r"(?U)[^\s\x1c-\x1f]+"
SPACE_CLASS_RE2 = (r"\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
                   r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}")
WORD_PATTERN_RE2 = "[^" + SPACE_CLASS_RE2 + "]+"
TRIM_PATTERN = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"
_SP = r"[\s\x1c-\x1f]"


def col_(c) -> Column:
    """A column from a name or a column."""
    return F.col(c) if isinstance(c, str) else c


def words(text) -> Column:
    """Array of whitespace-separated tokens; NULL text gives an empty array."""
    return F.regexp_extract_all(F.coalesce(col_(text), F.lit("")), F.lit(WORD_PATTERN), 0)


def n_words(text) -> Column:
    """Number of words (counted by the regex engine, no array is built)."""
    return F.regexp_count(F.coalesce(col_(text), F.lit("")), F.lit(WORD_PATTERN))


def more_words_than(text, n: int) -> Column:
    """``n_words(text) > n``: the text is split at most ``n`` times, and something must follow."""
    return F.coalesce(F.get(_split_head(text, n), F.lit(n)), F.lit("")) != ""


def _split_head(text, n: int) -> Column:
    """The first ``n`` words and, as one more element, the rest (at most ``n`` splits, for any ``n``).

    ``split`` with a limit loops; a counted regex group would recurse once per
    word and overflow the stack for large ``n``.
    """
    start = F.regexp_replace(F.coalesce(col_(text), F.lit("")), rf"(?U)^{_SP}+", "")
    return F.split(start, rf"(?U){_SP}+", n + 1)


def first_n_words(text, n: int = 200) -> Column:
    """First ``n`` words re-joined by single spaces.

    At most ``n`` splits are made, so a long document is not split in full to
    keep its head.
    """
    return F.array_join(F.filter(F.slice(_split_head(text, n), 1, n), lambda w: w != ""), " ")


def strip_ws(text) -> Column:
    """Python ``str.strip()``: removes all leading/trailing whitespace."""
    return F.regexp_replace(col_(text), TRIM_PATTERN, "")


def word_ngrams(word_arr: Column, k: int = 3) -> Column:
    """Contiguous k-word windows joined by a space; none when fewer than k words.

    Built from ``arrays_zip`` of shifted slices so the lambda only touches its
    own element: a lambda that referenced the outer array would make Catalyst
    re-evaluate that array once per window.
    """
    n = F.size(word_arr)
    shifted = [F.slice(word_arr, j + 1, F.greatest(n, F.lit(1))).alias(f"w{j}") for j in range(k)]
    full = F.slice(F.arrays_zip(*shifted), 1, F.greatest(n - k + 1, F.lit(0)))
    grams = F.transform(full, lambda s: F.concat_ws(" ", *[s[f"w{j}"] for j in range(k)]))
    return F.when(n >= k, grams).otherwise(F.array().cast("array<string>"))


def all_shingles(text, k: int = 3) -> Column:
    """Lower-cased word k-shingles of ``text`` in order, repeats included.

    Whitespace runs become single spaces, then one native regex captures every
    k-word window with a zero-width lookahead anchored at word starts.  This
    equals ``word_ngrams(words(lower(text)), k)`` without per-window lambdas.
    """
    norm = F.trim(F.regexp_replace(F.lower(col_(text)), r"(?U)[\s\x1c-\x1f]+", " "))
    window = " ".join(["[^ ]+"] * k)
    return F.regexp_extract_all(F.coalesce(norm, F.lit("")), F.lit(f"(?<![^ ])(?=({window}))"), 1)


def shingles(text, k: int = 3) -> Column:
    """Distinct lower-cased word k-shingles of ``text`` (first-occurrence order)."""
    return F.array_distinct(all_shingles(text, k))


def shingle_hashes(shingle_arr: Column) -> Column:
    """28-bit md5 hash per shingle (products with 31-bit coefficients fit BIGINT)."""
    return F.transform(shingle_arr, lambda s: md5_int(s, SHINGLE_HEX_DIGITS))


def packed_hashes(shingle_arr: Column) -> Column:
    """The first 32 bits of the md5 of every shingle as one binary value (big-endian), from which a kernel takes the 28 bits.

    Four bytes a shingle go to Python, and no number is formatted or parsed on the way.
    """
    return F.unhex(F.array_join(F.transform(shingle_arr, lambda s: F.substring(F.md5(s), 1, 8)), ""))


def sql_words(text_sql: str) -> str:
    """DuckDB twin of :func:`words`."""
    return f"regexp_extract_all(coalesce({text_sql}, ''), '{WORD_PATTERN_RE2}')"
