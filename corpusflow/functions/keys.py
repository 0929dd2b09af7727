"""Keyed, reproducible randomness (replaces unseeded shuffles and choices).

``rand(seed)`` depends on partitioning, so every random decision is instead a
hash of ``seed|purpose|row key``: the same row gets the same number on any
cluster layout, and a SQL engine with ``md5`` can recompute it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

KEY_HEX_DIGITS = 15          # 60-bit order keys: ties are practically absent
SHINGLE_HEX_DIGITS = 7       # 28-bit shingle hashes: h * a + b fits in BIGINT


def _as_col(x) -> Column:
    if isinstance(x, Column):
        return x.cast("string")
    if isinstance(x, str) and x.startswith("col:"):
        return F.col(x[4:]).cast("string")
    return F.lit(str(x))


def md5_int(s: Column, digits: int = KEY_HEX_DIGITS) -> Column:
    """Leading ``digits`` hex digits of md5(s) as a non-negative BIGINT."""
    return F.conv(F.substring(F.md5(s), 1, digits), 16, 10).cast("bigint")


def keyed_hash(*parts, digits: int = KEY_HEX_DIGITS) -> Column:
    """Uniform BIGINT in [0, 16**digits) from md5('p1|p2|...')."""
    return md5_int(F.concat_ws("|", *[_as_col(p) for p in parts]), digits)


def keyed_choice(n: int | Column, *parts) -> Column:
    """Index in [0, n) chosen by keyed hash (one random choice per row)."""
    n_col = n if isinstance(n, Column) else F.lit(int(n))
    return F.pmod(keyed_hash(*parts), n_col.cast("bigint"))


def sql_keyed_hash(parts_sql: list[str], digits: int = KEY_HEX_DIGITS) -> str:
    """DuckDB twin of :func:`keyed_hash` (for oracle SQL)."""
    inner = ", ".join(parts_sql)
    return f"('0x' || substr(md5(concat_ws('|', {inner})), 1, {digits}))::BIGINT"
