"""JSON extraction from free model text.

The JSON span is the widest ``{...}`` or ``[...]``, whichever bracket opens
first; an absent or malformed span parses to NULL and is routed to rejects.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusflow.functions.text import col_

CURLY_SPAN = r"(?s)(\{.*\})"
SQUARE_SPAN = r"(?s)(\[.*\])"


def opens_with_object(text) -> Column:
    """True when a '{' occurs and comes before any '['."""
    t = col_(text)
    c, s = F.instr(t, "{"), F.instr(t, "[")
    return (c > 0) & ((s == 0) | (c < s))


def json_span(text) -> Column:
    """Widest JSON-looking span, or NULL when there is none."""
    t = col_(text)
    span = F.when(opens_with_object(t), F.regexp_extract(t, CURLY_SPAN, 1)) \
            .otherwise(F.regexp_extract(t, SQUARE_SPAN, 1))
    return F.nullif(span, F.lit(""))


def parse_object_or_list(text, list_field: str, item_schema: str) -> Column:
    """Parse ``{"<list_field>": [items]}`` or a bare ``[items]`` into ARRAY<item>.

    NULL when the span is missing, malformed, or of the wrong shape.
    """
    t = col_(text)
    span = json_span(t)
    obj = F.from_json(span, f"struct<{list_field}: array<{item_schema}>>")[list_field]
    arr = F.from_json(span, f"array<{item_schema}>")
    return F.when(opens_with_object(t), obj).otherwise(arr)


def sql_json_span(text_sql: str) -> str:
    """DuckDB twin of :func:`json_span`."""
    c, s = f"strpos({text_sql}, '{{')", f"strpos({text_sql}, '[')"
    return (f"nullif(CASE WHEN {c} > 0 AND ({s} = 0 OR {c} < {s}) "
            f"THEN regexp_extract({text_sql}, '(?s)(\\{{.*\\}})', 1) "
            f"ELSE regexp_extract({text_sql}, '(?s)(\\[.*\\])', 1) END, '')")
