"""Polymorphic persona values (F6, T5) on Spark's VARIANT type.

A value is usable when it is truthy and either a string, or an object whose
``persona`` field is a string (an empty string there is still usable).
Numbers, arrays, objects without a string ``persona`` and empty values are
skipped.  Types are tested with ``schema_of_variant`` because a cast would
turn the number 7 into the string '7'.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusflow.functions.text import col_


def persona_text(v) -> Column:
    """Text to deduplicate, or NULL when the row is skipped."""
    v = col_(v)
    top = F.schema_of_variant(v)
    inner = F.try_variant_get(v, "$.persona", "variant")
    as_str = F.try_variant_get(v, "$", "string")
    return (F.when((top == "STRING") & (as_str != ""), as_str)
             .when(top.startswith("OBJECT") & (F.schema_of_variant(inner) == "STRING"),
                   F.try_variant_get(v, "$.persona", "string")))
