"""Expansions of model results into rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def explode_items(df: DataFrame, items_col: str = "items", key_col: str = "id",
                  drop_empty: bool = True) -> DataFrame:
    """One row per item with its position; empty/NULL items dropped.

    Adds ``item_key`` = ``<key>#<pos>`` (T3: a unique key per produced row,
    which is what the next stage's ledger records).
    """
    out = df.select("*", F.posexplode(F.col(items_col)).alias("pos", "item")).drop(items_col)
    if drop_empty:
        out = out.where(F.col("item").isNotNull())
    return out.withColumn("item_key", F.concat_ws("#", F.col(key_col).cast("string"), F.col("pos").cast("string")))


def explode_prompts(df: DataFrame, items_col: str = "items", id_col: str = "id", url_col: str | None = "url") -> DataFrame:
    """One row per generated prompt, id ``<id>_<pos>``, url '' when absent."""
    out = df.select("*", F.posexplode(F.col(items_col)).alias("pos", "item")).drop(items_col)
    url = F.coalesce(F.col(url_col).cast("string"), F.lit("")) if url_col and url_col in df.columns else F.lit("")
    return (out.withColumn("prompt_id", F.concat(F.col(id_col).cast("string"), F.lit("_"), F.col("pos").cast("string")))
               .withColumn("url", url)
               .withColumn("prompt", F.col("item.prompt"))
               .drop("item"))
