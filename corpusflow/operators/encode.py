"""Tokenise, truncate, mask, filter, batch and pad chat examples.

A token carries a label iff its first character lies in a trained span of the
rendered chat text: from the end of an assistant message's header (from its
start, if the message before is the assistant's too or there is none) to the end
of that message.  Everything else, with the whole generation prefix, is -100.

* Any tokenizer plugs in through :func:`offset_tokenizer`: it gets the complete
  rendered text and returns ids with the character offsets of their starts, so
  the ids are exactly those of the rendered text.
* The default tokenizer is whitespace with hashed ids, which a SQL engine can
  recompute.  Its tokens never cross a message border, so each message is
  tokenised once where it sits and its header tokens are counted.

Labels and ids are then cut to ``max_len`` (attention mask = ones).  Empty
messages and broken role alternation are errors, as in the chat template, or are
kept or rejected on request (``on_invalid``).
"""


from typing import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusflow.functions.keys import SHINGLE_HEX_DIGITS, keyed_hash, md5_int
from corpusflow.functions.text import col_, words
from corpusflow.operators.messages import BOS, MESSAGE_INDENT, alternates, header_text, message_text, render_chat
from corpusflow.operators.positions import batch_ids, exact_positions, running_sum

IGNORE = -100


def token_id(tok: Column) -> Column:
    """Whitespace tokenizer id: 28-bit md5 of the token (hashing vocabulary)."""
    return md5_int(tok, SHINGLE_HEX_DIGITS).cast("int")


def message_token_ids(messages) -> Column:
    """ARRAY<ARRAY<INT>>: token ids of each rendered message (whitespace tokenizer)."""
    return F.transform(col_(messages), lambda m: F.transform(words(message_text(m["role"], m["content"])), token_id))


def offset_tokenizer(encode_batch: Callable[[list[str]], list[tuple[list[int], list[int]]]]):
    """Build a ``pandas_udf`` STRING -> ARRAY<STRUCT<id, start>> from any batch tokenizer with offsets.

    ``encode_batch`` gets the rendered texts of one Arrow batch and returns, per
    text, the token ids and the character position at which each token starts.
    """
    @F.pandas_udf("array<struct<id: int, start: int>>")
    def tok(texts: pd.Series) -> pd.Series:
        got = encode_batch(["" if t is None else t for t in texts])
        return pd.Series([[{"id": int(i), "start": int(p)} for i, p in zip(ids, starts)] for ids, starts in got])
    return tok


def _starts(lengths: Column) -> Column:
    """ARRAY<INT>: where each part of a text starts, from the lengths of the parts (one pass, however many there are)."""
    @F.pandas_udf("array<int>")
    def starts(col: pd.Series) -> pd.Series:
        out = []
        for n in col:
            if n is None:
                out.append(None)
                continue
            at = np.cumsum(np.concatenate(([0.0], np.asarray(n, dtype=np.float64))))[:-1]
            # After a part without a length (NaN) nothing has a known start.
            out.append([None if np.isnan(x) else int(x) for x in at] if np.isnan(at).any() else at.astype(np.int32))
        return pd.Series(out, dtype=object)
    return starts(lengths)


def regex_tokens(text, pattern: str) -> Column:
    """ARRAY<STRUCT<id, start>> of a regex tokenizer (native; ids are hashed).

    ``pattern`` must match every character, so a token starts where the one before ends.
    """
    toks = F.regexp_extract_all(col_(text), F.lit(pattern), 0)
    return F.arrays_zip(F.transform(toks, token_id).alias("id"), _starts(F.transform(toks, F.length)).alias("start"))


def checked(df: DataFrame, messages: str = "messages", on_invalid: str = "error") -> DataFrame:
    """Rows with messages that are not empty and alternate: others fail the job, are rejected or are kept."""
    if on_invalid == "keep":
        return df
    m = F.col(messages)
    ok = F.coalesce((F.size(m) > 0) & alternates(m), F.lit(False))
    if on_invalid == "reject":
        return df.where(ok)
    if on_invalid != "error":
        raise ValueError(f"on_invalid is error, reject or keep, not {on_invalid!r}")
    why = F.when(F.coalesce(F.size(m), F.lit(0)) < 1, F.lit("an example has no messages")).otherwise(
        F.lit("user and assistant turns of an example do not take turns"))
    return df.where(F.when(ok, F.lit(True)).otherwise(F.raise_error(why).cast("boolean")))


def _before(roles: Column, n: Column) -> Column:
    """Role of the message before each message (NULL for the first)."""
    return F.concat(F.array(F.lit(None).cast("string")), F.slice(roles, 1, F.greatest(n - 1, F.lit(0))))


def trained_spans(messages) -> Column:
    """ARRAY<STRUCT<s, e>>: character spans of the rendered text whose tokens carry labels."""
    m = col_(messages)
    roles = F.transform(m, lambda x: x["role"])
    lengths = F.transform(m, lambda x: F.length(F.concat(F.lit(MESSAGE_INDENT), message_text(x["role"], x["content"]), F.lit("\n"))))
    parts = F.arrays_zip(
        roles.alias("r"), _before(roles, F.size(m)).alias("p"),
        F.transform(m, lambda x: F.length(F.concat(F.lit(MESSAGE_INDENT), header_text(x["role"])))).alias("h"),
        lengths.alias("n"), _starts(lengths).alias("at"))

    def span(x):
        at = x["at"] + F.lit(len(f"\n{BOS}\n"))
        # The first message is preceded by nothing to mask, so its text counts from the very beginning.
        first = F.when(x["p"].isNull(), F.lit(0)).when(x["p"] == "assistant", at).otherwise(at + x["h"])
        return F.struct(first.cast("int").alias("s"), (at + x["n"]).cast("int").alias("e"))
    return F.transform(F.filter(parts, lambda x: x["r"] == "assistant"), span)


def encode(df: DataFrame, messages: str = "messages", max_len: int | None = None,
           tokenizer=None, on_invalid: str = "error") -> DataFrame:
    """Add ``input_ids``, ``labels``, ``attention_mask``.

    ``tokenizer``: None for whitespace ids, or a function from a text column to
    ARRAY<STRUCT<id, start>>: :func:`offset_tokenizer` or :func:`regex_tokens`.
    """
    d = checked(df, messages, on_invalid)
    m = F.col(messages)
    if tokenizer is not None:
        d = d.withColumn("_t", tokenizer(render_chat(m))).withColumn("_s", trained_spans(m))
        toks = F.slice("_t", 1, max_len) if max_len else F.col("_t")
        lab = F.transform(toks, lambda t: F.when(F.exists(F.col("_s"), lambda s: (t["start"] >= s["s"]) & (t["start"] < s["e"])), t["id"])
                          .otherwise(F.lit(IGNORE)))
        return (d.withColumn("input_ids", F.transform(toks, lambda t: t["id"])).withColumn("labels", lab)
                 .withColumn("attention_mask", F.array_repeat(F.lit(1), F.size("input_ids"))).drop("_t", "_s"))
    roles = F.transform(m, lambda x: x["role"])
    heads = F.transform(m, lambda x: F.size(words(header_text(x["role"]))))
    d = d.withColumn("_z", F.arrays_zip(roles.alias("r"), _before(roles, F.size(m)).alias("p"), heads.alias("h"),
                                        message_token_ids(m).alias("t")))
    lab = F.flatten(F.transform(F.col("_z"), lambda e: F.transform(e["t"], lambda t, j: F.when(
        (e["r"] != "assistant") | ((j < e["h"]) & e["p"].isNotNull() & (e["p"] != "assistant")), F.lit(IGNORE)).otherwise(t))))
    bos = token_id(F.lit(BOS))
    bos_label = F.when(F.get(roles, 0) == "assistant", bos).otherwise(F.lit(IGNORE))
    all_ids = F.concat(F.array(bos), F.flatten(F.transform("_z", lambda e: e["t"])))
    all_lab = F.concat(F.array(bos_label), lab)
    if max_len:
        all_ids, all_lab = F.slice(all_ids, 1, max_len), F.slice(all_lab, 1, max_len)
    return (d.withColumn("input_ids", all_ids).withColumn("labels", all_lab)
             .withColumn("attention_mask", F.array_repeat(F.lit(1), F.size("input_ids")))
             .drop("_z"))


def encode_turns(turns: DataFrame, max_len: int, group_col: str = "conv_id", order_col: str = "turn",
                 role_col: str = "role", text_col: str = "text", on_invalid: str = "error") -> DataFrame:
    """Scale form of :func:`encode` for one-row-per-turn input (same output).

    Each turn is tokenised where it sits; its token offset (W2) and the
    previous role (W5) come from windows over the conversation's turns, which
    sort rows (spill-safe) instead of building one array.  Only the tokens
    below ``max_len`` are then gathered, so every collected array is bounded
    by ``max_len`` however long a conversation is.
    """
    w = Window.partitionBy(group_col).orderBy(order_col)
    t = turns.select(group_col, order_col, F.col(role_col).alias("_r"), F.size(words(header_text(F.col(role_col)))).alias("_h"),
                     F.transform(words(message_text(F.col(role_col), F.col(text_col))), token_id).alias("_ids"))
    if on_invalid not in ("error", "keep"):
        raise ValueError(f"on_invalid is error or keep, not {on_invalid!r}")
    place = F.row_number().over(w) - 1 - F.when(F.first("_r").over(w) == "system", 1).otherwise(0)
    t = (t.withColumn("_p", F.lag("_r").over(w))
          .withColumn("_first", F.row_number().over(w) == 1)
          .withColumn("_ok", (F.col("_r") == "user") == (F.pmod(place, F.lit(2)) == 0))
          .withColumn("_off", 1 + F.coalesce(F.sum(F.size("_ids")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))))
    if on_invalid == "error":
        bad = F.raise_error(F.lit("user and assistant turns of a conversation do not take turns")).cast("boolean")
        t = t.where(F.when(F.coalesce("_ok", F.lit(False)), F.lit(True)).otherwise(bad))
    # The first turn stays even when nothing of it does: it stands for its conversation.
    t = t.where((F.col("_off") < max_len) | F.col("_first"))
    keep = F.greatest(F.lit(0), F.least(F.size("_ids").cast("bigint"), F.lit(max_len) - F.col("_off"))).cast("int")
    ids = F.slice("_ids", 1, keep)
    lab = F.transform(ids, lambda x, j: F.when((F.col("_r") != "assistant") | (
        (j < F.col("_h")) & F.col("_p").isNotNull() & (F.col("_p") != "assistant")), F.lit(IGNORE)).otherwise(x))
    bos = token_id(F.lit(BOS))
    bos_lab = F.when(F.col("_r") == "assistant", bos).otherwise(F.lit(IGNORE))
    pieces = t.select(group_col, order_col, ids.alias("_ids"), lab.alias("_lab"),
                      F.when(F.col("_first"), bos_lab).alias("_bl"))
    agg = pieces.groupBy(group_col).agg(
        F.array_sort(F.collect_list(F.struct(F.col(order_col).alias("o"), "_ids", "_lab"))).alias("_parts"),
        F.max("_bl").alias("_bl"))
    all_ids = F.slice(F.concat(F.array(bos), F.flatten(F.transform("_parts", lambda p: p["_ids"]))), 1, max_len)
    all_lab = F.slice(F.concat(F.array(F.col("_bl")), F.flatten(F.transform("_parts", lambda p: p["_lab"]))), 1, max_len)
    return (agg.select(group_col, all_ids.alias("input_ids"), all_lab.alias("labels"))
               .withColumn("attention_mask", F.array_repeat(F.lit(1), F.size("input_ids"))))


def trainable_only(df: DataFrame, labels: str = "labels") -> DataFrame:
    """F8: rows with at least one label that is not -100."""
    return df.where(F.exists(F.col(labels), lambda x: x != F.lit(IGNORE)))


def epoch_order(df: DataFrame, id_col: str, seed: int = 42, epoch: int = 0, out: str = "pos") -> DataFrame:
    """Exact position in the epoch's keyed shuffle (md5(seed|epoch|id))."""
    d = df.withColumn("_k", keyed_hash(seed, f"epoch{epoch}", F.col(id_col)))
    return exact_positions(d, "_k", id_col, out=out).drop("_k")


def batched(df: DataFrame, id_col: str, batch_size: int, seed: int = 42, epoch: int = 0) -> DataFrame:
    """Ids with their position in the epoch's order and their batch.

    Only the id is numbered; examples join by id afterwards.
    """
    return epoch_order(df.select(id_col), id_col, seed, epoch).withColumn("batch_id", batch_ids(F.col("pos"), batch_size))


def pad_batches(df: DataFrame, id_col: str, batch_size: int, seed: int = 42, epoch: int = 0,
                length_col: str = "n_tokens") -> DataFrame:
    """A4/A3: per batch rows, longest length, real and padded token counts.

    Batches are consecutive slices of the epoch order; each batch is a group
    of ``batch_size`` rows, so the aggregation has no hot key.
    """
    d = df if length_col in df.columns else df.withColumn(length_col, F.size("input_ids"))
    d = epoch_order(d.select(id_col, length_col), id_col, seed, epoch).withColumn("batch_id", batch_ids(F.col("pos"), batch_size))
    return (d.groupBy("batch_id")
             .agg(F.count(F.lit(1)).alias("n_rows"), F.max(length_col).cast("bigint").alias("max_len"),
                  F.sum(length_col).cast("bigint").alias("tokens"))
             .withColumn("padded_tokens", (F.col("n_rows") * F.col("max_len")).cast("bigint")))


def padded_arrays(df: DataFrame, id_col: str, batch_size: int, pad_id: int = 0, seed: int = 42, epoch: int = 0) -> DataFrame:
    """A4: every example padded to the longest of its batch.

    ``input_ids`` with ``pad_id``, ``labels`` with -100, ``attention_mask`` with
    0; one row per example with ``batch_id`` and ``pos``.
    """
    d = df.join(batched(df, id_col, batch_size, seed, epoch), id_col)
    longest = F.max(F.size("input_ids")).over(Window.partitionBy("batch_id"))
    d = d.withColumn("_short", longest - F.size("input_ids"))
    fill = {"input_ids": pad_id, "labels": IGNORE, "attention_mask": 0}
    return d.select(id_col, "batch_id", "pos", *[F.concat(F.col(c), F.array_repeat(F.lit(v), F.col("_short"))).alias(c) for c, v in fill.items()])


def running_tokens(batches: DataFrame) -> DataFrame:
    """Running real and padded token totals over batch order."""
    a = running_sum(batches, "batch_id", "tokens", "total_tokens")
    return running_sum(a, "batch_id", "padded_tokens", "total_tokens_including_padding")


def training_plan(df: DataFrame, per_device_batch: int, processes: int = 1, grad_acc: int = 1,
                  epochs: int = 1, warmup_ratio: float = 0.0, max_train_steps: int | None = None) -> DataFrame:
    """A5: one-row plan arithmetic from the example count (computed in the plan).

    The scheduler is set up before the examples are dealt out to processes: it
    counts steps of all examples when the epochs are given, and the given steps
    of every process otherwise; its warm-up is a share of those steps.
    """
    n = df.agg(F.count(F.lit(1)).alias("n_examples"))

    def steps(batch: int):
        return F.ceil(F.ceil(F.col("n_examples") / F.lit(batch)) / F.lit(grad_acc))
    per_epoch = steps(per_device_batch * processes)
    total = F.lit(max_train_steps) if max_train_steps else per_epoch * F.lit(epochs)
    scheduler = F.lit(max_train_steps * processes) if max_train_steps else steps(per_device_batch) * F.lit(epochs)
    return (n.withColumn("batches_per_epoch", F.ceil(F.col("n_examples") / F.lit(per_device_batch * processes)).cast("bigint"))
             .withColumn("update_steps_per_epoch", per_epoch.cast("bigint"))
             .withColumn("max_train_steps", total.cast("bigint"))
             .withColumn("num_train_epochs", F.ceil(F.col("max_train_steps") / F.greatest(F.col("update_steps_per_epoch"), F.lit(1))).cast("bigint"))
             .withColumn("scheduler_steps", scheduler.cast("bigint"))
             .withColumn("warmup_steps", F.floor(F.col("scheduler_steps") * F.lit(warmup_ratio)).cast("bigint")))


def step_window_mean(metrics: DataFrame, step_col: str, value_col: str, every: int) -> DataFrame:
    """Mean of each complete block of ``every`` consecutive 0-based steps.

    The partial last block is never logged (``having count = every``).
    """
    return (metrics.groupBy(F.floor(F.col(step_col) / every).cast("bigint").alias("block"))
                   .agg(F.avg(value_col).alias("mean_value"), F.count(F.lit(1)).alias("_n"))
                   .where(F.col("_n") == every)
                   .select("block", ((F.col("block") + 1) * every).cast("bigint").alias("step"),
                           F.round("mean_value", 6).alias("mean_value")))
