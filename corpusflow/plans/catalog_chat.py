"""Catalog: message layouts, chat rendering, tokenising/masking, batching and step metrics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusflow.functions.keys import sql_keyed_hash
from corpusflow.functions.text import WORD_PATTERN_RE2, words
from corpusflow.operators import encode as enc
from corpusflow.operators import messages as M
from corpusflow.operators.encode import IGNORE
from corpusflow.plans.catalog_enrich import lit_sql
from corpusflow.plans.catalog_text import sql_strip
from corpusflow.plans.registry import query, table

MAX_LEN = 256
BATCH = 8


def summary(df, key="conv_id"):
    """Flat, hash-friendly view of a ``messages`` column."""
    m = F.col("messages")
    return df.select(key, F.size(m).alias("n_messages"),
                     F.array_join(F.transform(m, lambda x: F.coalesce(x["role"], F.lit("?"))), ",").alias("roles"),
                     F.md5(F.array_join(F.transform(m, lambda x: F.coalesce(x["content"], F.lit(""))), "\u0001")).alias("content_md5"))


def layout(spark, sf):
    """First system / user / assistant text of each conversation (partial-aggregated)."""
    t = table(spark, sf, "conversations")

    def first(role):
        return F.min_by("text", F.when(F.col("role") == role, F.col("turn")))
    return t.groupBy("conv_id").agg(first("system").alias("sys"), first("user").alias("usr"),
                                    first("assistant").alias("asst"))


def _first_sql(role):
    return f"arg_min(text, CASE WHEN role = '{role}' THEN turn END)"


LAYOUT_SQL = (f"(SELECT conv_id, {_first_sql('system')} AS sys, {_first_sql('user')} AS usr, "
              f"{_first_sql('assistant')} AS asst FROM conversations GROUP BY conv_id)")


def _sum_sql(n, roles, contents):
    parts = ", ".join(f"coalesce({c}, '')" for c in contents)
    return f"{n} AS n_messages, '{roles}' AS roles, md5(concat_ws(chr(1), {parts})) AS content_md5"


_ALPACA_SQL = (f"{lit_sql(M.ALPACA_HEAD + M.ALPACA_INSTRUCTION)} || coalesce(usr, 'None') || {lit_sql(M.ALPACA_INPUT)} "
               f"|| coalesce(sys, 'None') || {lit_sql(M.ALPACA_RESPONSE)}")


@query("msg_instruction", f"SELECT conv_id, {_sum_sql(2, 'user,assistant', [_ALPACA_SQL, 'asst'])} FROM {LAYOUT_SQL}")
def msg_instruction(spark, sf):
    """M1: instruction/input/output -> messages."""
    d = layout(spark, sf).select("conv_id", F.col("usr").alias("instruction"), F.col("sys").alias("input"),
                                 F.col("asst").alias("output"))
    return summary(M.to_messages(d))


@query("msg_prompt_completion", f"SELECT conv_id, {_sum_sql(2, 'user,assistant', ['usr', 'asst'])} FROM {LAYOUT_SQL}")
def msg_prompt_completion(spark, sf):
    """M2: prompt/completion -> messages."""
    d = layout(spark, sf).select("conv_id", F.col("usr").alias("prompt"), F.col("asst").alias("completion"))
    return summary(M.to_messages(d))


@query("msg_sys_question", f"SELECT conv_id, {_sum_sql(3, 'system,user,assistant', ['sys', 'usr', 'asst'])} FROM {LAYOUT_SQL}")
def msg_sys_question(spark, sf):
    """M4: system_prompt/question/response -> messages."""
    d = layout(spark, sf).select("conv_id", F.col("sys").alias("system_prompt"), F.col("usr").alias("question"),
                                 F.col("asst").alias("response"))
    return summary(M.to_messages(d))


@query("msg_query_answer", f"SELECT conv_id, {_sum_sql(2, 'user,assistant', ['usr', 'asst'])} FROM {LAYOUT_SQL}")
def msg_query_answer(spark, sf):
    """M5: query/answer -> messages."""
    d = layout(spark, sf).select("conv_id", F.col("usr").alias("query"), F.col("asst").alias("answer"))
    return summary(M.to_messages(d))


@query("msg_query_response", f"SELECT conv_id, {_sum_sql(2, 'user,assistant', ['usr', 'asst'])} FROM {LAYOUT_SQL}")
def msg_query_response(spark, sf):
    """M6: query/response -> messages."""
    d = layout(spark, sf).select("conv_id", F.col("usr").alias("query"), F.col("asst").alias("response"))
    return summary(M.to_messages(d))


_ALL_SQL = ("SELECT conv_id, count(*) AS n_messages, string_agg(role, ',' ORDER BY turn) AS roles, "
            "md5(string_agg(coalesce(text, ''), chr(1) ORDER BY turn)) AS content_md5 FROM conversations")


@query("to_messages", f"{_ALL_SQL} GROUP BY conv_id")
def to_messages_q(spark, sf):
    """Ordered turns collected into one messages array per conversation."""
    return summary(M.collect_turns(table(spark, sf, "conversations")))


@query("msg_chosen", f"{_ALL_SQL} GROUP BY conv_id")
def msg_chosen(spark, sf):
    """M7: chosen/rejected/reference_completion -> messages = chosen."""
    msgs = M.collect_turns(table(spark, sf, "conversations"))
    d = msgs.select("conv_id", F.col("messages").alias("chosen"), F.reverse("messages").alias("rejected"),
                    F.element_at(F.col("messages"), -1)["content"].alias("reference_completion"))
    return summary(M.to_messages(d))


@query("conv_role_map", "SELECT conv_id, count(*) AS n_messages, string_agg(role, ',' ORDER BY turn) AS roles, "
                        "md5(string_agg(coalesce(text, ''), chr(1) ORDER BY turn)) AS content_md5 FROM conversations "
                        "GROUP BY conv_id HAVING bool_and(role IN ('user', 'assistant'))")
def conv_role_map(spark, sf):
    """ShareGPT-style conversations; rows with an unmapped role are rejected."""
    t = table(spark, sf, "conversations").withColumn(
        "from", F.when(F.col("role") == "user", "human").when(F.col("role") == "assistant", "gpt").otherwise(F.col("role")))
    conv = (t.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "from", F.col("text").alias("value")))).alias("c"))
             .select("conv_id", F.transform("c", lambda x: F.struct(x["from"].alias("from"), x["value"].alias("value"))).alias("conversations")))
    m = M.from_conversations(conv, on_unknown="null")
    ok = m.where(F.forall("messages", lambda x: x["role"].isNotNull()))
    return summary(ok)


_STRIPPED_TEXT = sql_strip("coalesce(text, 'None')")
_RENDER_SQL = (f"md5(chr(10) || {lit_sql(M.BOS)} || chr(10) || string_agg(chr(10) || '    ' || {lit_sql(M.HEADER_START)} || role "
               f"|| {lit_sql(M.HEADER_END)} || chr(10) || chr(10) || {_STRIPPED_TEXT} "
               f"|| {lit_sql(M.END_OF_TURN)} || chr(10), '' ORDER BY turn) || chr(10))")


@query("chat_render", f"SELECT conv_id, {_RENDER_SQL} AS render_md5 FROM conversations GROUP BY conv_id")
def chat_render(spark, sf):
    """Chat template rendering (whitespace-exact)."""
    msgs = M.collect_turns(table(spark, sf, "conversations"))
    return msgs.select("conv_id", F.md5(M.render_chat("messages")).alias("render_md5"))


@query("role_alternation", """SELECT conv_id, bool_and((role = 'user') = ((idx % 2) = off)) AS ok FROM (
  SELECT conv_id, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS idx,
         CASE WHEN first_value(role) OVER (PARTITION BY conv_id ORDER BY turn) = 'system' THEN 1 ELSE 0 END AS off
  FROM conversations) GROUP BY conv_id""")
def role_alternation(spark, sf):
    """user/assistant alternation after an optional leading system turn."""
    msgs = M.collect_turns(table(spark, sf, "conversations"))
    return msgs.select("conv_id", M.alternates("messages").alias("ok"))


def encoded(spark, sf, max_len=MAX_LEN):
    """Encoded examples from the turn table (scale form: arrays bounded by max_len)."""
    return enc.encode_turns(table(spark, sf, "conversations"), max_len)


_WORD_RE = f"'{WORD_PATTERN_RE2}'"
_MSG_CTES = f"""m AS (SELECT conv_id, turn, role,
    lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS prev,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS mi,
    regexp_extract_all({lit_sql(M.HEADER_START)} || role || {lit_sql(M.HEADER_END)} || chr(10) || chr(10)
      || {_STRIPPED_TEXT} || {lit_sql(M.END_OF_TURN)}, {_WORD_RE}) AS toks FROM conversations),
 o AS (SELECT *, 1 + coalesce(sum(len(toks)) OVER (PARTITION BY conv_id ORDER BY mi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM m)"""
_TOK_SQL = f"""(WITH {_MSG_CTES},
 t AS (SELECT conv_id, off + j - 1 AS p, ('0x' || substr(md5(toks[j]), 1, 7))::INT AS id,
        CASE WHEN role <> 'assistant' OR (j = 1 AND prev IS NOT NULL AND prev <> 'assistant') THEN {IGNORE}
             ELSE ('0x' || substr(md5(toks[j]), 1, 7))::INT END AS label
       FROM o, range(1, len(toks) + 1) r(j)),
 b AS (SELECT conv_id, 0 AS p, ('0x' || substr(md5({lit_sql(M.BOS)}), 1, 7))::INT AS id,
        CASE WHEN arg_min(role, turn) = 'assistant' THEN ('0x' || substr(md5({lit_sql(M.BOS)}), 1, 7))::INT ELSE {IGNORE} END AS label
       FROM conversations GROUP BY conv_id)
 SELECT * FROM (SELECT * FROM t UNION ALL SELECT * FROM b) WHERE p < {MAX_LEN})"""


@query("truncate_tokens", f"SELECT conv_id, count(*) AS n_input, md5(string_agg(id::VARCHAR, ',' ORDER BY p)) AS ids_md5, "
                          f"count(*) AS mask_len FROM {_TOK_SQL} GROUP BY conv_id")
def truncate_tokens(spark, sf):
    """Token ids cut to 256, attention mask of ones."""
    e = encoded(spark, sf)
    return e.select("conv_id", F.size("input_ids").alias("n_input"), F.md5(F.array_join("input_ids", ",")).alias("ids_md5"),
                    F.size("attention_mask").alias("mask_len"))


@query("loss_mask", f"SELECT conv_id, count(*) FILTER (WHERE label <> {IGNORE}) AS n_trainable, "
                    f"md5(string_agg(label::VARCHAR, ',' ORDER BY p)) AS labels_md5 FROM {_TOK_SQL} GROUP BY conv_id")
def loss_mask(spark, sf):
    """labels = ids on assistant tokens, -100 elsewhere (incl. the generation header)."""
    e = encoded(spark, sf)
    return e.select("conv_id", F.size(F.filter("labels", lambda x: x != F.lit(IGNORE))).alias("n_trainable"),
                    F.md5(F.array_join("labels", ",")).alias("labels_md5"))


@query("trainable_filter", f"SELECT conv_id FROM {_TOK_SQL} GROUP BY conv_id HAVING count(*) FILTER (WHERE label <> {IGNORE}) > 0")
def trainable_filter(spark, sf):
    """Keep examples with at least one assistant label."""
    return enc.trainable_only(encoded(spark, sf)).select("conv_id")


@query("mask_spans", f"""WITH {_MSG_CTES}
SELECT conv_id, mi - 1 AS msg_idx, role, len(toks) AS n_tokens, off AS start,
  (role = 'assistant' AND prev IS NOT NULL AND prev <> 'assistant') AS header_masked FROM o""")
def mask_spans(spark, sf):
    """Token offset of each message (running sum) and the look-ahead header mask, per turn row."""
    t = table(spark, sf, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn")
    d = t.select("conv_id", "turn", "role", F.size(words(M.message_text(F.col("role"), F.col("text")))).alias("n_tokens"))
    prev = F.lag("role").over(w)
    return d.select(
        "conv_id", (F.row_number().over(w) - 1).cast("bigint").alias("msg_idx"), "role", "n_tokens",
        (1 + F.coalesce(F.sum("n_tokens").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).cast("bigint").alias("start"),
        ((F.col("role") == "assistant") & prev.isNotNull() & (prev != "assistant")).alias("header_masked"))


def trainable_examples(spark, sf):
    """Encoded examples with at least one trainable label, with their token count."""
    e = enc.trainable_only(encoded(spark, sf))
    return e.select("conv_id", "input_ids", F.size("input_ids").alias("n_tokens"))


_EX_SQL = f"""(SELECT conv_id, count(*) AS n_tokens FROM {_TOK_SQL} GROUP BY conv_id
   HAVING count(*) FILTER (WHERE label <> {IGNORE}) > 0)"""
_ORDER_SQL = f"""(SELECT *, (row_number() OVER (ORDER BY {sql_keyed_hash(["42", "'epoch0'", 'conv_id'])}, conv_id) - 1) AS pos FROM {_EX_SQL})"""
_BATCH_SQL = f"""(SELECT pos // {BATCH} AS batch_id, count(*) AS n_rows, max(n_tokens) AS max_len, sum(n_tokens)::BIGINT AS tokens,
   (count(*) * max(n_tokens))::BIGINT AS padded_tokens FROM {_ORDER_SQL} GROUP BY ALL)"""


@query("pad_batches", f"SELECT * FROM {_BATCH_SQL}")
def pad_batches(spark, sf):
    """Batches of 8 in keyed epoch order, padded to their longest row."""
    return enc.pad_batches(trainable_examples(spark, sf), "conv_id", BATCH, seed=42, epoch=0)


@query("token_totals", f"SELECT sum(tokens)::BIGINT AS total_tokens, sum(padded_tokens)::BIGINT AS total_tokens_including_padding FROM {_BATCH_SQL}")
def token_totals(spark, sf):
    """A3: real and padded token totals."""
    b = enc.pad_batches(trainable_examples(spark, sf), "conv_id", BATCH, seed=42, epoch=0)
    return b.agg(F.sum("tokens").cast("bigint").alias("total_tokens"),
                 F.sum("padded_tokens").cast("bigint").alias("total_tokens_including_padding"))


@query("running_tokens", f"""SELECT batch_id, sum(tokens) OVER (ORDER BY batch_id)::BIGINT AS total_tokens,
  sum(padded_tokens) OVER (ORDER BY batch_id)::BIGINT AS total_tokens_including_padding FROM {_BATCH_SQL}""")
def running_tokens(spark, sf):
    """Running token totals across steps (chunked prefix sums)."""
    b = enc.pad_batches(trainable_examples(spark, sf), "conv_id", BATCH, seed=42, epoch=0)
    return enc.running_tokens(b).select("batch_id", "total_tokens", "total_tokens_including_padding")


@query("epoch_shuffle", f"""SELECT conv_id, (row_number() OVER (ORDER BY {sql_keyed_hash(["42", "'epoch1'", 'conv_id'])}, conv_id) - 1) AS pos
FROM (SELECT DISTINCT conv_id FROM conversations)""")
def epoch_shuffle(spark, sf):
    """Per-epoch reshuffle keyed by md5(seed|epoch|id)."""
    ids = table(spark, sf, "conversations").select("conv_id").distinct()
    return enc.epoch_order(ids, "conv_id", seed=42, epoch=1)


# Counted, not computed: examples are dealt into batches, batches into update steps, and the groups are counted.
@query("training_plan", f"""WITH e AS (SELECT row_number() OVER (ORDER BY conv_id) - 1 AS i FROM {_EX_SQL}),
 c AS (SELECT count(*) AS n, count(DISTINCT i // 16) AS b, count(DISTINCT i // 16 // 2) AS u, count(DISTINCT i // 8 // 2) AS s FROM e)
SELECT n AS n_examples, b AS batches_per_epoch, u AS update_steps_per_epoch, 3 * u AS max_train_steps,
  CASE WHEN u = 0 THEN 0 ELSE (3 * u + u - 1) // u END AS num_train_epochs, 3 * s AS scheduler_steps,
  (3 * s) // 10 AS warmup_steps FROM c""")
def training_plan(spark, sf):
    """A5: batches, update steps, total steps, epochs and warm-up from the example count."""
    return enc.training_plan(trainable_examples(spark, sf), per_device_batch=8, processes=2, grad_acc=2,
                             epochs=3, warmup_ratio=0.1)


@query("step_window_mean", """SELECT event_id // 300 AS block, ((event_id // 300) + 1) * 300 AS step,
  round(avg(value), 6) AS mean_value FROM events GROUP BY ALL HAVING count(*) = 300""")
def step_window_mean(spark, sf):
    """Mean metric over each complete block of 300 steps."""
    return enc.step_window_mean(table(spark, sf, "events"), "event_id", "value", 300)


_SPAN_HEAD = f"({lit_sql(M.MESSAGE_INDENT)} || {lit_sql(M.HEADER_START)} || role || {lit_sql(M.HEADER_END)} || chr(10) || chr(10))"
_SPAN_TEXT = f"({_SPAN_HEAD} || {_STRIPPED_TEXT} || {lit_sql(M.END_OF_TURN)} || chr(10))"
_LEAD = len(f"\n{M.BOS}\n")
SUBWORD = "[A-Za-z]{1,3}|[0-9]|[^A-Za-z0-9]"


@query("encode_subword", f"""WITH m AS (SELECT conv_id, turn, role, {_SPAN_TEXT} AS seg, length({_SPAN_HEAD}) AS head,
    lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM conversations),
 p AS (SELECT *, {_LEAD} + coalesce(sum(length(seg)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM m),
 spans AS (SELECT conv_id, CASE WHEN prev IS NULL THEN 0 WHEN prev = 'assistant' THEN pos ELSE pos + head END AS s, pos + length(seg) AS e
           FROM p WHERE role = 'assistant'),
 t AS (SELECT conv_id, regexp_extract_all(chr(10) || {lit_sql(M.BOS)} || chr(10) || string_agg(seg, '' ORDER BY turn) || chr(10), '{SUBWORD}') AS toks
       FROM m GROUP BY conv_id),
 k AS (SELECT conv_id, j, toks[j] AS tok FROM t, range(1, len(toks) + 1) r(j)),
 o AS (SELECT conv_id, j, ('0x' || substr(md5(tok), 1, 7))::INT AS id,
         coalesce(sum(length(tok)) OVER (PARTITION BY conv_id ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM k),
 l AS (SELECT *, CASE WHEN EXISTS (SELECT 1 FROM spans WHERE spans.conv_id = o.conv_id AND o.start >= s AND o.start < e) THEN id ELSE {IGNORE} END AS label
       FROM o WHERE j <= {MAX_LEN})
SELECT conv_id, count(*) AS n_input, count(*) FILTER (WHERE label <> {IGNORE}) AS n_trainable,
  md5(string_agg(id::VARCHAR, ',' ORDER BY j)) AS ids_md5, md5(string_agg(label::VARCHAR, ',' ORDER BY j)) AS labels_md5
FROM l GROUP BY conv_id""")
def encode_subword(spark, sf):
    """A tokenizer that splits headers; tokens of the rendered text, the whole generation prefix masked."""
    msgs = M.collect_turns(table(spark, sf, "conversations"))
    e = enc.encode(msgs, "messages", MAX_LEN, tokenizer=lambda text: enc.regex_tokens(text, SUBWORD))
    return e.select("conv_id", F.size("input_ids").alias("n_input"),
                    F.size(F.filter("labels", lambda x: x != F.lit(IGNORE))).alias("n_trainable"),
                    F.md5(F.array_join("input_ids", ",")).alias("ids_md5"), F.md5(F.array_join("labels", ",")).alias("labels_md5"))


@query("pad_batch_arrays", f"""WITH x AS (SELECT t.conv_id, t.p, t.id, t.label FROM {_TOK_SQL} t SEMI JOIN {_EX_SQL} e ON t.conv_id = e.conv_id),
 b AS (SELECT conv_id, n_tokens, pos // {BATCH} AS batch_id, pos FROM {_ORDER_SQL}),
 w AS (SELECT *, max(n_tokens) OVER (PARTITION BY batch_id) AS width FROM b),
 f AS (SELECT w.conv_id, w.batch_id, w.pos, i AS p, coalesce(x.id, 0) AS id, coalesce(x.label, {IGNORE}) AS label, (x.id IS NOT NULL)::INT AS seen
       FROM w, range(0, {MAX_LEN}) r(i) LEFT JOIN x ON x.conv_id = w.conv_id AND x.p = i WHERE i < w.width)
SELECT conv_id, batch_id, pos, count(*) AS width, md5(string_agg(id::VARCHAR, ',' ORDER BY p)) AS ids_md5,
  md5(string_agg(label::VARCHAR, ',' ORDER BY p)) AS labels_md5, sum(seen)::BIGINT AS n_real FROM f GROUP BY ALL""")
def pad_batch_arrays(spark, sf):
    """A4: ids, labels and attention mask of every example, padded to the longest of its batch of 8."""
    ex = enc.trainable_only(encoded(spark, sf))
    d = enc.padded_arrays(ex, "conv_id", BATCH, pad_id=0, seed=42, epoch=0)
    return d.select("conv_id", "batch_id", "pos", F.size("input_ids").alias("width"), F.md5(F.array_join("input_ids", ",")).alias("ids_md5"),
                    F.md5(F.array_join("labels", ",")).alias("labels_md5"),
                    F.aggregate("attention_mask", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("n_real"))
