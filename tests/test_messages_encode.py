import hashlib
import re

import pytest
from pyspark.sql import functions as F

from corpusflow.operators import encode as enc
from corpusflow.operators import messages as M

from conftest import SF0001

MSG = "array<struct<role: string, content: string>>"


def render_py(msgs, gen=False):
    s = "\n" + M.BOS + "\n"
    for m in msgs:
        c = m["content"] if m["content"] is not None else "None"
        s += "\n    " + M.HEADER_START + m["role"] + M.HEADER_END + "\n\n" + c.strip() + M.END_OF_TURN + "\n"
    s += "\n"
    if gen:
        s += "    " + M.HEADER_START + "assistant" + M.HEADER_END + "\n\n\n"
    return s


def tok(s):
    return [int(hashlib.md5(t.encode()).hexdigest()[:7], 16) for t in s.split()]


def spans_encode(msgs, max_len):
    """Independent property: a token is trained iff it starts inside a trained character span of the rendered text."""
    text, pos, spans = render_py(msgs), len("\n" + M.BOS + "\n"), []
    for i, m in enumerate(msgs):
        c = m["content"] if m["content"] is not None else "None"
        head = len("\n    " + M.HEADER_START + m["role"] + M.HEADER_END + "\n\n")
        size = head + len(c.strip()) + len(M.END_OF_TURN + "\n")
        if m["role"] == "assistant":
            spans.append((0 if i == 0 else pos + (0 if msgs[i - 1]["role"] == "assistant" else head), pos + size))
        pos += size
    found = [(int(hashlib.md5(t[0].encode()).hexdigest()[:7], 16), t.start()) for t in re.finditer(r"\S+", text)][:max_len]
    return [i for i, _ in found], [i if any(s <= p < e for s, e in spans) else -100 for i, p in found]


CASES = [
    [("system", "be brief"), ("user", "hi there"), ("assistant", "hello  you")],
    [("user", "a"), ("user", "b"), ("assistant", "c d e")],
    [("assistant", "first"), ("user", "q"), ("assistant", "r")],
    [("user", "only user")],
    [("user", "x " * 30), ("assistant", "y " * 30), ("user", "z"), ("assistant", "w")],
    [("user", ""), ("assistant", "  \t"), ("user", None)],
]


@pytest.mark.parametrize("max_len", [4, 12, 1000])
def test_mask_equals_trained_character_spans(spark, max_len):
    rows = [(i, [{"role": r, "content": c} for r, c in case]) for i, case in enumerate(CASES)]
    df = spark.createDataFrame(rows, f"id int, messages {MSG}")
    got = {r.id: (r.input_ids, r.labels, r.attention_mask) for r in enc.encode(df, "messages", max_len, on_invalid="keep").collect()}
    for i, msgs in rows:
        ids, labels = spans_encode(msgs, max_len)
        assert got[i][0] == ids and got[i][1] == labels and got[i][2] == [1] * len(ids), i


def test_table_mask_equals_trained_character_spans(spark):
    turns = spark.read.parquet(f"{SF0001}/conversations.parquet")
    msgs = M.collect_turns(turns)
    got = {r.conv_id: (r.input_ids, r.labels) for r in enc.encode(msgs, "messages", 256).collect()}
    for r in msgs.collect():
        m = [{"role": x.role, "content": x.content} for x in r.messages]
        assert got[r.conv_id] == spans_encode(m, 256)


def test_render_exact(spark):
    df = spark.createDataFrame([([{"role": "system", "content": " s "}, {"role": "user", "content": "u\n"}],)], f"m {MSG}")
    msgs = [{"role": "system", "content": " s "}, {"role": "user", "content": "u\n"}]
    assert df.select(M.render_chat("m").alias("r")).first().r == render_py(msgs)
    assert df.select(M.render_chat("m", True).alias("r")).first().r == render_py(msgs, True)


def test_alternation(spark):
    cases = [(["system", "user", "assistant"], True), (["user", "user"], False), (["assistant", "user"], False),
             (["user", "assistant", "user"], True), ([], True), (["system", "assistant"], False)]
    df = spark.createDataFrame([([{"role": r, "content": "x"} for r in rs],) for rs, _ in cases], f"m {MSG}")
    assert [r.ok for r in df.select(M.alternates("m").alias("ok")).collect()] == [ok for _, ok in cases]
    bad = spark.createDataFrame([([{"role": "user", "content": "x"}, {"role": "user", "content": "y"}],)], f"m {MSG}")
    with pytest.raises(Exception):
        bad.select(M.render_chat("m", strict=True)).collect()


def test_converters_pick_by_columns(spark):
    d1 = spark.createDataFrame([("do", None, "done")], "instruction string, input string, output string")
    m1 = M.to_messages(d1).first().messages
    assert m1[0].content.endswith("### Instruction:\ndo\n\n### Input:\nNone\n\n### Response:") and m1[1].content == "done"
    d4 = spark.createDataFrame([("sys", "q", "r")], "system_prompt string, question string, response string")
    assert [m.role for m in M.to_messages(d4).first().messages] == ["system", "user", "assistant"]
    d6 = spark.createDataFrame([("q", "r")], "query string, response string")
    assert [m.content for m in M.to_messages(d6).first().messages] == ["q", "r"]
    d3 = spark.createDataFrame([([{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}],)],
                               "conversations array<struct<from: string, value: string>>")
    assert [m.role for m in M.to_messages(d3).first().messages] == ["user", "assistant"]
    bad = spark.createDataFrame([([{"from": "system", "value": "a"}],)], "conversations array<struct<from: string, value: string>>")
    with pytest.raises(Exception):
        M.to_messages(bad).collect()
    keep = spark.createDataFrame([([{"role": "user", "content": "x"}], "p", "c")], f"messages {MSG}, prompt string, completion string")
    assert M.to_messages(keep).columns == keep.columns


def test_step_window_mean_drops_partial_block(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(25)], "step bigint, loss double")
    got = [tuple(r) for r in enc.step_window_mean(df, "step", "loss", 10).orderBy("block").collect()]
    assert got == [(0, 10, 4.5), (1, 20, 14.5)]


@pytest.mark.parametrize("max_len", [1, 3, 40, 256])
def test_turn_level_encode_equals_message_encode(spark, max_len):
    turns = spark.read.parquet(f"{SF0001}/conversations.parquet")
    a = {r.conv_id: (r.input_ids, r.labels, r.attention_mask)
         for r in enc.encode(M.collect_turns(turns), "messages", max_len).collect()}
    b = {r.conv_id: (r.input_ids, r.labels, r.attention_mask) for r in enc.encode_turns(turns, max_len).collect()}
    assert a == b


def test_empty_and_broken_conversations(spark):
    rows = [(1, []), (2, [("user", "a"), ("user", "b")]), (3, [("user", "a"), ("assistant", "b")]), (4, None)]
    df = spark.createDataFrame([(i, m and [{"role": r, "content": c} for r, c in m] if m is not None else None) for i, m in rows], f"id int, messages {MSG}")
    assert [r.id for r in enc.encode(df, "messages", on_invalid="reject").collect()] == [3]
    for bad in (1, 2):
        with pytest.raises(Exception, match="no messages|take turns"):
            enc.encode(df.where(F.col("id") == bad), "messages").collect()
    turns = spark.createDataFrame([(1, 0, "user", "x"), (1, 1, "user", "y")], "conv_id int, turn int, role string, text string")
    with pytest.raises(Exception, match="take turns"):
        enc.encode_turns(turns, 8).collect()


def test_any_tokenizer_masks_the_whole_generation_prefix(spark):
    def pieces(texts):
        """Up to three letters, or one other character: headers become many tokens."""
        out = []
        for t in texts:
            m = list(re.finditer(r"[a-z_]{1,3}|[^a-z_]", t))
            out.append(([sum(map(ord, x[0])) for x in m], [x.start() for x in m]))
        return out
    cases = [[("system", "be"), ("user", "cd e"), ("assistant", "fgh ij")], [("user", "x"), ("assistant", "y"), ("user", "z"), ("assistant", " w ")]]
    df = spark.createDataFrame([(i, [{"role": r, "content": c} for r, c in m]) for i, m in enumerate(cases)], f"id int, messages {MSG}")
    for r in enc.encode(df, "messages", tokenizer=enc.offset_tokenizer(pieces)).collect():
        msgs = [{"role": a, "content": c} for a, c in cases[r.id]]
        (ids, starts), = pieces([render_py(msgs)])
        assert r.input_ids == ids
        kept = "".join(render_py(msgs)[s:e] for s, e, l in zip(starts, starts[1:] + [None], r.labels) if l != -100)
        assert kept == "".join(m["content"].strip() + M.END_OF_TURN + "\n" for m in msgs if m["role"] == "assistant")


def test_padded_arrays_and_plan(spark):
    df = spark.createDataFrame([(i, [7] * (i % 5 + 1), [7] * (i % 5 + 1), [1] * (i % 5 + 1)) for i in range(98)],
                               "id bigint, input_ids array<int>, labels array<int>, attention_mask array<int>")
    by = {}
    for r in enc.padded_arrays(df, "id", 8, pad_id=0).collect():
        n = r.id % 5 + 1
        assert r.input_ids[n:] == [0] * (len(r.input_ids) - n) and set(r.labels[n:]) <= {-100} and sum(r.attention_mask) == n
        by.setdefault(r.batch_id, []).append((len(r.input_ids), n))
    assert len(by) == 13 and all({w for w, _ in b} == {max(n for _, n in b)} for b in by.values())
    p = enc.training_plan(df, 8, processes=2, grad_acc=2, epochs=3, warmup_ratio=0.1).first()
    assert (p.max_train_steps, p.scheduler_steps, p.warmup_steps) == (12, 21, 2)
    q = enc.training_plan(df, 8, processes=2, grad_acc=2, max_train_steps=50, warmup_ratio=0.1).first()
    assert (q.scheduler_steps, q.warmup_steps) == (100, 10)


def test_token_and_span_starts_take_one_pass(spark):
    """A long conversation in one row: offsets were built by appending to an array per token, which copies all before it."""
    import time

    from corpusflow.operators.encode import encode, regex_tokens, trained_spans
    n = 4000
    turns = [("user" if i % 2 == 0 else "assistant", f"w{i} " + "ab " * 9) for i in range(n)]
    df = spark.createDataFrame([(1, turns)], "id int, messages array<struct<role: string, content: string>>")
    t = time.monotonic()
    got = df.select(regex_tokens(M.render_chat(F.col("messages")), "[A-Za-z]{1,3}|[0-9]|[^A-Za-z0-9]").alias("t"),
                    trained_spans("messages").alias("s"), M.render_chat(F.col("messages")).alias("x")).first()
    assert time.monotonic() - t < 60
    at = [r["start"] for r in got["t"]]
    assert at[0] == 0 and at == sorted(set(at)) and at[-1] < len(got["x"]) and len(got["s"]) == n // 2
    assert all(got["x"][s["s"]:s["e"]].strip().startswith(turns[2 * i + 1][1].split()[0]) for i, s in enumerate(got["s"]))
    e = encode(df, "messages", 64, tokenizer=lambda x: regex_tokens(x, "[A-Za-z]{1,3}|[0-9]|[^A-Za-z0-9]")).first()
    assert len(e["input_ids"]) == len(e["labels"]) == 64
