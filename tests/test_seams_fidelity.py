import random

from pyspark.sql import functions as F

from corpusflow.functions.text import first_n_words, more_words_than, n_words, shingles, strip_ws, words

WS = [" ", "\t", "\n", "\r", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x1f", "\x85", "\xa0", " ", " ",
      " ", " ", " ", " ", " ", " ", "　"]
CHARS = list("abcXYZ09éßΣ-_.") + ["​", "﻿"]   # zero-width chars are not whitespace in Python


def random_texts(n=600, seed=11):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        parts = [rng.choice(WS + CHARS + CHARS) for _ in range(rng.randint(0, 40))]
        out.append("".join(parts))
    return out


def test_word_functions_match_python_on_random_text(spark):
    texts = random_texts()
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    rows = df.select("i", words("t").alias("w"), n_words("t").alias("n"), more_words_than("t", 3).alias("m"),
                     first_n_words("t", 4).alias("h"), strip_ws("t").alias("s"), shingles("t", 2).alias("g")).collect()
    for r in rows:
        t = texts[r.i]
        sp = t.split()
        low = t.strip().lower().split()
        grams = list(dict.fromkeys(" ".join(low[j:j + 2]) for j in range(len(low) - 1)))
        assert r.w == sp and r.n == len(sp) and r.m == (len(sp) > 3), repr(t)
        assert r.h == " ".join(sp[:4]) and r.s == t.strip() and r.g == grams, repr(t)


def test_word_functions_take_any_n(spark):
    """Twenty thousand words neither overflow a stack nor change the answer."""
    text = " ".join(f"w{i}" for i in range(20_000))
    df = spark.createDataFrame([(text,), (" " + text + " x ",), (None,)], "t string")
    got = df.select(more_words_than("t", 19_999).alias("a"), more_words_than("t", 20_000).alias("b"), F.length(first_n_words("t", 20_000)).alias("n")).collect()
    assert [tuple(r) for r in got] == [(True, False, len(text)), (True, True, len(text)), (False, False, 0)]
