from pyspark.sql import functions as F

from corpusflow.functions.text import first_n_words, n_words, shingles, strip_ws, word_ngrams, words

SAMPLES = ["a b", "", "one two　three\x1cfour\x85five", "  lead and trail \t\n", "x",
           "tab\tnew\nline\rcr\x0bvt\x0cff", " em ls"]


def test_words_match_python_split(spark):
    df = spark.createDataFrame([(s,) for s in SAMPLES] + [(None,)], "t string")
    got = {r.t: r.w for r in df.select("t", words("t").alias("w")).collect()}
    for s in SAMPLES:
        assert got[s] == s.split(), s
    assert got[None] == []


def test_first_n_and_counts(spark):
    text = " ".join(f"w{i}" for i in range(250))
    df = spark.createDataFrame([(text,), ("a  b",)], "t string")
    rows = df.select(first_n_words("t", 200).alias("h"), n_words("t").alias("n")).collect()
    assert rows[0].h == " ".join(f"w{i}" for i in range(200)) and rows[0].n == 250
    assert rows[1].h == "a b" and rows[1].n == 2


def test_ngrams_edges(spark):
    df = spark.createDataFrame([("",), ("a",), ("a b",), ("a b c",), ("A b c D",)], "t string")
    got = [r.s for r in df.select(shingles("t", 3).alias("s")).collect()]
    assert got == [[], [], [], ["a b c"], ["a b c", "b c d"]]
    w = spark.createDataFrame([(["p", "q", "r"],)], "w array<string>")
    assert w.select(word_ngrams(F.col("w"), 2).alias("g")).first().g == ["p q", "q r"]


def test_strip_is_python_strip(spark):
    df = spark.createDataFrame([(s,) for s in SAMPLES], "t string")
    got = [r.s for r in df.select(strip_ws("t").alias("s")).collect()]
    assert got == [s.strip() for s in SAMPLES]
