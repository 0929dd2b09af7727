from pyspark.sql import functions as F

from corpusflow.functions.jsonx import json_span
from corpusflow.operators.enrich import PERSONA_ITEM, parsed_list
from corpusflow.operators.persona import persona_text


def test_json_span_cases(spark):
    cases = [
        ('Sure: {"a": 1} done', '{"a": 1}'),
        ('[{"a": 1}] trailing', '[{"a": 1}]'),
        ("[1, 2, 3]", "[1, 2, 3]"),
        ('{"a": [1, 2]', '{"a": [1, 2]'[:0] or None),
        ("no brackets", None),
        ('x [1] then {"b": 2}', "[1]"),
    ]
    df = spark.createDataFrame([(c,) for c, _ in cases], "t string")
    got = [r.s for r in df.select(json_span("t").alias("s")).collect()]
    assert got == [e for _, e in cases]


def test_parse_object_or_bare_list(spark):
    item = '{"countries": ["X"], "languages": ["Y"], "persona": "p"}'
    cases = ['{"persona_list": [' + item + "]}", "[" + item + "]", "text " + item[:20], '{"persona_list": []}',
             '{"persona_list": "oops"}']
    df = spark.createDataFrame([(c,) for c in cases], "t string")
    got = [r.i for r in df.select(parsed_list("t", "persona_list", PERSONA_ITEM).alias("i")).collect()]
    assert got[0][0].persona == "p" and got[1][0].persona == "p"
    assert got[2] is None and got[3] == [] and got[4] is None


def test_persona_variant_rules(spark):
    cases = [('"plain text"', "plain text"), ('""', None), ('{"persona": ""}', ""), ('{"persona": 7}', None),
             ('{"persona": "p"}', "p"), ('["a"]', None), ("null", None), ('{"other": "x"}', None), ("7", None)]
    df = spark.createDataFrame([(c,) for c, _ in cases], "j string")
    got = [r.p for r in df.select(persona_text(F.parse_json("j")).alias("p")).collect()]
    assert got == [e for _, e in cases]
