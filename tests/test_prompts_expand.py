from pyspark.sql import functions as F

from corpusflow.operators import prompts as PR
from corpusflow.operators.enrich import PROMPT_ITEM, parsed_list, split_parsed
from corpusflow.operators.expand import explode_items, explode_prompts


def test_labelled_prompt_layouts(spark):
    df = spark.createDataFrame([("a teacher", "French", "topic x", "puzzle")], "p string, l string, d string, s string")
    r = df.select(PR.labelled_user_prompt("p", "l", "d", "s").alias("full"),
                  PR.labelled_user_prompt("p", "l", math=True).alias("math")).first()
    assert r.full == "Persona: a teacher\n    Domain: topic x\n    Style: puzzle\n    Language: French"
    assert r.math == "Persona: a teacher\n    Language: French"


def test_prompt_shapes_by_model(spark):
    df = spark.createDataFrame([("model-a",), ("model-b",)], "m string")
    got = {r.m: r.p for r in df.select("m", PR.routed(F.col("m"), ["model-b"], F.lit("S"), F.lit("U")).alias("p")).collect()}
    assert [(x.role, x.content) for x in got["model-a"]] == [("system", "S"), ("user", "U")]
    assert [(x.role, x.content) for x in got["model-b"]] == [("user", "S\n\nU")]
    cached = df.select(PR.two_role_cached(F.lit("S"), F.lit("U")).alias("p")).first().p
    assert cached[0].cache_control.type == "ephemeral" and cached[1].cache_control is None


def test_all_or_nothing_and_url_default(spark):
    raws = [("r1", "https://x", '{"prompts": [{"prompt": "a", "language": "fr"}, {"prompt": "b", "language": "fr"}]}'),
            ("r2", None, '{"prompts": [{"prompt": "c", "language": "fr"}, {"language": "fr"}]}'),
            ("r3", None, '{"prompts": []}')]
    df = (spark.createDataFrame(raws, "id string, url string, raw string")
               .withColumn("error", F.lit(None).cast("string"))
               .withColumn("items", parsed_list("raw", "prompts", PROMPT_ITEM)))
    ok, rej = split_parsed(df, "items", require=["prompt"])
    assert sorted(r.id for r in ok.collect()) == ["r1", "r3"]
    assert [(r.id, r.reason) for r in rej.collect()] == [("r2", "invalid_item")]
    ex = explode_prompts(ok, "items", "id", "url")
    assert sorted((r.prompt_id, r.url, r.prompt) for r in ex.collect()) == [("r1_0", "https://x", "a"), ("r1_1", "https://x", "b")]
    nourl = explode_prompts(ok.drop("url"), "items", "id", "url")
    assert {r.url for r in nourl.collect()} == {""}


def test_explode_items_keys_and_empty(spark):
    df = spark.createDataFrame([("p", [{"persona": "a"}, None, {"persona": "b"}])], "id string, items array<struct<persona: string>>")
    got = sorted((r.item_key, r.item.persona) for r in explode_items(df, "items", "id").collect())
    assert got == [("p#0", "a"), ("p#2", "b")]
