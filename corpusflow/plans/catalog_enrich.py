"""Catalog: prompts, model enrichment (mock client), JSON parsing, expansions, VARIANT personas."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusflow.functions.jsonx import json_span, opens_with_object, sql_json_span
from corpusflow.functions.keys import keyed_choice, sql_keyed_hash
from corpusflow.functions.text import sql_words, words
from corpusflow.operators import prompts
from corpusflow.operators.enrich import split_parsed
from corpusflow.operators.expand import explode_items, explode_prompts
from corpusflow.operators.persona import persona_text
from corpusflow.plans import personas as P
from corpusflow.plans.catalog_text import seed_prompts
from corpusflow.plans.registry import partitions, query, table


def lit_sql(s: str) -> str:
    """A SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


HEAD_SQL = f"array_to_string({sql_words('text')}[1:200], ' ')"
PAGES_SQL = f"(SELECT doc_id, {HEAD_SQL} AS content FROM documents WHERE len({sql_words('text')}) > 100)"


def sql_mock(content_table: str, key: str, kind: str = "persona") -> str:
    """DuckDB rebuild of ``mock_reply``: columns key, h, n, mode, raw."""
    if kind == "persona":
        item = ("'{\"countries\": [\"C' || substr(h, 3 + i, 1) || '\"], \"languages\": [\"L' || substr(h, 6 + i, 1)"
                " || '\"], \"persona\": \"reader ' || substr(h, 9 + 4 * i, 4) || '\"}'")
        head = "'{\"persona_list\": ['"
    else:
        item = ("'{\"prompt\": \"task ' || substr(h, 9 + 4 * i, 4) || '\", \"language\": \"L' || substr(h, 3 + i, 1)"
                " || '\"}'")
        head = "'{\"prompts\": ['"
    return f"""(WITH hh AS (SELECT {key}, md5(coalesce(content, '')) AS h FROM {content_table}),
 p AS (SELECT {key}, h, (('0x' || substr(h, 1, 2))::INT % 3) + 1 AS n, ('0x' || substr(h, 21, 1))::INT % 8 AS mode FROM hh),
 it AS (SELECT {key}, h, n, mode, string_agg({item}, ', ' ORDER BY i) AS items
        FROM p, range(0, 3) r(i) WHERE i < n GROUP BY ALL),
 b AS (SELECT *, {head} || items || ']}}' AS body FROM it)
 SELECT {key}, h, n, mode,
   CASE mode WHEN 0 THEN 'Sure, here it is:' || chr(10) || body || chr(10) || 'Hope this helps.'
             WHEN 1 THEN substr(body, 1, length(body) // 2)
             WHEN 2 THEN '[' || items || ']' ELSE body END AS raw FROM b)"""


@query("prompt_two_role", f"SELECT doc_id, 2 AS n_messages, 'system,user' AS roles, "
                          f"md5({lit_sql(prompts.PERSONA_SYSTEM)}) AS system_md5, md5(content) AS user_md5 FROM {PAGES_SQL}")
def prompt_two_role(spark, sf):
    """[system, user] persona prompt over the first 200 words of long pages."""
    pr = P.persona_prompts(table(spark, sf, "documents"), "doc_id", "text")
    return pr.select("doc_id", F.size("prompt").alias("n_messages"),
                     F.array_join(F.transform("prompt", lambda m: m["role"]), ",").alias("roles"),
                     F.md5(F.col("prompt")[0]["content"]).alias("system_md5"),
                     F.md5(F.col("prompt")[1]["content"]).alias("user_md5"))


_MODEL_SQL = f"(['model-a', 'model-b'])[1 + ({sql_keyed_hash(['42', chr(39) + 'model' + chr(39), 'doc_id'])} % 2)]"


@query("prompt_one_role", f"""SELECT doc_id, model, CASE WHEN model = 'model-b' THEN 1 ELSE 2 END AS n_messages,
  CASE WHEN model = 'model-b' THEN 'user' ELSE 'system' END AS first_role,
  md5(CASE WHEN model = 'model-b' THEN {lit_sql(prompts.EXPAND_SYSTEM)} || chr(10) || chr(10) || content
      ELSE {lit_sql(prompts.EXPAND_SYSTEM)} END) AS first_md5
FROM (SELECT doc_id, content, {_MODEL_SQL} AS model FROM {PAGES_SQL})""")
def prompt_one_role(spark, sf):
    """Single user message for some models, [system, user] for the others."""
    d = P.persona_prompts(table(spark, sf, "documents"), "doc_id", "text").select(
        "doc_id", F.col("prompt")[1]["content"].alias("content"))
    model = F.element_at(F.array(F.lit("model-a"), F.lit("model-b")),
                         (keyed_choice(2, 42, "model", F.col("doc_id")) + 1).cast("int"))
    d = d.withColumn("model", model).withColumn(
        "m", prompts.routed(F.col("model"), P.ONE_ROLE_MODELS, F.lit(prompts.EXPAND_SYSTEM), F.col("content")))
    return d.select("doc_id", "model", F.size("m").alias("n_messages"), F.col("m")[0]["role"].alias("first_role"),
                    F.md5(F.col("m")[0]["content"]).alias("first_md5"))


_SEED_SQL = ("(SELECT item_id, text AS prompt, "
             f"(['en', 'fr', 'de', 'es'])[1 + ({sql_keyed_hash(['42', chr(39) + 'seed_language' + chr(39), 'item_id'])} % 4)] AS language, "
             f"(['instruction_following', 'math'])[1 + ({sql_keyed_hash(['42', chr(39) + 'domain' + chr(39), 'item_id'])} % 2)] AS domain "
             "FROM benchmark)")


def _sql_fill(tmpl: str) -> str:
    return f"replace(replace({lit_sql(tmpl)}, '{{seed_language}}', language), '{{seed_prompt}}', prompt)"


@query("template_fill", f"SELECT item_id, domain, md5(CASE WHEN domain = 'math' THEN {_sql_fill(prompts.MATH_SYSTEM)} "
                        f"ELSE {_sql_fill(prompts.TASK_SYSTEM)} END) AS system_md5 FROM {_SEED_SQL}")
def template_fill(spark, sf):
    """``{seed_language}`` then ``{seed_prompt}`` substitution per seed."""
    s = seed_prompts(spark, sf)
    tmpl = F.when(F.col("domain") == "math", F.lit(prompts.MATH_SYSTEM)).otherwise(F.lit(prompts.TASK_SYSTEM))
    return s.select("item_id", "domain", F.md5(prompts.fill_template(tmpl, F.col("language"), F.col("prompt"))).alias("system_md5"))


@query("persona_json", f"""SELECT doc_id, md5(to_json(struct_pack(countries := [lang], languages := [source],
  persona := array_to_string({sql_words('text')}, ' ')))) AS json_md5 FROM documents""")
def persona_json(spark, sf):
    """Persona struct serialised as JSON text."""
    d = table(spark, sf, "documents")
    st = F.struct(F.array("lang").alias("countries"), F.array("source").alias("languages"),
                  F.array_join(words("text"), " ").alias("persona"))
    return d.select("doc_id", F.md5(prompts.persona_json(st)).alias("json_md5"))


@query("enrich_mock", f"SELECT doc_id, 'mock-model' AS model, md5(raw) AS raw_md5, NULL::VARCHAR AS error "
                      f"FROM {sql_mock(PAGES_SQL, 'doc_id')}")
def enrich_mock(spark, sf):
    """Batch model call through ``mapInPandas`` with the offline mock client."""
    pr = P.persona_prompts(table(spark, sf, "documents"), "doc_id", "text")
    out = P.enrich_personas(pr, "doc_id", partitions=partitions(spark))
    return out.select("doc_id", "model", F.md5("raw").alias("raw_md5"), "error")


_PERSONAS_SQL = f"""SELECT doc_id, i AS pos, 'reader ' || substr(h, 9 + 4 * i, 4) AS persona,
  'C' || substr(h, 3 + i, 1) AS country, 'L' || substr(h, 6 + i, 1) AS language
FROM {sql_mock(PAGES_SQL, 'doc_id')} m, range(0, 3) r(i) WHERE i < n AND mode <> 1"""


@query("explode_personas", _PERSONAS_SQL)
def explode_personas(spark, sf):
    """Parse the model reply (object or bare array) and explode personas."""
    pr = P.persona_prompts(table(spark, sf, "documents"), "doc_id", "text")
    ok, _ = split_parsed(P.enrich_personas(pr, "doc_id", partitions=partitions(spark)), "items")
    ex = explode_items(ok, "items", "doc_id")
    return ex.select("doc_id", F.col("pos").cast("bigint").alias("pos"), F.col("item.persona").alias("persona"),
                     F.get(F.col("item.countries"), 0).alias("country"), F.get(F.col("item.languages"), 0).alias("language"))


@query("persona_rejects", f"SELECT doc_id, 'unparsed' AS reason FROM {sql_mock(PAGES_SQL, 'doc_id')} WHERE mode = 1")
def persona_rejects(spark, sf):
    """Replies that do not parse go to rejects (their keys stay unprocessed)."""
    pr = P.persona_prompts(table(spark, sf, "documents"), "doc_id", "text")
    _, rej = split_parsed(P.enrich_personas(pr, "doc_id", partitions=partitions(spark)), "items")
    return rej.select("doc_id", "reason")


def _model_text(e):
    props = F.col("props")
    return (F.when(e == "view", props)
             .when(e == "click", F.concat(F.lit("Sure! "), props, F.lit(" Hope it helps")))
             .when(e == "signup", F.concat(F.lit("["), props, F.lit("]")))
             .when(e == "purchase", F.substring(props, 1, 5))
             .otherwise(F.lit("no json here")))


_EV_TEXT_SQL = ("CASE event_type WHEN 'view' THEN props WHEN 'click' THEN 'Sure! ' || props || ' Hope it helps' "
                "WHEN 'signup' THEN '[' || props || ']' WHEN 'purchase' THEN substr(props, 1, 5) ELSE 'no json here' END")
_EV_SQL = f"""(SELECT event_id, span, obj,
   CASE WHEN json_valid(span) THEN CASE WHEN obj THEN json_extract(span, '$.k')::BIGINT
        ELSE json_extract(span, '$[0].k')::BIGINT END END AS k
 FROM (SELECT event_id, {sql_json_span('t')} AS span,
         strpos(t, '{{') > 0 AND (strpos(t, '[') = 0 OR strpos(t, '{{') < strpos(t, '[')) AS obj
       FROM (SELECT event_id, {_EV_TEXT_SQL} AS t FROM events)))"""


def _parsed_events(spark, sf):
    ev = table(spark, sf, "events").select("event_id", _model_text(F.col("event_type")).alias("t"))
    span = json_span("t")
    k = F.when(opens_with_object("t"), F.from_json(span, "struct<k: bigint>")["k"]) \
         .otherwise(F.get(F.from_json(span, "array<struct<k: bigint>>"), 0)["k"])
    return ev.select("event_id", k.alias("k"))


@query("json_extract", f"SELECT event_id, k FROM {_EV_SQL}")
def json_extract(spark, sf):
    """JSON object or array span inside free text, parsed with a schema."""
    return _parsed_events(spark, sf)


@query("json_rejects", f"SELECT event_id FROM {_EV_SQL} WHERE k IS NULL")
def json_rejects(spark, sf):
    """Texts without a parsable span are rejected."""
    return _parsed_events(spark, sf).where(F.col("k").isNull()).select("event_id")


_PT_SQL = """SELECT event_id, CASE event_type WHEN 'view' THEN 'viewer ' || k WHEN 'click' THEN 'clicker ' || k
  WHEN 'error' THEN '' END AS persona
FROM (SELECT *, json_extract_string(props, '$.k') AS k FROM events)
WHERE event_type IN ('view', 'click') OR (event_type = 'error' AND value >= 10)"""


@query("persona_text", _PT_SQL)
def persona_text_q(spark, sf):
    """Usable text of polymorphic persona values (VARIANT)."""
    ev = table(spark, sf, "events")
    k = F.get_json_object("props", "$.k")
    e = F.col("event_type")
    js = (F.when(e == "view", F.concat(F.lit('{"persona": "viewer '), k, F.lit('"}')))
           .when(e == "click", F.concat(F.lit('"clicker '), k, F.lit('"')))
           .when(e == "signup", F.concat(F.lit('{"persona": '), k, F.lit("}")))
           .when(e == "purchase", F.concat(F.lit("["), F.col("props"), F.lit("]")))
           .otherwise(F.when(F.col("value") < 10, F.lit('""')).otherwise(F.lit('{"persona": ""}'))))
    v = ev.select("event_id", F.parse_json(js).alias("v"))
    return v.select("event_id", persona_text("v").alias("persona")).where(F.col("persona").isNotNull())


# Instruction generation over long documents acting as personas.
_PERSONA_OF = f"array_to_string({sql_words('text')}, ' ')"


def _persona_rows(spark, sf):
    d = table(spark, sf, "documents")
    from corpusflow.operators import filters
    return filters.min_words(d, "text", 100).select(F.col("doc_id"), F.array_join(words("text"), " ").alias("persona"))


def _topics(spark, sf):
    return table(spark, sf, "documents").select(F.col("source").alias("topic")).distinct()


def _seeds(spark, sf):
    s = seed_prompts(spark, sf).where(F.col("domain") == "instruction_following")
    return s.select(F.col("item_id").alias("seed_item"), F.col("prompt").alias("seed_prompt"),
                    F.col("language").alias("seed_language"))


def _assigned(spark, sf):
    return P.assign_choices(_persona_rows(spark, sf), "doc_id", spark, _topics(spark, sf), _seeds(spark, sf))


def _sql_list(vals):
    return "[" + ", ".join(lit_sql(v) for v in vals) + "]"


def _kh(purpose):
    return sql_keyed_hash(["42", lit_sql(purpose), "doc_id"])


_ASSIGN_SQL = f"""(WITH pr AS (SELECT doc_id, {_PERSONA_OF} AS persona FROM documents WHERE len({sql_words('text')}) > 100),
 tp AS (SELECT topic, row_number() OVER (ORDER BY {sql_keyed_hash([lit_sql('dimension'), 'topic'])}, topic) - 1 AS idx FROM (SELECT DISTINCT source AS topic FROM documents)),
 sd AS (SELECT item_id AS seed_item, prompt AS seed_prompt, language AS seed_language,
               row_number() OVER (ORDER BY {sql_keyed_hash([lit_sql('dimension'), 'item_id'])}, item_id) - 1 AS idx FROM {_SEED_SQL} WHERE domain = 'instruction_following')
 SELECT pr.doc_id, pr.persona, {_sql_list(P.LANGUAGES)}[1 + ({_kh('language')} % {len(P.LANGUAGES)})] AS language,
        {_sql_list(P.STYLES)}[1 + ({_kh('style')} % {len(P.STYLES)})] AS style, tp.topic, sd.seed_item, sd.seed_prompt, sd.seed_language
 FROM pr JOIN tp ON tp.idx = {_kh('topic')} % (SELECT count(*) FROM tp)
         JOIN sd ON sd.idx = {_kh('seed')} % (SELECT count(*) FROM sd))"""


@query("choice_join", f"SELECT doc_id, language, style, topic, seed_item FROM {_ASSIGN_SQL}")
def choice_join(spark, sf):
    """Keyed random language, style, topic and seed joined from broadcast dimensions."""
    return _assigned(spark, sf).select("doc_id", "language", "style", "topic", "seed_item")


_USER_SQL = ("'Persona: ' || persona || chr(10) || '    Domain: ' || topic || chr(10) || '    Style: ' || style "
             "|| chr(10) || '    Language: ' || language")


@query("explode_prompts", f"""SELECT CAST(doc_id AS VARCHAR) || '_' || CAST(i AS VARCHAR) AS prompt_id, doc_id,
  i AS pos, 'task ' || substr(h, 9 + 4 * i, 4) AS prompt, language, topic AS domain, style, '' AS url
FROM {sql_mock(f"(SELECT doc_id, language, style, topic, {_USER_SQL} AS content FROM {_ASSIGN_SQL})", 'doc_id, language, style, topic', 'prompts')} m,
  range(0, 3) r(i) WHERE i < n AND mode <> 1""")
def explode_prompts_q(spark, sf):
    """Stage 4: prompt per persona, model call, validation, one row per generated prompt."""
    pr = P.instruction_prompts(_assigned(spark, sf))
    out = P.enrich_instructions(pr, ["doc_id", "language", "style", "topic"], partitions=partitions(spark))
    ok, _ = P.valid_instructions(out)
    ex = explode_prompts(ok, "items", "doc_id", None)
    return ex.select("prompt_id", "doc_id", F.col("pos").cast("bigint").alias("pos"), "prompt", "language",
                     F.col("topic").alias("domain"), "style", "url")


_EXPAND_CONTENT = ("(SELECT item_key, to_json(struct_pack(countries := [country], languages := [language], persona := persona)) AS content "
                   f"FROM (SELECT CAST(doc_id AS VARCHAR) || '#' || CAST(pos AS VARCHAR) AS item_key, * FROM ({_PERSONAS_SQL})))")


@query("expand_personas", f"""SELECT item_key AS parent_key, i AS pos, 'reader ' || substr(h, 9 + 4 * i, 4) AS persona
FROM {sql_mock(_EXPAND_CONTENT, 'item_key')} m, range(0, 3) r(i) WHERE i < n AND mode <> 1""")
def expand_personas(spark, sf):
    """Stage 2 (persona -> persona): JSON-serialised persona prompt, model call, explode; keys are row keys."""
    pr = P.persona_prompts(table(spark, sf, "documents"), "doc_id", "text")
    ok, _ = split_parsed(P.enrich_personas(pr, "doc_id", partitions=partitions(spark)), "items")
    first = explode_items(ok, "items", "doc_id").select(F.col("item_key").alias("parent_key"), "item")
    prompted = P.expand_prompts(first, "parent_key", "item")
    out = P.enrich_personas(prompted, "parent_key")
    ok2, _ = split_parsed(out, "items")
    ex = explode_items(ok2, "items", "parent_key")
    return ex.select("parent_key", F.col("pos").cast("bigint").alias("pos"), F.col("item.persona").alias("persona"))


def _with_url(spark, sf):
    """Assigned personas with the url of the page that has their id ('' where there is none)."""
    pages = table(spark, sf, "pages").select(F.col("page_id").alias("doc_id"), "url")
    return _assigned(spark, sf).join(pages, "doc_id", "left").withColumn("url", F.coalesce("url", F.lit("")))


_RECORD_KEYS = "doc_id, persona, url, language, style, topic"


def _records_sql(user_sql: str) -> str:
    content = f"""(SELECT a.doc_id, a.persona, coalesce(p.url, '') AS url, a.language, a.style, a.topic, {user_sql} AS content
      FROM {_ASSIGN_SQL} a LEFT JOIN pages p ON p.page_id = a.doc_id)"""
    return f"""SELECT persona, url, CAST(doc_id AS VARCHAR) || '_' || CAST(i AS VARCHAR) AS id, 'task ' || substr(h, 9 + 4 * i, 4) AS prompt,
  language, 'mock-model' AS model, topic AS domain, style
FROM {sql_mock(content, _RECORD_KEYS, 'prompts')} m, range(0, 3) r(i) WHERE i < n AND mode <> 1"""


def _records(spark, sf, math: bool):
    prompted = P.instruction_prompts(_with_url(spark, sf), math=math)
    out = P.enrich_instructions(prompted, ["doc_id", "persona", "url", "language", "style", "topic"], options={"temperature": 0.7})
    return P.prompt_records(out, "doc_id")[0]


@query("prompt_records", _records_sql(_USER_SQL))
def prompt_records_q(spark, sf):
    """The complete stage 4 record (8 fields), url from ``pages``."""
    return _records(spark, sf, math=False)


@query("prompt_records_math", _records_sql("'Persona: ' || persona || chr(10) || '    Language: ' || language"))
def prompt_records_math(spark, sf):
    """Math mode end to end (its own template, a user prompt of persona and language)."""
    return _records(spark, sf, math=True)
