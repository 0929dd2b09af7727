"""Page -> persona and persona -> instruction jobs (stages 1, 2 and 4).

Both are one lazy plan: scan -> filters -> ledger anti-join -> prompt
expressions -> ``enrich`` (the only Python step) -> JSON parse -> explode.
The model runs once per row: callers persist or write the enriched frame
before splitting it into results and rejects.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusflow.functions.keys import keyed_choice, keyed_hash
from corpusflow.functions.text import first_n_words
from corpusflow.operators import filters, prompts
from corpusflow.operators.enrich import PERSONA_ITEM, PROMPT_ITEM, enrich, mock_client, parsed_list, split_parsed
from corpusflow.operators.positions import exact_positions
from corpusflow.sources.ledger import exclude_processed

# Our own default vocabularies (parameters of the instruction job).
LANGUAGES = ["English", "French", "German", "Spanish", "Portuguese", "Italian", "Dutch", "Polish", "Swedish"]
STYLES = ["question", "instruction", "puzzle", "dialogue", "summary", "critique", "plan", "story", "explanation"]
ONE_ROLE_MODELS = ["model-b"]


def persona_prompts(pages: DataFrame, id_col: str, text_col: str, ledger: DataFrame | None = None,
                    min_words: int = 100, head_words: int = 200, system: str = prompts.PERSONA_SYSTEM,
                    carry: tuple = (), counts: filters.StageCounts | None = None) -> DataFrame:
    """Stage 1 up to the model call: (id, columns to carry such as ``url``, prompt messages).

    ``counts`` observes the rows of each stage (A1) in the job that runs the plan.
    """
    seen = counts.stage if counts else lambda df, name: df
    d = seen(filters.min_words(seen(pages, "pages"), text_col, min_words), "long")
    if ledger is not None:
        d = seen(exclude_processed(d, ledger, id_col), "todo")
    return d.select(F.col(id_col), *carry, prompts.two_role(F.lit(system), first_n_words(text_col, head_words)).alias("prompt"))


def enrich_personas(prompted: DataFrame, id_col: str, client_factory=None, **kw) -> DataFrame:
    """Model call + parse: (id and all other columns of ``prompted``, raw, model, error, items)."""
    factory = client_factory or (lambda **o: mock_client("persona", **o))
    out = enrich(prompted, factory, "prompt", [id_col, *[c for c in prompted.columns if c not in (id_col, "prompt")]], **kw)
    return out.withColumn("items", parsed_list("raw", "persona_list", PERSONA_ITEM))


def dimension(spark: SparkSession, values: list[str], name: str) -> DataFrame:
    """A closed vocabulary as (idx, value); a few rows, broadcast by construction."""
    return spark.createDataFrame(list(enumerate(values)), f"idx bigint, {name} string")


# A dimension of at most this many rows is sorted in one task and broadcast; a larger one is numbered by ranges and joined
# as Spark sees fit.
SMALL_DIMENSION = 100_000


def indexed(df: DataFrame, key_col: str) -> tuple[DataFrame, int]:
    """(dimension rows numbered 0, 1, ... in the order of a hash of ``key_col``, their number).

    The number is counted first: a small dimension (the usual case) is sorted
    once and broadcast, so what it is joined to is not exchanged.
    """
    n = df.count()
    keyed = df.withColumn("_k", keyed_hash("dimension", F.col(key_col)))
    if n > SMALL_DIMENSION:
        return exact_positions(keyed, "_k", key_col, out="idx").drop("_k"), n
    order = Window.orderBy("_k", key_col)
    return F.broadcast(keyed.withColumn("idx", (F.row_number().over(order) - 1).cast("bigint")).drop("_k")), n


def assign_choices(personas: DataFrame, id_col: str, spark: SparkSession, topics: DataFrame, seeds: DataFrame,
                   seed: int = 42) -> DataFrame:
    """One keyed random language, style, topic and seed prompt per row.

    Each choice is ``md5(seed|purpose|id) mod n`` joined to an ``(idx, value)``
    dimension.  Topics and seeds come from data and may have any size
    (:func:`indexed`).
    """
    topic_rows, n_topics = indexed(topics, "topic")
    seed_rows, n_seeds = indexed(seeds, "seed_item")
    p = (personas
         .withColumn("_li", keyed_choice(len(LANGUAGES), seed, "language", F.col(id_col)))
         .withColumn("_si", keyed_choice(len(STYLES), seed, "style", F.col(id_col)))
         .withColumn("_ti", keyed_choice(max(1, n_topics), seed, "topic", F.col(id_col)))
         .withColumn("_pi", keyed_choice(max(1, n_seeds), seed, "seed", F.col(id_col))))
    # Closed vocabularies built from driver lists: bounded by construction.
    lang = F.broadcast(dimension(spark, LANGUAGES, "language")).withColumnRenamed("idx", "_li")
    sty = F.broadcast(dimension(spark, STYLES, "style")).withColumnRenamed("idx", "_si")
    return (p.join(lang, "_li").join(sty, "_si")
             .join(topic_rows.withColumnRenamed("idx", "_ti"), "_ti")
             .join(seed_rows.withColumnRenamed("idx", "_pi"), "_pi")
             .drop("_li", "_si", "_ti", "_pi"))


def instruction_prompts(assigned: DataFrame, persona_col: str = "persona", model_col: str | None = None,
                        math: bool = False) -> DataFrame:
    """Stage 4 prompt: system from the seed (P7), labelled user text (P8), shape by model."""
    template = prompts.MATH_SYSTEM if math else prompts.TASK_SYSTEM
    system = prompts.fill_template(template, F.col("seed_language"), F.col("seed_prompt"))
    user = prompts.labelled_user_prompt(F.col(persona_col), F.col("language"), F.col("topic"), F.col("style"), math)
    msgs = (prompts.routed(F.col(model_col), ONE_ROLE_MODELS, system, user) if model_col
            else prompts.two_role(system, user))
    return assigned.withColumn("prompt", msgs)


def enrich_instructions(prompted: DataFrame, key_cols: list[str], client_factory=None, **kw) -> DataFrame:
    """Stage 4 model call + parse: (keys..., raw, model, error, items ARRAY<prompt item>)."""
    factory = client_factory or (lambda **o: mock_client("prompts", **o))
    out = enrich(prompted, factory, "prompt", key_cols, **kw)
    return out.withColumn("items", parsed_list("raw", "prompts", PROMPT_ITEM))


def prompt_records(enriched: DataFrame, id_col: str) -> tuple[DataFrame, DataFrame]:
    """K1: (records, rejects) of stage 4.

    A record has persona, url ('' when absent), id (``<id>_<position>``),
    prompt, language, model, domain and style.
    """
    from corpusflow.operators.expand import explode_prompts
    ok, rejects = valid_instructions(enriched)
    out = explode_prompts(ok, "items", id_col, "url")
    return out.select("persona", "url", F.col("prompt_id").alias("id"), "prompt", "language", "model",
                      F.col("topic").alias("domain"), "style"), rejects


def valid_instructions(enriched: DataFrame):
    """All prompts of a row must carry text, else the whole row is rejected."""
    return split_parsed(enriched, "items", require=["prompt"])


def expand_prompts(personas: DataFrame, key_col: str, persona_col: str, model_col: str | None = None,
                   system: str = prompts.EXPAND_SYSTEM) -> DataFrame:
    """Stage 2 prompt: the persona serialised as JSON (P9), prompt shape by model."""
    user = prompts.persona_json(F.col(persona_col))
    msgs = (prompts.routed(F.col(model_col), ONE_ROLE_MODELS, F.lit(system), user) if model_col
            else prompts.two_role(F.lit(system), user))
    return personas.select(F.col(key_col), msgs.alias("prompt"))


JOB_TABLES = {"rows": "rows", "rejects": "rejects"}


def write_batch(spark: SparkSession, log, run: str, batch_id: int, prompted, id_col: str, out_dir: str, ledger_path: str,
                client_factory=None, shape=None, info=None) -> dict:
    """One batch of a persona job: replies, rows, rejects and ledger keys, visible by one commit.

    ``prompted()`` gives the prompts; it is called only if the batch's replies
    are not stored yet.  They are kept over a failure (a replay uses them and
    does not ask the model again), every other table of a failed attempt is
    written anew.  ``shape`` maps (rows, rejects) to the tables as stored and
    ``info(...)`` adds facts to the commit.  Returns the committed entry.
    """
    from corpusflow.operators.expand import explode_items
    from corpusflow.sources.ledger import keys_folder, path_exists, write_filter
    done = log.entry(run, batch_id)
    if done:
        return done
    replies = f"{out_dir.rstrip('/')}/enriched/run={run}/batch_id={batch_id}"
    if not path_exists(spark, f"{replies}/_SUCCESS"):
        enrich_personas(prompted(), id_col, client_factory).write.mode("overwrite").parquet(replies)
    enriched = spark.read.parquet(replies)
    ok, rejects = split_parsed(enriched, "items")
    rows, rejects = (shape or (lambda x, y: (x, y)))(explode_items(ok, "items", id_col), rejects.drop("items"))
    keys = ok.select(F.col(id_col).cast("string").alias("key")).distinct()
    at = log.begin(run, batch_id, {k: f"{out_dir.rstrip('/')}/{v}" for k, v in JOB_TABLES.items()} | {"keys": keys_folder(ledger_path, log.op)})
    rows.write.parquet(at["rows"])
    rejects.write.parquet(at["rejects"])
    write_filter(keys, ledger_path, log.op, batch_id, run=run)
    keys.write.parquet(at["keys"])
    log.commit(run, batch_id, at, info() if info else None)
    return log.entry(run, batch_id)


def persona_job(spark: SparkSession, pages: DataFrame, id_col: str, text_col: str, out_dir: str,
                ledger_path: str, batch_id: int, client_factory=None, run: str = "batch") -> DataFrame:
    """Stage 1 as one batch job: rows, rejects and ledger keys of batch ``batch_id``, committed together; returns the rows.

    A batch that is committed is not run again; one that failed goes on from its
    stored replies.  The stage counts (A1) are observed while the replies are
    written and kept in the commit (:func:`job_counts`).
    """
    from corpusflow.operators.filters import StageCounts
    from corpusflow.sources.commits import CommitLog
    from corpusflow.sources.ledger import read_ledger
    log = CommitLog(spark, ledger_path, "persona")
    counts = StageCounts()
    carry = ("url",) if "url" in pages.columns else ()

    def prompted() -> DataFrame:
        return persona_prompts(pages, id_col, text_col, read_ledger(spark, ledger_path, "persona"), carry=carry, counts=counts)
    entry = write_batch(spark, log, run, batch_id, prompted, id_col, out_dir, ledger_path, client_factory, info=lambda: {"counts": counts.get()})
    return spark.read.parquet(entry["tables"]["rows"])


def job_rows(spark: SparkSession, ledger_path: str, schema, op: str = "persona", table: str = "rows") -> DataFrame:
    """Rows (or another table) of all committed batches of a job."""
    from corpusflow.sources.commits import CommitLog
    return CommitLog(spark, ledger_path, op).read(table, schema)


def job_counts(spark: SparkSession, ledger_path: str, batch_id: int, run: str = "batch", op: str = "persona") -> dict[str, int]:
    """A1: the stage counts of a committed batch: pages read, long enough, not processed before.

    Empty where the batch was finished by a replay, which read its stored replies only.
    """
    from corpusflow.sources.commits import CommitLog
    entry = CommitLog(spark, ledger_path, op).entry(run, batch_id)
    return entry["info"].get("counts", {}) if entry else {}
