"""Catalog: keyed shuffles and samples, dataset mixing (documents by language as parts)."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusflow.functions.keys import sql_keyed_hash
from corpusflow.functions.text import sql_words
from corpusflow.operators import filters
from corpusflow.operators import mix as MX
from corpusflow.operators import sampling as S
from corpusflow.plans.catalog_text import seed_prompts
from corpusflow.plans.registry import query, table

LANGS = ["en", "fr", "de", "es"]


def _kh(purpose_sql, id_sql="doc_id"):
    return sql_keyed_hash(["42", purpose_sql, id_sql])


@query("shuffle_rank", f"SELECT doc_id, (row_number() OVER (ORDER BY {_kh(chr(39) + 'shuffle' + chr(39))}, doc_id) - 1) AS pos FROM documents")
def shuffle_rank(spark, sf):
    """L1/L2: reproducible keyed shuffle with exact positions (no single-task window)."""
    return S.shuffle_positions(table(spark, sf, "documents").select("doc_id"), "doc_id")


@query("batch_assign", f"""SELECT doc_id, pos, pos // 10 AS batch_id FROM (SELECT doc_id,
  (row_number() OVER (ORDER BY {_kh(chr(39) + 'shuffle' + chr(39))}, doc_id) - 1) AS pos FROM documents
  WHERE len({sql_words('text')}) > 100)""")
def batch_assign(spark, sf):
    """Long pages in shuffled order cut into batches of 10."""
    d = filters.min_words(table(spark, sf, "documents"), "text", 100).select("doc_id")
    return S.assign_batches(d, "doc_id", 10).select("doc_id", "pos", "batch_id")


@query("sample_k", f"SELECT doc_id FROM documents ORDER BY {_kh(chr(39) + 'inspect' + chr(39))}, doc_id LIMIT 3")
def sample_k(spark, sf):
    """Three rows to inspect (top-k by keyed order; the limit is the feature)."""
    return S.first_n(table(spark, sf, "documents").select("doc_id"), "doc_id", 3, purpose="inspect")


@query("max_samples", f"SELECT doc_id FROM documents ORDER BY {_kh(chr(39) + 'shuffle' + chr(39))}, doc_id LIMIT 500")
def max_samples(spark, sf):
    """Cap the training rows at 500 in keyed order (the cap is the feature)."""
    return S.first_n(table(spark, sf, "documents").select("doc_id"), "doc_id", 500)


def load_part(spark, sf):
    """Parts: documents of one language (train) and benchmark items of that language (test)."""
    def load(name, split):
        if "train" in split:
            return table(spark, sf, "documents").where(F.col("lang") == name).select("doc_id", "text", "lang", "n_chars")
        s = seed_prompts(spark, sf).where(F.col("language") == name)
        return s.select(F.col("item_id").alias("doc_id"), F.col("prompt").alias("text"), F.col("language").alias("lang"))
    return load


def _pos_sql(split="train"):
    return (f"(row_number() OVER (PARTITION BY lang ORDER BY "
            f"{sql_keyed_hash(['42', 'lang', repr(split), 'doc_id'])}, CAST(doc_id AS VARCHAR)) - 1)")


def _train_sql(amounts: dict, count: bool, extra_cols="doc_id, lang"):
    cases = " ".join(f"WHEN '{k}' THEN {v if count else f'floor(total * {float(v)}::DOUBLE)'}" for k, v in amounts.items())
    langs = ", ".join(f"'{k}'" for k in amounts)
    return f"""(SELECT lang || '_' || CAST(pos AS VARCHAR) AS id, {extra_cols} FROM (
  SELECT *, {_pos_sql()} AS pos, count(*) OVER (PARTITION BY lang) AS total FROM documents WHERE lang IN ({langs}))
  WHERE pos < CASE lang {cases} END)"""


COUNTS = {"en": 40, "fr": 30, "de": 20, "es": 10}
FRACTIONS = {"en": 0.3, "fr": 0.25, "de": 0.29, "es": 0.5}


@query("mix_count", f"SELECT * FROM {_train_sql(COUNTS, True)}")
def mix_count(spark, sf):
    """L3/P20: exact counts per part in keyed shuffle order, generated ids."""
    out = MX.mix(load_part(spark, sf), COUNTS, splits=("train",), columns_to_keep=["doc_id", "lang"],
                 keep_ids=True, order_col="doc_id")
    return out["train"].select("id", "doc_id", "lang")


@query("mix_fraction", f"SELECT * FROM {_train_sql(FRACTIONS, False)}")
def mix_fraction(spark, sf):
    """int(fraction x size) rows per part."""
    out = MX.mix(load_part(spark, sf), FRACTIONS, splits=("train",), columns_to_keep=["doc_id", "lang"],
                 keep_ids=True, order_col="doc_id")
    return out["train"].select("id", "doc_id", "lang")


CONCAT_LIST = ["en", "25", "fr", "15", "de", "10", "es", "5"]


@query("mix_concat", f"SELECT lang AS source, doc_id FROM {_train_sql({'en': 25, 'fr': 15, 'de': 10, 'es': 5}, True)}")
def mix_concat(spark, sf):
    """List-form mixer with string amounts, parts concatenated with a source column."""
    out = MX.mix(load_part(spark, sf), CONCAT_LIST, splits=("train",), columns_to_keep=["doc_id"],
                 add_source_col=True, order_col="doc_id")
    return out["train"].select("source", "doc_id")


_ALIGN_F = {"en": 0.1, "fr": 0.1, "de": 0.1, "es": 0.1}
_TEST_SQL = (f"(SELECT item_id AS doc_id, (['en', 'fr', 'de', 'es'])[1 + ({sql_keyed_hash(['42', repr('seed_language'), 'item_id'])} % 4)] AS lang "
             "FROM benchmark)")


@query("mix_align", f"""SELECT 'train' AS split, doc_id, lang, n_chars FROM {_train_sql(_ALIGN_F, False, 'doc_id, lang, n_chars')}
UNION ALL SELECT 'test' AS split, doc_id, lang, NULL::BIGINT AS n_chars FROM {_TEST_SQL}""")
def mix_align(spark, sf):
    """Kept columns only, missing ones as typed NULL, every part cast to the first's schema."""
    out = MX.mix(load_part(spark, sf), _ALIGN_F, splits=("train", "test"), columns_to_keep=["doc_id", "lang", "n_chars"],
                 order_col="doc_id")
    return (out["train"].select(F.lit("train").alias("split"), "doc_id", "lang", "n_chars")
            .unionByName(out["test"].select(F.lit("test").alias("split"), "doc_id", "lang", "n_chars")))


@query("mix_ids", f"SELECT id, doc_id FROM {_train_sql({k: 1.0 for k in LANGS}, False)}")
def mix_ids(spark, sf):
    """P20: '<part>_<position after shuffle>' ids for parts without an id column."""
    out = MX.mix(load_part(spark, sf), {k: 1.0 for k in LANGS}, splits=("train",), columns_to_keep=["doc_id"],
                 keep_ids=True, order_col="doc_id")
    return out["train"].select("id", "doc_id")


@query("mix_source", f"SELECT lang AS source, doc_id FROM {_train_sql({'en': 0.5, 'de': 0.5}, False)}")
def mix_source(spark, sf):
    """Constant source column per part."""
    out = MX.mix(load_part(spark, sf), {"en": 0.5, "de": 0.5}, splits=("train",), columns_to_keep=["doc_id"],
                 add_source_col=True, order_col="doc_id")
    return out["train"].select("source", "doc_id")


@query("mix_manifest", f"""SELECT string_agg(source, ',' ORDER BY source) AS datasets, sum(n)::BIGINT AS rows,
  '{{' || string_agg('"' || source || '":' || CAST(n AS VARCHAR), ',' ORDER BY source) || '}}' AS rows_by_source,
  'model-a' AS model_name
FROM (SELECT lang AS source, count(*) AS n FROM {_train_sql({'en': 25, 'fr': 15, 'de': 10, 'es': 5}, True)} GROUP BY lang)""")
def mix_manifest(spark, sf):
    """K5: one-row lineage record of a mix."""
    out = MX.mix(load_part(spark, sf), CONCAT_LIST, splits=("train",), columns_to_keep=["doc_id"],
                 add_source_col=True, order_col="doc_id")
    m = MX.manifest(out["train"], "model-a")
    return m.select(F.array_join("datasets", ",").alias("datasets"), "rows", "rows_by_source", "model_name")


@query("split_route", f"SELECT doc_id, lang FROM {_TEST_SQL}")
def split_route(spark, sf):
    """Test splits are routed by name and concatenated unsampled."""
    out = MX.mix(load_part(spark, sf), {k: 0.5 for k in LANGS}, splits=("test_dev",), columns_to_keep=["doc_id", "lang"],
                 order_col="doc_id")
    return out["test"].select("doc_id", "lang")


@query("mix_saved", f"SELECT id, doc_id, lang FROM {_train_sql(COUNTS, True)}")
def mix_saved(spark, sf):
    """Mixed splits saved as JSON (ids included), read back."""
    from corpusflow.session import new_scratch_dir
    out_dir = new_scratch_dir(spark, "mix-save")
    MX.mix(load_part(spark, sf), COUNTS, splits=("train",), columns_to_keep=["doc_id", "lang"], order_col="doc_id",
           save_dir=out_dir)
    return spark.read.schema("id string, doc_id bigint, lang string").json(f"{out_dir}/mixed_ds_train")


def _nested_part(spark, sf):
    """Parts in three layouts: prompt/completion, messages with fields in another order, and a part without messages."""
    def load(name, split):
        d = table(spark, sf, "documents").where(F.col("lang") == name).select("doc_id", "text", "source")
        if name == "en":
            return d.select("doc_id", "source")
        if name == "fr":
            return d.select("doc_id", F.col("text").alias("prompt"), F.col("source").alias("completion"))
        turns = [F.struct(F.col(c).alias("content"), F.lit(r).alias("role")) for c, r in (("text", "user"), ("source", "assistant"))]
        return d.select(F.col("doc_id").cast("int").alias("doc_id"), F.array(*turns).alias("messages"))
    return load


_NESTED_SQL = _train_sql({"en": 0.5, "fr": 0.5, "de": 0.5}, False, "doc_id, lang, text, source")


@query("mix_align_nested", f"""SELECT doc_id, CASE WHEN lang = 'en' THEN NULL ELSE 2 END AS n_messages,
  CASE WHEN lang = 'en' THEN NULL ELSE md5('user' || chr(1) || text || chr(1) || 'assistant' || chr(1) || source) END AS messages_md5 FROM {_NESTED_SQL}""")
def mix_align_nested(spark, sf):
    """Messages of two layouts meet by field name; a first part without messages gives them no type."""
    out = MX.mix(_nested_part(spark, sf), {"en": 0.5, "fr": 0.5, "de": 0.5}, splits=("train",), columns_to_keep=["doc_id", "messages"],
                 order_col="doc_id")["train"]
    flat = F.flatten(F.transform("messages", lambda m: F.array(m["role"], m["content"])))
    return out.select("doc_id", F.when(F.col("messages").isNotNull(), F.size("messages")).alias("n_messages"),
                      F.md5(F.array_join(flat, "\u0001")).alias("messages_md5"))
