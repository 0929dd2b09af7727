"""Catalog: scans, filters, word functions, dedup, ledger exclusion, counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusflow.functions.keys import keyed_choice, sql_keyed_hash
from corpusflow.functions.text import SPACE_CLASS_RE2, first_n_words, more_words_than, n_words, shingles, sql_words, strip_ws
from corpusflow.operators import dedup, filters
from corpusflow.operators.dedup import (band_keys, lsh_params, minhash_coefficients, signatures,
                                        sql_band_ctes, sql_first_wins)
from corpusflow.plans.registry import partitions, query, table
from corpusflow.sources.ledger import exclude_processed
from corpusflow.sources.tables import scan_partition

def sql_strip(x: str) -> str:
    """DuckDB twin of ``strip_ws`` (Python ``str.strip``)."""
    return f"regexp_replace({x}, '^[{SPACE_CLASS_RE2}]+|[{SPACE_CLASS_RE2}]+$', '', 'g')"


@query("scan_lang", "SELECT doc_id, lang, n_chars FROM documents WHERE lang = 'en'")
def scan_lang(spark, sf):
    """One language configuration of the corpus (pushed-down filter)."""
    return scan_partition(spark, f"{sf}/documents.parquet", "lang", "en").select("doc_id", "lang", "n_chars")


@query("min_words", f"SELECT doc_id, len({sql_words('text')}) AS n_words FROM documents "
                    f"WHERE len({sql_words('text')}) > 100")
def min_words(spark, sf):
    """Pages with more than 100 words."""
    d = table(spark, sf, "documents")
    return filters.min_words(d, "text", 100).select("doc_id", n_words("text").alias("n_words"))


@query("first_n_words", f"SELECT doc_id, md5(array_to_string({sql_words('text')}[1:200], ' ')) AS head_md5, "
                        f"len({sql_words('text')}[1:200]) AS head_words FROM documents")
def first_n_words_q(spark, sf):
    """First 200 words re-joined with single spaces."""
    d = table(spark, sf, "documents")
    head = first_n_words("text", 200)
    return d.select("doc_id", F.md5(head).alias("head_md5"), n_words(head).alias("head_words"))


@query("lower_md5", f"SELECT doc_id, md5(lower({sql_strip('text')})) AS norm_md5 FROM documents")
def lower_md5(spark, sf):
    """Strip + lower-case."""
    d = table(spark, sf, "documents")
    return d.select("doc_id", F.md5(F.lower(strip_ws("text"))).alias("norm_md5"))


_SH_SQL = f"""WITH w AS (SELECT doc_id, {sql_words('lower(text)')} AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) >= 3 THEN list_distinct([array_to_string(w[i:i + 2], ' ')
      FOR i IN range(1, len(w) - 1)]) ELSE [] END AS s FROM w)
SELECT doc_id, len(s) AS n_shingles, md5(array_to_string(list_sort(s), chr(10))) AS shingles_md5 FROM s"""


@query("shingles", _SH_SQL)
def shingles_q(spark, sf):
    """Distinct lower-cased word 3-shingles per document."""
    d = table(spark, sf, "documents").select("doc_id", shingles("text", 3).alias("s"))
    return d.select("doc_id", F.size("s").alias("n_shingles"),
                    F.md5(F.array_join(F.array_sort("s"), "\n")).alias("shingles_md5"))


_BAND_CTES, _NB = sql_band_ctes("documents", "doc_id", "text")


@query("minhash_bands", f"WITH {_BAND_CTES} SELECT o AS doc_id, band, key FROM bands")
def minhash_bands(spark, sf):
    """117 min-hashes per document cut into 9 band keys of 13 values."""
    b, r = lsh_params(0.8)
    d = table(spark, sf, "documents")
    keys = band_keys(signatures(d, "doc_id", "text", 3, minhash_coefficients(b * r)), "doc_id", b, r)
    return keys.select("doc_id", F.col("band").cast("int").alias("band"),
                       F.concat_ws("-", F.transform("key", lambda x: x.cast("string"))).alias("key"))


@query("lsh_dedup", f"SELECT d.doc_id, d.lang FROM documents d SEMI JOIN ({sql_first_wins('documents', 'doc_id', 'text')}) k "
                    f"ON d.doc_id = k.doc_id")
def lsh_dedup(spark, sf):
    """§2.10/J5/A8: first-row-wins near-duplicate removal (k=3, t=0.8) in doc_id order."""
    d = table(spark, sf, "documents").select("doc_id", "lang", "text")
    return dedup.first_wins_dedup(d, "doc_id", "text", partitions=partitions(spark)).select("doc_id", "lang")


@query("lsh_dedup_aggregate", f"SELECT d.doc_id, d.lang FROM documents d SEMI JOIN ({sql_first_wins('documents', 'doc_id', 'text')}) k "
                              f"ON d.doc_id = k.doc_id")
def lsh_dedup_aggregate(spark, sf):
    """§2.10/A7: the same dedup with min-hashes from a code-generated hash aggregate (no Python at all)."""
    d = table(spark, sf, "documents").select("doc_id", "lang", "text")
    return dedup.first_wins_dedup(d, "doc_id", "text", method="aggregate").select("doc_id", "lang")


_AUDIT_SQL = f"""WITH w AS (SELECT doc_id AS o, {sql_words('lower(text)')} AS w FROM documents),
s AS (SELECT o, CASE WHEN len(w) >= 3 THEN list_distinct([array_to_string(w[i:i + 2], ' ') FOR i IN range(1, len(w) - 1)]) ELSE [] END AS s FROM w),
t AS (SELECT o, len(s) AS n, unnest(s) AS x FROM s),
common AS (SELECT a.o AS a, b.o AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c FROM t a JOIN t b ON a.x = b.x AND a.o < b.o GROUP BY a.o, b.o),
near AS (SELECT DISTINCT b AS o FROM common WHERE c >= 0.8 * (na + nb - c) - 1e-9
  UNION SELECT o FROM s WHERE len(s) = 0 AND o > (SELECT min(o) FROM s WHERE len(s) = 0)),
kept AS ({sql_first_wins('documents', 'doc_id', 'text')})
SELECT s.o AS doc_id, n.o IS NOT NULL AS near, k.doc_id IS NULL AS dropped
FROM s LEFT JOIN near n ON n.o = s.o LEFT JOIN kept k ON k.doc_id = s.o
WHERE n.o IS NOT NULL OR k.doc_id IS NULL"""


@query("lsh_recall_audit", _AUDIT_SQL)
def lsh_recall_audit(spark, sf):
    """§2.10: documents with an earlier one of exact similarity >= 0.8, against those that the LSH dedup drops (missed and false drops)."""
    from corpusflow.operators.similarity import earlier_near
    d = table(spark, sf, "documents").select("doc_id", "text")
    near = earlier_near(d, "doc_id", "text", 0.8, 3).withColumn("near", F.lit(True))
    kept = dedup.kept_ords(d, "doc_id", F.col("text"), partitions=partitions(spark)).withColumn("kept", F.lit(True))
    rows = d.select("doc_id").join(near, "doc_id", "left").join(kept, "doc_id", "left")
    return rows.where("near or kept is null").select("doc_id", F.coalesce("near", F.lit(False)).alias("near"), F.col("kept").isNull().alias("dropped"))


@query("anti_processed", "SELECT doc_id FROM documents d WHERE NOT EXISTS "
                         "(SELECT 1 FROM labels l WHERE CAST(l.doc_id AS VARCHAR) = CAST(d.doc_id AS VARCHAR))")
def anti_processed(spark, sf):
    """Rows whose id is not in the ledger (labels stand in for it)."""
    ledger = table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("key"))
    return exclude_processed(table(spark, sf, "documents"), ledger, "doc_id").select("doc_id")


@query("anti_processed_filtered", "SELECT doc_id, md5(text) AS text_md5 FROM documents d WHERE NOT EXISTS "
                                  "(SELECT 1 FROM labels l WHERE CAST(l.doc_id AS VARCHAR) = CAST(d.doc_id AS VARCHAR))")
def anti_processed_filtered(spark, sf):
    """A ledger of two batches with their Bloom filters; rows that miss the filter pass without an exchange."""
    from corpusflow.session import new_scratch_dir
    from corpusflow.sources.ledger import append_ledger, exclude_processed_filtered, read_filter, read_ledger
    path = new_scratch_dir(spark, "ledger")
    done = table(spark, sf, "labels").select("doc_id")
    for i in range(2):
        append_ledger(done.where(F.col("doc_id") % 2 == i), path, "persona", i, key_col="doc_id")
    left = exclude_processed_filtered(table(spark, sf, "documents"), read_ledger(spark, path, "persona"), read_filter(spark, path, "persona"), "doc_id")
    return left.select("doc_id", F.md5("text").alias("text_md5"))


# Our own domain vocabulary for seed prompts (T14: assigned by keyed hash).
SEED_DOMAINS = ["instruction_following", "math"]
_SEED_DOMAIN_SQL = (f"(['instruction_following', 'math'])[1 + ({sql_keyed_hash(['42', chr(39) + 'domain' + chr(39), 'item_id'])} % 2)]")


def seed_prompts(spark, sf):
    """Seed prompts from ``benchmark``: (item_id, prompt, language, domain)."""
    b = table(spark, sf, "benchmark")
    dom = F.element_at(F.array(*[F.lit(x) for x in SEED_DOMAINS]), (keyed_choice(2, 42, "domain", F.col("item_id")) + 1).cast("int"))
    lang = F.element_at(F.array(*[F.lit(x) for x in ("en", "fr", "de", "es")]),
                        (keyed_choice(4, 42, "seed_language", F.col("item_id")) + 1).cast("int"))
    return b.select("item_id", F.col("text").alias("prompt"), lang.alias("language"), dom.alias("domain"))


@query("seed_filter", f"SELECT item_id, {_SEED_DOMAIN_SQL} AS domain FROM benchmark WHERE {_SEED_DOMAIN_SQL} = 'math'")
def seed_filter(spark, sf):
    """seed prompts of one domain."""
    return filters.equals(seed_prompts(spark, sf), "domain", "math").select("item_id", "domain")


@query("first_turn_filter", "SELECT conv_id, arg_min(role, turn) AS first_value FROM conversations "
                            "GROUP BY conv_id HAVING lower(arg_min(role, turn)) IN ('system')")
def first_turn_filter(spark, sf):
    """Conversations whose first turn's attribute is in a list (case-insensitive)."""
    turns = table(spark, sf, "conversations")
    allowed = spark.createDataFrame([("SYSTEM",)], "value string")
    return filters.first_turn_in(turns, "conv_id", "turn", "role", allowed)


# Our own list of accepted values for A2 (matched case-insensitively).
NATION_LIST = ["Nation_1", "NATION_3", "nation_5", "Nation_8", "nation_13", "NATION_21", "nation_99"]


@query("distinct_matched", "SELECT DISTINCT lower(n.n_name) AS matched FROM customer c JOIN nation n "
                           "ON c.c_nationkey = n.n_nationkey WHERE lower(n.n_name) IN "
                           f"({', '.join(repr(x.lower()) for x in NATION_LIST)})")
def distinct_matched(spark, sf):
    """Distinct matched values (customers' nation names in a list)."""
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    n = table(spark, sf, "nation").select("n_nationkey", "n_name")
    vocab = spark.createDataFrame([(x,) for x in NATION_LIST], "value string").select(F.lower("value").alias("matched"))
    named = c.join(n, c.c_nationkey == n.n_nationkey).select(F.lower("n_name").alias("matched"))
    return named.join(F.broadcast(vocab), "matched", "left_semi").distinct()


_STAGE_SQL = f"""SELECT count(*) AS n_rows,
  count(*) FILTER (WHERE len({sql_words('text')}) > 100) AS n_long,
  count(*) FILTER (WHERE len({sql_words('text')}) > 100 AND l.doc_id IS NULL) AS n_todo,
  count(*) FILTER (WHERE len({sql_words('text')}) < 3) AS n_short
FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id"""


@query("stage_counts", _STAGE_SQL)
def stage_counts(spark, sf):
    """A1: row counts after each filter stage, in one pass."""
    d = table(spark, sf, "documents").select("doc_id", more_words_than("text", 100).alias("long"), (~more_words_than("text", 2)).alias("short"))
    led = table(spark, sf, "labels").select(F.col("doc_id").alias("l_id")).distinct()
    j = d.join(led, d.doc_id == led.l_id, "left")
    return j.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if("long").alias("n_long"),
                 F.count_if(F.col("long") & F.col("l_id").isNull()).alias("n_todo"),
                 F.count_if("short").alias("n_short"))


@query("stage_counts_observed", f"SELECT n_rows, n_long, n_todo FROM ({_STAGE_SQL})")
def stage_counts_observed(spark, sf):
    """A1: the counts of the filter stages, observed while the job that filters writes its rows (one scan, no pass for counting)."""
    from corpusflow.session import new_scratch_dir
    counts = filters.StageCounts()
    d = counts.stage(table(spark, sf, "documents"), "pages")
    d = counts.stage(filters.min_words(d, "text", 100), "long")
    ledger = table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("key"))
    todo = counts.stage(exclude_processed(d, ledger, "doc_id"), "todo")
    todo.select("doc_id", "text").write.parquet(new_scratch_dir(spark, "todo"))
    got = counts.get()
    return spark.createDataFrame([(got["pages"], got["long"], got["todo"])], "n_rows bigint, n_long bigint, n_todo bigint")
