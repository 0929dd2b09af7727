"""Catalog: JSON-lines and CSV round trips through the shared scratch folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusflow.plans import catalog_text  # noqa: F401  (registers lsh_dedup, whose SQL twin is reused)
from corpusflow.plans.registry import REGISTRY, query, table
from corpusflow.session import FREED_SHUFFLES, new_scratch_dir, session_conf
from corpusflow.sources.jsonl import GZIP, read_csv_records, read_jsonl, write_jsonl

# Rows of documents a file holds at most: a file that only one task can read or write stays bounded.
FILE_ROWS = 4096
CUSTOMER_SCHEMA = "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double"


@query("jsonl_roundtrip", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def jsonl_roundtrip(spark, sf):
    """Write JSON lines partitioned by a column, read back with a schema and line numbers."""
    out = new_scratch_dir(spark, "jsonl")
    c = table(spark, sf, "customer")
    write_jsonl(c, out, partition_by=["c_mktsegment"])
    back = read_jsonl(spark, out, CUSTOMER_SCHEMA + ", c_mktsegment string", with_position=True, glob="*.json")
    return back.select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")


@query("csv_to_json_records", "SELECT doc_id, md5(coalesce(text, '')) AS text_md5, coalesce(lang, '') AS lang FROM documents")
def csv_to_json_records(spark, sf):
    """CSV files with header, quoted texts and line breaks inside them -> one JSON record per row (fields read back from the record)."""
    out = new_scratch_dir(spark, "csv")
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    # A file with line breaks inside fields is read by one task: the rows of a file are bounded, not the files.
    (docs.write.option("maxRecordsPerFile", FILE_ROWS).option("header", True).option("escape", '"').option("quoteAll", True).csv(out))
    records = read_csv_records(spark, out, "doc_id bigint, text string, lang string", multi_line=True)
    r = records.select(F.from_json("record", "doc_id bigint, text string, lang string").alias("r")).select("r.*")
    return r.select("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"), F.coalesce("lang", F.lit("")).alias("lang"))


@query("csv_lines_checked", "SELECT c_custkey, c_name || ', \"' || c_mktsegment || '\"' AS label, c_acctbal FROM customer")
def csv_lines_checked(spark, sf):
    """CSV files read in one splittable scan (quotes and commas inside quoted fields, every line checked for a broken record)."""
    from corpusflow.sources.tables import read_any
    out = new_scratch_dir(spark, "lines") + ".csv"
    label = F.concat("c_name", F.lit(', "'), "c_mktsegment", F.lit('"'))
    table(spark, sf, "customer").select("c_custkey", label.alias("label"), "c_acctbal").write.option("header", True).option("escape", '"').csv(out)
    return read_any(spark, out, "c_custkey bigint, label string, c_acctbal double")


@query("jsonl_rejects", """SELECT doc_id, doc_id % 7 = 3 AS rejected, row_number() OVER (PARTITION BY coalesce(lang, '') ORDER BY doc_id) - 1 AS line
  FROM documents""")
def jsonl_rejects(spark, sf):
    """Files with cut lines: rows and rejects with file and line; every line is in one of the two."""
    from corpusflow.sources.jsonl import read_jsonl_rejects
    out = new_scratch_dir(spark, "cut-lines")
    docs = table(spark, sf, "documents").select("doc_id", "text", F.coalesce("lang", F.lit("")).alias("part"))
    whole = F.to_json(F.struct("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    cut = F.when(F.col("doc_id") % 7 == 3, F.substring(whole, F.lit(1), F.length(whole) - 2)).otherwise(whole)
    # As many files a folder as its rows need, in the order of their names; lines are counted through the folder.
    (docs.repartitionByRange("part", "doc_id").sortWithinPartitions("part", "doc_id")
         .select(cut.alias("value"), "part").write.option("maxRecordsPerFile", FILE_ROWS).partitionBy("part").text(out))
    rows, rejects = read_jsonl_rejects(spark, out, "doc_id bigint, text string", glob="*.txt", per="folder")
    raw_id = F.regexp_extract("raw", r'^\{"doc_id":([0-9]+)', 1).cast("bigint")
    return (rows.select("doc_id", F.lit(False).alias("rejected"), "line")
            .union(rejects.select(raw_id, F.lit(True), "line")))


@query("jsonl_lines", "SELECT n_nationkey, n_name, row_number() OVER (ORDER BY n_nationkey) - 1 AS line FROM nation")
def jsonl_lines(spark, sf):
    """Line index inside a JSON-lines file (written in key order as one file: a 25-row dimension)."""
    out = new_scratch_dir(spark, "jsonl-lines")
    n = table(spark, sf, "nation")
    n.coalesce(1).sortWithinPartitions("n_nationkey").write.mode("overwrite").json(out)
    back = read_jsonl(spark, out, "n_nationkey int, n_name string, n_regionkey int", with_position=True, glob="*.json")
    return back.select("n_nationkey", "n_name", "line")


@query("persona_dedup_files", REGISTRY["lsh_dedup"][1])
def persona_dedup_files(spark, sf):
    """Stage 3 end to end (S4/K3/T4/T5/T7/T8): JSON-lines persona files (strings and objects) -> ordered first-wins dedup -> output folder."""
    from corpusflow.functions.keys import keyed_choice
    from corpusflow.plans.dedup_job import dedup_persona_files
    src, out = new_scratch_dir(spark, "persona-files"), new_scratch_dir(spark, "persona-dedup")
    d = table(spark, sf, "documents")
    as_object = F.to_json(F.struct(F.col("text").alias("persona"), F.array("lang").alias("languages")))
    as_string = F.to_json(F.array("text")).substr(F.lit(2), F.length(F.to_json(F.array("text"))) - 2)
    persona = F.when(keyed_choice(2, 42, "shape", F.col("doc_id")) == 0, as_object).otherwise(as_string)
    # Dealt out in key order before the personas are built: the files, in the order of their names, hold the ids in order.
    d = d.select("doc_id", "text", "lang").repartitionByRange(F.col("doc_id").cast("bigint")).sortWithinPartitions(F.col("doc_id").cast("bigint"))
    rows = d.select(F.col("doc_id").cast("string").alias("id"), F.parse_json(persona).alias("persona"),
                    F.lit("mock-model").alias("model"), "lang")
    with session_conf(spark, FREED_SHUFFLES):
        rows.write.options(**GZIP).mode("overwrite").json(src)
    dedup_persona_files(spark, src, out, glob="*.json.gz", gzip=True)
    back = spark.read.schema("id string, lang string, shingles array<string>").json(out)
    return back.select(F.split("id", "#")[0].cast("bigint").alias("doc_id"), "lang")


@query("scan_lang_partitioned", "SELECT doc_id, lang, n_chars FROM documents WHERE lang = 'fr'")
def scan_lang_partitioned(spark, sf):
    """Language as a partition directory; the scan reads only lang=fr (partition pruning)."""
    from corpusflow.sources.tables import scan_partition
    out = new_scratch_dir(spark, "by-lang")
    table(spark, sf, "documents").select("doc_id", "n_chars", "lang").write.mode("overwrite").partitionBy("lang").parquet(out)
    df = scan_partition(spark, out, "lang", "fr").select("doc_id", "lang", "n_chars")
    plan = df._jdf.queryExecution().executedPlan().toString()
    if "PartitionFilters: [isnotnull(lang" not in plan:
        raise AssertionError("expected partition pruning on lang")
    return df


@query("jsonl_lines_partitioned", """SELECT c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) - 1 AS line,
  dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS file_rank FROM customer""")
def jsonl_lines_partitioned(spark, sf):
    """Lines and file order over folders whose files share one name."""
    out = new_scratch_dir(spark, "jsonl-folders")
    c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    c.repartition("c_mktsegment").sortWithinPartitions("c_mktsegment", "c_custkey").write.partitionBy("c_mktsegment").json(out)
    back = read_jsonl(spark, out, "c_custkey bigint, c_mktsegment string", with_position=True, glob="*.json")
    return back.select("c_custkey", "c_mktsegment", "line", "file_rank")
