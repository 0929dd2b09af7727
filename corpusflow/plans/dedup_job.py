"""Stage 3 as one job: persona files in a folder -> first-wins dedup -> output folder.

Rows are ordered by (file path, line) (T8: explicit order, not listing
order); ids become ``<id>#<line>`` (P12); usable persona text follows the
VARIANT rule (F6/T5); kept rows are written with their shingle list (K3) to
a folder separate from the input (T7).
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.functions.text import all_shingles
from corpusflow.operators.dedup import first_wins_dedup
from corpusflow.operators.persona import persona_text
from corpusflow.sources.jsonl import read_jsonl, read_jsonl_rejects, write_jsonl

PERSONA_ROW = "id string, url string, persona variant, model string, lang string"


def _ordered(rows: DataFrame) -> DataFrame:
    return (rows.withColumn("ord", F.col("file_rank") * F.lit(1 << 32) + F.col("line"))
                .withColumn("id", F.concat(F.col("id"), F.lit("#"), F.col("line").cast("string")))
                .drop("file_rank", "file_path"))


def ordered_rows(spark: SparkSession, in_dir: str, schema: str = PERSONA_ROW, glob: str = "*.jsonl") -> DataFrame:
    """Rows with ``ord`` = (rank of file path) * 2^32 + line, and ``id#line`` ids."""
    return _ordered(read_jsonl(spark, in_dir, schema, with_position=True, glob=glob))


def dedup_persona_files(spark: SparkSession, in_dir: str, out_dir: str | None = None, threshold: float = 0.8,
                        k: int = 3, glob: str = "*.jsonl", schema: str = PERSONA_ROW, rejects_dir: str | None = None,
                        gzip: bool = False) -> DataFrame:
    """Dedup every persona file under ``in_dir``; the index spans all files.

    The ordered, usable rows are written once to the shared scratch folder
    (the lineage cut), so the JSON scan runs once although dedup reads its input
    twice.  They hold the text once, as ``persona``, and are not exchanged
    afterwards (:func:`corpusflow.operators.dedup.with_kept`): what the job
    keeps on disk is its input, those rows and the output, which is several
    times the text (``gzip`` compresses its files).  A malformed line fails
    the job; with ``rejects_dir`` it is written there with its file and line,
    and the other rows go on.
    """
    from corpusflow.session import new_scratch_dir
    if rejects_dir:
        good, rejects = read_jsonl_rejects(spark, in_dir, schema, glob)
        write_jsonl(rejects, rejects_dir)
        rows = _ordered(good)
    else:
        rows = ordered_rows(spark, in_dir, schema, glob)
    staged, text = new_scratch_dir(spark, "persona-ordered"), persona_text("persona")
    rows.where(text.isNotNull()).write.option("compression", "zstd").mode("overwrite").parquet(staged)
    usable = spark.read.parquet(staged)
    kept = first_wins_dedup(usable, "ord", text, threshold, k, words_dir=new_scratch_dir(spark, "persona-kept"))
    out = kept.withColumn("shingles", all_shingles(text, k))
    if out_dir:
        write_jsonl(out.withColumn("persona", F.to_json("persona")), out_dir, gzip=gzip)
    return out
