"""JSON-lines and CSV I/O.

Writes are idempotent per batch: each batch goes to its own ``batch=<id>``
sub-folder with overwrite, so a retried batch replaces its own output
instead of appending duplicates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusflow.sources.tables import read_csv

# The table of file splits is broadcast up to this many splits (about 64 bytes each); beyond, the join is left to Spark.
MOST_SPLITS = 1 << 20
CORRUPT = "_corrupt"
# About a third of the default level's time, for files that are 7 % larger; one task reads a whole file, so its rows are bounded.
GZIP = {"compression": "gzip", "zlib.compress.level": "THREE", "maxRecordsPerFile": "4096"}


def _lines(spark: SparkSession, path: str, glob: str | None) -> DataFrame:
    r = spark.read
    if glob:
        r = r.option("pathGlobFilter", glob)
    return r.text(path)


def with_lines(scan: DataFrame, per: str = "file") -> DataFrame:
    """A file scan with ``file_name``, ``file_path``, 0-based ``line`` and ``file_rank`` (order of the paths) per row.

    ``line`` counts within a file or, with ``per="folder"``, on through the files of a folder in the order of their
    names: a large part of a dataset can then be written as many files and keeps its line numbers.

    Rows are numbered inside their scan task, where the rows of a split follow
    one another.  A narrow count per split gives the first number of the split
    and the rows before it in its file; that table is joined by broadcast, so
    the rows themselves are not exchanged and no file is gathered in one task.
    Files are told apart by their full path.
    """
    if per not in ("file", "folder"):
        raise ValueError(f"per is file or folder, not {per!r}")
    d = (scan.withColumn("file_name", F.col("_metadata.file_name")).withColumn("file_path", F.col("_metadata.file_path"))
             .withColumn("_split", F.col("_metadata.file_block_start")).withColumn("_row", F.monotonically_increasing_id()))
    # Two hashes stand for a path: the table stays narrow however long the paths are.
    marks = [F.xxhash64("file_path").alias("_f"), F.xxhash64(F.lit("path"), F.col("file_path")).alias("_g")]
    splits = d.groupBy("file_path", "_split").agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_n"))
    whole = F.col("file_path") if per == "file" else F.regexp_replace("file_path", "[^/]*$", "")
    before = Window.partitionBy(whole).orderBy("file_path", "_split").rowsBetween(Window.unboundedPreceding, -1)
    # One row per file: the window's single task grows with the files, not with their rows.
    ranks = splits.select("file_path").distinct().select("file_path", (F.dense_rank().over(Window.orderBy("file_path")) - 1).cast("bigint").alias("file_rank"))
    table = (splits.select("file_path", "_split", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off")).join(ranks, "file_path")
                   .select(*marks, "_split", (F.col("_off") - F.col("_first")).alias("_shift"), "file_rank"))
    bound = len(scan.inputFiles()) + scan._jdf.queryExecution().toRdd().getNumPartitions()  # no more splits than that
    table = F.broadcast(table) if bound <= MOST_SPLITS else table
    return (d.select("*", *marks).join(table, ["_f", "_g", "_split"])
             .withColumn("line", (F.col("_row") + F.col("_shift")).cast("bigint")).drop("_f", "_g", "_split", "_row", "_shift"))


def parsed_lines(lines: DataFrame, schema) -> DataFrame:
    """Text lines (column ``value``) as the fields of JSON records; ``_corrupt`` holds a line that is not one.

    Blank lines are no records.  All fields are parsed wherever one is read,
    so whether a line is malformed does not depend on the columns a reader picks.
    """
    kind = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    full = T.StructType([*kind.fields, T.StructField(CORRUPT, T.StringType())])
    record = F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    rest = [c for c in lines.columns if c != "value"]
    # A partition column of the folder gives its field's value, as in Spark's own readers.
    fields = [F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) if f.name in rest else F.col(f"_r.`{f.name}`") for f in full.fields]
    return (lines.where(F.trim("value") != "").select(record.alias("_r"), *rest)
                 .select(*fields, *[c for c in rest if c not in kind.names]))


def strict(rows: DataFrame) -> DataFrame:
    """``rows`` of :func:`parsed_lines` without the corrupt column; a malformed line fails the job, whatever is read of it.

    The error sits in a filter and in every field: later filters may be
    evaluated before the first, but not without one of the fields.
    """
    where = [F.lit(" in "), F.col("file_path"), F.lit(" line "), F.col("line").cast("string")] if "line" in rows.columns else []
    bad = F.raise_error(F.concat(F.lit("malformed JSON"), *where, F.lit(": "), F.substring(CORRUPT, 1, 200)))
    malformed = F.col(CORRUPT).isNotNull()
    own = [c for c in rows.columns if c != CORRUPT]
    extra = ("file_name", "file_path", "line", "file_rank")
    return (rows.where(F.when(malformed, bad.cast("boolean")).otherwise(F.lit(True)))
                .select(*[F.col(f"`{c}`") if c in extra else F.when(malformed, bad).otherwise(F.col(f"`{c}`")).alias(c) for c in own]))


def split_malformed(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good rows, rejects) of numbered :func:`parsed_lines`; a reject has file_path, line and the raw text."""
    good = rows.where(F.col(CORRUPT).isNull()).drop(CORRUPT)
    return good, rows.where(F.col(CORRUPT).isNotNull()).select("file_path", "line", F.col(CORRUPT).alias("raw"))


def read_jsonl_rejects(spark: SparkSession, path: str, schema, glob: str | None = "*.jsonl",
                       per: str = "file") -> tuple[DataFrame, DataFrame]:
    """(rows with file and line, rejects (file_path, line, raw)) of JSON lines under ``path``; lines as in :func:`with_lines`."""
    return split_malformed(parsed_lines(with_lines(_lines(spark, path, glob), per), schema))


def read_jsonl(spark: SparkSession, path: str, schema, with_position: bool = False,
               glob: str | None = "*.jsonl") -> DataFrame:
    """JSON lines under ``path`` (a file or a folder; by default only ``*.jsonl`` files); a malformed line fails the job.

    Spark's own JSON writer names files ``*.json``: read those with ``glob="*.json"``.

    ``with_position`` adds ``file_name``, ``file_path``, ``file_rank`` and the 0-based ``line`` of the file (W6).
    """
    lines = _lines(spark, path, glob)
    return strict(parsed_lines(with_lines(lines) if with_position else lines, schema))


def write_jsonl(df: DataFrame, path: str, batch_id: int | None = None, partition_by: list[str] | None = None,
                mode: str = "overwrite", gzip: bool = False) -> str:
    """K1/K3/K4: write JSON lines (UTF-8, nulls dropped as in Spark's default); ``gzip`` writes ``*.json.gz`` files of bounded rows."""
    out = f"{path.rstrip('/')}/batch={batch_id}" if batch_id is not None else path
    w = df.write.mode(mode)
    if gzip:
        w = w.options(**GZIP)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.json(out)
    return out


def read_csv_records(spark: SparkSession, path: str, schema=None, multi_line: bool = False) -> DataFrame:
    """CSV with header (quoted commas/braces) turned into JSON-record strings.

    ``multi_line`` allows line breaks inside quoted fields (:func:`corpusflow.sources.tables.read_csv`).
    """
    df = read_csv(spark, path, schema, multi_line)
    return df.select(F.to_json(F.struct(*[F.col(c) for c in df.columns])).alias("record"))
