"""Table scans (S1, S2, S6, S7) and the training-source selection rule."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table (``{sf_dir}/{name}.parquet``)."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# Complete quoted fields of a CSV line, and a quoted field that is still open at its end.
_QUOTED, _OPEN = r'(^|,)"[^"]*+(?:""[^"]*+)*+"(?=,|$)', r'(^|,)"'


def read_csv(spark: SparkSession, path: str, schema=None, multi_line: bool = False) -> DataFrame:
    """CSV with header, quotes doubled inside quoted fields.

    ``multi_line`` allows line breaks inside quoted fields; such a file cannot be split among tasks.
    Without it a line that ends inside a quoted field fails the job, so no record is broken in silence:
    the lines are read once, as raw text without the header, looked at, and parsed by ``from_csv``.
    """
    r = spark.read.option("header", True).option("escape", '"').option("multiLine", multi_line)
    if schema is not None:
        r = r.schema(schema)
    if multi_line:
        return r.csv(path)
    kind = r.csv(path).schema  # given, or the names of the header line
    # One column that no separator or quote divides: the raw line, with Spark's own handling of the header of every file.
    lines = spark.read.option("header", True).option("sep", "\u0001").option("quote", "").option("enforceSchema", True).schema("value string").csv(path)
    broken = F.regexp_replace("value", _QUOTED, "$1").rlike(_OPEN)
    error = F.raise_error(F.concat(F.lit("a quoted CSV field holds a line break, read it with multi_line=True: "),
                                   F.substring("value", 1, 200))).cast("boolean")
    sound = lines.where(F.when(broken, error).otherwise(F.lit(True)))
    return sound.select(F.from_csv("value", F.lit(kind.toDDL()), {"escape": '"'}).alias("_r")).select("_r.*")


def read_any(spark: SparkSession, path: str, schema=None, fmt: str | None = None, multi_line: bool = False) -> DataFrame:
    """Read a dataset by format: explicit ``fmt``, else by suffix.

    ``.json``/``.jsonl`` -> JSON lines (schema strongly advised; a malformed line
    fails the job), ``.csv`` -> CSV with header, anything else -> Parquet (a
    directory of a saved split).
    ``multi_line`` allows line breaks inside quoted CSV fields (:func:`read_csv`).
    """
    fmt = fmt or ("json" if path.endswith((".json", ".jsonl")) else
                  "csv" if path.endswith(".csv") else "parquet")
    r = spark.read
    if schema is not None:
        r = r.schema(schema)
    if fmt == "json":
        return r.option("mode", "FAILFAST").json(path)
    if fmt == "csv":
        return read_csv(spark, path, schema, multi_line)
    return r.format(fmt).load(path)


def scan_partition(spark: SparkSession, path: str, column: str, value) -> DataFrame:
    """One configuration (e.g. a language) of a corpus.

    On a ``partitionBy(column)`` layout the predicate prunes directories; on a
    flat Parquet file it is pushed into the scan as a row-group filter.
    """
    return read_any(spark, path).where(F.col(column) == F.lit(value))


def resolve_source(dataset_name: str | None = None, dataset_mixer: dict | None = None,
                   dataset_mixer_list: list | None = None, train_file: str | None = None) -> tuple[str, object]:
    """Exactly one of name / mixer dict / mixer list / file; file must be JSON(L).

    Returns ``(kind, value)`` with kind in {"name", "mixer", "mixer_list", "file"}.
    """
    given = [(k, v) for k, v in (("name", dataset_name), ("mixer", dataset_mixer),
                                 ("mixer_list", dataset_mixer_list), ("file", train_file))
             if v is not None]
    if not given:
        raise ValueError("no training source is given")
    if len(given) > 1:
        raise ValueError(f"more than one training source is given: {[k for k, _ in given]}")
    kind, value = given[0]
    if kind == "file":
        ext = os.path.splitext(str(value))[1].lstrip(".")
        if ext not in ("json", "jsonl"):
            raise ValueError(f"unknown kind of training file: {value}")
    return kind, value
