"""Dataset mixing.

Each part is shuffled by a keyed hash (seed | part | split | row key).  One job
counts the ranges of that key for all parts; the counts give the cut of each
part to a count or a fraction (exact, and only the rows that stay are
exchanged).  Parts are aligned by column and field name and unioned.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import reduce
from typing import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusflow.functions.keys import keyed_hash
from corpusflow.operators.filters import require_columns, split_kind
from corpusflow.operators.messages import to_messages
from corpusflow.operators.positions import first_of_parts, key_histograms, sorted_positions


def parse_mixer(mixer) -> dict:
    """A dict as it is, or a flat list of names and amounts; a text amount with a point is a fraction."""
    if isinstance(mixer, dict):
        return dict(mixer)
    names, amounts = list(mixer[0::2]), list(mixer[1::2])
    if len(names) != len(amounts):
        raise ValueError(f"the mixer has {len(names)} names but {len(amounts)} amounts: {mixer}")
    wrong = [n for n in names if not isinstance(n, str)]
    if wrong:
        raise ValueError(f"part names must be text, not {wrong}")
    return {n: (float(v) if "." in v else int(v)) if isinstance(v, str) else v for n, v in zip(names, amounts)}


def amount_mode(amounts: list) -> bool:
    """True for row counts (some amount above 1, all integers), False for fractions."""
    below = [v for v in amounts if v < 0]
    if below:
        raise ValueError(f"amounts below zero: {below}")
    counts = max(amounts, default=0) > 1
    if counts and not all(type(v) is int for v in amounts):
        raise NotImplementedError(f"either all amounts are row counts or all are fractions: {amounts}")
    return counts


def row_key(df: DataFrame, order_col: str | None) -> F.Column:
    """Row identity for the keyed shuffle: a unique column, or the whole row's md5."""
    if order_col:
        return F.col(order_col).cast("string")
    return F.md5(F.to_json(F.struct(*[F.col(c) for c in df.columns])))


def _keyed(df: DataFrame, name: str, split: str, seed: int, order_col: str | None) -> DataFrame:
    """Rows with ``_rk`` (identity) and the uniform ``_k``.

    Without a unique column, equal rows would share one key and land in one
    task however many there are.  They are counted first (partial aggregation)
    and dealt out again as numbered copies with keys of their own.
    """
    d = df.withColumn("_rk", row_key(df, order_col))
    if not order_col:
        rows = d.groupBy("_rk").agg(F.any_value(F.struct(*[F.col(c) for c in df.columns])).alias("_row"), F.count(F.lit(1)).alias("_c"))
        rows = rows.select("_rk", "_row", F.explode(F.sequence(F.lit(1), F.col("_c"))).alias("_copy"))
        d = rows.select("_row.*", F.concat_ws("#", "_rk", F.nullif(F.col("_copy").cast("string"), F.lit("1"))).alias("_rk"))
    return d.withColumn("_k", keyed_hash(seed, name, split, F.col("_rk")))


def _merged_type(a: T.DataType, b: T.DataType, at: str) -> T.DataType:
    """The type of a column that two parts have: structs by field name, the first's order; widest of two numbers."""
    if a == b or isinstance(b, T.NullType):
        return a
    if isinstance(a, T.NullType):
        return b
    if isinstance(a, T.StructType) and isinstance(b, T.StructType):
        both = {f.name: f for f in b.fields}
        own = [T.StructField(f.name, _merged_type(f.dataType, both[f.name].dataType, f"{at}.{f.name}") if f.name in both else f.dataType)
               for f in a.fields]
        return T.StructType(own + [T.StructField(f.name, f.dataType) for f in b.fields if f.name not in a.names])
    if isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType):
        return T.ArrayType(_merged_type(a.elementType, b.elementType, f"{at}[]"))
    whole = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
    if isinstance(a, whole) and isinstance(b, whole):
        return max(a, b, key=lambda t: whole.index(type(t)))
    if all(isinstance(t, (*whole, T.FloatType, T.DoubleType)) for t in (a, b)):
        return T.DoubleType()
    raise ValueError(f"column {at}: parts have types {a.simpleString()} and {b.simpleString()}, which do not agree")


def _shaped(c: F.Column, have: T.DataType, want: T.DataType) -> F.Column:
    """``c`` rebuilt as ``want``: nested fields are taken by name, missing ones are NULL."""
    if isinstance(want, T.StructType) and isinstance(have, T.StructType):
        kinds = {f.name: f.dataType for f in have.fields}
        fields = [(_shaped(c[f.name], kinds[f.name], f.dataType) if f.name in kinds else F.lit(None).cast(f.dataType)).alias(f.name)
                  for f in want.fields]
        return F.when(c.isNotNull(), F.struct(*fields))
    if isinstance(want, T.ArrayType) and isinstance(have, T.ArrayType):
        return F.transform(c, lambda x: _shaped(x, have.elementType, want.elementType))
    return c.cast(want)


def align_parts(parts: list[DataFrame], columns: list[str], extra: list[list[str]] | None = None) -> list[DataFrame]:
    """Every part with the same columns and types, and behind them its own ``extra`` columns as they are.

    A column's type comes from the parts that have it (the first leads); a part
    without it gets NULL of that type.  Types that do not agree are an error.
    """
    types: dict[str, T.DataType] = {}
    for d in parts:
        for f in d.schema.fields:
            if f.name in columns:
                types[f.name] = _merged_type(types[f.name], f.dataType, f.name) if f.name in types else f.dataType
    types = {c: types.get(c, T.StringType()) for c in columns}
    types = {c: T.StringType() if isinstance(t, T.NullType) else t for c, t in types.items()}
    out = []
    for d, more in zip(parts, extra or [[]] * len(parts)):
        have = {f.name: f.dataType for f in d.schema.fields}
        out.append(d.select(*[(_shaped(F.col(c), have[c], t) if c in have else F.lit(None).cast(t)).alias(c) for c, t in types.items()], *more))
    return out


def table_loader(spark, configs: dict | None = None) -> Callable[..., DataFrame]:
    """Loader of parts by name: a JSON(L) file, else a saved dataset folder (``<name>[/<config>]/<split>``, Parquet or JSON)."""
    from corpusflow.sources.ledger import path_exists
    from corpusflow.sources.tables import read_any

    def load(name: str, split: str, config: str | None = None) -> DataFrame:
        if name.endswith((".json", ".jsonl")):
            return read_any(spark, name)
        root = "/".join(x for x in (name.rstrip("/"), config) if x)
        for path in (f"{root}/{split}", f"{root}/{split}.parquet", f"{root}/{split}.jsonl", f"{root}/{split}.json"):
            if path_exists(spark, path):
                return read_any(spark, path)
        raise ValueError(f"no split {split!r} of {root!r}")
    return load


def mix(load: Callable[..., DataFrame], mixer, splits=("train", "test"), columns_to_keep=(),
        shuffle: bool = True, seed: int = 42, need_columns=None, keep_ids: bool = False,
        add_source_col: bool = False, order_col: str | None = None, check_counts: bool = True,
        save_dir: str | None = None, configs: list | None = None) -> dict[str, DataFrame]:
    """Mix parts into {"train": df, "test": df}.

    ``load(name, split)``, or ``load(name, split, config)`` when ``configs``
    gives one configuration per part, returns a part.  Train parts are cut to
    the count or fraction given for their part; test parts are kept whole.
    ``order_col`` names a unique column to key the shuffle (else the row content is).

    One job counts the key ranges of all parts; from the counts follow the cut
    of every part and the offsets of its positions, so the parts are read once
    more and only the rows that stay are exchanged, all parts at once.  A part
    that is kept whole without new ids is not exchanged at all.
    """
    amounts = parse_mixer(mixer)
    is_count = amount_mode(list(amounts.values()))
    if configs and len(configs) != len(amounts):
        raise ValueError(f"{len(configs)} configurations for {len(amounts)} parts")
    keep = [c for c in dict.fromkeys(columns_to_keep or []) if c != "id"]
    parts: list[_Part] = []
    for i, (name, amount) in enumerate(amounts.items()):
        for split in splits:
            kind = split_kind(split)
            df = load(name, split, configs[i]) if configs else load(name, split)
            if need_columns:
                require_columns(df, need_columns)
            raw, df = df, to_messages(df)
            part = _Part(name, kind, raw, df, amount if kind == "train" else None, bool((keep_ids or save_dir) and "id" not in df.columns))
            if not shuffle and not order_col and (part.new_ids or kind == "train"):
                raise ValueError("without shuffle, positions need an order_col")
            if shuffle and (part.new_ids or kind == "train"):
                part.df = _keyed(df, name, split, seed, order_col)
            parts.append(part)
    if not parts:
        raise ValueError(f"the splits {list(splits)} gave no part to mix")
    ranked = [p for p in parts if shuffle and (p.new_ids or p.kind == "train")]
    buckets, counts = key_histograms([p.df for p in ranked], "_k") if ranked else (0, [])
    for p, c in zip(ranked, counts):
        p.counts, p.limit = c, p.rows_wanted(sum(n for _, n in c), is_count, check_counts)
    if is_count and check_counts and not shuffle:
        _check_counts([(p.name, p.amount, p.raw) for p in parts if p.kind == "train"])
    for p in parts:
        if not shuffle and (p.new_ids or p.kind == "train"):
            p.df = sorted_positions(p.df, order_col, out="pos", total_out="_tot")
            if p.kind == "train":
                p.df = p.df.where(F.col("pos") < (F.lit(p.amount) if is_count else F.floor(F.col("_tot") * F.lit(float(p.amount)))))
            if p.new_ids:
                p.df = p.df.withColumn("id", F.concat(F.lit(f"{p.name}_"), F.col("pos").cast("string")))
    # Parts that are cut or numbered, to be ranked together; the others are read as they are.
    cut = [p for p in ranked if p.new_ids or p.limit < sum(n for _, n in p.counts)]
    for p in parts:
        new = [F.lit(None).cast("string").alias("id")] if p in cut and p.new_ids else ["id"] if "id" in p.df.columns else []
        kept = p.df.select(*new, *[c for c in keep if c in p.df.columns], *(["_k", "_rk"] if p in cut else []))
        p.df = kept.withColumn("source", F.lit(p.name)) if add_source_col else kept
    columns = (["id"] if any("id" in p.df.columns for p in parts) else []) + keep + (["source"] if add_source_col else [])
    keys = [["_k", "_rk"] if p in cut else [] for p in parts]
    for p, d in zip(parts, align_parts([p.df for p in parts], columns, keys)):
        p.df = d
    out = {}
    for kind in ("train", "test"):
        own = [p for p in parts if p.kind == kind]
        done = [p.df for p in own if p not in cut]
        if both := [p for p in own if p in cut]:
            rows = reduce(lambda a, b: a.unionByName(b), [p.df.withColumn("_p", F.lit(i)) for i, p in enumerate(both)])
            rows = first_of_parts(rows, buckets, [p.counts for p in both], [p.limit for p in both], "_k", "_rk")
            if any(p.new_ids for p in both):
                names = F.element_at(F.array(*[F.lit(p.name if p.new_ids else None) for p in both]), F.col("_p") + 1)
                rows = rows.withColumn("id", F.coalesce(F.concat(names, F.lit("_"), F.col("pos").cast("string")), F.col("id").cast("string")))
            done = [rows.select(*columns), *done]
        if done:
            out[kind] = reduce(lambda a, b: a.unionByName(b), done)
    if save_dir:
        for split, d in out.items():
            d.write.mode("overwrite").json(f"{save_dir.rstrip('/')}/mixed_ds_{split}")
    return out if keep_ids else {k: v.drop("id") for k, v in out.items()}


@dataclass(eq=False)
class _Part:
    """One part of a mix: the amount is None for parts that are kept whole (test)."""

    name: str
    kind: str
    raw: DataFrame
    df: DataFrame
    amount: int | float | None
    new_ids: bool
    counts: list = field(default_factory=list)
    limit: int = 0

    def rows_wanted(self, total: int, is_count: bool, check: bool) -> int:
        if self.amount is None:
            return total
        if not is_count:
            return math.floor(total * float(self.amount))
        if check and total < self.amount:
            raise ValueError(f"requested {self.amount} rows from {self.name}, only {total} available")
        return int(self.amount)


def _check_counts(train) -> None:
    """A requested count above the part size is an error (parts that are not shuffled; the others are counted with their keys)."""
    parts = [d.select(F.lit(i).alias("_i")) for i, (_, _, d) in enumerate(train)]
    got = {r["_i"]: r["n"] for r in reduce(lambda a, b: a.unionByName(b), parts)
           .groupBy("_i").agg(F.count(F.lit(1)).alias("n")).collect()}
    for i, (name, amount, _) in enumerate(train):
        if got.get(i, 0) < amount:
            raise ValueError(f"requested {amount} rows from {name}, only {got.get(i, 0)} available")


def manifest(mixed: DataFrame, model_name: str, source_col: str = "source", datasets: list[str] | None = None,
             base_model: str | None = None, model_type: str = "sft") -> DataFrame:
    """K5: one-row lineage record.

    ``datasets`` lists the declared parts: each appears, also with no row left
    in the mix; by default the parts that have rows.
    """
    per = mixed.groupBy(F.col(source_col).alias("source")).agg(F.count(F.lit(1)).alias("rows"))
    if datasets is not None:
        declared = mixed.sparkSession.createDataFrame([(d,) for d in datasets], "source string")
        per = declared.join(per, "source", "left").withColumn("rows", F.coalesce("rows", F.lit(0).cast("bigint")))
    one = per.agg(F.array_sort(F.collect_list("source")).alias("datasets"),
                  F.coalesce(F.sum("rows"), F.lit(0)).cast("bigint").alias("rows"),
                  F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("source", "rows"))))).alias("rows_by_source"))
    return (one.withColumn("model_name", F.lit(model_name)).withColumn("model_type", F.lit(model_type))
               .withColumn("base_model", F.lit(base_model).cast("string")))


def save_manifest(record: DataFrame, path: str) -> None:
    """K5: the record as a JSON file under ``path`` (one row, one file)."""
    record.write.mode("overwrite").json(path)
