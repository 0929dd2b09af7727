"""A sample of the registered queries against their DuckDB twins on the smallest tables."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as E  # noqa: E402
from check_oracle import TABLES, digest  # noqa: E402

from conftest import SF0001  # noqa: E402

SAMPLE = ["min_words", "first_n_words", "lsh_dedup", "anti_processed", "first_turn_filter", "explode_personas",
          "json_extract", "persona_text", "choice_join", "chat_render", "loss_mask", "pad_batches",
          "mix_fraction", "shuffle_rank", "step_window_mean", "msg_instruction"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF0001}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_sql_twin(spark, duck, name):
    df = E.queries()[name](spark, SF0001)
    cols, rows = df.columns, [tuple(r) for r in df.collect()]
    res = duck.execute(E.oracle_sql()[name])
    ocols, orows = [d[0] for d in res.description], res.fetchall()
    assert sorted(cols) == sorted(ocols)
    assert len(rows) == len(orows)
    assert digest(cols, rows)[0] == digest(ocols, orows)[0]
