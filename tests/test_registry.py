"""Driver contract: entry() runs, every query has a callable, and a sample
of queries matches its DuckDB oracle on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as E
from tools.oracle_check import TABLES, digest

SF = "/root/testdata/sf0.001"

SAMPLE = ["tag_scoreboard", "tag_scoreboard_pivot", "exact_mood_first_tag", "match_coverage",
          "index_documents", "label_documents", "tokens_treebank", "vocabulary", "split_80_10_10",
          "balance_classes", "tfidf", "nearest_k", "per_class_report", "skipgram_pairs"]


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "mood" in df.columns


def test_every_sql_has_a_query():
    q, s = E.queries(), E.oracle_sql()
    assert set(s) <= set(q)
    assert len(q) >= 90


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", SAMPLE)
def test_matches_oracle(spark, duck, name):
    sdf = E.queries()[name](spark, SF).toPandas()
    ddf = duck.execute(E.oracle_sql()[name]).df()
    assert digest(sdf)[:3] == digest(ddf)[:3]
