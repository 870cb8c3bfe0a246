"""Every query has SQL, and a sample of them agrees with it."""

import duckdb
import pytest

import __spark_entry__ as entry
from suite.registry import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SAMPLE = ["a3_clone_set_metrics_text", "a7_service_file_stats", "j1_service_resolution", "w1_state_chunks", "a12_pair_summary_without_pairs", "k10_best_compose_file"]


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())
    assert len(QUERIES) > 150


def test_entry(spark):
    df = entry.entry(spark)
    assert df.limit(1).count() == 1 and "service_count" in df.columns


@pytest.mark.parametrize("name", SAMPLE)
def test_query_agrees_with_sql(spark, tiny, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tiny}/{t}.parquet'")
    df = entry.queries()[name](spark, tiny)
    columns = sorted(df.columns)
    want = db.sql(f"SELECT {', '.join(chr(34) + c + chr(34) for c in columns)} FROM ({entry.oracle_sql()[name]})").fetchall()
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in df.select(*columns).collect())
