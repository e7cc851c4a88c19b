"""Registered queries against their SQL on the small tables."""

import math

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()
SAMPLE = ["vx1_all_rules", "a02_otif_by_month_plant", "g03_publish_log", "a10_compare_consumers", "a13_cause_sizing",
          "a17_column_profile", "a21_unit_inference", "a22_candidate_key", "u02_column_diff", "j20_backlog_as_at",
          "w10_pooled_anomalies", "w11_weekday_anomalies", "r03_bm25", "r04_tfidf", "r06_rank_fusion",
          "y01_policy_gate", "s03_bronze_rows", "x01_each_file_once", "x03_later_batch_wins"]


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return repr(round(float(v), 7) + 0.0) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", SAMPLE)
def test_same_rows(spark, sf, duck, name):
    df = queries()[name](spark, sf)
    names = sorted(df.columns)
    mine = sorted(repr([plain(r[c]) for c in names]) for r in df.collect())
    rel = duck.execute(oracle_sql()[name])
    cols = [c[0] for c in rel.description]
    theirs = sorted(repr([plain(r[cols.index(c)]) for c in names]) for r in rel.fetchall())
    assert sorted(cols) == names
    assert mine == theirs and mine


def test_every_check_has_a_query():
    assert set(oracle_sql()) <= set(queries()) and len(queries()) > 190


def test_entry(spark):
    assert entry(spark).count() > 0
