"""Registered queries against their SQL in DuckDB."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from keyloom import queries

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CORE = ["scan_primary", "get_points_positional", "idx_points_dup", "idx_range", "idx_ordered_desc", "idx_multi_key", "idx_shortlex_order", "after_sorted", "intersect_multi_key", "upsert_fold", "batch_atomic", "bloom_no_false_negatives"]


def same(spark, name, folder=DIR):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    df = entry.queries()[name](spark, folder)
    cols = sorted(df.columns)
    rel = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    norm = lambda v: repr(round(v, 6)) if isinstance(v, float) else str(v)
    want = sorted(tuple(norm(r[k]) for k in at) for r in rel.fetchall())
    got = sorted(tuple(norm(r[c]) for c in cols) for r in df.collect())
    assert got == want


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
@pytest.mark.parametrize("name", CORE)
def test_core_queries(spark, name):
    same(spark, name)


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert {"scan_primary", "upsert_fold"} <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
def test_insert_of_a_whole_table(spark):
    same(spark, "insert_then_scan")
    orders = spark.read.parquet(f"{DIR}/orders.parquet")
    got = queries.inserted_halves(spark, DIR).scan().select(*orders.columns)
    assert got.count() == orders.count() and got.exceptAll(orders).isEmpty()
