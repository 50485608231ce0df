import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

CORE = ["exact_topk_batch", "exact_topk_filtered", "ivf_topk_nprobe2", "ivfpq_topk", "pq_adc_topk", "recall_at_k_ivf", "hnsw_unreachable", "p7_found", "substring_search", "log_torn_tail"]


@pytest.fixture(scope="module")
def con(small):
    c = duckdb.connect()
    for p in glob.glob(f"{small}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_every_statement_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", CORE)
def test_query_equals_sql(spark, small, con, name):
    df = entry.queries()[name](spark, small)
    got = sorted(repr([r[c] for c in sorted(df.columns)]) for r in df.collect())
    rel = con.sql(entry.oracle_sql()[name])
    assert sorted(rel.columns) == sorted(df.columns)
    want = sorted(repr([r[rel.columns.index(c)] for c in sorted(rel.columns)]) for r in rel.fetchall())
    assert got == want
