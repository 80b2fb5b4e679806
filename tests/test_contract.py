"""Registered queries against their SQL in DuckDB on the smallest tables.

A quick selection by default; all of them with FULL_CONTRACT=1.
"""

import os

import duckdb
import pytest

import __spark_entry__ as contract
from tools.check_oracles import TABLES, difference

FOLDER = "/root/testdata/sf0.001"
QUICK = (
    "bm25_topk chunk_fixed list_indexes full_scan knn_cosine dims_pad payload_base64 hash_embed rerank_topn hybrid_rrf "
    "chat_prompt upsert_latest star_enrich align_uploads clean_filename transliterate_names classify_requests collapse_runs "
    "ctc_decode box_text page_route stream_windows"
).split()

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return connection


def test_names():
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_entry(spark):
    assert contract.entry(spark).limit(1).count() == 1


@pytest.mark.parametrize("name", sorted(contract.oracle_sql()) if os.environ.get("FULL_CONTRACT") else QUICK)
def test_query_equals_sql(spark, duck, name):
    ours = contract.queries()[name](spark, FOLDER).toPandas()
    assert difference(ours, duck.execute(contract.oracle_sql()[name]).df()) is None
