"""Queries with SQL against DuckDB on the smallest test tables; the other queries run and name every document once."""

import duckdb
import pytest

from featpipe.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, duck, name):
    got = queries.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    want = duck.execute(f"SELECT {', '.join(columns)} FROM ({queries.ORACLES[name]})").fetchall()
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(want)


@pytest.mark.parametrize("name", ["op1_pitman_yor", "op2_sharding", "op3_sentencepiece", "op5_token_counts", "op8_pii_surrogates", "op9_quality_rules",
                                  "op13_simhash"])
def test_query_names_every_document_once(spark, duck, name):
    ids = [r[0] for r in duck.execute("SELECT doc_id FROM documents ORDER BY doc_id").fetchall()]
    assert sorted(r.doc_id for r in queries.QUERIES[name](spark, SF).select("doc_id").collect()) == ids
