"""Every registered query against its DuckDB oracle on the smallest test tables (the same
check the driver runs at sf0.01). Queries without an oracle must at least run."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "scripts"))

from check_oracle import rows_of  # noqa: E402

from featpipe.queries import load_all  # noqa: E402
from featpipe.sources.tables import TABLES  # noqa: E402

SF = "/root/testdata/sf0.001"
REG = load_all()


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(REG))
def test_query_matches_oracle(spark, duck, name):
    q = REG[name]
    df = q.fn(spark, SF)
    rows = [tuple(r) for r in df.collect()]
    if not q.oracle:
        assert df.columns
        return
    res = duck.execute(q.oracle)
    cols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(cols)
    assert rows_of(df.columns, rows) == rows_of(cols, res.fetchall())


def test_entry_smoke(spark):
    import importlib.util

    path = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "__spark_entry__.py")
    spec = importlib.util.spec_from_file_location("spark_entry", path)
    mod = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(mod)
    df = mod.entry(spark)
    assert df.count() > 0
    assert set(mod.oracle_sql()) <= set(mod.queries())
