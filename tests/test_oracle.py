"""Every registered query equals its SQL twin on DuckDB (sf0.001)."""

import pytest

from conftest import SF001


def test_entry_contract(spark):
    import __spark_entry__ as e
    df = e.entry(spark)
    assert df.count() >= 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_all_queries_match_oracle(spark):
    pytest.importorskip("duckdb")
    from oracle_compare import compare
    res = compare(spark, SF001)
    bad = {k: v for k, v in res.items() if v[0] not in ("MATCH",)}
    assert not bad, bad
