import importlib.util
import os

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"


def test_names_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.skipif(not os.path.isdir(DATA) or importlib.util.find_spec("duckdb") is None, reason="no test data")
@pytest.mark.parametrize("name", ["p1_found", "p3_found", "p4_found", "lot_reconcile", "prf_by_stratum", "pattern_candidates"])
def test_twins(spark, name):
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    a = entry.queries()[name](spark, DATA)
    b = con.execute(entry.oracle_sql()[name])
    cols = [d[0] for d in b.description]
    text = lambda x: "" if x is None else f"{float(x):.5f}" if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)
    assert sorted(tuple(text(r[c]) for c in cols) for r in a.collect()) == sorted(tuple(map(text, r)) for r in b.fetchall())
