import pytest

import __spark_entry__ as entry


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["gate_funnel", "upserted_leads", "p1_found"])
def test_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    import glob
    import os

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no tables here")
    db = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        db.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    want = db.sql(entry.oracle_sql()[name])
    got = entry.queries()[name](spark, sf).select(*want.columns)
    assert sorted(map(repr, (tuple(r) for r in got.collect()))) == sorted(map(repr, want.fetchall()))
