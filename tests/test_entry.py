"""The driver's contract: every query runs, and agrees with its oracle on the smallest tables."""

import os

import pytest

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
def test_queries_match_their_oracles(spark):
    import duckdb

    from refrain.plans.queries import registry

    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")

    def told(columns, rows):
        order = sorted(range(len(columns)), key=lambda i: columns[i])
        return sorted(tuple(f"{r[i]:.9g}" if isinstance(r[i], float) else str(r[i]) for i in order) for r in rows)

    oracles = registry.oracle_sql()
    for name, query in registry.queries().items():
        got = query(spark, DIR)
        rows = got.collect()
        if name in oracles:
            want = db.sql(oracles[name])
            assert sorted(got.columns) == sorted(want.columns), name
            assert told(got.columns, rows) == told(want.columns, want.fetchall()), name


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
