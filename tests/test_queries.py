"""Every query of the library against its SQL, and the driver's contract."""

from __future__ import annotations

import duckdb
import pytest

from cambium.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return db


def agree(ours, theirs) -> bool:
    names = sorted(theirs.columns)
    assert names == sorted(ours.columns)
    a, b = (x[names].sort_values(names).reset_index(drop=True) for x in (ours, theirs))
    return len(a) == len(b) and all(((a[n] == b[n]) | (a[n].isna() & b[n].isna())).all() for n in names)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, duck, name):
    assert agree(catalog.QUERIES[name](spark, SF).toPandas(), duck.sql(catalog.ORACLES[name]).df())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_query_without_sql_has_rows(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_contract(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(catalog.QUERIES) <= set(entry.queries())
    assert entry.entry(spark).count() == 450
