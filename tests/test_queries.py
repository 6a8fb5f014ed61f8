"""Every query of the scan against its SQL on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from lexward.plans import queries as Q

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return con


def plain(value):
    if value is None or value is pd.NA or isinstance(value, float) and value != value:
        return None
    if hasattr(value, "item"):
        value = value.item()
    return round(value, 9) if isinstance(value, float) else value


def rows(frame):
    columns = sorted(frame.columns)
    return columns, sorted((tuple(plain(v) for v in row) for row in frame[columns].itertuples(index=False)), key=repr)


def test_every_query_has_sql():
    assert set(Q.queries()) == set(Q.oracle_sql())
    assert len(Q.queries()) >= 68


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_query_equals_sql(name, spark, small, duck):
    assert rows(Q.queries()[name](spark, small).toPandas()) == rows(duck.execute(Q.oracle_sql()[name]).df())


def test_entry_has_rows(spark):
    import __spark_entry__ as e

    assert e.entry(spark).limit(1).count() == 1
    assert set(e.oracle_sql()) <= set(e.queries())
