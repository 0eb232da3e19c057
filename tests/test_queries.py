"""Every query with SQL against DuckDB on the smallest tables, the way the driver compares them."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
MINE = [n for n in entry.queries() if not n.startswith("op") and n != "pipeline"]


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    c.sql("SET timezone = 'UTC'")
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    return c


def rows(df):
    cols = sorted(df.columns)
    norm = lambda v: "" if v is None or v is pd.NA or v != v else float(v) if isinstance(v, (int, float)) or hasattr(v, "dtype") else str(v)
    return cols, sorted((tuple(norm(v) for v in r) for r in df[cols].astype(object).itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", MINE)
def test_query(spark, duck, name):
    got = entry.queries()[name](spark, D).toPandas()
    if name in entry.oracle_sql():
        assert rows(got) == rows(duck.sql(entry.oracle_sql()[name]).df())
    else:
        assert len(got)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
