"""Every registered query with SQL gives the SQL's rows."""

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    return c


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["sum", "s_suppkey"] and df.count() > 0


from millrace import queries as relational  # noqa: E402


@pytest.mark.parametrize("name", sorted(relational.SQL))
def test_query(spark, duck, sf, name):
    df = relational.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    r = duck.execute(relational.SQL[name])
    names = [d[0] for d in r.description]
    assert sorted(names) == columns
    want = sorted(repr(tuple(row[names.index(c)] for c in columns)) for row in r.fetchall())
    assert sorted(repr(tuple(row[c] for c in columns)) for row in df.collect()) == want


def test_sql_names_exist():
    assert set(entry.oracle_sql()) <= set(entry.queries())
