import decimal

import duckdb
import pytest

from tessera import queries

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return round(float(v), 6)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, name):
    df = queries.QUERIES[name](spark, DATA)
    got = sorted(repr([plain(r[c]) for c in sorted(df.columns)]) for r in df.collect())
    if name in queries.ORACLE_SQL:
        found = duck.execute(queries.ORACLE_SQL[name])
        names = [c[0] for c in found.description]
        assert sorted(names) == sorted(df.columns)
        at = [names.index(c) for c in sorted(names)]
        assert got == sorted(repr([plain(r[i]) for i in at]) for r in found.fetchall())


def test_entry_without_llm(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() >= 0
    assert set(queries.QUERIES) <= set(__spark_entry__.queries())
