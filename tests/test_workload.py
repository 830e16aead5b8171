"""Every registered query against its SQL on the smallest given tables."""

import math
import os

import duckdb
import pytest

from brewlens import workload

SF_DIR = os.environ.get("BREWLENS_TEST_DIR", "/root/testdata/sf0.001")
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="benchmark tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    return con


def text(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    return str(v)


def test_every_check_belongs_to_a_query():
    assert set(workload.oracle_sql()) <= set(workload.queries())


@pytest.mark.parametrize("name", sorted(workload.queries()))
def test_query(spark, duck, name):
    df = workload.queries()[name](spark, SF_DIR)
    columns = sorted(df.columns)
    got = sorted("|".join(text(r[c]) for c in columns) for r in df.collect())
    sql = workload.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    result = duck.execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    expected = sorted("|".join(text(r[names.index(c)]) for c in columns) for r in result.fetchall())
    assert got == expected
