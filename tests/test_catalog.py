"""Every catalog query against its SQL on the smallest tables."""

import duckdb
import pytest

from motifspark.plans.catalog import QUERIES, SQL

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    own = QUERIES[name](spark, DATA).toPandas()
    if name not in SQL:
        assert own.shape[1]
        return
    other = duck.sql(SQL[name]).df()
    cols = sorted(own.columns)
    assert cols == sorted(other.columns)
    own, other = (x[cols].sort_values(cols).reset_index(drop=True) for x in (own, other))
    assert len(own) == len(other)
    for c in cols:
        assert own[c].dtype == other[c].dtype, c
        assert ((own[c] == other[c]) | (own[c].isna() & other[c].isna())).all(), c
