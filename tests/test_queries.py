"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import math

import duckdb
import pytest

from siteline.plans import catalogue
from siteline.plans.proxies import TABLES

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return c


def norm(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return f"{v:.6g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, con, name):
    df = catalogue.queries()[name](spark, DIR)
    cols = sorted(df.columns)
    got = sorted(str([norm(v) for v in r]) for r in df.select(*cols).collect())
    if name not in catalogue.oracle_sql():
        assert got
        return
    cur = con.execute(catalogue.oracle_sql()[name])
    names = [x[0] for x in cur.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert got == sorted(str([norm(float(r[k]) if type(r[k]).__name__ == "Decimal" else r[k]) for k in at]) for r in cur.fetchall())
