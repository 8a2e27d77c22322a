"""Every core query with SQL against DuckDB at the smallest size."""

import datetime as dt
from collections import Counter
from pathlib import Path

import duckdb
import pytest

from courtspark.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from '{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if v != v else round(v, 6)
    return v.replace(tzinfo=None) if isinstance(v, dt.datetime) else v


@pytest.mark.parametrize("name", sorted(registry.oracle()))
def test_query_equals_sql(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    cur = duck.execute(registry.oracle()[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    want = Counter(tuple(str(plain(r[i])) for i in at) for r in cur.fetchall())
    assert Counter(tuple(str(plain(r[c])) for c in cols) for r in df.collect()) == want
