"""Every query with SQL gives the same rows in Spark and in DuckDB."""

import math
import os
from collections import Counter

import duckdb
import pytest

from tessella.plans import queries


def normal(rows):
    def one(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else repr(round(v, 9) + 0.0)
        if isinstance(v, (list, tuple)):
            return str([one(x) for x in v])
        return v.isoformat() if hasattr(v, "isoformat") else repr(v)

    return Counter(tuple(map(one, r)) for r in rows)


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for f in os.listdir(small):
        con.execute(f"create view {f.split('.')[0]} as select * from read_parquet('{small}/{f}')")
    return con


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_rows(spark, small, duck, name):
    df = queries.QUERIES[name](spark, small)
    columns = sorted(df.columns)
    mine = [tuple(r) for r in df.select(*columns).collect()]
    rel = duck.sql(f"select * from ({queries.SQL[name]}) q")
    assert sorted(rel.columns) == columns
    theirs = duck.sql("select " + ", ".join(f'"{c}"' for c in columns) + f" from ({queries.SQL[name]}) q").fetchall()
    assert normal(mine) == normal(theirs)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_runs(spark, small, name):
    # samples of the smallest tables are under the floors of these two
    assert (queries.QUERIES[name](spark, small).count() > 0) == (name not in ("hotspot_regions", "ripley_verdicts"))
