"""Every registered table query against its SQL."""

import math
import os

import duckdb
import pytest

from gridloom import plans

DIR = "/root/testdata/sf0.001"


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 4)
    return value


@pytest.mark.parametrize("name", sorted(plans.queries()))
def test_query(spark, name):
    if not os.path.isdir(DIR):
        pytest.skip("no test tables")
    c = duckdb.connect()
    for f in os.listdir(DIR):
        c.sql(f"create view {f[:-8]} as select * from '{DIR}/{f}'")
    df = plans.queries()[name](spark, DIR)
    got = [tuple(r) for r in df.collect()]
    rel = c.sql(plans.oracle_sql()[name])
    assert sorted(rel.columns) == sorted(df.columns)
    order = [rel.columns.index(x) for x in df.columns]
    want = [tuple(r[i] for i in order) for r in rel.fetchall()]
    key = lambda r: tuple((x is None, str(x)) for x in r)
    clean = lambda rows: sorted((tuple(map(_plain, r)) for r in rows), key=key)
    assert clean(got) == clean(want)
