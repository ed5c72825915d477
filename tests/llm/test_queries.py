"""Registered queries against their SQL on the smallest tables."""

import pytest
from oracle_check import connect, norm

from talkloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", [name for name, (_, sql) in QUERIES.items() if sql])
def test_query_equals_its_sql(spark, name):
    fn, sql = QUERIES[name]
    frame = fn(spark, SF)
    columns = sorted(frame.columns)
    got = sorted(tuple(norm(r[c]) for c in columns) for r in frame.collect())
    found = connect(SF).execute(sql)
    names = [d[0] for d in found.description]
    want = sorted(tuple(norm(r[names.index(c)]) for c in columns) for r in found.fetchall())
    assert sorted(names) == columns and got == want and got
