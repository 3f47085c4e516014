"""Queries of the llm subpackage against their SQL, on the smallest tables."""

import pytest

from corpusloom.llm.queries import ORACLES, QUERIES

from ..test_oracles import TABLES, duck, plain  # noqa: F401

pytestmark = pytest.mark.skipif(not TABLES.exists(), reason="the tables aren't here")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, duck, name):  # noqa: F811
    df = QUERIES[name](spark, str(TABLES))
    columns = sorted(df.columns)
    answer = duck.sql(ORACLES[name])
    assert sorted(answer.columns) == columns
    order = [answer.columns.index(c) for c in columns]
    assert sorted(tuple(plain(r[c]) for c in columns) for r in df.collect()) == sorted(tuple(plain(r[k]) for k in order) for r in answer.fetchall())
