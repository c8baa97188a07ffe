"""Queries of the subpackage against SQL on the smallest tables."""

import pytest

pytest.importorskip("mirefold.llm.queries")
from mirefold.llm import queries as q  # noqa: E402
from tests.compare import rows  # noqa: E402


@pytest.mark.parametrize("name", sorted(q.SQL))
def test_rows_equal(spark, small, duck, name):
    got = q.QUERIES[name](spark, small).toPandas()
    want = duck.execute(q.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(q.QUERIES) - set(q.SQL)))
def test_runs(spark, small, name):
    assert q.QUERIES[name](spark, small).count() > 0
