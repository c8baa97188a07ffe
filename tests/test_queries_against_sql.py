"""Every core query with SQL gives the rows of that SQL on the smallest tables."""

import pytest

from mirefold.plans import reference, training, triage
from tests.compare import rows

QUERIES = {**training.QUERIES, **reference.QUERIES, **triage.QUERIES}
SQL = {**training.SQL, **reference.SQL, **triage.SQL}


@pytest.mark.parametrize("name", sorted(SQL))
def test_rows_equal(spark, small, duck, name):
    got = QUERIES[name](spark, small).toPandas()
    want = duck.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and len(got) > 0
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs_without_sql(spark, small, name):
    assert QUERIES[name](spark, small).count() > 0
