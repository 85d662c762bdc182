import os

import pytest
from support import DATA, duck, rows_of

from tracewell.llm.queries import QUERIES, SQL

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    assert rows_of(QUERIES[name](spark, DATA)) == duck(SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_runs(spark, name):
    df = QUERIES[name](spark, DATA)
    assert df.count() > 0
    assert all(kind != "void" for _, kind in df.dtypes)
