import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import sql_twins  # noqa: E402
from orderloom.llm import queries  # noqa: E402

pytestmark = pytest.mark.skipif(not os.path.isdir(sql_twins.SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return sql_twins.connection()


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_and_sql_agree(spark, con, name):
    sql_twins.check(spark, con, queries.QUERIES[name], queries.SQL[name])
