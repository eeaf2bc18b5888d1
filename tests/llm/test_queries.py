"""Every query of the subpackage with SQL gives the same rows in both engines."""

import pytest

from caselode.llm import queries as llm
from tests.helpers import compare

SQL = llm.oracle_sql()


def test_sql_belongs_to_queries():
    assert set(SQL) <= set(llm.queries())


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, name):
    compare(spark, llm.queries()[name], SQL[name])
