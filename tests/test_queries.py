"""Every core query with SQL gives the same rows in both engines; the others run."""

import pytest

from caselode.plans import queries as core
from tests.helpers import FOLDER, compare

SQL = core.oracle_sql()
ALL = core.queries()


def test_sql_belongs_to_queries():
    assert set(SQL) <= set(ALL)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, name):
    compare(spark, ALL[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(ALL) - set(SQL)))
def test_runs(spark, name):
    df = ALL[name](spark, FOLDER)
    assert df.columns
    df.collect()


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
