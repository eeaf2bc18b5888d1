"""Prefix refinement against a plain count."""

from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from caselode.llm.frequent import frequent_items

ROW = st.tuples(st.sampled_from(["x", "y", None]), st.sampled_from(["a", "b", "c", "d", "", None, "Ü"]), st.one_of(st.none(), st.integers(-2, 9)))


def totals(rows):
    out = Counter()
    for by, v, w in rows:
        if v is not None:
            out[by, v] += max(1 if w is None else w, 0)
    return out


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(ROW, min_size=1, max_size=60), st.integers(1, 4))
def test_against_counts(spark, rows, k):
    df = spark.createDataFrame(rows, "by string, v string, total bigint")  # a column named like a result's
    want = totals(rows)
    whole = sum(max(1 if w is None else w, 0) for _, _, w in rows)
    got = {(r["by"], r["value"]): r["total"] for r in frequent_items(df, F.col("v"), ["by"], F.col("total"), share=0.2, bits=(2, 4)).collect()}
    assert got == {x: n for x, n in want.items() if n >= whole * 0.2}
    got = {(r["by"], r["value"]): r["total"] for r in frequent_items(df, F.col("v"), ["by"], F.col("total"), k=k, bits=(2, 4)).collect()}
    limit = sorted(want.values(), reverse=True)[k - 1] if len(want) >= k else 0
    assert got == {x: n for x, n in want.items() if n >= limit}


def test_edges(spark):
    df = spark.createDataFrame([], "v string")
    assert frequent_items(df, F.col("v"), share=0.1).count() == 0 and frequent_items(df, F.col("v"), k=3).count() == 0
    one = spark.createDataFrame([("a" * 100_000,)] * 3 + [(None,)], "v string")
    assert [r["total"] for r in frequent_items(one, F.col("v"), share=0.7).collect()] == [3]
    with pytest.raises(ValueError):
        frequent_items(df, F.col("v"))
    with pytest.raises(ValueError):
        frequent_items(df, F.col("v"), share=0.1, k=1)


def test_sql(spark):
    from caselode.llm import queries
    from tests.helpers import compare

    for name, sql in queries.oracle_sql().items():
        compare(spark, queries.queries()[name], sql)
