"""Mixtures reach their shares, and the flight keeps its sums."""

import random

import pytest
from hypothesis import given
from hypothesis import strategies as st

from caselode.llm import mixing


@given(st.lists(st.tuples(st.floats(0, 1), st.integers(1, 500)), max_size=40))
def test_flight_keeps_sums(units):
    p, x = [a for a, _ in units], [float(b) for _, b in units]
    q = mixing.flight(p, x, random.Random(1))
    assert sum(q) == pytest.approx(sum(p), abs=1e-5) and sum(a * b for a, b in zip(q, x, strict=True)) == pytest.approx(sum(a * b for a, b in zip(p, x, strict=True)), abs=1e-2)
    assert all(0 <= v <= 1 for v in q) and sum(0 < v < 1 for v in q) <= 2


@given(st.lists(st.tuples(st.floats(0.05, 0.95), st.integers(1, 500)), min_size=30, max_size=60))
def test_landing_is_close(units):
    p, x = [a for a, _ in units], [float(b) for _, b in units]
    t = mixing.landing(p, x, random.Random(1))
    assert set(t) <= {0, 1} and abs(sum(a * b for a, b in zip(t, x, strict=True)) - sum(a * b for a, b in zip(p, x, strict=True))) <= max(x) / 2 + 1e-6
    with pytest.MonkeyPatch.context() as m:
        m.setattr(mixing, "LOOSE", 1e9)  # the number of documents never gives way
        assert abs(sum(mixing.landing(p, x, random.Random(1))) - sum(p)) <= 1


def test_inclusion_is_unbiased():
    p, x = [0.2, 0.4, 0.6, 0.8, 0.5, 0.5], [3.0, 9.0, 4.0, 7.0, 1.0, 12.0]
    n = 4000
    mean = [sum(c) / n for c in zip(*(mixing.flight(p, x, random.Random(i)) for i in range(n)), strict=True)]
    assert mean == pytest.approx(p, abs=0.04)


def mixture(spark, rows, targets):
    s = spark.createDataFrame([(*r, "clash") for r in rows], "id bigint, source string, n_tokens bigint, p string")
    t = spark.createDataFrame(targets, "source string, target_share double, max_repeats int")
    return mixing.mix(s, t).cache(), {r["source"]: r for r in mixing.mix_report(s, t).collect()}


def test_shares(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 100)
    rng = random.Random(2)
    rows = [(i, s, int(rng.lognormvariate(4, 1)) + 1) for i, s in enumerate(["big"] * 4000 + ["mid"] * 900 + ["small"] * 150 + ["other"] * 300)] + [(None, "mid", 5), (7, "mid", None), (8, "mid", 0), (9, None, 5)]
    m, by = mixture(spark, rows, [("big", 0.5, 1), ("mid", 0.3, 2), ("small", 0.1, 4), ("gone", 0.1, 1), ("none", 0.0, 1), (None, 0.2, 1)])
    for s, share in (("big", 5 / 9), ("mid", 3 / 9), ("small", 1 / 9)):
        assert by[s]["reached_share"] == pytest.approx(share, abs=1e-3) and by[s]["most_copies"] <= by[s]["max_repeats"]
        assert abs(by[s]["tokens_off"]) <= 2 and abs(by[s]["copies_off"]) < 1  # both balances are kept
    assert by["gone"]["tokens"] == 0 and by["none"]["tokens"] == 0
    assert m.where("source = 'other' or n_tokens is null or n_tokens <= 0").count() == 0
    # one source reaches its cap
    assert max(by[s]["tokens"] / (sum(n or 0 for _, x, n in rows if x == s) * by[s]["max_repeats"]) for s in ("big", "mid", "small")) == pytest.approx(1, abs=0.02)


def test_edges(spark):
    m, by = mixture(spark, [], [("a", 1.0, 2)])
    assert m.count() == 0 and by["a"]["tokens"] == 0
    m, by = mixture(spark, [(1, "a", 10), (1, "a", 10)], [("a", 1.0, 3)])
    assert sum(r["copies"] for r in m.collect()) == 6
    m, _ = mixture(spark, [(1, "a", 10)], [])
    assert m.count() == 0
