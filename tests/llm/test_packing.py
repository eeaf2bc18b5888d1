"""Packs hold everything once and are nearly as few as possible."""

from collections import defaultdict

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from caselode.llm import tokens
from caselode.llm.packing import pack, pack_all, pack_report, plan_packs, price_knapsack, solve


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 500), min_size=1, max_size=25), st.integers(60, 90), st.sampled_from([0, 300]), st.sampled_from([3, 48]))
def test_plan(hist, capacity, rounds, classes):
    sizes, counts = (np.array(x) for x in zip(*sorted(hist.items()), strict=True))
    got = plan_packs(sizes, counts, capacity, rounds, classes).packs
    used = np.zeros(len(sizes), int)
    for times, f in got:
        assert times > 0 and sum(sizes[k] * u for k, u in f.items()) <= capacity
        for k, u in f.items():
            used[k] += times * u
    assert (used == counts).all()


def test_knapsack_is_best():
    sizes, prices = np.array([3, 5, 7]), np.array([4.0, 8.0, 11.0])
    best = max(4 * a + 8 * b + 11 * c for a in range(10) for b in range(10) for c in range(10) if 3 * a + 5 * b + 7 * c <= 23)
    assert (price_knapsack(sizes, prices, 23) * prices).sum() == pytest.approx(best)
    use = price_knapsack(sizes, prices, 23, 1.7)  # room is worth more than the pieces of 3 and 5
    assert use.tolist() == [0, 0, 0]


def test_program_reaches_its_bound():
    sizes, counts = np.array([27, 33, 40]), np.array([300, 300, 300])
    p = solve(sizes, counts, 100, False)
    assert 299.99 <= p.times.sum() <= 1.03 * 300 and p.bound <= 300 + 1e-6 and p.bound >= 0.97 * 300
    assert len(p.times) <= 3 and (p.columns.T @ p.times >= counts - 1e-6).all()


def test_program_decides():
    """Triples that fill a pack exactly: with the program none is wasted, largest first wastes every eighth."""
    sizes, counts = np.array([26, 27, 47]), np.array([400, 400, 400])
    packs = lambda rounds: sum(n for n, _ in plan_packs(sizes, counts, 100, rounds=rounds).packs)
    assert packs(20_000) <= 404 and packs(0) >= 430


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.none(), st.integers(0, 130)), max_size=60))
def test_pack(spark, sizes):
    df = spark.createDataFrame([(i // 2, n, 1) for i, n in enumerate(sizes)], "id bigint, n_tokens bigint, pack_no int")
    rows = pack(df, [50])[0].collect()
    room, pieces = defaultdict(int), defaultdict(list)
    for r in rows:
        room[r["pack_no"]] += r["n_tokens"]
        pieces[r["id"]].append(r["n_tokens"])
    assert all(v <= 50 for v in room.values())
    assert sum(room.values()) == sum(n or 0 for n in sizes)
    for i in pieces:
        own = [n or 0 for n in sizes[2 * i : 2 * i + 2]]
        assert sorted(pieces[i]) == sorted(x for n in own for x in ([50] * (n // 50) + [n % 50] * (n % 50 > 0 or n == 0)))


def test_many_and_report(spark):
    rng = np.random.default_rng(1)
    sizes = np.minimum(rng.lognormal(4.5, 1, 5000).astype(int) + 1, 4000)
    df = spark.createDataFrame([(i, int(n)) for i, n in enumerate(sizes)], "id bigint, n_tokens bigint").repartition(5)
    wanted = spark.createDataFrame([("s", 512), ("m", 2048), ("s", 512), (None, 5), ("z", 0)], "pack_name string, capacity_tokens int")
    packs = pack_all(df, wanted).cache()
    by = {r["pack_name"]: r for r in pack_report(df, wanted).collect()}
    assert set(by) == {"s", "m"}
    for r in by.values():
        assert r["tokens"] == sizes.sum() and r["packs"] <= 1.01 * r["least_packs"] + 1
        assert r["program_packs"] <= 1.03 * r["program_bound"] and r["program_share"] > 0.4
    whole = packs.where("pack_name = 'm'").groupBy("id").count()
    assert whole.where("count > 1").count() == (sizes > 2048).sum()


def test_one_size_is_a_third(spark):
    df = spark.createDataFrame([(i, 7 if i % 3 else 100) for i in range(3000)], "id bigint, n_tokens bigint").repartition(7)
    by = pack(df, [107])[0].groupBy("pack_no").sum("n_tokens").collect()
    assert max(r[1] for r in by) <= 107 and len(by) == 1000 + -(-1000 * 7 // 105)


def test_errors(spark):
    df = spark.createDataFrame([], "id bigint, n_tokens bigint")
    assert pack(df, [5])[0].count() == 0
    with pytest.raises(ValueError):
        pack(df, [0])


def test_token_counts(spark):
    df = spark.createDataFrame([(1, "hello world", "a"), (2, None, "b"), (3, "", None), (4, "<|endoftext|>", "c")], "i bigint, t string, n_tokens string")
    got = {r["id"]: r["n_tokens"] for r in tokens.token_counts(df.drop("n_tokens"), "i", "t").collect()}
    assert got[1] >= 2 and got[2] == got[3] == 0 and got[4] > 1
