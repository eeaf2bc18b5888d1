"""Near copies against all pairs."""

import random

import numpy as np

from caselode.llm.neardup import MinWise, banded_pairs, distances, near_copies
from tests.test_functions import distance_model


def digest(rng):
    return "".join(rng.choice("0123456789abcdef") for _ in range(70))


def edited(rng, d, n):
    d = list(d)
    for _ in range(n):
        i = rng.randrange(6, 70)
        d[i] = f"{int(d[i], 16) ^ 1 << rng.randrange(4):x}"
    return "".join(d)


def rows(seed=1, families=60):
    rng, out, n = random.Random(seed), [], 0
    for f in range(families):
        base = digest(rng)
        for v in range(rng.randint(1, 4)):
            n += 1
            t = edited(rng, base, rng.randint(0, 14)) if v else base
            out.append((n, f % 3, "T1" + t.upper() if v % 2 else t, f"s{f}-{v}"))
    copy = out[0]
    extra = [(900 + k, copy[1], copy[2], copy[3]) for k in range(3)]  # exact copies
    odd = [(950, None, copy[2], "x"), (951, copy[1], None, "x"), (952, copy[1], copy[2], None), (953, copy[1], "zz", "x"), (954, copy[1], "", "x"), (None, copy[1], copy[2], "x"), out[1]]
    return out + extra + odd


def brute(data, most=40):
    ok = [r for r in set(data) if all(x is not None for x in r) and len(r[2].removeprefix("T1")) == 70]
    return {(min(a[0], b[0]), max(a[0], b[0])) for a in ok for b in ok if a[0] != b[0] and a[1] == b[1] and a[3] != b[3] and distance_model(a[2], b[2]) <= most}


def found(spark, data, **k):
    df = spark.createDataFrame([(*r, "clash", 1) for r in data], "id bigint, evidence_id bigint, tlsh string, sha256 string, cid string, key int")
    return [(r["id_a"], r["id_b"]) for r in near_copies(df, **k).collect()]


def test_both_ways_agree_with_all_pairs(spark):
    data = rows()
    want = brute(data)
    small, large, split, both = found(spark, data), found(spark, data, large_group=5), found(spark, data, split_group=5), found(spark, data, split_group=5, large_group=1)
    for got in (small, large, split, both):
        assert len(got) == len(set(got))
        assert set(got) <= want and len(set(got)) >= 0.97 * len(want) > 30
    assert set(split) == set(small)


def at_the_limit(pairs=400):
    """Pairs of one image whose bodies differ by one in 36 to 40 codes, which banding finds by chance."""
    rng, out = random.Random(5), []
    for k in range(pairs):
        head, codes = digest(rng)[:6], [rng.randrange(4) for _ in range(128)]
        other = list(codes)
        for i in rng.sample(range(128), 36 + k % 5):
            other[i] += 1 if other[i] == 0 else -1 if other[i] == 3 else rng.choice((-1, 1))
        for v, c in enumerate((codes, other)):
            out.append((2 * k + v, 1, head + "".join(f"{4 * c[i] + c[i + 1]:x}" for i in range(0, 128, 2)), f"s{k}-{v}"))
    return out


def test_the_ways_find_the_same_pairs(spark):
    """Also those missed by chance are the same, however the work is divided."""
    data = at_the_limit()
    small = sorted(found(spark, data))
    assert 370 <= len(small) < 400
    for k in ({"large_group": 100}, {"split_group": 100}, {"split_group": 100, "large_group": 20}):
        assert sorted(found(spark, data, **k)) == small


def test_limits_too_wide_to_split_by_length(spark):
    base = digest(random.Random(9))
    data = [(i, 1, base[:2] + f"{i:02x}"[::-1] + base[4:], f"s{i}") for i in range(0, 256, 8)]
    for most in (800, 1600, 4000):  # two cells, one cell, less than one
        assert sorted(found(spark, data, most=most, split_group=5)) == sorted(brute(data, most))


def test_lengths_are_split_exactly(spark):
    """Copies that differ in length by up to three steps, around every border of cells."""
    base = digest(random.Random(9))
    data = [(i, 1, base[:2] + f"{i:02x}"[::-1] + base[4:], f"s{i}") for i in range(256)]
    want = brute(data)
    assert set(found(spark, data, split_group=5)) == want and len(want) == 256 * 3


def test_min_wise_hashes_agree_as_often_as_sets_overlap():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 1 << 63, (1, 4), dtype=np.uint64)
    codes = lambda w: [(int(v) >> s) & 3 for v in w for s in range(62, -2, -2)]
    for words in (1, 2, 3):
        y = x.copy()
        y[0, :words] = rng.integers(0, 1 << 63, words, dtype=np.uint64)
        a, b = ({(i, c) for i, c in enumerate(codes(v[0]))} for v in (x, y))
        h = MinWise(700, 2).hashes(np.vstack([x, y]))
        assert abs((h[:, 0] == h[:, 1]).mean() - len(a & b) / len(a | b)) < 0.04


def test_empty(spark):
    assert found(spark, []) == [] and found(spark, rows()[:1]) == []


def test_distance_of_arrays():
    rng = random.Random(3)
    pairs = [(digest(rng), digest(rng)) for _ in range(50)]
    swap = lambda t: int(t[1] + t[0] + t[3] + t[2] + t[5] + t[4], 16)
    all_ = [t for p in pairs for t in p]
    x = np.array([[int(t[6 + 16 * i : 22 + 16 * i], 16) for i in range(4)] for t in all_], np.uint64)
    hd = np.array([swap(t) for t in all_], np.int32)
    a, b = np.arange(0, 100, 2), np.arange(1, 100, 2)
    assert distances(x, hd, a, b).tolist() == [distance_model(p, q) for p, q in pairs]
    got = banded_pairs(np.zeros(100, np.int64), np.repeat(x[:50], 2, axis=0), np.repeat(hd[:50], 2), np.arange(100), 40, MinWise())
    assert {(2 * k, 2 * k + 1) for k in range(50)} <= set(zip(*map(np.ndarray.tolist, got), strict=True))
