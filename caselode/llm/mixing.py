"""Mixing sources to target shares by cube-method balanced sampling (problem 7).

The total is the largest at which no source needs more than its capped repeats; each source's
tokens over its documents give the expected copies of a document, of which whole copies are certain
and the rest is an inclusion probability. The cube method's flight phase moves these probabilities
along the null space of the balancing constraints (tokens and number of documents) until each is 0
or 1: three open units at a time leave a direction that changes neither sum. Flights run within
blocks of documents in parallel; a block leaves at most two open units, which meet again in larger
blocks, until only a small landing problem remains.
"""

from __future__ import annotations

import random
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caselode.session import cut

#: Documents of a block, on average.
BLOCK = 4_000
#: Documents of a source, about, that enter the flight last, so that the landing can be exact.
RESERVE = 96
#: Open units that the landing on the driver takes at most.
LANDING = 5_000
#: Units on each side that the landing weighs against each other.
EXCHANGE = 200
#: Share of a source's tokens by which the landing may miss before the number of its documents gives way.
LOOSE = 0.001
_EPS = 1e-9


def flight(p: list[float], x: list[float], rng: random.Random) -> list[float]:
    """Probabilities after the flight: sums of p and of p * x are kept, at most two stay between 0 and 1."""
    p = list(p)
    held: list[int] = []
    for i in range(len(p)):
        if not _EPS < p[i] < 1 - _EPS:
            p[i] = float(round(p[i]))
            continue
        held.append(i)
        while len(held) == 3:
            a, b, c = held
            u = (x[b] - x[c], x[c] - x[a], x[a] - x[b])  # orthogonal to (1, 1, 1) and to x
            if not any(u):
                u = (1.0, -1.0, 0.0)
            up = min((1 - p[k]) / d if d > 0 else p[k] / -d for k, d in zip(held, u, strict=True) if d)
            down = min(p[k] / d if d > 0 else (1 - p[k]) / -d for k, d in zip(held, u, strict=True) if d)
            step = up if rng.random() < down / (up + down) else -down
            for k, d in zip(held, u, strict=True):
                p[k] = min(1.0, max(0.0, p[k] + step * d))
                if p[k] < _EPS or p[k] > 1 - _EPS:
                    p[k] = float(round(p[k]))
            held = [k for k in held if 0 < p[k] < 1]
    return p


def landing(p: list[float], x: list[float], rng: random.Random) -> list[int]:
    """0 or 1 for every unit of a source: a flight over all of them, then a small program over the two units left and exchanges.

    The program takes, of the choices for the open units, one whose number of units is next to the
    wanted one, by its total. Exchanges of one or two units in for as many out bring the total
    closer and leave the number as it is. Only where a few very unequal units leave the total more
    than ``LOOSE`` off may the number change as well, for the shares count in tokens.
    """
    want, order = sum(a * b for a, b in zip(p, x, strict=True)), sorted(range(len(p)), key=lambda i: -x[i])
    number = sum(p)
    q = [0.0] * len(p)
    for i, v in zip(order, flight([p[i] for i in order], [x[i] for i in order], rng), strict=True):
        q[i] = v
    open_ = [i for i, v in enumerate(q) if 0 < v < 1]
    sure = sum(v for v in q if v >= 1)
    rest = sum(q[i] * x[i] for i in open_)
    choices = [c for n in range(len(open_) + 1) for c in combinations(open_, n)]
    best = min(choices, key=lambda c: (round(max(0.0, abs(sure + len(c) - number) - 0.5), 6), abs(sum(x[i] for i in c) - rest)))
    take = np.array([int(i in best) if 0 < v < 1 else round(v) for i, v in enumerate(q)])
    size = np.asarray(x, float)
    for free in (False, True):
        for _ in range(20):
            off = float((take * size).sum() - want)
            swaps = _exchange(take, size, off, free) if not free or abs(off) > LOOSE * want else []
            if not swaps:
                break
            for i, j in swaps:
                if i >= 0:
                    take[i] = 0
                if j >= 0:
                    take[j] = 1
    return take.tolist()


def _exchange(take: np.ndarray, size: np.ndarray, off: float, free: bool = False) -> list[tuple[int, int]]:
    """One or two pairs (unit taken, unit not taken) whose exchange brings the total closer to the wanted one; none if no pair does.

    free: either may be -1 for no unit.
    """

    def some(at: np.ndarray) -> np.ndarray:
        """Units of all sizes, EXCHANGE at most: they only refine what is chosen already."""
        at = at[np.argsort(size[at], kind="stable")]
        return at if len(at) <= EXCHANGE else at[np.linspace(0, len(at) - 1, EXCHANGE).astype(int)]

    inside, outside = some(np.flatnonzero(take == 1)), some(np.flatnonzero(take == 0))
    if free:
        inside, outside, size = np.append(inside, -1), np.append(outside, -1), np.append(size, 0.0)
    if abs(off) <= 0.5 or not len(inside) or not len(outside):
        return []
    change = (size[outside][None, :] - size[inside][:, None]).ravel()
    order = np.argsort(change, kind="stable")
    ranked = change[order]
    pair = lambda k: (int(inside[k // len(outside)]), int(outside[k % len(outside)]))
    one = int(np.argmin(np.abs(off + change)))
    swaps, least = ([pair(one)], abs(off + change[one])) if abs(off + change[one]) < abs(off) - _EPS else ([], abs(off))
    at = np.clip(np.searchsorted(ranked, -off - change), 0, len(ranked) - 1)
    error = np.abs(off + change + ranked[at])
    for k in np.argsort(error, kind="stable")[:64]:
        first, second = pair(int(k)), pair(int(order[at[k]]))
        if error[k] < least - _EPS and all(a != b or a < 0 for a, b in zip(first, second, strict=True)):
            return [first, second]
    return swaps


def mixing_plan(totals: dict[str, int], targets: dict[str, tuple[float, int]]) -> dict[str, tuple[float, float]]:
    """source -> (share among the sources that have tokens, expected copies of a document)."""
    usable = {s: t for s, t in targets.items() if t[0] > 0 and t[1] > 0 and totals.get(s, 0) > 0}
    whole = sum(t[0] for t in usable.values())
    if not usable:
        return {}
    size = min(totals[s] * t[1] / (t[0] / whole) for s, t in usable.items())
    return {s: (t[0] / whole, min(float(t[1]), size * t[0] / whole / totals[s])) for s, t in usable.items()}


def mix(sizes: DataFrame, targets: DataFrame, seed: int = 7) -> DataFrame:
    """The mixture alone, see ``planned_mix``."""
    return planned_mix(sizes, targets, seed)[0]


def planned_mix(sizes: DataFrame, targets: DataFrame, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """The mixture and what was wanted of each source.

    The mixture: id, source, n_tokens, copies (at least 1) of the documents of the mixture.

    sizes: id, source, n_tokens. targets: source, target_share, max_repeats; a small table.
    Sources without a target, with a share or repeats of 0 or less, or NULL, are left out; the shares
    of target sources without tokens are spread over the others in proportion. Documents without
    tokens are never used. Repeated ids are documents of their own. Empty tables give an empty result.
    What was wanted: source, wanted_tokens, wanted_copies.
    """
    spark = sizes.sparkSession
    rows = sizes.where("n_tokens > 0 and source is not null").select("id", "source", "n_tokens")
    goal = {r["source"]: (r["s"], r["m"]) for r in targets.where("source is not null").groupBy("source").agg(F.max("target_share").alias("s"), F.max("max_repeats").alias("m")).collect() if r["s"] and r["m"]}
    wanted = spark.createDataFrame([(s,) for s in goal], "source string")  # one row for each line of the plan
    totals = {r["source"]: (int(r["t"]), int(r["n"])) for r in rows.join(F.broadcast(wanted), "source").groupBy("source").agg(F.sum("n_tokens").alias("t"), F.count(F.lit(1)).alias("n")).collect()}
    plan = mixing_plan({s: t for s, (t, _) in totals.items()}, goal)
    empty = "id bigint, source string, n_tokens bigint, copies int"
    aims = spark.createDataFrame([(s, float(c * totals[s][0]), float(c * totals[s][1])) for s, (_, c) in plan.items()], "source string, wanted_tokens double, wanted_copies double")
    if not plan:
        return spark.createDataFrame([], empty), aims
    table = spark.createDataFrame(
        [(s, int(c + _EPS), max(0.0, c - int(c + _EPS)), max(1, totals[s][1] // BLOCK), max(1, totals[s][1] // RESERVE)) for s, (_, c) in plan.items()],
        "source string, sure int, p double, blocks int, every int",
    )
    start = cut(rows.join(F.broadcast(table), "source").select("id", "source", "n_tokens", "sure", "p", "blocks", "every", F.monotonically_increasing_id().alias("u")))
    decided = start.where(F.col("p") <= _EPS).select("id", "source", "n_tokens", F.col("sure").alias("copies"))
    late = F.pmod(F.xxhash64("u"), F.col("every")) == 0
    reserve = start.where((F.col("p") > _EPS) & late).drop("every")
    open_ = start.where((F.col("p") > _EPS) & ~late).drop("every")

    def block(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("u")
        rng = random.Random(f"{seed} {pdf['source'].iloc[0]} {pdf['u'].iloc[0]}")
        return pdf.assign(p=flight(pdf["p"].tolist(), pdf["n_tokens"].astype(float).tolist(), rng))

    done, level = [decided], 0
    while True:
        level += 1
        key = F.pmod(F.xxhash64(F.col("u"), F.lit(level)), F.col("blocks")).alias("block")
        moved = cut(open_.select("*", key).groupBy("source", "block").applyInPandas(block, "id bigint, source string, n_tokens bigint, sure int, p double, blocks int, u bigint, block bigint").drop("block"))
        settled = (F.col("p") <= 0) | (F.col("p") >= 1)
        done.append(moved.where(settled).select("id", "source", "n_tokens", (F.col("sure") + F.col("p").cast("int")).alias("copies")))
        open_ = moved.where(~settled)
        if open_.limit(LANDING + 1).count() <= LANDING:
            break
        open_ = open_.withColumn("blocks", F.greatest(F.lit(1), (F.col("blocks") * 2 / BLOCK).cast("int")))
    last = open_.unionByName(reserve).orderBy("source", "u").toPandas()
    land = []
    for source, pdf in last.groupby("source"):
        take = landing(pdf["p"].tolist(), pdf["n_tokens"].astype(float).tolist(), random.Random(f"{seed} {source}"))
        land += [(int(i), source, int(n), int(s) + t) for i, n, s, t in zip(pdf["id"], pdf["n_tokens"], pdf["sure"], take, strict=True)]
    out = spark.createDataFrame(land, empty)
    for d in done:
        out = out.unionByName(d)
    return out.where("copies > 0"), aims


def mix_report(sizes: DataFrame, targets: DataFrame, seed: int = 7) -> DataFrame:
    """By source of the targets: its target share, the tokens and share really reached, documents used, the most copies of one,
    and how far tokens and copies of documents lie from what the plan wants (0 for sources that give nothing)."""
    mixture, aims = planned_mix(sizes, targets, seed)
    by = cut(
        mixture.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.count(F.lit(1)).alias("documents"), F.max("copies").alias("most_copies"), F.sum("copies").cast("bigint").alias("copies"))
    )
    whole = by.agg(F.sum("tokens").alias("all_tokens"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    off = lambda a, b: F.coalesce(F.col(a) - F.col(b), F.lit(0.0)).alias(f"{a}_off")
    return (
        targets.select("source", "target_share", "max_repeats").join(by, "source", "left").join(F.broadcast(aims), "source", "left").crossJoin(F.broadcast(whole))  # one row
        .select("source", "target_share", "max_repeats", zero("tokens"), zero("documents"), zero("most_copies"), (F.coalesce(F.col("tokens"), F.lit(0)) / F.col("all_tokens")).alias("reached_share"), off("tokens", "wanted_tokens"), zero("copies"), off("copies", "wanted_copies"))
    )
