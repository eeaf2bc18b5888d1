"""Filling packs of fixed capacity with documents (problem 6).

The length histogram has at most ``capacity`` sizes whatever the number of documents. Its sizes are
the rows of a configuration linear program (how often to use which filling of a pack): up to
``CLASSES`` classes of neighbouring sizes, and the small sizes together as tokens that fill what
room a filling leaves. The program is solved by multiplicative weights: every row carries a price
that falls as the row is covered, a knapsack dynamic program finds the filling of highest total
price, and that filling is used a little more often. Fillings found earlier serve again as long as
their price stays near that of the best one. This goes on until every row is covered; the prices give
a lower bound of the program, so the gap is known. The fractional solution is moved to a corner (as
many fillings as rows at most), rounded down, and the fractional rest rounded up as far as the sizes
last. What is left then is filled largest first. Documents take their places by their rank among those
of the same size, each on its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caselode.session import cut

#: Classes of sizes that the program tells apart.
CLASSES = 48
#: Sizes up to this share of the capacity are small: any room is filled with them.
SMALL = 1 / 16
#: Shares of the capacity up to which a pack of the program may stay free, tried one after the other; the pieces of others wait.
LOSSES = (0.004, 0.0)
#: The program stops at this gap between the fillings used and the lower bound, or after ROUNDS uses of a filling.
GAP = 0.02
ROUNDS = 20_000
#: Share of a row that one use of a filling covers at most; the best filling is sought anew after EVERY uses at the latest.
STEP = 0.01
EVERY = 30


def price_knapsack(sizes: np.ndarray, prices: np.ndarray, capacity: int, per_token: float = 0.0) -> np.ndarray:
    """How often each size occurs in the filling of highest total price; room left over is worth ``per_token`` a token."""
    best = per_token * np.arange(capacity + 1)
    steps: list[tuple[int, int, np.ndarray]] = []
    for i in np.argsort(-prices / sizes):
        s, p, k = int(sizes[i]), float(prices[i]), 1
        if p <= per_token * s:
            continue
        while s * k <= capacity:  # 1, 2, 4, ... of them give any number
            with_them = best[: capacity + 1 - s * k] + p * k
            better = with_them > best[s * k :] + 1e-15
            if better.any():
                best[s * k :][better] = with_them[better]
                steps.append((int(i), k, better))
            k *= 2
    out, c = np.zeros(len(sizes), np.int64), capacity
    for i, k, better in reversed(steps):
        at = c - int(sizes[i]) * k
        if at >= 0 and better[at]:
            out[i] += k
            c = at
    return out


@dataclass
class Program:
    """rows: size of each class (the last row stands for the small tokens, with size 1, if there are any); need: how many of each.
    columns: fillings as arrays over the rows; times: how often each is used; bound: no solution of the program uses fewer packs."""

    rows: np.ndarray
    need: np.ndarray
    columns: np.ndarray
    times: np.ndarray
    bound: float = 0.0
    rounds: int = 0


def solve(rows: np.ndarray, need: np.ndarray, capacity: int, fluid: bool, rounds: int = ROUNDS, gap: float = GAP) -> Program:
    """Multiplicative weights with knapsack pricing on the covering program over ``rows``.

    fluid: the last row is measured in tokens and takes the room that the others leave.
    """
    n = len(rows)
    last = n - 1 if fluid else n
    columns: list[np.ndarray] = []
    pool = np.zeros((0, n))
    known: dict[bytes, int] = {}
    times: list[float] = []
    covered, mean, bound, done, best, next_price = np.zeros(n), np.zeros(n), 0.0, 0, np.inf, 0
    sharp = 1.0 / STEP
    first = rows * need / (rows * need).sum()  # where no room need be lost, prices by size are a dual solution already

    def price_best(price: np.ndarray) -> tuple[np.ndarray, float]:
        use = price_knapsack(rows[:last], price[:last], capacity, float(price[last]) if fluid else 0.0)
        filling = np.append(use, capacity - int(use @ rows[:last])) if fluid else use
        return filling, float(filling @ price)

    bound = 1.0 / price_best(first / need)[1]
    while done < rounds:
        w = first * np.exp(-sharp * (covered - covered.min()))
        w /= w.sum()
        price = w / need
        value = pool @ price if columns else np.zeros(0)
        at = int(np.argmax(value)) if columns else -1
        if at < 0 or done >= next_price or value[at] < (1 - gap / 2) * best:
            filling, best = price_best(price)
            next_price = done + EVERY
            key = filling.tobytes()
            if key not in known:
                known[key] = len(columns)
                columns.append(filling)
                times.append(0.0)
                pool = np.vstack([pool, filling[None, :]])
            at = known[key]
        share = pool[at] / need
        t = STEP / share.max()
        times[at] += t
        covered += t * share
        mean += t * w
        done += 1
        if done % 200 == 0:
            bound = max(bound, 1.0 / price_best(mean / mean.sum() / need)[1])  # scaled by it, prices are a dual solution
            if covered.min() >= 1 and sum(times) / covered.min() <= (1 + gap) * bound:
                break
    if not columns:
        return Program(rows, need, np.zeros((0, n)), np.zeros(0), bound, done)
    x = np.array(times) / max(float(covered.min()), 1e-12)
    return Program(rows, need, *_corner(pool, x, need), bound, done)


def _corner(columns: np.ndarray, x: np.ndarray, need: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A corner of the program that uses no more packs: at most as many fillings as rows, moved along the null space."""
    n = columns.shape[1]
    slack = np.maximum(columns.T @ x - need, 0.0)
    scale = need.astype(float)
    a = np.vstack([columns / scale, -np.eye(n)]).T  # rows x (fillings and slacks), each row in shares of its need
    v, cost = np.append(x, slack / scale), np.append(np.ones(len(x)), np.zeros(n))
    while True:
        some = np.flatnonzero(v > 1e-9)
        if len(some) <= n:
            break
        some = some[np.argsort(v[some])][: n + 1]
        move = np.linalg.svd(a[:, some])[2][-1]
        if cost[some] @ move > 0:
            move = -move
        down = move < -1e-12
        if not down.any():
            move, down = -move, move > 1e-12
        v[some] += move * float((v[some][down] / -move[down]).min())
        v[v < 1e-9] = 0.0
    keep = v[: len(x)] > 0
    return columns[keep], v[: len(x)][keep]


@dataclass
class Plan:
    """packs: (times, {index of size: how often}) that hold every item once; bound: least packs of the program over the classes, 0 if there is none; tokens: those in packs that the program opened."""

    packs: list[tuple[int, dict[int, int]]] = field(default_factory=list)
    bound: float = 0.0
    used: float = 0.0
    tokens: int = 0


def _classes(sizes: np.ndarray, counts: np.ndarray, most: int, fluid: bool) -> tuple[list[np.ndarray], np.ndarray]:
    """Index runs of about equal weight in tokens and the size that stands for each: the mean where small items take up the difference, the largest otherwise."""
    if len(sizes) <= most:
        return [np.array([i]) for i in range(len(sizes))], sizes.copy()
    weight = np.cumsum(sizes * counts)
    cuts = np.unique(np.searchsorted(weight, weight[-1] * np.arange(1, most) / most))
    runs = [r for r in np.split(np.arange(len(sizes)), cuts) if len(r)]
    mean = [int(np.ceil((sizes[r] * counts[r]).sum() / counts[r].sum())) if fluid else int(sizes[r[-1]]) for r in runs]
    return runs, np.array(mean, np.int64)


class _Queue:
    """The sizes of a class that are left, taken from both ends in turn, so that what is taken has about the mean size."""

    def __init__(self, run: np.ndarray, left: np.ndarray):
        self.run, self.left, self.low, self.high = run.tolist(), left, 0, len(run) - 1

    def next(self, taken: dict[int, int], low: bool) -> int | None:
        """The lowest or highest size left besides what is ``taken``."""
        while self.low <= self.high and not self.left[self.run[self.low]]:
            self.low += 1
        while self.low <= self.high and not self.left[self.run[self.high]]:
            self.high -= 1
        for at in range(self.low, self.high + 1) if low else range(self.high, self.low - 1, -1):
            if self.left[self.run[at]] > taken.get(self.run[at], 0):
                return self.run[at]
        return None


    def best(self, taken: dict[int, int], room: int, sizes: np.ndarray) -> int | None:
        """The largest size up to ``room`` that is left besides what is ``taken``, or else the smallest."""
        for at in range(int(np.searchsorted(sizes[self.run], room, side="right")) - 1, self.low - 1, -1):
            if self.left[self.run[at]] > taken.get(self.run[at], 0):
                return self.run[at]
        return self.next(taken, True)


def _draw(queues: list[_Queue], slots: np.ndarray, turn: int, room: int, sizes: np.ndarray) -> dict[int, int] | None:
    """Sizes for one pack of a filling, the last two slots by what room the others leave; None if a class has run out."""
    taken: dict[int, int] = {}

    def take(i: int | None) -> int:
        taken[i] = taken.get(i, 0) + 1
        return int(sizes[i])

    order = [int(g) for g in np.flatnonzero(slots) for _ in range(int(slots[g]))]
    order.sort(key=lambda g: queues[g].run[-1] - queues[g].run[0])  # the widest classes make up for the others
    for k, g in enumerate(order[:-2]):
        i = queues[g].next(taken, (k + turn) % 2 == 1)
        if i is None:
            return None
        room -= take(i)
    if len(order) > 1:
        most, choice, (g, h) = None, None, order[-2:]
        for i in queues[g].run[queues[g].low : queues[g].high + 1]:
            if queues[g].left[i] > taken.get(i, 0):
                j = queues[h].best(taken | {i: taken.get(i, 0) + 1}, room - int(sizes[i]), sizes)
                free = room - int(sizes[i] + sizes[j]) if j is not None else -1
                if j is not None and (most is None or (free >= 0) > (most >= 0) or (free >= 0) == (most >= 0) and abs(free) < abs(most)):
                    most, choice = free, (i, j)
                    if not free:
                        break
        if choice is None:
            return None
        for i in choice:
            take(i)
    else:
        for g in order:
            i = queues[g].best(taken, room, sizes)
            if i is None:
                return None
            take(i)
    return taken


def _fill(room: int, sizes: np.ndarray, left: np.ndarray, filling: dict[int, int], upto: int) -> int:
    """Adds to ``filling``, largest first, what sizes below index ``upto`` fit the room; gives the room left."""
    k = min(upto, int(np.searchsorted(sizes, room, side="right"))) - 1
    while k >= 0 and room > 0:
        have = int(left[k]) - filling.get(k, 0)
        if have > 0:
            n = min(have, room // int(sizes[k]))
            if n:
                filling[k] = filling.get(k, 0) + n
                room -= n * int(sizes[k])
        k = min(k - 1, int(np.searchsorted(sizes, room, side="right")) - 1)
        if k >= 0 and not left[k]:
            some = np.flatnonzero(left[: k + 1])
            k = int(some[-1]) if len(some) else -1
    return room


def plan_packs(sizes: np.ndarray, counts: np.ndarray, capacity: int, rounds: int = ROUNDS, classes: int = CLASSES) -> Plan:
    """Packs that hold every item exactly once.

    sizes: ascending, distinct, from 1 to capacity. counts: items of each size. rounds=0 leaves all to filling largest first.
    """
    first = counts.astype(np.int64).copy()
    whole = int(np.searchsorted(sizes, capacity))  # full packs need no search
    full: list[tuple[int, dict[int, int]]] = []
    if whole < len(sizes) and first[whole]:
        full = [(int(first[whole]), {whole: 1})]
        first[whole] = 0
    small = int(np.searchsorted(sizes, capacity * SMALL, side="right"))
    big = np.flatnonzero((first > 0) & (np.arange(len(sizes)) >= small))
    loose = int((sizes[:small] * first[:small]).sum())
    if not loose:
        small = 0
    program, runs = None, []
    if rounds and len(big):
        runs, mean = _classes(sizes[big], first[big], classes, loose > 0)
        runs = [big[r] for r in runs]
        need = np.array([first[r].sum() for r in runs], np.int64)
        rows = np.append(mean, 1) if loose else mean
        program = solve(rows, np.append(need, loose) if loose else need, capacity, loose > 0, rounds)
    best, fewest = None, 0
    for loss in LOSSES if program else LOSSES[:1]:
        left, plan = first.copy(), Plan(list(full))

        def use(n: int, filling: dict[int, int], left=left, plan=plan) -> None:
            plan.packs.append((n, filling))
            for k, u in filling.items():
                left[k] -= n * u

        if program:
            plan.bound, plan.used = program.bound, float(program.times.sum())
            _round(program, runs, sizes, left, capacity, small, loss, use)
            plan.tokens = sum(n * sum(int(sizes[k]) * u for k, u in f.items()) for n, f in plan.packs[len(full) :])
        while left.any():
            filling: dict[int, int] = {}
            _fill(capacity, sizes, left, filling, len(sizes))
            use(min(int(left[k]) // u for k, u in filling.items()), filling)
        packs = sum(n for n, _ in plan.packs)
        if best is None or packs < fewest:
            best, fewest = plan, packs
    return best


def _round(program: Program, runs: list[np.ndarray], sizes: np.ndarray, left: np.ndarray, capacity: int, small: int, loss: float, use) -> None:
    """Whole numbers of every filling, then one more of those with a fractional rest, with the sizes that their classes hold."""
    queues = [_Queue(r, left) for r in runs]
    whole = np.floor(program.times + 1e-6).astype(np.int64)
    part = program.times - whole
    turn = 0
    order = [(int(whole[i]), i) for i in np.argsort(-program.times)] + [(1, i) for i in np.argsort(-part) if part[i] > 1e-6]
    for times, i in order:
        slots = program.columns[i][: len(runs)].astype(np.int64)
        while times > 0:
            filling = _draw(queues, slots, turn, capacity, sizes)
            if filling is None:
                break
            room = capacity - sum(int(sizes[k]) * u for k, u in filling.items())
            while room < 0:  # larger than the mean: the smallest piece that makes room waits
                fits = [k for k in filling if sizes[k] >= -room]
                k = min(fits) if fits else max(filling)
                room += int(sizes[k])
                filling[k] -= 1
                if not filling[k]:
                    del filling[k]
            _fill(_fill(room, sizes, left, filling, small), sizes, left, filling, len(sizes))
            if not filling:
                break
            n = min(times, *(int(left[k]) // u for k, u in filling.items()))
            if capacity - sum(int(sizes[k]) * u for k, u in filling.items()) <= loss * capacity:
                use(n, filling)
            times -= n
            turn += 1


def _ranked(pieces: DataFrame) -> DataFrame:
    """Adds r: 0, 1, ... among the pieces of one capacity and size. Counted within the partitions of a written table, so that no size meets in one task."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), {}
        for batch in batches:
            ranks = []
            for s in zip(batch.column("capacity_tokens").to_pylist(), batch.column("n_tokens").to_pylist(), strict=True):
                r = seen.get(s, 0)
                ranks.append(r)
                seen[s] = r + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * len(ranks), pa.int32()), pa.array(ranks, pa.int64())], names=[*batch.schema.names, "part", "k"])

    counted = cut(pieces.mapInArrow(local, _PIECES + ", part int, k bigint"))
    per = counted.groupBy("capacity_tokens", "n_tokens", "part").count()
    before = F.coalesce(F.sum("count").over(Window.partitionBy("capacity_tokens", "n_tokens").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return counted.join(per.select("capacity_tokens", "n_tokens", "part", before.alias("before")), ["capacity_tokens", "n_tokens", "part"]).withColumn("r", F.col("before") + F.col("k"))


_PIECES = "capacity_tokens int, id bigint, piece_no bigint, start_token bigint, n_tokens bigint"


def pack(sizes: DataFrame, capacities: list[int], rounds: int = ROUNDS) -> tuple[DataFrame, dict[int, Plan]]:
    """(capacity_tokens, id, piece_no, start_token, n_tokens, pack_no) of the packs of each capacity that hold every document, and their plans.

    sizes: id, n_tokens (other columns are ignored). A document is divided only if it alone is larger
    than the pack: into whole packs and one remainder. NULL sizes count as 0; documents without
    tokens need no room and stand in pack 0. Repeated ids are items of their own. An empty table
    gives an empty result; a capacity below 1 is an error.
    """
    if min(capacities) < 1:
        raise ValueError("capacity must be at least 1")
    cap = F.col("capacity_tokens").cast("bigint")
    n = F.greatest(F.coalesce(F.col("n_tokens"), F.lit(0)), F.lit(0)).cast("bigint")
    last = F.greatest(F.ceil(F.col("n") / cap).cast("bigint") - 1, F.lit(0).cast("bigint"))
    each = sizes.select("id", n.alias("n"), F.explode(F.array(*[F.lit(c).cast("int") for c in capacities])).alias("capacity_tokens"))
    pieces = each.withColumn("piece_no", F.explode(F.sequence(F.lit(0).cast("bigint"), last))).select(
        "capacity_tokens", "id", "piece_no", (F.col("piece_no") * cap).alias("start_token"), F.least(cap, F.col("n") - F.col("piece_no") * cap).cast("bigint").alias("n_tokens")
    )
    ranked = _ranked(pieces)
    counted = ranked.where("n_tokens > 0").groupBy("capacity_tokens", "n_tokens").count().collect()  # at most capacity rows for each capacity
    plans, tables = {}, {}
    for c in capacities:
        hist = sorted((r["n_tokens"], r["count"]) for r in counted if r["capacity_tokens"] == c)
        size, count = np.array([a for a, _ in hist], np.int64), np.array([b for _, b in hist], np.int64)
        plans[c] = plan_packs(size, count, c, rounds) if hist else Plan()
        rows: list[tuple[int, int, int, int]] = []  # size, first rank, pieces a pack, first pack
        packs, used = 0, np.zeros(len(size), np.int64)
        for times, filling in plans[c].packs:
            for k, u in filling.items():
                rows.append((int(size[k]), int(used[k]), u, packs))
                used[k] += times * u
            packs += times
        tables[c] = np.array(sorted(rows), np.int64).reshape(-1, 4)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = {c: t[:, 0] << 42 | t[:, 1] for c, t in tables.items()}  # ordered by size and first rank
        for batch in batches:
            c, s, r = (batch.column(x).to_numpy() for x in ("capacity_tokens", "n_tokens", "r"))
            out = np.zeros(len(s), np.int64)
            for v, t in tables.items():
                here = np.flatnonzero((c == v) & (s > 0))
                if len(here):
                    row = t[np.searchsorted(keys[v], s[here] << 42 | r[here], side="right") - 1]
                    out[here] = row[:, 3] + (r[here] - row[:, 1]) // row[:, 2]
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in ("capacity_tokens", "id", "piece_no", "start_token", "n_tokens")), pa.array(out)], names=["capacity_tokens", "id", "piece_no", "start_token", "n_tokens", "pack_no"])

    return ranked.select("capacity_tokens", "id", "piece_no", "start_token", "n_tokens", "r").mapInArrow(place, _PIECES + ", pack_no bigint"), plans


_EMPTY = "pack_name string, capacity_tokens int, id bigint, piece_no bigint, start_token bigint, n_tokens bigint, pack_no bigint"


def _named(sizes: DataFrame, pack_sizes: DataFrame, rounds: int) -> tuple[DataFrame, dict[int, Plan]]:
    names = {(r["pack_name"], r["capacity_tokens"]) for r in pack_sizes.select("pack_name", "capacity_tokens").where("pack_name is not null and capacity_tokens > 0").distinct().collect()}
    if not names:
        return sizes.sparkSession.createDataFrame([], _EMPTY), {}
    placed, plans = pack(sizes, sorted({c for _, c in names}), rounds)
    name = F.explode(F.element_at(F.create_map(*[x for c in plans for x in (F.lit(c), F.array(*[F.lit(a) for a, b in sorted(names) if b == c]))]), F.col("capacity_tokens"))).alias("pack_name")
    return placed.select(name, "capacity_tokens", "id", "piece_no", "start_token", "n_tokens", "pack_no"), plans


def pack_all(sizes: DataFrame, pack_sizes: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """The packs of every row of ``pack_sizes`` (pack_name, capacity_tokens; a few rows). Rows with NULLs or repeated are left out."""
    return _named(sizes, pack_sizes, rounds)[0]


def pack_report(sizes: DataFrame, pack_sizes: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """By pack_name: packs used, the least number possible for that many tokens, tokens, the share left free, and of the program:
    its lower bound and its fractional number of packs (both over the sizes' classes, without full packs), and the share of the
    tokens outside full packs that lie in packs it opened."""
    placed, plans = _named(sizes, pack_sizes, rounds)
    by = placed.groupBy("pack_name", "capacity_tokens").agg(F.countDistinct("pack_no").alias("packs"), F.sum("n_tokens").alias("tokens"), F.sum(F.when(F.col("n_tokens") < F.col("capacity_tokens"), F.col("n_tokens")).otherwise(0)).alias("open_tokens"))
    program = sizes.sparkSession.createDataFrame([(c, p.bound, p.used, p.tokens) for c, p in plans.items()], "capacity_tokens int, program_bound double, program_packs double, placed bigint")
    return by.join(F.broadcast(program), "capacity_tokens").select(
        "pack_name", "capacity_tokens", "packs", F.ceil(F.col("tokens") / F.col("capacity_tokens")).alias("least_packs"), "tokens", (1 - F.col("tokens") / (F.col("packs") * F.col("capacity_tokens"))).alias("free_share"),
        "program_bound", "program_packs", (F.col("placed") / F.greatest(F.col("open_tokens"), F.lit(1))).alias("program_share"),
    )
