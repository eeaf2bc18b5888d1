"""Near-copies by tensored banding over similarity digests (problem 2).

A digest body is 128 codes of two bits, a set of 128 (position, code) features. A min-wise hash is the
least rank of its features in a random order of all 512, so two bodies agree on it with the
probability of their Jaccard similarity. A *collection* joins ``PER_COLLECTION`` such hashes. Tensored
banding does not draw fresh hashes for every table: ``COLLECTIONS`` small collections are computed once
for each digest, and every pair of them forms the key of one table, so C(c, 2) tables of doubled key
length need only c collections. Pairs that share a key in any table are candidates, and each is
verified by its exact distance.

Groups (one image's files) beyond ``SPLIT_GROUP`` rows are split exactly, by the length byte of the
digest: a difference that the distance allows is at most a few steps, so each row stands at home in one
cell and as a guest in the next. Cells meet in one task each and band their digests there, so that the
keys are never shuffled. A cell beyond ``LARGE_GROUP`` rows is dealt into blocks of half that size, and
every two blocks meet in a task of their own. The hashes, tables and verification are the same for every
size, so that neither switch changes which pairs are found.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caselode.functions.digests import LOW, WORDS, digest_columns
from caselode.session import cut

POSITIONS = 128
PER_COLLECTION = 3
COLLECTIONS = 32
SEED = 20
#: Rows of a group beyond which it is split by length.
SPLIT_GROUP = 10_000
#: Rows of a cell up to which it is banded within one task, and of any two blocks of a larger one.
LARGE_GROUP = 250_000
#: At most so many cells are broadcast.
MAX_BROADCAST = 10_000
#: Rows held by a task at a time, apart from the last cell.
BLOCK = 40_000


class MinWise:
    """``count`` collections of ``size`` min-wise hashes of digest bodies."""

    def __init__(self, count: int = COLLECTIONS, size: int = PER_COLLECTION, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.count, self.size = count, size
        codes = np.arange(256)[:, None] >> np.array([6, 4, 2, 0]) & 3  # of a byte
        self.tables = []  # for each hash the least rank among the four features of a byte, by its place and value
        for _ in range(count * size):
            rank = rng.permutation(4 * POSITIONS).reshape(POSITIONS // 4, 4, 4)
            self.tables.append(np.min([rank[:, i][:, codes[:, i]] for i in range(4)], axis=0).astype(np.uint16).ravel())

    def hashes(self, x: np.ndarray) -> np.ndarray:
        """Of bodies x, shape (n, 4), uint64: the hashes, shape (count * size, n)."""
        at = x.astype(">u8").view(np.uint8).reshape(len(x), 32).astype(np.int32) + 256 * np.arange(32, dtype=np.int32)
        return np.stack([t[at].min(axis=1) for t in self.tables]) if len(x) else np.zeros((len(self.tables), 0), np.uint16)

    def parts(self, x: np.ndarray) -> list[np.ndarray]:
        """One number a collection."""
        h = self.hashes(x).astype(np.uint64)
        with np.errstate(over="ignore"):
            out = []
            for i in range(self.count):
                part = np.full(len(x), np.uint64(i + 1))
                for j in range(self.size):
                    part = _mixed(part * np.uint64(4 * POSITIONS) + h[i * self.size + j])
                out.append(part)
            return out


def _apart(hd: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """What checksum, length and quartiles add to the distance."""

    def cyclic(p: np.ndarray, q: np.ndarray, size: int) -> np.ndarray:
        d = np.abs(p - q)
        return np.minimum(d, size - d)

    ha, hb = hd[a].astype(np.int32), hd[b].astype(np.int32)
    d = cyclic(ha >> 8 & 255, hb >> 8 & 255, 256)
    out = np.where(d <= 1, d, d * 12)
    for shift in (0, 4):
        d = cyclic(ha >> shift & 15, hb >> shift & 15, 16)
        out += np.where(d <= 1, d, (d - 1) * 12)
    return out + (ha >> 16 != hb >> 16)


def distances(x: np.ndarray, hd: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The same distance for index pairs (a, b) of arrays: x of shape (n, 4), uint64; hd of shape (n,)."""
    out = _apart(hd, a, b)
    low, one = np.uint64(LOW), np.uint64(1)
    xa, xb = x[a], x[b]
    ia, la, ib, lb = xa >> one & low, xa & low, xb >> one & low, xb & low
    d1, d2, d3 = (ia | la) ^ (ib | lb), ia ^ ib, (ia & la) ^ (ib & lb)
    for plane, weight in ((d1, 1), (d2, 1), (d3, 1), (d1 & d2 & d3, 3)):
        out += weight * np.bitwise_count(plane).sum(axis=1).astype(out.dtype)
    return out


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(31)) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ x >> np.uint64(29)


def banded_pairs(group: np.ndarray, x: np.ndarray, hd: np.ndarray, sha: np.ndarray, most: int, minwise: MinWise, guest: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of rows of one group that share a table key but no bit of ``guest``, differ in ``sha`` and lie within ``most``."""
    n, found = len(group), [np.zeros(0, np.int64)]
    guest = np.zeros(n, np.int32) if guest is None else guest
    with np.errstate(over="ignore"):
        g = _mixed(group.astype(np.uint64) + np.uint64(1))
        parts = minwise.parts(x)
        for i, j in combinations(range(len(parts)), 2):
            key = _mixed(parts[i] * np.uint64(3) + parts[j]) ^ g
            order = np.argsort(key)
            key = key[order]
            left = np.flatnonzero(key[1:] == key[:-1])
            step = 1
            while len(left):
                a, b = order[left], order[left + step]
                real = (group[a] == group[b]) & (sha[a] != sha[b]) & (guest[a] & guest[b] == 0)
                a, b = a[real], b[real]
                real = _apart(hd, a, b) <= most  # most unrelated candidates end here
                a, b = a[real], b[real]
                near = distances(x, hd, a, b) <= most
                found.append(np.minimum(a, b)[near] * n + np.maximum(a, b)[near])
                step += 1
                left = left[left + step < n]
                left = left[key[left] == key[left + step]]
            if len(found) > 64:
                found = [np.unique(np.concatenate(found))]
    codes = np.unique(np.concatenate(found))
    return codes // max(n, 1), codes % max(n, 1)


def _band(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Rows arrive in order of their cell; whole cells are banded together, about BLOCK rows at a time."""
    minwise = MinWise()

    def block(table: pa.Table) -> pa.RecordBatch:
        c = {k: table.column(k).to_numpy(zero_copy_only=False) for k in ("cell", "grp", "guest", "cid", "hd", "sha", *WORDS)}
        _, keep = np.unique(np.rec.fromarrays([c["cell"], c["cid"]]), return_index=True)
        c = {k: v[keep] for k, v in c.items()}
        x = np.stack([c[w] for w in WORDS], axis=1).view(np.uint64)
        a, b = banded_pairs(c["cell"], x, c["hd"], c["sha"], most, minwise, c["guest"])
        return pa.RecordBatch.from_arrays([pa.array(c["grp"][a]), pa.array(c["cid"][a]), pa.array(c["cid"][b])], names=["grp", "cid_a", "cid_b"])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(map(len, held)) < BLOCK:
            continue
        table = pa.Table.from_batches(held)
        cell = table.column("cell").to_numpy()
        done = int(np.searchsorted(cell, cell[-1]))  # the last cell may go on
        if done:
            yield block(table.slice(0, done))
            held = table.slice(done).combine_chunks().to_batches()
    if held:
        yield block(pa.Table.from_batches(held))


def _small(df: DataFrame) -> DataFrame:
    """Broadcast after a count, or as it is."""
    return F.broadcast(df) if df.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST else df


def _cells(classes: DataFrame, most: int, split_group: int) -> DataFrame:
    """Adds cell and guest, whose rows meet elsewhere if they share a bit: a group as a whole, or split by length."""
    steps = most // 12 if most >= 24 else 1  # of length that the distance allows
    width = 1
    while width <= steps:
        width *= 2
    blocks = 256 // width
    if blocks < 3:  # a cell would be its own neighbour, or two cells neighbours on both sides
        return classes.select("*", F.xxhash64("grp").alias("cell"), F.lit(0).alias("guest"))
    crowded = cut(classes.groupBy("grp").count().where(F.col("count") > split_group).select("grp", F.lit(True).alias("crowded")))
    home = F.shiftright("hd", 8).bitwiseAND(F.lit(255)) / F.lit(width)
    home = F.floor(home).cast("int")
    places = F.array(F.struct(home.alias("block"), F.lit(0).alias("guest")), F.struct(((home + 1) % blocks).alias("block"), F.lit(1).alias("guest")))
    whole = F.array(F.struct(F.lit(-1).alias("block"), F.lit(0).alias("guest")))
    marked = classes.join(_small(crowded), "grp", "left")
    at = marked.withColumn("at", F.explode(F.when(F.col("crowded"), places).otherwise(whole)))
    return at.select("*", F.xxhash64("grp", "at.block").alias("cell"), F.col("at.guest").alias("guest")).drop("at", "crowded")


def _met(cells: DataFrame, large: DataFrame) -> DataFrame:
    """Large cells by pairs of their blocks: each row goes to the cells of its block with every other one. Rows of one block are compared in that with the next only."""
    once = cells.join(_small(large), "cell").dropDuplicates(["cell", "cid"]).withColumn("block", F.pmod("cid", "blocks"))
    other = once.withColumn("step", F.explode(F.sequence(F.lit(1), F.col("blocks") - 1))).withColumn("other", (F.col("block") + F.col("step")) % F.col("blocks"))
    apart = F.when(F.col("step") == 1, 0).when(F.col("block") < F.col("other"), 2).otherwise(4)
    met = other.withColumn("cell", F.xxhash64("cell", F.least("block", "other"), F.greatest("block", "other"))).withColumn("guest", F.col("guest").bitwiseOR(apart))
    return met.drop("blocks", "block", "step", "other")


def near_copies(
    df: DataFrame, id_col: str = "id", group_col: str = "evidence_id", digest_col: str = "tlsh", content_col: str = "sha256", most: int = 40, large_group: int = LARGE_GROUP, split_group: int = SPLIT_GROUP
) -> DataFrame:
    """id_a < id_b: pairs of rows of one group with differing content whose digest distance is at most ``most``.

    Rows with equal digest and content are one class while candidates are sought; the pairs of
    classes are then expanded to rows. NULLs in any of the four columns and malformed digests are no
    case. Rows repeated under the same id give each pair once. Empty tables give an empty result;
    other columns are ignored. Verified pairs are exact; a pair at the full distance may be missed
    with the small probability measured in the README. ``large_group`` and ``split_group`` say where
    the work is divided and change no pair.
    """
    rows = (
        df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{group_col}`").cast("bigint").alias("grp"), F.lower(F.col(f"`{content_col}`")).alias("content"), F.col(f"`{digest_col}`").alias("digest"))
        .where("id is not null and grp is not null and content is not null and digest is not null")
        .select("id", "grp", F.xxhash64("content").alias("sha"), *[c.alias(n) for n, c in digest_columns(F.col("digest")).items()])
        .where("hd is not null")
        .withColumn("cid", F.xxhash64("sha", "hd", *WORDS))
    )
    rows = cut(rows)  # parsed once: it is read four times
    cells = _cells(rows.drop("id"), most, split_group)
    halves = F.ceil(2 * F.col("count") / large_group).cast("int")  # of large_group rows each
    large = cut(cells.groupBy("cell").count().where(F.col("count") > large_group).select("cell", halves.alias("blocks")))
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    band = lambda c: c.repartition(partitions, "cell").sortWithinPartitions("cell").mapInArrow(lambda it: _band(it, most), "grp bigint, cid_a bigint, cid_b bigint")
    if large.take(1):
        pairs = band(cells.join(_small(large), "cell", "left_anti")).unionByName(band(_met(cells, large)))
    else:
        pairs = band(cells)
    member = rows.select("grp", "cid", "id").distinct()
    a = member.select("grp", F.col("cid").alias("cid_a"), F.col("id").alias("a"))
    b = member.select("grp", F.col("cid").alias("cid_b"), F.col("id").alias("b"))
    both = pairs.join(a, ["grp", "cid_a"]).join(b, ["grp", "cid_b"])
    return both.select(F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b"))
