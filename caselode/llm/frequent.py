"""Most frequent items with exact counts by prefix refinement (problem 3).

Every value is hashed to 64 bits. A pass counts hash prefixes; the count of a prefix is an upper
bound for each value under it, and the heaviest single row or the exact count of a witness value is
a lower bound for its best value. Prefixes whose upper bound stays below the limit (a share of the
total, or the current k-th lower bound) are dropped, the rest is counted again with longer
prefixes, until full values remain. A pass holds at most 2^(bits per pass) counters for each
surviving prefix, whatever the number of distinct values, and pre-aggregates before its shuffle.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caselode.session import cut

#: Prefix lengths in bits of the passes before the full values.
PREFIX_BITS = (14, 28, 44)
#: At most so many surviving prefixes are broadcast; more are joined by shuffle.
MAX_BROADCAST = 20_000


def _prefix(h: Column, bits: int) -> Column:
    return F.shiftrightunsigned(h, 64 - bits)


def frequent_items(
    df: DataFrame, value: Column, by: list[str] = (), weight: Column | None = None, *, share: float | None = None, k: int | None = None, bits: tuple[int, ...] = PREFIX_BITS
) -> DataFrame:
    """``by`` columns, ``value`` and ``total`` of the heaviest values.

    value: the value to count; rows where it is NULL are no item, but weigh in the whole.
    weight: whole number per row; NULL counts as 1, negative as 0. None: every row weighs 1.
    share: keep the items (of ``by`` and value together) holding at least this share of the whole.
    k: keep the k heaviest; items tied with the k-th are all kept. Exactly one of share and k.

    Counts are exact. NULLs in ``by`` form a group of their own. Empty tables give an empty result.
    Columns of any other name are ignored.
    """
    if (share is None) == (k is None):
        raise ValueError("give exactly one of share and k")
    if share is not None and not 0 < share <= 1 or k is not None and k < 1:
        raise ValueError("share must lie in (0, 1], k must be at least 1")
    w = F.lit(1).cast("bigint") if weight is None else F.greatest(F.coalesce(weight.cast("bigint"), F.lit(1)), F.lit(0))
    rows = df.select(*[F.col(f"`{b}`").alias(f"b{i}") for i, b in enumerate(by)], value.alias("v"), w.alias("w"))
    names = [f"b{i}" for i in range(len(by))]
    # hash() skips NULLs, so their positions are hashed as well
    h = F.xxhash64(*[x for n in names for x in (F.col(n), F.col(n).isNull())], F.col("v"))
    every = live = rows.where("v is not null").withColumn("h", h)

    limit = 0
    if share is not None:
        whole = rows.agg(F.sum("w")).first()[0] or 0
        limit = whole * share  # a float: compared with exact sums
    for n in bits:
        counted = live.groupBy(_prefix(F.col("h"), n).alias("p")).agg(F.sum("w").alias("most"), F.max("w").alias("least"))
        if k is not None:
            counted = cut(counted)
            # distinct prefixes have distinct values, so the k-th heaviest single row bounds the k-th total
            limit = max(limit, _kth(counted, "least", k), _witnessed(live, counted, n, k))
        kept = counted.where(F.col("most") >= F.lit(limit)).select("p")
        kept = cut(kept)
        if kept.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST:
            kept = F.broadcast(kept)
        # prefixes that are left imply the shorter ones of earlier passes, so only the newest are joined
        live = every.join(kept, _prefix(F.col("h"), n) == F.col("p"), "left_semi")
    out = live.groupBy(*names, "v").agg(F.sum("w").alias("total"))
    if k is not None:
        limit = max(limit, _kth(out, "total", k))
    return out.where(F.col("total") >= F.lit(limit)).select(*[F.col(f"b{i}").alias(b) for i, b in enumerate(by)], F.col("v").alias("value"), "total")


def _kth(df: DataFrame, column: str, k: int) -> int:
    """The k-th largest value, 0 if there are fewer."""
    top = df.select(column).orderBy(F.desc(column)).limit(k).agg(F.min(column).alias("m"), F.count(F.lit(1)).alias("n")).first()
    return top["m"] if top["n"] == k else 0


def _witnessed(live: DataFrame, counted: DataFrame, bits: int, k: int) -> int:
    """The k-th largest exact total among one value (that of the heaviest row) of each of the 4 k heaviest prefixes."""
    top = F.broadcast(counted.orderBy(F.desc("most"), "p").limit(4 * k).select("p"))  # 4 k rows
    best = live.withColumn("p", _prefix(F.col("h"), bits)).join(top, "p", "left_semi")
    exact = best.groupBy("p", "h").agg(F.sum("w").alias("n")).groupBy("p").agg(F.max("n").alias("n"))
    return _kth(exact, "n", k)
