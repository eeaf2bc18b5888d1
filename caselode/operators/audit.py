"""Hash-chained audit log.

row_hash = sha256(ts_text|actor|action|payload_json|prev_hash). The time's text is stored, as
engines render floating numbers differently.
"""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Iterator
from threading import Lock

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

GENESIS = "0" * 64
SCHEMA = "id bigint, ts double, ts_text string, actor string, action string, payload_json string, prev_hash string, row_hash string"
_LOCK = Lock()


def canonical_json(payload: dict) -> str:
    return json.dumps(payload, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def _text(ts: Column, actor: Column, action: Column, payload: Column, prev: Column) -> Column:
    return F.concat_ws("|", *[F.coalesce(c, F.lit("")) for c in (ts, actor, action, payload, prev)])


def row_hash(prev: Column) -> Column:
    return F.sha2(_text(F.col("ts_text"), F.col("actor"), F.col("action"), F.col("payload_json"), prev), 256)


def append(spark: SparkSession, path: str, action: str, payload: dict, actor: str = "examiner") -> str:
    """Appends one entry to the log at ``path`` (single writer) and returns its hash."""
    with _LOCK:
        try:
            last = spark.read.schema(SCHEMA).parquet(path).orderBy(F.desc("id")).select("id", "row_hash").first()
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e):
                raise
            last = None
        ts = time.time()
        prev = last["row_hash"] if last else GENESIS
        text = canonical_json(payload)
        digest = hashlib.sha256("|".join((repr(ts), actor, action, text, prev)).encode()).hexdigest()
        row = ((last["id"] if last else 0) + 1, ts, repr(ts), actor, action, text, prev, digest)
        spark.createDataFrame([row], SCHEMA).coalesce(1).write.mode("append").parquet(path)
        return digest


def chain(entries: DataFrame, by: str, order: str, parts: list[str]) -> DataFrame:
    """``by``, entries, head: the hash over each group's entries in ``order`` (ties by the entries' text).

    Every hash needs the one before, so a group is folded one entry after the other; the entries stream
    by in order, sorted with spilling, and only the running hash is held, however large a group is.
    """
    text = F.concat_ws("|", *[F.coalesce(F.col(p).cast("string"), F.lit("")) for p in parts])
    rows = entries.select(F.col(by).alias("k"), F.col(order).alias("o"), text.alias("t")).repartition("k").sortWithinPartitions("k", "o", "t")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, n, head = None, 0, GENESIS
        for batch in batches:
            keys, counts, heads = [], [], []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if n and k != last:
                    keys.append(last)
                    counts.append(n)
                    heads.append(head)
                    n, head = 0, GENESIS
                last, n, head = k, n + 1, hashlib.sha256(f"{t}|{head}".encode()).hexdigest()
            yield pa.RecordBatch.from_arrays([pa.array(keys, batch.schema.field(0).type), pa.array(counts, pa.int64()), pa.array(heads, pa.string())], names=["k", "entries", "head"])
            kind = batch.schema.field(0).type
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([last], kind), pa.array([n], pa.int64()), pa.array([head])], names=["k", "entries", "head"])

    key = entries.schema[by].dataType.simpleString()
    return rows.mapInArrow(fold, f"k {key}, entries bigint, head string").withColumnRenamed("k", by)


def latest(log: DataFrame, k: int = 500, order: str = "id") -> DataFrame:
    """The k newest entries (a list's limit), newest first."""
    return log.orderBy(F.desc(order)).limit(k)


def verify(log: DataFrame) -> DataFrame:
    """ok, first_bad_id, reason: every entry must name its predecessor's hash and hash to its own.

    The predecessor comes from a self-join on the rank, not from a window over the whole log in one
    task: ids are checked in ranges.
    """
    keyed = log.select("id", "ts_text", "actor", "action", "payload_json", "prev_hash", "row_hash")
    span = F.floor(F.col("id") / 10_000)
    within = Window.partitionBy("span").orderBy("id")
    rows = keyed.withColumn("span", span).withColumn("before", F.lag("row_hash").over(within))
    ends = rows.groupBy("span").agg(F.max_by("row_hash", "id").alias("end"))
    # one row for each 10,000 entries
    ends = ends.withColumn("carry", F.lag("end", 1, GENESIS).over(Window.orderBy("span"))).select("span", "carry")
    rows = rows.join(ends, "span").withColumn("want", F.coalesce("before", "carry"))
    bad = F.when(~F.col("prev_hash").eqNullSafe(F.col("want")), "prev_hash").when(~F.col("row_hash").eqNullSafe(row_hash(F.col("prev_hash"))), "row_hash")
    return rows.select("id", bad.alias("bad")).where("bad is not null").agg(F.min(F.struct("id", "bad")).alias("b")).select(F.col("b").isNull().alias("ok"), F.col("b.id").alias("first_bad_id"), F.col("b.bad").alias("reason"))
