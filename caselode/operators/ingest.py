"""What is done with the files of an image: which are hashed, parsed as containers or read as text, and the counts of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from caselode.sources.containers import artifact_kind

#: Fixed value: bytes up to which a file is read and hashed.
HASH_CAP = 256 << 20


def eligibility(files: DataFrame, head: Column | None = None, cap: int = HASH_CAP) -> DataFrame:
    """files (name, size_bytes, read_bytes, is_regular) with kind, hash_it and extract_it.

    A file is hashed only if all of it was read: a digest of a part would be wrong. NULL sizes count
    as read. Containers are parsed, not read as text; side files of databases (-wal, -shm) go with
    them. Directories, unread and empty files are neither. head: first bytes, if they are at hand.
    """
    low = F.lower(F.coalesce("name", F.lit("")))
    there = F.coalesce(F.col("is_regular"), F.lit(False)) & (F.coalesce("read_bytes", F.lit(0)) > 0)
    whole = F.col("size_bytes").isNull() | (F.col("read_bytes") >= F.col("size_bytes"))
    kind = artifact_kind(F.coalesce("name", F.lit("")), F.lit(None).cast("binary") if head is None else head)
    side = low.endswith("-wal") | low.endswith("-shm")
    return files.withColumn("kind", kind).withColumns({"hash_it": there & whole & (F.col("read_bytes") <= cap), "extract_it": there & (F.col("kind") == "") & ~side})


def observed(files: DataFrame, name: str = "ingest") -> tuple[DataFrame, Observation]:
    """The files with an observation that holds, once they were used by any action, how many there were, were hashed, known, skipped and their bytes: no pass of its own."""
    seen = Observation(name)
    n = F.count(F.lit(1)).alias("files")
    return files.observe(seen, n, F.count("sha256").alias("hashed"), F.count("known_set").alias("known"), F.count_if(F.col("sha256").isNull()).alias("skipped"), F.sum("size_bytes").alias("bytes")), seen


def stats(files: DataFrame) -> DataFrame:
    """Files, hashed ones and the share known by evidence item and kind of container."""
    kind = artifact_kind(F.coalesce("name", F.lit("")), F.lit(None).cast("binary"))
    by = files.groupBy("evidence_id", kind.alias("kind")).agg(F.count(F.lit(1)).alias("files"), F.count("sha256").alias("hashed"), F.count("known_set").alias("known"), F.count_if(F.col("sha256").isNull()).alias("skipped"))
    return by.withColumn("known_percent", F.round(100 * F.col("known") / F.col("files"), 2))
