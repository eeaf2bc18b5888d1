"""Snapshot copies: the live volume wins, then the oldest snapshot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caselode.operators.search import keep_first


def _identity():
    return ["evidence_id", "volume_offset", "path", "size_bytes", F.coalesce(F.col("mtime").try_cast("bigint"), F.lit(0))]


def snapshot_dedup(files: DataFrame, is_dir: Column | None = None) -> DataFrame:
    """One row for each identity (evidence, volume, path, size, whole seconds of mtime). Directories, where ``is_dir`` tells them, are all kept."""
    order = [F.coalesce(F.col("vss_snapshot_id"), F.lit("")), F.col("id")]
    if is_dir is None:
        return keep_first(files, _identity(), order)
    folder = F.coalesce(is_dir, F.lit(False))
    return keep_first(files.where(~folder), _identity(), order).unionByName(files.where(folder))


def snapshot_stats(files: DataFrame) -> DataFrame:
    """Rows kept and rows dropped by snapshot_dedup, by evidence item."""
    per = files.groupBy(*[(F.col(k) if isinstance(k, str) else k).alias(f"k{i}") for i, k in enumerate(_identity())]).agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy(F.col("k0").alias("evidence_id")).agg(F.count(F.lit(1)).alias("unique_files"), F.sum(F.col("n") - 1).alias("duplicates"))
