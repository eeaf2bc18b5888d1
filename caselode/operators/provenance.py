"""Where hits come from, and what of them can be exported."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caselode.functions.scalars import container_of, origin_of, safe_name
from caselode.operators.search import keep_first


def describe(hits: DataFrame, files: DataFrame, evidence: DataFrame) -> DataFrame:
    """hits with origin, evidence_id, image, file_id, exportable, note and suggested_name.

    A hit belongs to the image its evidence_uuid names and there to the first file of its path (the
    part before # for a document in a container). Raw pages have no file; their offset is in the path.
    """
    ev = evidence.select("evidence_uuid", F.col("id").alias("evidence_id"), F.col("path").alias("image"))
    # the live file (no snapshot) comes first, then the smallest id
    one = keep_first(files.select("evidence_id", F.col("path").alias("file_path"), F.col("id").alias("file_id"), "vss_snapshot_id", "is_allocated"), ["evidence_id", "file_path"], [F.coalesce(F.col("vss_snapshot_id"), F.lit("")), F.col("file_id")])
    rows = hits.withColumn("origin", origin_of(F.col("path"))).withColumn("file_path", container_of(F.col("path")))
    out = rows.join(ev, "evidence_uuid", "left").join(one.drop("vss_snapshot_id"), ["evidence_id", "file_path"], "left")
    exportable = F.col("image").isNotNull() & (F.col("file_id").isNotNull() | (F.col("origin") == "raw/unalloc"))
    note = (
        F.when(F.col("image").isNull(), "unknown evidence item")
        .when(F.col("origin") == "raw/unalloc", "raw page: exported as a byte range")
        .when(F.col("file_id").isNull(), "no file of that path in the case")
        .when(F.col("origin") == "in container", "exported as its whole container")
        .otherwise("")
    )
    return out.select(*[F.col(c) for c in hits.columns], "origin", "evidence_id", "image", "file_id", exportable.alias("exportable"), note.alias("note"), safe_name(F.col("file_path")).alias("suggested_name"))


def origin_counts(docs: DataFrame, path: str = "path") -> DataFrame:
    return docs.groupBy(origin_of(F.col(path)).alias("origin")).agg(F.count(F.lit(1)).alias("documents"))
