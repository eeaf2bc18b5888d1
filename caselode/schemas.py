"""Schemas of the case tables, and migration to them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SCHEMAS = {
    "evidence": "id bigint, evidence_uuid string, path string, format string, size_bytes bigint, acquired_md5 string, acquired_sha256 string, notes string, added_at double",
    "files": "id bigint, evidence_id bigint, inode bigint, path string, name string, size_bytes bigint, mtime double, atime double, ctime double, crtime double, md5 string, sha256 string, tlsh string, "
    "is_allocated boolean, ads_name string, vss_snapshot_id string, volume_offset bigint, volume_label string, fs_backend string, data_offset bigint, known_set string",
    "findings": "id bigint, evidence_id bigint, kind string, subtype string, value string, count bigint, first_offset bigint, added_at double",
    "hash_set": "id bigint, name string, source_path string, kind string, imported_at double, n_hashes bigint, complete boolean, source_rows bigint, notes string",
    "known_hash": "set_id bigint, algo string, hash string",
}


def migrate(df: DataFrame, table: str) -> DataFrame:
    """The table with the columns of its schema: missing ones NULL, others dropped."""
    empty = SparkSession.getActiveSession().createDataFrame([], SCHEMAS[table])
    out = empty.unionByName(df, allowMissingColumns=True)
    return out.select(*empty.columns)
