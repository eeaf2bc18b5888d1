"""A case folder: tables, append and upsert, safe CSV, manifest, byte export."""

from __future__ import annotations

import hashlib
import hmac
import json
import os
import re
import shutil
import time
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caselode.functions.scalars import csv_safe
from caselode.operators import audit
from caselode.operators.search import keep_first
from caselode.sources.ranges import open_range

#: Fixed value: the manifest's own files, which it leaves out.
OWN_FILES = ("manifest.json", "manifest.sig")


EVIDENCE = "id bigint, evidence_uuid string, path string, format string, size_bytes bigint, acquired_md5 string, acquired_sha256 string, notes string, added_at double"
FILES = (
    "id bigint, evidence_id bigint, inode bigint, path string, name string, size_bytes bigint, mtime double, atime double, ctime double, crtime double, md5 string, sha256 string, tlsh string, "
    "is_allocated boolean, ads_name string, vss_snapshot_id string, volume_offset bigint, volume_label string, fs_backend string, data_offset bigint, known_set string"
)
FINDINGS = "id bigint, evidence_id bigint, kind string, subtype string, value string, count bigint, first_offset bigint, added_at double"


class Case:
    """Tables under a folder, with an audit log of what was done."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    @classmethod
    def create(cls, spark: SparkSession, root: str, name: str, examiner: str) -> Case:
        """A new case; fails if the folder exists."""
        os.makedirs(root)
        case = cls(spark, root)
        case.log("case.create", {"examiner": examiner, "name": name})
        return case

    @classmethod
    def open(cls, spark: SparkSession, root: str) -> Case:
        if not os.path.isdir(root):
            raise FileNotFoundError(root)
        case = cls(spark, root)
        case.log("case.open", {})
        return case

    def path(self, table: str) -> str:
        return os.path.join(self.root, table)

    def log(self, action: str, payload: dict, actor: str = "examiner") -> str:
        return audit.append(self.spark, self.path("audit_log"), action, payload, actor)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))

    def add_evidence(self, path: str, fmt: str, size: int | None = None, md5: str | None = None, sha256: str | None = None, notes: str = "") -> str:
        """Registers an evidence item and returns its uuid."""
        key = str(uuid.uuid4())
        new = (self.table("evidence").agg(F.max("id")).first()[0] or 0) + 1 if os.path.isdir(self.path("evidence")) else 1
        self.append("evidence", self.spark.createDataFrame([(new, key, path, fmt, size, md5, sha256, notes, time.time())], EVIDENCE))
        self.log("evidence.add", {"format": fmt, "path": path, "uuid": key})
        return key

    def add_files(self, rows: DataFrame) -> None:
        """Appends file rows, by evidence item. Columns of the files table that are missing are NULL; others are an error."""
        self._add("files", rows, FILES)

    def add_findings(self, rows: DataFrame) -> None:
        """Appends findings, by evidence item."""
        self._add("findings", rows, FINDINGS)

    def _add(self, table: str, rows: DataFrame, schema: str) -> None:
        fields = T._parse_datatype_string(schema).fields
        odd = set(rows.columns) - {f.name for f in fields}
        if odd or "evidence_id" not in rows.columns:
            raise ValueError(f"columns {sorted(odd)} are none of {table}'s" if odd else "evidence_id is missing")
        full = rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields])
        self.append(table, full, "evidence_id")
        self.log(f"{table}.add", {"columns": sorted(rows.columns)})

    def append(self, table: str, rows: DataFrame, *partition: str) -> None:
        writer = rows.write.mode("append")
        (writer.partitionBy(*partition) if partition else writer).parquet(self.path(table))

    def replace(self, table: str, rows: DataFrame) -> None:
        """Writes beside the table and swaps folders, so that readers never see a half-written one."""
        new, old = self.path(f"~staging~{table}"), self.path(f"~old~{table}")
        shutil.rmtree(new, ignore_errors=True)
        rows.write.parquet(new)
        if os.path.isdir(self.path(table)):
            os.rename(self.path(table), old)
        os.rename(new, self.path(table))
        shutil.rmtree(old, ignore_errors=True)

    def set_config(self, key: str, value: object) -> None:
        """Upsert into the small config table."""
        row = self.spark.createDataFrame([(key, audit.canonical_json({"v": value}))], "key string, value_json string")
        old = self.table("case_config").where(F.col("key") != key) if os.path.isdir(self.path("case_config")) else row.limit(0)
        self.replace("case_config", old.unionByName(row))
        self.log("case.config", {"key": key})

    def config(self, key: str, default: object = None) -> object:
        if not os.path.isdir(self.path("case_config")):
            return default
        row = self.table("case_config").where(F.col("key") == key).first()
        return json.loads(row["value_json"])["v"] if row else default


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; text that a spreadsheet would run is made harmless; dates, maps and arrays as JSON text."""
    columns = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            c = F.to_json(c)
        columns.append((csv_safe(c) if isinstance(f.dataType, T.StringType) else c).alias(f.name))
    df.select(*columns).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


#: Fixed value: how the name of a set begins that is not complete.
STAGING = "~staging~"


def import_set(known_hash: DataFrame, hashes: DataFrame, set_id: int) -> DataFrame:
    """known_hash with the set's hashes added, each (algo, hash) once for a set."""
    return keep_first(known_hash.unionByName(hashes.select(F.lit(set_id).cast("bigint").alias("set_id"), "algo", "hash")), ["set_id", "algo", "hash"], [F.col("set_id")])


_SET = "id bigint, name string, source_path string, kind string, n_hashes bigint, complete boolean"


class KnownSets:
    """Imported hash sets of a case: a set is staged under a name that no lookup sees, then promoted or discarded as a whole."""

    def __init__(self, case: Case):
        self.case = case

    def sets(self) -> DataFrame:
        """One row for each set; empty before the first import."""
        return self.case.table("hash_set") if os.path.isdir(self.case.path("hash_set")) else self.case.spark.createDataFrame([], _SET)

    def hashes(self) -> DataFrame:
        """(algo, hash, set_id) of all sets, staged ones included."""
        schema = "algo string, hash string, set_id bigint"
        path = self.case.path("known_hash")
        return self.case.spark.read.schema(schema).parquet(path) if os.path.isdir(path) else self.case.spark.createDataFrame([], schema)

    def stage(self, name: str, hashes: DataFrame, source_path: str = "", kind: str = "list") -> int:
        """Stores the hashes, each (algo, hash) once, under a staging name; gives the set's id. The number stored is counted from what was written."""
        new = (self.sets().agg(F.max("id")).first()[0] or 0) + 1
        self.case.append("known_hash", hashes.select("algo", "hash").distinct().withColumn("set_id", F.lit(new).cast("bigint")), "set_id")
        stored = self.hashes().where(F.col("set_id") == new).count()
        row = self.case.spark.createDataFrame([(new, STAGING + name, source_path, kind, stored, False)], _SET)
        self.case.replace("hash_set", self.sets().unionByName(row))
        self.case.log("hash_set.stage", {"hashes": stored, "id": new, "name": name})
        return new

    def promote(self, set_id: int) -> None:
        """Makes a staged set visible; a set of the same name is replaced."""
        name = self._name(set_id).removeprefix(STAGING)
        sets = self.sets().where((F.col("name") != name) | (F.col("id") == set_id))
        mine = F.col("id") == set_id
        self.case.replace("hash_set", sets.withColumns({"name": F.when(mine, name).otherwise(F.col("name")), "complete": mine | F.col("complete")}))
        self._sweep()
        self.case.log("hash_set.promote", {"id": set_id, "name": name})

    def discard(self, set_id: int) -> None:
        """Removes a staged set with its hashes."""
        name = self._name(set_id)
        if not name.startswith(STAGING):
            raise ValueError(f"set {set_id} is not staged")
        self.case.replace("hash_set", self.sets().where(F.col("id") != set_id))
        self._sweep()
        self.case.log("hash_set.discard", {"id": set_id, "name": name})

    def delete(self, name: str) -> int:
        """Removes the sets of that name; gives how many."""
        n = self.sets().where(F.col("name") == name).count()
        if n:
            self.case.replace("hash_set", self.sets().where(F.col("name") != name))
            self._sweep()
            self.case.log("hash_set.delete", {"name": name, "sets": n})
        return n

    def _name(self, set_id: int) -> str:
        row = self.sets().where(F.col("id") == set_id).first()
        if row is None:
            raise KeyError(set_id)
        return row["name"]

    def _sweep(self) -> None:
        """Hashes of sets that are gone go as whole partitions: nothing else is rewritten."""
        live = {r["id"] for r in self.sets().select("id").collect()}  # one row for each set
        for entry in os.listdir(self.case.path("known_hash")):
            if entry.startswith("set_id=") and int(entry.removeprefix("set_id=")) not in live:
                shutil.rmtree(os.path.join(self.case.path("known_hash"), entry))


def build_manifest(spark: SparkSession, root: str) -> DataFrame:
    """path, size_bytes, sha256 of every file under the folder except the manifest's own."""
    # contents are not selected here, so files of any size are listed and then read in blocks where they are hashed
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", F.col("length").alias("size_bytes"))
    prefix = "^.*" + re.escape(root.rstrip("/")) + "/"

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = [hash_file(p, ("sha256",))["sha256"] for p in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sums, pa.string())], names=["path", "size_bytes", "sha256"])

    hashed = raw.mapInArrow(digest, "path string, size_bytes bigint, sha256 string")
    return hashed.withColumn("path", F.regexp_replace("path", prefix, "")).where(~F.col("path").isin(*OWN_FILES)).orderBy("path")


def sign_manifest(manifest: DataFrame, root: str, key: bytes) -> str:
    """Writes manifest.json and manifest.sig. The signature is an HMAC-SHA256, as no public-key library is installed; whoever verifies needs the key."""
    rows = [r.asDict() for r in manifest.toLocalIterator()]
    text = json.dumps({"files": rows, "manifest_version": 1}, sort_keys=True, separators=(",", ":"))
    sig = hmac.new(key, text.encode(), hashlib.sha256).hexdigest()
    for name, content in zip(OWN_FILES, (text, sig), strict=True):
        with open(os.path.join(root, name), "w", encoding="utf-8") as f:
            f.write(content)
    return sig


def verify_manifest(root: str, key: bytes) -> bool:
    with open(os.path.join(root, OWN_FILES[0]), "rb") as f, open(os.path.join(root, OWN_FILES[1]), encoding="utf-8") as s:
        return hmac.compare_digest(hmac.new(key, f.read(), hashlib.sha256).hexdigest(), s.read().strip())


def hash_file(path: str, algos: tuple[str, ...] = ("sha256", "md5"), block: int = 1 << 20) -> dict[str, str]:
    """All digests of a file in one read, whatever its size."""
    hashers = {a: hashlib.new(a) for a in dict.fromkeys(algos)}
    with open_range(path) as f:
        while data := f.read(block):
            for h in hashers.values():
                h.update(data)
    return {a: h.hexdigest() for a, h in hashers.items()}


def export_range(image: str, offset: int, length: int, target: str, expected_sha256: str | None = None) -> dict[str, object]:
    """Copies a byte range of an image and re-reads what was written: digests and MATCH, MISMATCH or NOT COMPARED."""
    left = length
    with open(image, "rb") as f, open(target, "wb") as out:
        f.seek(offset)
        while left and (data := f.read(min(left, 1 << 20))):
            out.write(data)
            left -= len(data)
    got = hash_file(target)
    verdict = "NOT COMPARED" if expected_sha256 is None else "MATCH" if got["sha256"] == expected_sha256.lower() else "MISMATCH"
    return {"bytes": length - left, "complete": left == 0, "verdict": verdict} | got


def receipt(export: dict[str, object], source: str) -> str:
    return "\n".join([f"Source: {source}", f"Bytes written: {export['bytes']}", *(f"{a.upper()}: {export[a]}" for a in ("sha256", "md5")), f"Verification: {export['verdict']}"])
