"""Hash lists, CSV hash sets and published hash databases as (algo, hash) rows."""

from __future__ import annotations

import csv
import sqlite3
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caselode.functions.scalars import normalise_hash
from caselode.operators.known import import_hashes, unpivot_hashes


def read_list(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Hashes of a text file, and one row with the unreadable lines' number."""
    return import_hashes(spark.read.text(path))


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Hashes of a CSV whose header names md5, sha1 or sha256; the delimiter is sniffed from the first 8 KiB."""
    with open(path, encoding="utf-8", errors="replace", newline="") as f:
        head = f.read(8192)
    first = head.splitlines()[0] if head else ""
    try:
        sep = csv.Sniffer().sniff(head, delimiters=",;\t|").delimiter
    except csv.Error:
        sep = max(",;\t|", key=first.count)
    return unpivot_hashes(spark.read.option("sep", sep).option("header", True).csv(path))


def read_database(spark: SparkSession, path: str, algos: tuple[str, ...] = ("sha256", "md5"), rows_per_task: int = 1_000_000) -> DataFrame:
    """Hashes of a published SQLite database with a table or view FILE, read in row-id ranges, read-only."""
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
        names = {r[1].lower() for r in db.execute("pragma table_info(FILE)")}
        if not names:
            raise ValueError("no table FILE")
        wanted = [a for a in algos if a in names]
        if not wanted:
            raise ValueError("FILE has none of the columns " + ", ".join(algos))
        try:
            lo, hi = db.execute("select min(rowid), max(rowid) from FILE").fetchone()
            ranged = lo is not None
        except sqlite3.OperationalError:  # a view has no row ids
            lo, hi, ranged = 0, 0, False
    if not ranged and lo is None:
        return spark.createDataFrame([], "algo string, hash string")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
            for batch in batches:
                for start in batch.column(0).to_pylist():
                    where = f" where rowid between {start} and {start + rows_per_task - 1}" if ranged else ""
                    cursor = db.execute(f"select {', '.join(wanted)} from FILE{where}")
                    while rows := cursor.fetchmany(10_000):
                        yield pa.RecordBatch.from_arrays([pa.array([v for r in rows for v in r], pa.string())], names=["value"])

    starts = spark.range(lo, hi + 1, rows_per_task, max(1, (hi - lo) // rows_per_task + 1))
    return starts.mapInArrow(read, "value string").select(normalise_hash(F.col("value")).alias("h")).where("h is not null").select("h.*").distinct()
