"""Byte-range reader of raw images: a Python data source whose partitions are page ranges.

    spark.dataSource.register(PageSource)
    spark.read.format("image_pages").option("path", "/case/disk.dd").load()

Rows: image, page_offset, body_length, before, margin, data: ``before`` bytes that stand before the page, its body and
up to ``margin`` bytes behind it. Only the offsets are planned on the
driver; every task opens the image and reads its own range. A page row is large: read it with a
small spark.sql.execution.arrow.maxRecordsPerBatch and drop data before any shuffle.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from caselode.sources.ranges import open_range, size_of

PAGE = 16 * 1024 * 1024
MARGIN = 4096
#: Bytes before a page by which a run is told that began there.
BEFORE = 64


class _Range(InputPartition):
    def __init__(self, first: int, end: int):
        self.first, self.end = first, end


class _Reader(DataSourceReader):
    def __init__(self, path: str, page: int, margin: int, pages_per_task: int):
        self.path, self.page, self.margin, self.step = path, page, margin, pages_per_task
        if page < 1 or margin < 0 or pages_per_task < 1:
            raise ValueError("page and pages_per_task must be positive")
        self.size = size_of(path)
        with open_range(path) as f:
            if detect_format(path, f.read(512)) not in ("RAW",):
                raise ValueError(f"{path} is no raw image; compressed image formats need a library that is not installed")

    def partitions(self) -> list[_Range]:
        n = -(-self.size // self.page)
        return [_Range(i, min(n, i + self.step)) for i in range(0, n, self.step)]

    def read(self, partition: _Range) -> Iterator[tuple]:
        with open_range(self.path) as f:
            for i in range(partition.first, partition.end):
                at = i * self.page
                before = min(BEFORE, at)
                f.seek(at - before)
                yield self.path, at, min(self.page, self.size - at), before, self.margin, f.read(before + self.page + self.margin)


class PageSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "image_pages"

    def schema(self) -> str:
        return "image string, page_offset bigint, body_length int, before int, margin int, data binary"

    def reader(self, schema) -> DataSourceReader:
        o = self.options
        return _Reader(o["path"], int(o.get("page", PAGE)), int(o.get("margin", MARGIN)), int(o.get("pages_per_task", 1)))


def read_pages(spark: SparkSession, path: str, page: int = PAGE, margin: int = MARGIN) -> DataFrame:
    spark.dataSource.register(PageSource)
    return spark.read.format("image_pages").option("path", path).option("page", page).option("margin", margin).load()


#: Marks in the first bytes of an AFF4 container.
AFF4_MARKS = (b"aff4", b"container.description")


def detect_format(name: str, head: bytes) -> str:
    """E01, Ex01, L01, AFF4, RAW or UNKNOWN from name and first bytes (512 tell all); an image extension without its signature is UNKNOWN."""
    ext = name.rsplit(".", 1)[-1].lower() if "." in os.path.basename(name) else ""
    if ext == "aff4" or head[:4] == b"PK\x03\x04" and any(x in head[:512].lower() for x in AFF4_MARKS):
        return "AFF4"
    if head[:3] in (b"EVF", b"LVF"):
        return "Ex01" if head[:4] == b"EVF2" else "E01" if head[:3] == b"EVF" else "L01"
    if len(ext) in (3, 4) and ext[0] in "els" and (ext[1:].lstrip("x").isdigit() and ext[1:]):
        return "UNKNOWN"
    return "RAW"


def format_column(path: Column, head: Column) -> Column:
    """The same as a Column over path and the first bytes (BINARY)."""
    ext = F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))
    begins = lambda mark: F.coalesce(F.substring(head, 1, len(mark)) == F.lit(mark), F.lit(False))
    text = F.lower(F.decode(F.substring(head, 1, 512), "ISO-8859-1"))
    marked = begins(b"PK\x03\x04") & F.coalesce(F.greatest(*[text.contains(x.decode()) for x in AFF4_MARKS]), F.lit(False))
    return (
        F.when((ext == "aff4") | marked, "AFF4")
        .when(begins(b"EVF2"), "Ex01")
        .when(begins(b"EVF"), "E01")
        .when(begins(b"LVF"), "L01")
        .when(ext.rlike(r"^[els]x?\d{2,}$"), "UNKNOWN")
        .otherwise("RAW")
    )


def read_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """path, name, size_bytes, modified, content of every file under a folder."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    return raw.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified"), "content")
