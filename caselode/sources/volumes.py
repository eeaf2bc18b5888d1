"""Volumes of raw images: partition tables, encryption marks, placeholder rows."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caselode.sources.ranges import open_range, size_of

SECTOR = 512
#: Where a volume with shadow copies bears the mark of their header, and the mark.
SNAPSHOT_OFFSET = 0x1E00
SNAPSHOT_MARK = bytes.fromhex("6b87083876c1484eb7ae04046e6cc752")
SCHEMA = "image string, volume_offset bigint, size_bytes bigint, volume_label string, kind string, encryption string, file_system string, has_snapshots boolean"
#: Partition types without a file system of their own (empty, extended, protective).
SKIPPED_TYPES = (0x00, 0x05, 0x0F, 0x85, 0xEE)


def partitions(read, size: int) -> list[tuple[int, int, str]]:
    """(offset, bytes, scheme) of the allocated partitions; the whole image if there is no table.

    read: (offset, length) -> bytes. GPT entries come first; logical partitions follow their chain,
    which may not turn back.
    """
    boot = read(0, SECTOR)
    if boot[510:512] != b"\x55\xaa":
        return [(0, size, "whole")]
    head = read(SECTOR, SECTOR)
    if head[:8] == b"EFI PART":
        table, count, width = struct.unpack_from("<Q", head, 72)[0], *struct.unpack_from("<II", head, 80)
        raw = read(table * SECTOR, min(count * width, size))
        out = []
        for k in range(len(raw) // width if width else 0):
            entry = raw[k * width : (k + 1) * width]
            first, last = struct.unpack_from("<QQ", entry, 32)
            if any(entry[:16]) and first <= last:
                out.append((first * SECTOR, (last - first + 1) * SECTOR, "gpt"))
        return out or [(0, size, "whole")]
    out, extended = [], []
    for k in range(4):
        entry = boot[446 + 16 * k : 462 + 16 * k]
        kind, (first, count) = entry[4], struct.unpack_from("<II", entry, 8)
        if kind in (0x05, 0x0F, 0x85):
            extended.append(first)
        elif kind not in SKIPPED_TYPES and first and count and first * SECTOR < size:
            out.append((first * SECTOR, count * SECTOR, "mbr"))
    for base in extended:
        at, seen = base, set()
        while at not in seen and at * SECTOR < size:
            seen.add(at)
            table = read(at * SECTOR, SECTOR)
            if table[510:512] != b"\x55\xaa":
                break
            first, count = struct.unpack_from("<II", table, 454)
            if table[450] not in SKIPPED_TYPES and count:
                out.append(((at + first) * SECTOR, count * SECTOR, "mbr"))
            step = struct.unpack_from("<I", table, 470)[0]
            if not step:
                break
            at = base + step
    # a boot sector of a file system looks like a table without entries
    return out or [(0, size, "whole")]


def encryption_of(head: bytes) -> str:
    """bitlocker, luks, filevault or ''."""
    if head[3:11] == b"-FVE-FS-":
        return "bitlocker"
    if head[:6] == b"LUKS\xba\xbe":
        return "luks"
    return "filevault" if head[88:90] == b"CS" else ""


def file_system_of(head: bytes) -> str:
    """ntfs, fat, ext, apfs or '' from a volume's first 2 KiB."""
    if head[3:11] == b"NTFS    ":
        return "ntfs"
    if head[54:57] == b"FAT" or head[82:87] == b"FAT32":
        return "fat"
    if head[1080:1082] == b"\x53\xef":
        return "ext"
    return "apfs" if head[32:36] == b"NXSB" else ""


def encryption_column(head: Column) -> Column:
    """encryption_of as a Column over BINARY."""
    h = F.hex(F.substring(head, 1, 96))
    return F.when(F.substring(h, 7, 16) == b"-FVE-FS-".hex().upper(), "bitlocker").when(h.startswith(b"LUKS\xba\xbe".hex().upper()), "luks").when(F.substring(h, 177, 4) == "4353", "filevault").otherwise("")


def volumes_of(image: str, read, size: int) -> list[tuple]:
    """Rows of SCHEMA for the volumes of one image; read: (offset, length) -> bytes."""
    out = []
    for k, (at, length, kind) in enumerate(partitions(read, size), 1):
        head = read(at, 2048)
        locked = encryption_of(head)
        # an encrypted volume's header is no plain text
        shadow = not locked and read(at + SNAPSHOT_OFFSET, 16) == SNAPSHOT_MARK
        out.append((image, at, min(length, size - at), f"vol{k}", kind, locked, file_system_of(head), shadow))
    return out


def volumes_in(images: DataFrame) -> DataFrame:
    """As scan_volumes for images at hand as bytes: columns image, size_bytes and head (the tables and the beginnings of volumes; what lies beyond reads as zeros)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for image, size, head in zip(*(batch.column(c).to_pylist() for c in ("image", "size_bytes", "head")), strict=True):
                data = head or b""
                rows += volumes_of(image, lambda at, n, data=data: data[at : at + n].ljust(min(n, SECTOR), b"\0"), size if size is not None else len(data))
            yield _record(rows)

    return images.select("image", "size_bytes", "head").mapInArrow(run, SCHEMA)


def _record(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.bool_()]
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 8, types, strict=True)], names=[x.split()[0] for x in SCHEMA.split(", ")])


def scan_volumes(spark: SparkSession, images: DataFrame) -> DataFrame:
    """One row for each volume of the raw images in column ``path``; an image without a table is one volume, an unreadable one a row with kind 'error: …'."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for path in batch.column(0).to_pylist():
                try:
                    size = size_of(path)
                    with open_range(path) as f:

                        def read(at: int, n: int, f=f) -> bytes:
                            f.seek(at)
                            return f.read(n).ljust(min(n, SECTOR), b"\0")

                        rows += volumes_of(path, read, size)
                except OSError as e:
                    rows.append((path, 0, None, "", f"error: {e.strerror}", "", "", False))
            yield _record(rows)

    return images.select("path").mapInArrow(run, SCHEMA)


def placeholder_files(volumes: DataFrame) -> DataFrame:
    """A files row for every volume that can't be walked (encrypted, or of no known file system): never silence."""
    reason = F.when(F.col("kind").startswith("error"), F.col("kind")).when(F.col("encryption") != "", F.concat(F.lit("encrypted: "), "encryption")).when(F.col("file_system") == "", "no known file system")
    rows = volumes.withColumn("reason", reason).where("reason is not null")
    return rows.select("image", "volume_offset", "volume_label", F.concat(F.lit("/("), "volume_label", F.lit(")")).alias("path"), F.concat(F.lit("["), "reason", F.lit("]")).alias("name"), F.lit(False).alias("is_allocated"))


def inspect_images(files: DataFrame) -> DataFrame:
    """path, format, bytes_per_sector, note of image files (path, content or its first bytes)."""
    from caselode.sources.image import format_column

    fmt = format_column(F.col("path"), F.col("content"))
    note = F.when(fmt == "AFF4", "recognised, not supported").when(fmt == "UNKNOWN", "the extension of an image without its signature").when(fmt != "RAW", "compressed: no library").otherwise("")
    return files.select("path", fmt.alias("format"), F.when(fmt == "RAW", SECTOR).alias("bytes_per_sector"), note.alias("note"))
