"""Files of FAT volumes (FAT12, FAT16, FAT32) in raw images, read by the published on-disk format.

Volumes of other file systems need libraries that are not installed; ``volumes.placeholder_files`` and
``walk_volumes`` give a row that says so.
"""

from __future__ import annotations

import calendar
import hashlib
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from caselode.sources.ranges import open_range

SCHEMA = (
    "image string, volume_offset bigint, volume_label string, path string, name string, inode bigint, size_bytes bigint, mtime double, is_dir boolean, is_allocated boolean, data_offset bigint, md5 string, sha256 string, fs_backend string, error string"
)
#: Fixed value: bytes of a file up to which it is read and hashed.
HASH_CAP = 256 << 20
_TYPES = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.bool_(), pa.bool_(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string()]


@dataclass
class Entry:
    path: str
    name: str
    cluster: int
    size: int
    mtime: float | None
    is_dir: bool
    is_allocated: bool


class Fat:
    """A FAT volume; read: (absolute offset, length) -> bytes."""

    def __init__(self, read, offset: int):
        self.read, self.offset = read, offset
        boot = read(offset, 512)
        sector, self.per, reserved, fats, self.roots, small, _, fat16 = struct.unpack_from("<HBHBHHBH", boot, 11)
        large, fat32 = struct.unpack_from("<II", boot, 32)
        if sector not in (512, 1024, 2048, 4096) or not self.per or not fats or not reserved:
            raise ValueError("no FAT boot sector")
        self.sector, self.fat_at = sector, offset + reserved * sector
        fat_size = fat16 or fat32
        self.root_at = self.fat_at + fats * fat_size * sector
        self.data_at = self.root_at + -(-self.roots * 32 // sector) * sector
        self.clusters = ((small or large) * sector - (self.data_at - offset)) // (self.per * sector)
        self.bits = 12 if self.clusters < 4085 else 16 if self.clusters < 65_525 else 32
        self.root_cluster = struct.unpack_from("<I", boot, 44)[0] if self.bits == 32 else 0
        self.table = read(self.fat_at, fat_size * sector)

    def at(self, cluster: int) -> int:
        return self.data_at + (cluster - 2) * self.per * self.sector

    def following(self, cluster: int) -> int:
        """The next cluster of a chain, 0 at its end."""
        if self.bits == 12:
            pair = struct.unpack_from("<H", self.table, cluster + cluster // 2)[0]
            n = pair >> 4 if cluster % 2 else pair & 0xFFF
        else:
            n = struct.unpack_from("<H", self.table, 2 * cluster)[0] if self.bits == 16 else struct.unpack_from("<I", self.table, 4 * cluster)[0] & 0x0FFFFFFF
        return n if 2 <= n < self.clusters + 2 else 0

    def chain(self, cluster: int) -> Iterator[int]:
        """Clusters from the first one on; a chain may not turn back."""
        seen: set[int] = set()
        while 2 <= cluster < self.clusters + 2 and cluster not in seen:
            seen.add(cluster)
            yield cluster
            cluster = self.following(cluster)

    def blocks(self, entry: Entry) -> Iterator[bytes]:
        """The bytes of a file, cluster by cluster; of a deleted one those that follow its first cluster, as its chain is gone."""
        size, left = self.per * self.sector, entry.size
        chain = self.chain(entry.cluster) if entry.is_allocated else range(entry.cluster, entry.cluster + -(-entry.size // size))
        for cluster in chain:
            if left <= 0:
                break
            yield self.read(self.at(cluster), min(size, left))
            left -= size

    def walk(self) -> Iterator[Entry]:
        todo, seen = [("", self.root_cluster)], set()
        while todo:
            path, cluster = todo.pop()
            if cluster in seen:
                continue
            seen.add(cluster)
            size = self.per * self.sector
            raw = b"".join(self.read(self.at(c), size) for c in self.chain(cluster)) if cluster else self.read(self.root_at, self.roots * 32)
            for e in self._entries(path, raw):
                yield e
                if e.is_dir and e.is_allocated:
                    todo.append((e.path, e.cluster))

    def _entries(self, path: str, raw: bytes) -> Iterator[Entry]:
        parts: list[str] = []
        for at in range(0, len(raw) - 31, 32):
            e = raw[at : at + 32]
            if e[0] == 0:
                break
            if e[11] & 0x3F == 0x0F:  # a part of a long name, the last part first
                parts.insert(0, (e[1:11] + e[14:26] + e[28:32]).decode("utf-16-le", "replace"))
                continue
            long, parts = "".join(parts).split("\0")[0].rstrip("￿"), []
            if e[11] & 0x08 or e[:2] in (b". ", b".."):
                continue
            base, ext = (b"_" + e[1:8] if e[0] == 0xE5 else e[:8]).decode("cp437").rstrip(), e[8:11].decode("cp437").rstrip()
            name = long or (f"{base}.{ext}" if ext else base)
            high, clock, day, low, size = struct.unpack_from("<HHHHI", e, 20)
            yield Entry(f"{path}/{name}", name, (high if self.bits == 32 else 0) << 16 | low, size, _wall(day, clock), bool(e[11] & 0x10), e[0] != 0xE5)


def _wall(day: int, clock: int) -> float | None:
    """Wall-clock seconds written as if they were UTC; None for no date."""
    year, month, date = 1980 + (day >> 9), day >> 5 & 15, day & 31
    if not 1 <= month <= 12 or not 1 <= date <= calendar.monthrange(year, month)[1]:
        return None
    return float(calendar.timegm((year, month, date, clock >> 11, clock >> 5 & 63, 2 * (clock & 31))))


def volume_rows(image: str, offset: int, label: str, read, cap: int = HASH_CAP) -> Iterator[tuple]:
    """Rows of SCHEMA for the files of one volume; an unreadable one gives a row with an error."""
    try:
        fat = Fat(read, offset)
        for e in fat.walk():
            sums = (None, None)
            if not e.is_dir and 0 < e.size <= cap and e.cluster >= 2:
                md5, sha, n = hashlib.md5(), hashlib.sha256(), 0
                for block in fat.blocks(e):
                    md5.update(block)
                    sha.update(block)
                    n += len(block)
                if n == e.size:  # no digest of a part
                    sums = (md5.hexdigest(), sha.hexdigest())
            yield (image, offset, label, e.path, e.name, e.cluster, None if e.is_dir else e.size, e.mtime, e.is_dir, e.is_allocated, fat.at(e.cluster) if e.cluster >= 2 else None, *sums, "fat", None)
    except (ValueError, struct.error, OSError) as x:
        yield (image, offset, label, None, None, None, None, None, False, False, None, None, None, "fat", f"{type(x).__name__}: {x}")


def walk_volumes(spark: SparkSession, volumes: DataFrame, cap: int = HASH_CAP) -> DataFrame:
    """Files of the volumes found by ``scan_volumes``, a task for each volume: FAT is walked; a locked or other one gives one row with an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for image, offset, label, system, locked in zip(*(batch.column(c).to_pylist() for c in ("image", "volume_offset", "volume_label", "file_system", "encryption")), strict=True):
                if system != "fat" or locked:
                    why = f"encrypted: {locked}" if locked else f"no library for {system or 'an unknown file system'}"
                    rows.append((image, offset, label, None, None, None, None, None, False, False, None, None, None, system or None, why))
                    continue
                with open_range(image) as f:

                    def read(at: int, n: int, f=f) -> bytes:
                        f.seek(at)
                        return f.read(n)

                    for row in volume_rows(image, offset, label, read, cap):
                        rows.append(row)
                        if len(rows) == 10_000:
                            yield _record(rows)
                            rows = []
            yield _record(rows)

    n = max(1, volumes.count())  # one row for each volume
    return volumes.select("image", "volume_offset", "volume_label", "file_system", "encryption").repartition(n).mapInArrow(run, SCHEMA)


def _record(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * len(_TYPES), _TYPES, strict=True)], names=[x.split()[0] for x in SCHEMA.split(", ")])
