"""FAT volumes made here, entry by entry."""

import hashlib
import struct

import pytest

from caselode.sources import fat, volumes

SECTOR, PER = 512, 1


def entry(name, cluster, size, attr=0x20, long=None):
    out, short = b"", name
    if long:
        text = (long + "\0").encode("utf-16-le")
        text += b"\xff" * (-len(text) % 26)
        parts = [text[i : i + 26] for i in range(0, len(text), 26)]
        out = b"".join(bytes([k + 1]) + p[:10] + b"\x0f\0\0" + p[10:22] + b"\0\0" + p[22:] for k, p in reversed(list(enumerate(parts))))
    return out + struct.pack("<11sB8xHHHHI", short, attr, cluster >> 16, 12 << 11 | 30 << 5 | 5, (2020 - 1980) << 9 | 2 << 5 | 29, cluster & 0xFFFF, size)


def build(bits):
    clusters = {12: 100, 16: 5000, 32: 66_000}[bits]
    table = [0] * (clusters + 2)
    end = {12: 0xFFF, 16: 0xFFFF, 32: 0x0FFFFFFF}[bits]
    big, note, gone = bytes(range(256)) * 5, b"hello fat", b"deleted text"
    root = entry(b"DISK       ", 0, 0, 0x08) + entry(b"BIGFIL~1BIN", 10, len(big), long="big file name.binary") + entry(b"SUB        ", 5, 0, 0x10) + entry(b"\xe5ONE    TXT", 40, len(gone)) + entry(b"EMPTY   TXT", 0, 0)
    sub = entry(b".          ", 5, 0, 0x10) + entry(b"..         ", 0, 0, 0x10) + entry(b"NOTE    TXT", 6, len(note)) + entry(b"LOOP       ", 5, 0, 0x10)
    data = {5: sub, 6: note, 10: big[:512], 12: big[512:1024], 11: big[1024:], 40: gone}
    for a, b in ((5, end), (6, end), (10, 12), (12, 11), (11, end)):
        table[a] = b
    if bits == 32:
        data[2], table[2] = root, end
    if bits == 12:
        raw = bytearray(len(table) * 3 // 2 + 3)
        for i, v in enumerate(table):
            at = i + i // 2
            old = struct.unpack_from("<H", raw, at)[0]
            struct.pack_into("<H", raw, at, old & 0x000F | v << 4 if i % 2 else old & 0xF000 | v)
    else:
        raw = struct.pack(f"<{len(table)}{'H' if bits == 16 else 'I'}", *table)
    fat_size = -(-len(raw) // SECTOR)
    roots = 0 if bits == 32 else 32
    reserved, root_sectors = 4, roots * 32 // SECTOR
    total = reserved + 2 * fat_size + root_sectors + clusters * PER
    boot = bytearray(512)
    boot[:11] = b"\xeb\x3c\x90MKTESTS"[:11].ljust(11)
    struct.pack_into("<HBHBHHBH", boot, 11, SECTOR, PER, reserved, 2, roots, 0, 0xF8, 0 if bits == 32 else fat_size)
    struct.pack_into("<II", boot, 32, total, fat_size)
    struct.pack_into("<I", boot, 44, 2)
    boot[54:59], boot[82:87], boot[510:512] = (b"FAT16" if bits != 32 else b"\0" * 5), (b"FAT32" if bits == 32 else b"\0" * 5), b"\x55\xaa"
    image = bytearray(total * SECTOR)
    image[:512] = boot
    for k in (0, 1):
        at = (reserved + k * fat_size) * SECTOR
        image[at : at + len(raw)] = raw
    at = (reserved + 2 * fat_size) * SECTOR
    image[at : at + len(root)] = root if bits != 32 else b"\0" * len(root)
    for c, b in data.items():
        place = at + root_sectors * SECTOR + (c - 2) * SECTOR * PER
        image[place : place + len(b)] = b
    return bytes(image), big, note, gone


@pytest.mark.parametrize("bits", [12, 16, 32])
def test_walk(spark, tmp_path, bits):
    image, big, note, gone = build(bits)
    path = tmp_path / "v.dd"
    path.write_bytes(image)
    found = volumes.scan_volumes(spark, spark.createDataFrame([(str(path),)], "path string"))
    got = {r["path"]: r for r in fat.walk_volumes(spark, found).collect()}
    assert set(got) == {"/big file name.binary", "/SUB", "/_ONE.TXT", "/EMPTY.TXT", "/SUB/NOTE.TXT", "/SUB/LOOP"}
    for name, content in (("/big file name.binary", big), ("/SUB/NOTE.TXT", note), ("/_ONE.TXT", gone)):
        assert got[name]["sha256"] == hashlib.sha256(content).hexdigest() and got[name]["size_bytes"] == len(content)
    assert not got["/_ONE.TXT"]["is_allocated"] and got["/SUB"]["is_dir"] and got["/EMPTY.TXT"]["sha256"] is None
    assert got["/SUB/NOTE.TXT"]["mtime"] == 1582979410.0 and image[got["/SUB/NOTE.TXT"]["data_offset"] :][: len(note)] == note


def test_what_cannot_be_walked(spark, tmp_path):
    (tmp_path / "n.dd").write_bytes(b"\xeb\x52\x90NTFS    ".ljust(4096, b"\0"))
    (tmp_path / "f.dd").write_bytes((b"\0" * 54 + b"FAT16").ljust(4096, b"\0"))
    (tmp_path / "b.dd").write_bytes(b"\xeb\x58\x90-FVE-FS-".ljust(4096, b"\0"))
    found = volumes.scan_volumes(spark, spark.createDataFrame([(str(tmp_path / n),) for n in ("n.dd", "f.dd", "b.dd")], "path string"))
    got = {r["image"][-4]: r["error"] for r in fat.walk_volumes(spark, found).collect()}
    assert got == {"n": "no library for ntfs", "f": "ValueError: no FAT boot sector", "b": "encrypted: bitlocker"}
