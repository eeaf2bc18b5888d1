"""Partition tables, encryption marks, header sections, policy and report."""

import struct
import zlib

from pyspark.sql import functions as F

from caselode.operators.policy import HashPolicy, text_report
from caselode.sources import segments, volumes


def mbr(*entries):
    b = bytearray(512)
    for k, (kind, first, count) in enumerate(entries):
        b[446 + 16 * k + 4] = kind
        struct.pack_into("<II", b, 446 + 16 * k + 8, first, count)
    b[510:512] = b"\x55\xaa"
    return bytes(b)


def write(path, parts, size=1 << 16):
    data = bytearray(size)
    for at, b in parts.items():
        data[at : at + len(b)] = b
    path.write_bytes(bytes(data))
    return str(path)


def test_volumes(spark, tmp_path):
    ntfs, luks, bit = b"\xeb\x52\x90NTFS    ", b"LUKS\xba\xbe\0\1", b"\xeb\x58\x90-FVE-FS-"
    a = write(tmp_path / "a.dd", {0: mbr((7, 4, 8), (0x83, 16, 8), (5, 32, 40)), 4 * 512: ntfs, 16 * 512: luks, 32 * 512: mbr((7, 2, 4), (5, 16, 8)), 34 * 512: ntfs, 48 * 512: mbr((7, 2, 4)), 50 * 512: bit})
    entry = b"\1" * 16 + b"\2" * 16 + struct.pack("<QQ", 40, 47)
    gpt = b"EFI PART" + b"\0" * 64 + struct.pack("<QII", 2, 4, 128)
    b = write(tmp_path / "b.dd", {0: mbr((0xEE, 1, 100)), 512: gpt, 1024: entry, 40 * 512 + 32: b"NXSB"})
    c = write(tmp_path / "c.dd", {1080: b"\x53\xef", volumes.SNAPSHOT_OFFSET: volumes.SNAPSHOT_MARK}, 1 << 14)
    d = write(tmp_path / "d.dd", {}, 10)
    images = spark.createDataFrame([(p,) for p in (a, b, c, d, str(tmp_path / "gone.dd"))], "path string")
    got = volumes.scan_volumes(spark, images).cache()
    rows = {(r["image"][-4], r["volume_offset"] // 512): (r["kind"], r["encryption"], r["file_system"]) for r in got.collect() if not r["kind"].startswith("error")}
    assert rows == {("a", 4): ("mbr", "", "ntfs"), ("a", 16): ("mbr", "luks", ""), ("a", 34): ("mbr", "", "ntfs"), ("a", 50): ("mbr", "bitlocker", ""), ("b", 40): ("gpt", "", "apfs"), ("c", 0): ("whole", "", "ext"), ("d", 0): ("whole", "", "")}
    assert [r["image"][-4] for r in got.where("has_snapshots").collect()] == ["c"]
    names = sorted(r["name"] for r in volumes.placeholder_files(got).collect())
    assert names[:2] == ["[encrypted: bitlocker]", "[encrypted: luks]"] and len(names) == 4 and names[2].startswith("[error")
    heads = spark.createDataFrame([(luks,), (bit,), (b"\0" * 88 + b"CS",), (b"",), (None,)], "h binary")
    assert [r[0] for r in heads.select(volumes.encryption_column(F.col("h"))).collect()] == ["luks", "bitlocker", "filevault", "", ""]
    assert [r["format"] for r in volumes.inspect_images(spark.createDataFrame([("x.E01", b"EVF\t"), ("y.dd", b"")], "path string, content binary")).orderBy("path").collect()] == ["E01", "RAW"]


def test_header_sections():
    data = bytearray(0x4C)
    data[0] = 1
    struct.pack_into("<7I", data, 4, 10, 64, 512, 640, 1, 2, 3)
    data[32], data[0x30] = 3, 2
    got = segments.volume_fields(bytes(data))
    assert got["MediaType"].startswith("Fixed") and got["TotalBytes"] == 512 * 640 and got["MediaFlags"] == "Image, Physical" and got["Compression"] == "Best" and "SetGUID" in got
    assert segments.volume_fields(b"x") == {} and segments.volume_fields(None) == {}
    assert segments.decode_header(zlib.compress("aé".encode("latin-1"))) == "aé" and segments.decode_header(zlib.compress("ab".encode("utf-16"))) == "ab" and segments.decode_header(b"??") is None
    section = lambda kind, at, nxt: kind.ljust(16, b"\0") + struct.pack("<QQ", nxt, 76) + b"\0" * 44
    blob = b"\0" * 13 + section(b"header", 13, 89) + section(b"volume", 89, 165) + section(b"done", 165, 165)
    assert [k for k, _, _ in segments.read_sections(blob)] == ["header", "volume", "done"]


def test_policy_and_report(spark):
    p = HashPolicy("sha1", ("md5", "sha1"))
    assert p.algorithms() == ("sha1", "md5") and HashPolicy.from_json(p.to_json()) == p
    assert HashPolicy.from_json("{broken") == HashPolicy.from_json('{"primary":"crc"}') == HashPolicy.from_json(None) == HashPolicy()
    s = spark.createDataFrame([("a", "/a.E01", 1, "EWF", "OK", []), ("a", "/a.E03", 3, "EWF", "BAD", ["done early"])], "image_set string, path string, number int, family string, status string, notes array<string>")
    t = spark.createDataFrame([("a", 2, 1, 1, False)], "image_set string, segments bigint, bad bigint, missing bigint, complete boolean")
    text = text_report(s, t, "Sets")
    more = {"metadata": spark.createDataFrame([("a", "Notes", None), ("a", "CaseNumber", "7")], "image_set string, field string, value string"), "missing": spark.createDataFrame([("a", 2, "E02")], "image_set string, number int, extension string")}
    whole = text_report(s, t, "Sets", {"Examiner": "me"}, notes="one\ntwo", generated="2020", **more)
    assert whole == text_report(s, t, "Sets", {"Examiner": "me"}, notes="one\ntwo", generated="2020", **more)
    assert all(x in whole for x in ("Examiner", "  two", "CaseNumber", "(none)", "  2    E02")) and whole.index("CaseNumber") < whole.index("a.E01") < whole.index("E02\n")
    assert "a: INCOMPLETE, 2 segments, 1 bad, 1 missing" in text and "done early" in text
