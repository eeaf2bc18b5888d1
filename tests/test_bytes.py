"""Byte-level sources and operators on files made here."""

import io
import random
import sqlite3
import struct
import time
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from caselode.functions import extract
from caselode.operators import audit, raw
from caselode.sources import containers, hashsets, image, segments
from caselode.sinks import case


def disk(tmp_path):
    parts = {100: b"hello indicator a@b.org ", 4090: b"straddling text over the edge 10.1.2.3 ", 9000: "wide text here".encode("utf-16-le"), 12000: "größere Übung".encode("cp1252")}
    data = bytearray(b"\x01" * 20_000)
    for at, b in parts.items():
        data[at : at + len(b)] = b
    jpeg = b"\xff\xd8\xff\xe0" + b"\x02" * 700 + b"\xff\xd9"
    png = b"\x89PNG\r\n\x1a\n" + b"\x03" * 600 + b"IEND\xaeB`\x82"
    bmp = b"BM" + struct.pack("<IIII", 800, 0, 54, 40) + b"\x04" * 782
    for at, b in ((14_000, jpeg), (8190 * 2 - 4, png), (18_000, bmp), (19_500, b"\xff\xd8\xff\xe0" + b"\x05" * 100)):
        data[at : at + len(b)] = b
    path = tmp_path / "disk.dd"
    path.write_bytes(bytes(data))
    return str(path), {("jpeg", 14_000, len(jpeg)), ("png", 16_376, len(png)), ("bmp", 18_000, 800)}


@pytest.mark.parametrize("page", [1000, 4096, 50_000])
def test_strings_do_not_depend_on_pages(spark, tmp_path, page):
    path, _ = disk(tmp_path)
    pages = image.read_pages(spark, path, page, 4096)
    assert pages.agg(F.sum("body_length")).first()[0] == 20_000
    strings = raw.page_strings(pages).cache()
    texts = {(r["encoding"], r["offset"], r["text"]) for r in strings.where("encoding in ('ascii', 'utf-16-le')").collect()}
    assert ("ascii", 100, "hello indicator a@b.org ") in texts and ("utf-16-le", 9000, "wide text here") in texts
    assert ("ascii", 4090, "straddling text over the edge 10.1.2.3 ") in texts
    whole = raw.page_strings(spark.createDataFrame([("x", 0, 20_000, bytearray(open(path, "rb").read()))], "image string, page_offset bigint, body_length int, data binary"))
    everything = lambda df: sorted((r["encoding"], r["offset"], r["text"]) for r in df.collect())
    assert everything(strings) == everything(whole)  # none twice, and every offset is the run's first byte
    assert {r["value"] for r in raw.page_indicators(strings.where("encoding = 'ascii'")).collect()} >= {"a@b.org", "10.1.2.3"}
    assert any("Übung" in r["text"] for r in strings.where("encoding = 'cp1252'").collect())
    assert raw.sweep_stats(pages, strings).first()["bytes"] == 20_000


@pytest.mark.parametrize("window", [5000, 16_380, 100_000])
def test_carving_does_not_depend_on_windows(spark, tmp_path, window):
    path, want = disk(tmp_path)
    got = raw.carve_image(spark, path, window)
    assert {(r["kind"], r["offset"], r["size"]) for r in got.collect()} == want
    assert {r["kind"]: r["files"] for r in raw.carve_stats(got).collect()} == {"jpeg": 1, "png": 1, "bmp": 1}


def test_what_the_end_cuts_is_not_complete(spark, tmp_path):
    path = tmp_path / "cut.dd"
    path.write_bytes(b"BM" + struct.pack("<IIII", 40_000_000, 0, 54, 40) + b"\x04" * 1000 + b"%PDF-1." + b"x" * 600)
    got = [(r["kind"], r["complete"], r["sha256"]) for r in raw.carve_image(spark, str(path), 64).collect()]
    assert got == [("bmp", False, None)]  # no digest of half a file; a header whose footer never comes is no file
    many = b"".join(b"%PDF-1." + bytes([65 + k]) * 600 + b"%%EOF" + b"\1" * k for k in range(20))
    assert [(k, n) for k, _, n, _ in raw.carve_bytes(many, len(many))] == [("pdf", 612)] * 20  # each ends at its own footer
    page = spark.createDataFrame([("i", 0, 16, b"%PDF-1." + b"x" * 600)], "image string, page_offset bigint, body_length int, data binary")
    assert [tuple(r) for r in raw.carve_pages(page).select("kind", "size", "complete").collect()] == [("pdf", 607, False)]


def test_long_runs_and_one_pass(spark, tmp_path):
    text = bytes(32 + i % 90 for i in range(5000))
    path = tmp_path / "long.dd"
    path.write_bytes(b"\1" * 10 + text + b"\1" * 10)
    for page, margin in ((1000, 100), (64, 40), (2048, 4096)):
        pages = image.read_pages(spark, str(path), page, margin)
        rows = sorted((r["offset"], r["text"]) for r in raw.page_strings(pages, "ascii_utf16").collect() if r["encoding"] == "ascii")
        assert "".join(t for _, t in rows).encode() == text and rows[0][0] == 10
    disk_path, carved = disk(tmp_path)
    pages = image.read_pages(spark, disk_path, 4096, 16_384)
    both = raw.sweep_and_carve(pages).cache()
    assert {(r["label"], r["offset"], r["size"]) for r in both.where("what = 'carved' and complete").collect()} == carved
    assert both.where("what = 'string'").count() == raw.page_strings(pages).count()


def test_runs_by_bytes_are_those_of_the_decoded_text():
    rng = random.Random(3)
    pieces = ["größe".encode(), "日本語です".encode(), b"\xe0\x80\x80", b"\xef\xbf\xbd", b"\xed\xa0\x80", b"\xff\xfe", b"plain text", b"\x00", b"\x81\x8d", b"\xc2\x85", b"\n\t", "ÄÖÜ".encode("cp1252"), b"\xf4\x90\x80\x80"]
    for _ in range(400):
        data = b"".join(rng.choice([*pieces, rng.randbytes(5)]) for _ in range(rng.randint(1, 12)))
        for encoding in ("utf-8", "cp1252"):
            assert list(raw.string_runs(data, encoding)) == list(raw.decoded_runs(data, encoding))


def test_page_text(spark):
    data = b"first run of text\0" + b"second run here\1" + "wide one".encode("utf-16-le")
    page = spark.createDataFrame([("i", 0, len(data), data), ("j", 0, 0, None)], "image string, page_offset bigint, body_length int, data binary")
    got = {r["image"]: r for r in raw.page_text(page, "ascii_utf16", most=5).collect()}
    assert got["i"]["text"] == "first run of text\nwide one\nide one" and got["i"]["left_out"] == 1 and got["j"]["text"] == ""
    assert raw.page_text(page, "ascii_utf16", most=0).where("image = 'i'").first()["strings"] == 4


def test_formats(spark):
    assert [image.detect_format(n, h) for n, h in (("a.E01", b"EVF\t\r\n\xff\0"), ("a.Ex01", b"EVF2\r\n\x81\0"), ("a.L01", b"LVF\t"), ("a.E01", b"\x7fELF"), ("a.aff4", b""), ("a.dd", b"xx"), ("a.zip", b"PK\x03\x04..Container.Description"))] == ["E01", "Ex01", "L01", "UNKNOWN", "AFF4", "RAW", "AFF4"]
    df = spark.createDataFrame([("a.E01", b"\x7fELF"), ("b.E01", b"EVF\t\r\n\xff\0"), ("c.dd", b""), ("d.dd", b"PK\x03\x04..aff4://x"), ("e.dd", None)], "p string, h binary")
    assert [r[0] for r in df.orderBy("p").select(image.format_column(F.col("p"), F.col("h"))).collect()] == ["UNKNOWN", "E01", "RAW", "AFF4", "RAW"]


def segment(number, kind, ok=True):
    tail = kind.ljust(16, b"\0") + struct.pack("<QQ", 0, 0) + b"\0" * 40
    return b"EVF\t\r\n\xff\0\1" + struct.pack("<H", number) + b"\0\0" + b"\0" * 32 + tail + struct.pack("<I", zlib.adler32(tail) + (not ok))


def test_segments(spark):
    files = [("/s/a.E01", segment(1, b"next")), ("/s/a.E02", segment(2, b"next")), ("/s/a.E04", segment(4, b"done")), ("/s/b.E01", segment(1, b"done")), ("/s/c.E01", segment(2, b"next")), ("/s/d.E01", b"short"), ("/s/e.E01", segment(1, b"done", False)), ("/s/f.E01", None)]
    got = segments.inspect_segments(spark.createDataFrame(files, "path string, content binary")).cache()
    assert {r["path"] for r in got.where("status = 'OK'").collect()} == {"/s/a.E01", "/s/a.E02", "/s/a.E04", "/s/b.E01"}
    assert [(r["image_set"], r["number"], r["extension"]) for r in segments.missing_segments(got).collect()] == [("/s/a", 3, "E03")]
    done = {r["image_set"]: r["complete"] for r in segments.set_summary(got).collect()}
    assert [s for s, ok in done.items() if ok] == ["/s/b"]
    head = spark.createDataFrame([("a", "1\nmain\nc\tn\ta\tm\n77\t1\tB. Jones\t2011 10 3 1 2 3\n"), ("b", None)], "image_set string, text string")
    assert {(r["field"], r["value"]) for r in segments.header_fields(head).collect()} == {("CaseNumber", "77"), ("EvidenceNumber", "1"), ("ExaminerName", "B. Jones"), ("AcquiredDate", "2011-10-03 01:02:03")}


def test_containers(spark, tmp_path):
    path = tmp_path / "x.db"
    db = sqlite3.connect(path)
    db.execute("create table t (a, b)")
    db.executemany("insert into t values (?, ?)", [(1, "one"), (None, ""), (2, "two")])
    db.commit()
    db.close()
    key = b"key"
    files = [("/x.db", "x.db", path.read_bytes()), ("/y.db", "y.db", b"not plain"), ("/m.pst", "m.pst", b"!BDN...."), ("/q/quarantine/f", "quarantine_f", containers.rc4(key, b"secret text")), ("/n.txt", "n.txt", b"x"), ("/z.sqlite", "z.sqlite", b"SQLite format 3\0broken"), ("/w.mem", "w.mem", None)]
    got = containers.explode_containers(spark.createDataFrame(files, "path string, name string, content binary"), key).collect()
    by = {r["path"]: r for r in got}
    assert by["/x.db"]["subpath"] == "table:t" and by["/x.db"]["text"] == "1 | one\n2 | two"
    assert by["/q/quarantine/f"]["text"] == "secret text"
    assert "no library" in by["/m.pst"]["error"] and by["/y.db"]["kind"] == "sqlcipher" and by["/z.sqlite"]["error"] and "/n.txt" not in by and by["/w.mem"]["kind"] == "memory"


def test_segments_by_path(spark, tmp_path):
    (tmp_path / "a.E01").write_bytes(segment(1, b"done"))
    paths = spark.createDataFrame([(str(tmp_path / "a.E01"),), (str(tmp_path / "gone.E01"),)], "path string")
    got = {r["path"][-8:]: (r["status"], r["notes"]) for r in segments.inspect_segments(paths).collect()}
    assert got[str(tmp_path / "a.E01")[-8:]] == ("OK", []) and got["gone.E01"][0] == "BAD" and "not readable" in got["gone.E01"][1][0]


def test_known_sets(spark, tmp_path):
    c = case.Case.create(spark, str(tmp_path / "k"), "n", "me")
    sets, h = case.KnownSets(c), spark.createDataFrame([("md5", "b" * 32), ("md5", "b" * 32), ("sha256", "a" * 64)], "algo string, hash string")
    one = sets.stage("os", h)
    assert [(r["name"], r["n_hashes"], r["complete"]) for r in sets.sets().collect()] == [("~staging~os", 2, False)]
    sets.promote(one)
    two = sets.stage("os", h.limit(1))
    sets.discard(two)
    assert sets.hashes().count() == 2 and [r["name"] for r in sets.sets().collect()] == ["os"]
    with pytest.raises(ValueError):
        sets.discard(one)
    three = sets.stage("os", h.limit(1))
    sets.promote(three)  # takes the place of the set of that name
    assert [(r["id"], r["name"], r["complete"]) for r in sets.sets().collect()] == [(three, "os", True)] and sets.hashes().count() == 1
    assert sets.delete("os") == 1 and sets.delete("os") == 0 and sets.hashes().count() == 0
    assert audit.verify(c.table("audit_log")).first()["ok"]


def test_hash_sources(spark, tmp_path):
    sha, md5 = "a" * 64, "b" * 32
    (tmp_path / "l.txt").write_text(f"# c\n{sha.upper()}  x\nbad\n")
    got, bad = hashsets.read_list(spark, str(tmp_path / "l.txt"))
    assert [tuple(r) for r in got.collect()] == [("sha256", sha)] and bad.first()[0] == 1
    for n, sep in enumerate(",;\t|"):
        p = tmp_path / f"{n}.csv"
        p.write_text(sep.join(["name", "SHA-256", "MD5"]) + "\n" + sep.join(["x", sha, md5]) + "\n" + sep.join(["y", "-", md5]) + "\n")
        assert {tuple(r) for r in hashsets.read_csv(spark, str(p)).collect()} == {("sha256", sha), ("md5", md5)}
    (tmp_path / "n.csv").write_text("a,b\n1,2\n")
    with pytest.raises(ValueError):
        hashsets.read_csv(spark, str(tmp_path / "n.csv"))
    db = sqlite3.connect(tmp_path / "rds.db")
    db.execute("create table FILE (sha256 varchar, sha1 varchar, md5 varchar)")
    db.executemany("insert into FILE values (?, ?, ?)", [(sha, "c" * 40, md5)] * 3)
    db.commit()
    db.close()
    assert {r["algo"] for r in hashsets.read_database(spark, str(tmp_path / "rds.db"), rows_per_task=2).collect()} == {"sha256", "md5"}


def test_extraction(spark):
    def package(files):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for n, t in files.items():
                z.writestr(n, t)
        return out.getvalue()

    docx = package({"word/document.xml": '<w:d xmlns:w="u"><w:t>Hello</w:t><w:t>docx</w:t></w:d>'})
    pptx = package({f"ppt/slides/slide{i}.xml": f'<p:d xmlns:p="u"><p:t>s{i}</p:t></p:d>' for i in (10, 2)})
    files = [
        ("a.html", b"<html><head><title>no</title></head><body>yes<script>no</script> <b>bold</b></body></html>"), ("b.rtf", rb"{\rtf1\ansi Hello \b World\b0}"), ("c.bin", docx), ("d.pptx", pptx),
        ("e.eml", b"Subject: S\nFrom: a@b.c\nContent-Type: text/html\n\n<p>body</p>"), ("f.txt", b"a \xc2\xa0 b\n\n\n\nc"), ("g.pdf", b"%PDF-1."), ("h", b"\0\1\2"), ("i.docx", b"broken"), ("j.txt", None), ("k.txt", b""),
    ]
    df = spark.createDataFrame([("/" + n, n, c) for n, c in files], "path string, name string, content binary")
    got = {r["path"][1]: r for r in extract.extract_texts(df).collect()}
    assert [got[k]["text"] for k in "abcdf"] == ["yes bold", "Hello World", "Hello docx", "s2 s10", "a b\n\nc"]
    assert "Subject: S" in got["e"]["text"] and got["e"]["text"].endswith("body")
    assert "no library" in got["g"]["error"] and got["h"]["extractor"] == "" and got["i"]["error"] and got["j"]["error"] and not got["k"]["text"]
    kinds = {n: extract.sniff(n, d) for n, d in (("a.docm", b""), ("b.xlsm", b""), ("c.doc", b""), ("d.toml", b""), ("e.xhtml", b""), ("f", b"  <!DOCTYPE html>"), ("g", b"see <body> below"), ("h", bytes(range(200, 250)) * 9), ("i", b"{\\RTF1 x}"))}
    assert kinds == {"a.docm": "docx", "b.xlsm": "xlsx", "c.doc": "ole", "d.toml": "text", "e.xhtml": "html", "f": "html", "g": "text", "h": "", "i": "rtf"}
    assert extract.rtf_plain(r"{\rtf1 caf\'e9teria}").strip() == "cafteria"
    russian = "Комиссия проверила журнал и нашла в нём ошибки, о которых сообщила в тот же день начальнику отдела."
    assert extract.extract("x.txt", russian.encode("cp1251"))[1] == russian and extract.extract("x.txt", "größer".encode("cp1252"))[1] != ""
    assert extract.file_hashes(df, algos=("blake2b",)).where("path = '/k.txt'").first()["blake2b"].startswith("786a02f7")
    assert extract.file_hashes(df).where("path = '/k.txt'").first()["md5"] == "d41d8cd98f00b204e9800998ecf8427e"


def test_case_folder(spark, tmp_path):
    root = str(tmp_path / "case")
    c = case.Case.create(spark, root, "n", "me")
    with pytest.raises(FileExistsError):
        case.Case.create(spark, root, "n", "me")
    c.add_evidence("/x.E01", "E01", 5)
    c.add_evidence("/y.dd", "RAW")
    assert sorted((r["id"], r["path"]) for r in c.table("evidence").where("added_at > 0").collect()) == [(1, "/x.E01"), (2, "/y.dd")]
    c.add_files(spark.createDataFrame([(1, 1, "/a"), (2, 2, "/b")], "id bigint, evidence_id bigint, path string"))
    c.add_findings(spark.createDataFrame([(1, 1, "ioc", "v")], "id bigint, evidence_id bigint, kind string, value string"))
    with pytest.raises(ValueError):
        c.add_files(spark.createDataFrame([(1, 2)], "evidence_id bigint, odd int"))
    assert c.table("files").where("evidence_id = 2").first()["path"] == "/b" and c.table("findings").count() == 1
    c.set_config("policy", ["sha256"])
    c.set_config("policy", ["md5"])
    assert c.config("policy") == ["md5"] and c.config("none", 1) == 1
    log = c.table("audit_log").cache()
    assert log.count() == 7 and audit.verify(log).first()["ok"]
    bad = log.withColumn("payload_json", F.when(F.col("id") == 2, "{}").otherwise(F.col("payload_json")))
    assert tuple(audit.verify(bad).first()) == (False, 2, "row_hash")
    assert tuple(audit.verify(log.where("id <> 2")).first()) == (False, 3, "prev_hash")
    assert audit.verify(log.limit(0)).first()["ok"]
    case.write_csv(spark.createDataFrame([("=x", 1, [1])], "a string, b int, c array<int>"), root + "/csv")
    assert spark.read.csv(root + "/csv", header=True).first() == ("'=x", "1", "[1]")
    manifest = case.build_manifest(spark, root)
    case.sign_manifest(manifest, root, b"k")
    assert case.verify_manifest(root, b"k") and not case.verify_manifest(root, b"other")
    (tmp_path / "case" / "manifest.json").write_text("{}")
    assert not case.verify_manifest(root, b"k")
    (tmp_path / "img").write_bytes(b"0123456789")
    got = case.export_range(str(tmp_path / "img"), 2, 3, str(tmp_path / "out"), None)
    assert (tmp_path / "out").read_bytes() == b"234" and got["verdict"] == "NOT COMPARED"
    assert case.export_range(str(tmp_path / "img"), 2, 3, str(tmp_path / "out"), got["sha256"])["verdict"] == "MATCH"
    assert "MATCH" in case.receipt(got | {"verdict": "MATCH"}, "/img")


def test_progress_and_observation(spark, tmp_path):
    from caselode.operators import ingest as ops
    from caselode.streaming import ingest, progress

    listener = progress.Progress()
    spark.streams.addListener(listener)
    try:
        spark.range(5).write.parquet(str(tmp_path / "in"))
        q = ingest.append_batches(ingest.stream_table(spark, str(tmp_path / "in"), "id bigint"), str(tmp_path / "out"), str(tmp_path / "state"))
        q.awaitTermination()
        for _ in range(100):
            state = listener.states.get(str(q.id), {})
            if state.get("running") is False:
                break
            time.sleep(0.1)
        assert state["rows"] == 5 and state["error"] is None
    finally:
        spark.streams.removeListener(listener)
    assert progress.seconds_left(25, 100, 5) == 15 and progress.seconds_left(0, 100, 5) is None
    files = spark.createDataFrame([("a.txt", 5, 5, True, "s", None), ("b.db", 9, 4, True, None, "k"), ("c.db-wal", None, 4, True, "s", None), ("d", 5, 5, False, None, None), (None, 0, 0, True, None, None)], "name string, size_bytes bigint, read_bytes bigint, is_regular boolean, sha256 string, known_set string")
    rows, seen = ops.observed(files)
    got = {r["name"]: (r["kind"], r["hash_it"], r["extract_it"]) for r in ops.eligibility(rows).collect()}
    assert got == {"a.txt": ("", True, True), "b.db": ("sqlcipher", False, False), "c.db-wal": ("", True, False), "d": ("", False, False), None: ("", False, False)}
    assert seen.get == {"files": 5, "hashed": 2, "known": 1, "skipped": 3, "bytes": 19}


def test_streaming(spark, tmp_path):
    from caselode.streaming import ingest

    src, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    spark.range(5).write.parquet(src)
    for _ in range(2):
        ingest.append_batches(ingest.stream_table(spark, src, "id bigint"), out, state).awaitTermination()
    assert spark.read.parquet(out).count() == 5
    spark.range(5, 8).write.mode("append").parquet(src)
    ingest.append_batches(ingest.stream_table(spark, src, "id bigint"), out, state).awaitTermination()
    assert spark.read.parquet(out).count() == 8
