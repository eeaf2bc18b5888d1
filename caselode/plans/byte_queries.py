"""Registered queries of the byte-level operators: images, packages and databases are made of the given tables' rows, read back by the operators, and SQL says what must come out."""

from __future__ import annotations

import sqlite3
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caselode.functions import extract, scalars
from caselode.operators import known, raw
from caselode.session import cut, shared_folder, spread
from caselode.sinks import index
from caselode.sources import containers, fat, image, segments, volumes
from caselode.sources.tables import table

#: Bytes of the pages that documents are cut into; the margin is longer than any run in them.
PAGE, MARGIN = 4096, 1 << 17
WORDS = "server image checksum"


def _pages(docs: DataFrame, content: Column) -> DataFrame:
    """An image for each document, cut into pages."""
    rows = spread(docs.select(F.col("doc_id").cast("string").alias("image"), content.alias("content")).where("length(content) > 0"))
    at = rows.withColumn("page_offset", F.explode(F.sequence(F.lit(0).cast("bigint"), F.length("content") - 1, F.lit(PAGE).cast("bigint"))))
    before = F.least(F.col("page_offset"), F.lit(image.BEFORE)).cast("int")
    body = F.least(F.lit(PAGE), F.length("content") - F.col("page_offset")).cast("int")
    data = F.substring(F.col("content"), (F.col("page_offset") - before + 1).cast("int"), before + PAGE + MARGIN)
    return at.select("image", "page_offset", body.alias("body_length"), before.alias("before"), F.lit(MARGIN).alias("margin"), data.alias("data"))


def _text() -> Column:
    return F.col("text").cast("binary")


def _wrapped() -> Column:
    """The text within a carved kind's header and footer, behind a few other bytes."""
    return F.concat(F.lit(b"\1" * 16), F.lit(b"%PDF-1."), _text(), F.lit(b"%%EOF"), F.lit(b"\2" * 5))


def page_strings(spark: SparkSession, d: str) -> DataFrame:
    """Runs of ASCII in the documents' bytes."""
    runs = raw.page_strings(_pages(table(spark, d, "documents"), _text()), "ascii_utf16")
    return runs.where("encoding = 'ascii'").select(F.col("image").cast("bigint").alias("doc_id"), "text")


def page_strings_wide(spark, d):
    """The same of the documents' UTF-16 bytes, and how many do not stand at the offset told."""
    wide = F.encode("text", "UTF-16LE")
    docs = table(spark, d, "documents")
    runs = raw.page_strings(_pages(docs, wide), "ascii_utf16").where("encoding = 'utf-16-le'").withColumn("doc_id", F.col("image").cast("bigint"))
    there = F.substring(wide, (F.col("offset") + 1).cast("int"), (2 * F.length("run")).cast("int")) == F.encode("run", "UTF-16LE")
    return runs.withColumnRenamed("text", "run").join(docs.select("doc_id", "text"), "doc_id").groupBy("doc_id").agg(F.count(F.lit(1)).alias("strings"), F.sum(F.length("run")).alias("characters"), F.count_if(~there).alias("misplaced"))


def page_strings_beyond_ascii(spark, d):
    """Runs of UTF-8 with other characters, by document, and how many do not stand at the offset told."""
    docs = table(spark, d, "documents")
    runs = raw.page_strings(_pages(docs, _text()), "windows").where("encoding = 'utf-8'").withColumn("doc_id", F.col("image").cast("bigint")).withColumnRenamed("text", "run")
    there = F.substring(_text(), (F.col("offset") + 1).cast("int"), F.octet_length("run")) == F.col("run").cast("binary")
    return runs.join(docs.select("doc_id", "text"), "doc_id").groupBy("doc_id").agg(F.count(F.lit(1)).alias("strings"), F.sum(F.length("run")).alias("characters"), F.count_if(~there).alias("misplaced"))


def page_indicators(spark, d):
    """Mail addresses in the runs, counted by document."""
    runs = raw.page_strings(_pages(table(spark, d, "documents"), _text()), "ascii_utf16").where("encoding = 'ascii'")
    return raw.page_indicators(runs).where("subtype = 'email'").select(F.col("image").cast("bigint").alias("doc_id"), "value", "count")


def page_texts(spark, d):
    """Strings and characters of the pages' texts, by document, without a budget."""
    texts = raw.page_text(_pages(table(spark, d, "documents"), _text()), "ascii_utf16", most=0)
    return texts.groupBy(F.col("image").cast("bigint").alias("doc_id")).agg(F.sum("strings").alias("strings"), F.sum("left_out").alias("left_out")).where("strings > 0")


def carved_documents(spark, d):
    """Files carved from images that hold the documents."""
    found = raw.carve_pages(_pages(table(spark, d, "documents").where("text is not null"), _wrapped()))
    return found.select(F.col("image").cast("bigint").alias("doc_id"), "kind", "offset", "size", "complete", "sha256", "md5")


def swept_documents(spark, d):
    """What one pass over the same images finds, by sort."""
    both = raw.sweep_and_carve(_pages(table(spark, d, "documents").where("text is not null"), _wrapped()), "ascii_utf16")
    return both.where("label <> 'utf-16-le' and label <> 'utf-16-be'").groupBy("what", "label").agg(F.count(F.lit(1)).alias("found"), F.sum("size").alias("bytes"))


def _le(n: Column) -> Column:
    """Four bytes in hex, the lowest first."""
    h = F.lpad(F.hex(n), 8, "0")
    return F.concat(*[F.substring(h, 7 - 2 * i, 2) for i in range(4)])


def evidence_volumes(spark, d):
    """Volumes of images with a partition table made for every evidence item."""
    i = F.col("id")
    first, zeros = 1 + i % 3, lambda n: F.repeat(F.lit("00"), n)
    entry = lambda kind, at, count: F.concat(F.lit("00000000"), kind, F.lit("000000"), _le(at), _le(count))
    boot = F.concat(zeros(F.lit(446)), entry(F.lit("07"), first, 100 + i), F.when(i % 2 == 0, entry(F.lit("83"), F.lit(20_000), F.lit(500))).otherwise(zeros(F.lit(16))), zeros(F.lit(32)), F.lit("55AA"))
    mark = F.when(i % 5 == 0, F.hex(F.lit("-FVE-FS-"))).otherwise(F.hex(F.lit("NTFS    ")))
    head = F.concat(boot, zeros(((first - 1) * 512).cast("int")), F.lit("EB5290"), mark, zeros(F.lit(501)))
    images = table(spark, d, "evidence").select(i.cast("string").alias("image"), F.lit(64 << 20).cast("bigint").alias("size_bytes"), F.unhex(head).alias("head"))
    return volumes.volumes_in(spread(images)).select(F.col("image").cast("bigint").alias("id"), "volume_offset", "size_bytes", "volume_label", "kind", "encryption", "file_system", "has_snapshots")


def volume_placeholders(spark, d):
    """Rows that stand for volumes that cannot be walked."""
    found = evidence_volumes(spark, d).withColumn("image", F.col("id").cast("string"))
    return volumes.placeholder_files(found).select(F.col("image").cast("bigint").alias("id"), "volume_offset", "path", "name")


def _fat12(content: bytes) -> bytes:
    """A small FAT volume with the content as its one file, in clusters of 4 KiB whose chain runs backwards."""
    n = -(-len(content) // 4096)
    clusters, table = n + 4, [0] * (n + 6)
    chain = list(range(n + 1, 1, -1))
    for a, b in zip(chain, [*chain[1:], 0xFFF], strict=False):
        table[a] = b
    raw = bytearray(512 * -(-(len(table) * 3 // 2 + 2) // 512))
    for i, v in enumerate(table):
        at = i + i // 2
        old = struct.unpack_from("<H", raw, at)[0]
        struct.pack_into("<H", raw, at, old & 0x000F | v << 4 if i % 2 else old & 0xF000 | v)
    boot = bytearray(512)
    struct.pack_into("<HBHBHHBH", boot, 11, 512, 8, 1, 1, 16, 2 + len(raw) // 512 + 8 * clusters, 0xF8, len(raw) // 512)
    boot[54:59], boot[510:512] = b"FAT12", b"\x55\xaa"
    root = struct.pack("<11sB8xHHHHI", b"DOC     TXT", 0x20, 0, 0, (2020 - 1980) << 9 | 1 << 5 | 1, chain[0] if chain else 0, len(content)).ljust(512, b"\0")
    body = bytearray(4096 * clusters)
    for k, c in enumerate(chain):
        part = content[4096 * k : 4096 * (k + 1)]
        body[4096 * (c - 2) : 4096 * (c - 2) + len(part)] = part
    return bytes(boot + raw + root + body)


def fat_documents(spark, d):
    """Documents stored in FAT volumes of their own and found by walking them."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                volume = _fat12(text.encode())
                rows += fat.volume_rows(str(i), 0, "vol1", lambda at, n, v=volume: v[at : at + n])
            yield fat._record(rows)

    docs = table(spark, d, "documents").where("text is not null").select("doc_id", "text")
    return spread(docs).mapInArrow(walk, fat.SCHEMA).select(F.col("image").cast("bigint").alias("doc_id"), "path", "size_bytes", "mtime", "is_allocated", "md5", "sha256", "error")


def _segment(number: int, kind: bytes, whole: bool) -> bytes:
    tail = kind.ljust(16, b"\0") + bytes(56)
    return b"EVF\t\r\n\xff\0\1" + struct.pack("<H", number) + bytes(34) + tail + struct.pack("<I", zlib.adler32(tail) ^ (not whole))


def segment_sets(spark, d):
    """Checks of three segments made for every image set: by the length of its name all right, the second missing, or the third damaged."""
    sets = table(spark, d, "case_metadata").select("image_set").where("image_set is not null").distinct()

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name in batch.column(0).to_pylist():
                fault = len(name) % 3
                rows += [(f"{name}.E0{k}", _segment(k, b"done" if k == 3 else b"next", not (fault == 2 and k == 3))) for k in (1, 2, 3) if not (fault == 1 and k == 2)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.binary())], names=["path", "content"])

    checked = cut(segments.inspect_segments(sets.mapInArrow(make, "path string, content binary")))
    return segments.set_summary(checked)


def container_documents(spark, d):
    """Artifact items written into databases of their own and read back."""
    items = table(spark, d, "artifact_items").select("item_id", "subpath", "text")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blobs = []
            for sub, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                db = sqlite3.connect(":memory:")
                db.execute("create table t (a, b)")
                db.execute("insert into t values (?, ?)", (sub, text))
                db.commit()
                blobs.append(db.serialize())
                db.close()
            ids = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([str(i) for i in ids]), pa.array([f"{i}.bin" for i in ids]), pa.array(blobs, pa.binary())], names=["path", "name", "content"])

    made = spread(items).mapInArrow(make, "path string, name string, content binary")
    return containers.explode_containers(made).select(F.col("path").cast("bigint").alias("item_id"), "kind", "subpath", F.md5(F.col("text").cast("binary")).alias("digest"), "error")


def extracted_texts(spark, d):
    """Documents as plain text, HTML and RTF by turns, and what the extractors give back."""
    n, plain = F.col("doc_id") % 3, F.regexp_replace("text", r"[<>&{}\\]", " ")
    page = F.concat(F.lit("<!DOCTYPE html><html><head><title>no</title></head><body><p>"), plain, F.lit("</p><script>no</script></body></html>"))
    content = F.when(n == 0, _text()).when(n == 1, page.cast("binary")).otherwise(F.concat(F.lit(r"{\rtf1\ansi "), F.regexp_replace(plain, r"[^\x00-\x7f]", r"\\'e9"), F.lit(r"\par}")).cast("binary"))
    name = F.concat(F.lit("f"), F.element_at(F.array(F.lit(".log"), F.lit(""), F.lit(".rtf")), (n + 1).cast("int")))
    files = table(spark, d, "documents").where("text <> ''").select(F.col("doc_id").cast("string").alias("path"), name.alias("name"), content.alias("content"))
    texts = extract.extract_texts(spread(files))
    bare = F.regexp_replace("text", r"\s+|[\x{a0}\x{2000}-\x{200a}\x{202f}\x{3000}\x{85}\x{2028}\x{2029}]+", "")
    return texts.select(F.col("path").cast("bigint").alias("doc_id"), "extractor", F.md5(bare.cast("binary")).alias("digest"), "truncated", "error")


def image_formats(spark, d):
    """Formats told from the paths of the evidence items and first bytes made by their recorded format."""
    head = F.when(F.col("format").isin("E01", "EWF"), F.lit(b"EVF\t\r\n\xff\0")).when(F.lower("format") == "ex01", F.lit(b"EVF2\r\n\x81\0")).when(F.col("format") == "AFF4", F.lit(b"PK\3\4 aff4://x")).otherwise(F.lit(b"\0" * 8))
    rows = table(spark, d, "evidence").select("format", F.concat(F.regexp_replace("path", r"\.[^./]*$", ""), F.lit(".img")).alias("path"), head.alias("content"))
    return volumes.inspect_images(rows.select("path", "content")).groupBy(F.col("format").alias("found")).agg(F.count(F.lit(1)).alias("items"), F.count("bytes_per_sector").alias("readable"))


def magic_kinds(spark, d):
    """Files by the kind of container that first bytes tell, made for every file in turn; names stay as they are."""
    heads = (b"!BDN", b"regf", b"\0\0\0\0\xef\xcd\xab\x89", b"SQLite format 3\0", b"\xd4\xc3\xb2\xa1", b"none")
    content = F.element_at(F.array(*[F.lit(h) for h in heads]), (F.col("id") % len(heads) + 1).cast("int"))
    return table(spark, d, "files").select(containers.artifact_kind(F.concat(F.lit("f"), F.col("id"), F.lit(".x")), content).alias("kind")).groupBy("kind").agg(F.count(F.lit(1)).alias("files"))


def hash_list_import(spark, d):
    """A hash list made of the files' digests, with comments, blanks and unreadable lines; (algo, hash) counted with the lines skipped."""
    f = table(spark, d, "files")
    lines = f.select(F.explode(F.array(F.concat(F.lit("  "), F.upper("sha256"), F.lit("  name.bin")), F.concat(F.lit("'"), F.col("md5"), F.lit("'")), F.concat(F.lit("# "), F.col("md5")), F.lit(""), F.col("name"))).alias("value"))
    hashes, skipped = known.import_hashes(lines)
    return hashes.groupBy("algo").agg(F.count(F.lit(1)).alias("hashes")).crossJoin(F.broadcast(skipped))  # one row


def index_search(spark, d):
    """keyword_search from an index written to the shared folder (a report's limit of 50)."""
    path = shared_folder(spark, "index")
    index.write_index(table(spark, d, "documents"), path, "doc_id", "evidence_uuid", "text")
    return index.search_index(spark, path, WORDS)


def index_sizes(spark, d):
    """Documents and terms by evidence item, of the written index."""
    path = shared_folder(spark, "index")
    index.write_index(table(spark, d, "documents"), path, "doc_id", "evidence_uuid", "text")
    return spark.read.parquet(f"{path}/sizes").select("evidence", "n", F.round("avgdl", 6).alias("avgdl"))


def queries() -> dict:
    own = [
        page_strings, page_strings_wide, page_strings_beyond_ascii, page_indicators, page_texts, carved_documents, swept_documents, evidence_volumes, volume_placeholders, fat_documents, segment_sets, container_documents,
        extracted_texts, image_formats, magic_kinds, hash_list_import, index_search, index_sizes,
    ]
    return {f.__name__: f for f in own}


_RUN = r"regexp_extract_all({t}, '[\t -~]{{6,}}')"
_PDF = "'%PDF-1.' || text || '%%EOF'"
_STARTS = "(1 + id % 3)"
_TERMS = r"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda t: t <> '' and strlen(t) < 40)"


def oracle_sql() -> dict[str, str]:
    runs = f"select doc_id, unnest({_RUN.format(t='text')}) as run from documents"
    volumes_sql = f"""select id, cast({_STARTS} * 512 as bigint) as volume_offset, cast((100 + id) * 512 as bigint) as size_bytes, 'vol1' as volume_label, 'mbr' as kind, case when id % 5 = 0 then 'bitlocker' else '' end as encryption,
        case when id % 5 = 0 then '' else 'ntfs' end as file_system, false as has_snapshots from evidence union all select id, 20000 * 512, 500 * 512, 'vol2', 'mbr', '', '', false from evidence where id % 2 = 0"""
    blank = r"[\s\x{a0}\x{2000}-\x{200a}\x{202f}\x{3000}\x{85}\x{2028}\x{2029}]+"
    plain = r"regexp_replace(text, '[<>&{}\\]', ' ', 'g')"
    return {
        "page_strings": f"select doc_id, run as text from ({runs})",
        "page_strings_wide": f"select doc_id, count(*) as strings, cast(sum(length(run)) as bigint) as characters, cast(0 as bigint) as misplaced from ({runs}) group by 1",
        "page_strings_beyond_ascii": r"""select doc_id, count(*) as strings, cast(sum(length(run)) as bigint) as characters, cast(0 as bigint) as misplaced from (
            select doc_id, unnest(regexp_extract_all(text, '[^\x00-\x08\x0b-\x1f\x7f\x{fffd}]{6,}')) as run from documents) where regexp_matches(run, '[^\x00-\x7f]') group by 1""",
        "page_indicators": f"select doc_id, value, count(*) as count from (select doc_id, unnest(regexp_extract_all(run, '[A-Za-z0-9._%+\\-]+@[A-Za-z0-9.\\-]+\\.[A-Za-z]{{2,24}}')) as value from ({runs})) group by all",
        "page_texts": f"select doc_id, count(*) as strings, cast(0 as bigint) as left_out from ({runs}) group by 1",
        "carved_documents": f"select doc_id, 'pdf' as kind, cast(16 as bigint) as \"offset\", cast(strlen({_PDF}) as bigint) as size, true as complete, sha256({_PDF}) as sha256, md5({_PDF}) as md5 from documents where text is not null and strlen({_PDF}) >= 512",
        "swept_documents": f"""select 'string' as what, 'ascii' as label, count(*) as found, cast(sum(length(run)) as bigint) as bytes from (select unnest({_RUN.format(t=_PDF)}) as run from documents where text is not null)
            union all select 'carved', 'pdf', count(*), cast(sum(strlen({_PDF})) as bigint) from documents where text is not null and strlen({_PDF}) >= 512""",
        "evidence_volumes": volumes_sql,
        "volume_placeholders": f"""select id, volume_offset, '/(' || volume_label || ')' as path, case when encryption <> '' then '[encrypted: ' || encryption || ']' else '[no known file system]' end as name
            from ({volumes_sql}) where encryption <> '' or file_system = ''""",
        "fat_documents": """select doc_id, '/DOC.TXT' as path, cast(strlen(text) as bigint) as size_bytes, cast(1577836800 as double) as mtime, true as is_allocated, case when text <> '' then md5(text) end as md5, case when text <> '' then sha256(text) end as sha256,
            null::varchar as error from documents where text is not null""",
        "segment_sets": """select image_set, cast(case when length(image_set) % 3 = 1 then 2 else 3 end as bigint) as segments, cast(case when length(image_set) % 3 = 2 then 1 else 0 end as bigint) as bad, true as has_end,
            cast(case when length(image_set) % 3 = 1 then 1 else 0 end as bigint) as missing, length(image_set) % 3 = 0 as complete from (select distinct image_set from case_metadata where image_set is not null)""",
        "container_documents": "select item_id, 'sqlite' as kind, 'table:t' as subpath, md5(concat_ws(' | ', nullif(subpath, ''), nullif(text, ''))) as digest, '' as error from artifact_items where coalesce(subpath, '') <> '' or coalesce(text, '') <> ''",
        "extracted_texts": f"""select doc_id, case doc_id % 3 when 0 then 'text' when 1 then 'html' else 'rtf' end as extractor, md5(regexp_replace(case doc_id % 3 when 0 then text when 1 then {plain} else regexp_replace({plain}, '[^\\x00-\\x7f]', '', 'g') end, '{blank}', '', 'g')) as digest,
            false as truncated, '' as error from documents where text <> ''""",
        "image_formats": """select case when format in ('E01', 'EWF') then 'E01' when lower(format) = 'ex01' then 'Ex01' when format = 'AFF4' then 'AFF4' else 'RAW' end as found, count(*) as items,
            count(*) filter (not (format in ('E01', 'EWF', 'AFF4') or lower(format) = 'ex01')) as readable from evidence group by 1""",
        "magic_kinds": "select case id % 6 when 0 then 'pst' when 1 then 'registry' when 2 then 'esedb' when 3 then 'sqlite' when 4 then 'pcap' else '' end as kind, count(*) as files from files group by 1",
        "hash_list_import": r"""with w as (select unnest([upper(sha256), '''' || md5 || '''', regexp_extract(trim(name), '^\S+')]) as w from files), h as (select lower(regexp_replace(w, '^[\s"'']+|[\s"'']+$', '', 'g')) as h from w where w <> '' and not starts_with(w, '#')),
            n as (select h, regexp_full_match(h, '[0-9a-f]+') and length(h) in (32, 40, 64) as fine from h)
            select case length(h) when 32 then 'md5' when 40 then 'sha1' else 'sha256' end as algo, count(distinct h) as hashes, (select count(*) from n where not fine) as skipped from n where fine group by 1""",
        "index_search": f"""with t as (select evidence_uuid as evidence, doc_id as doc, {_TERMS} as terms from documents), s as (select evidence, count(*) as n, avg(len(terms)) as avgdl from t group by 1),
            h as (select evidence, doc, dl, term, count(*) as tf from (select evidence, doc, len(terms) as dl, unnest(terms) as term from t) where term in ({", ".join(f"'{w}'" for w in WORDS.split())}) group by all),
            f as (select evidence, term, count(*) as df from h group by all)
            select evidence, doc, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 4) as score
            from h join f using (evidence, term) join s using (evidence) group by evidence, doc order by score desc, doc limit 50""",
        "index_sizes": f"select evidence_uuid as evidence, count(*) as n, round(avg(len({_TERMS})), 6) as avgdl from documents group by 1",
    }
