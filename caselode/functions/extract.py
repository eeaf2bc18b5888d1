"""Text of files by kind: plain, HTML, RTF, Office packages, mail. Kinds without an installed library give an error, not an empty text."""

from __future__ import annotations

import email
import email.policy
import hashlib
import io
import re
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Longest text kept, sample for telling text from binary.
MOST_CHARS = 1_000_000
SAMPLE = 8192
SCHEMA = "path string, extractor string, text string, char_count bigint, truncated boolean, error string"
#: Extensions by extractor.
TEXT = frozenset(
    "txt log csv tsv ini cfg conf md rst json yaml yml xml sql sh bat ps1 ps py js ts java c cc cpp h hpp cs go rb php pl lua r m swift kt scala "
    "vb asm css scss less toml env properties reg url vbs wsf applescript gradle dockerfile makefile cmake diff patch srt vtt tex".split()
)
KINDS = {
    **dict.fromkeys(TEXT, "text"), **dict.fromkeys(("html", "htm", "xhtml", "mhtml"), "html"), **dict.fromkeys(("docx", "docm"), "docx"), **dict.fromkeys(("xlsx", "xlsm"), "xlsx"),
    **dict.fromkeys(("pptx", "pptm"), "pptx"), **dict.fromkeys(("doc", "xls", "ppt"), "ole"), "rtf": "rtf", "eml": "eml", "pdf": "pdf", "msg": "msg",
}


class _Html(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.skip, self.parts = 0, []

    def handle_starttag(self, tag, attrs):
        self.skip += tag in ("script", "style", "head")

    def handle_endtag(self, tag):
        if tag in ("script", "style", "head") and self.skip:
            self.skip -= 1

    def handle_data(self, data):
        if not self.skip and data.strip():
            self.parts.append(data.strip())


def html_text(text: str) -> str:
    """Visible text, chunks joined by a blank; script, style and head left out."""
    parser = _Html()
    parser.feed(text)
    parser.close()
    return " ".join(parser.parts)


def rtf_plain(text: str) -> str:
    text = re.sub(r"\\'[0-9a-fA-F]{2}", "", text)
    return re.sub(r"[{}\\]", " ", re.sub(r"\\[a-zA-Z]+-?\d* ?", " ", text))


_PRINTABLE = bytes([9, 10, 13, *range(32, 127)])


def looks_like_text(data: bytes) -> bool:
    """No NUL and more than 85 % printable ASCII in the first 8 KiB."""
    head = data[:SAMPLE]
    return bool(head) and 0 not in head and len(head.translate(None, _PRINTABLE)) < 0.15 * len(head)


def _members(names: list[str], kind: str) -> list[str]:
    if kind == "docx":
        return [n for n in names if re.fullmatch(r"word/(document|header\d*|footer\d*|footnotes|endnotes)\.xml", n)]
    if kind == "xlsx":
        return [n for n in names if re.fullmatch(r"xl/(sharedStrings|worksheets/sheet\d+)\.xml", n)]
    slides = [n for n in names if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)]
    return sorted(slides, key=lambda n: int(re.search(r"\d+", n.rsplit("/", 1)[1])[0]))  # slide 2 before slide 10


def package_kind(data: bytes) -> str:
    """docx, xlsx, pptx or '' of a ZIP."""
    try:
        names = zipfile.ZipFile(io.BytesIO(data)).namelist()
    except zipfile.BadZipFile:
        return ""
    return next((k for p, k in (("word/", "docx"), ("xl/", "xlsx"), ("ppt/", "pptx")) if any(n.startswith(p) for n in names)), "")


def office_text(data: bytes, kind: str) -> str:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        out = []
        for name in _members(z.namelist(), kind):
            root = ElementTree.fromstring(z.read(name))
            out += [e.text for e in root.iter() if e.tag.rpartition("}")[2] in ("t", "v") and e.text] if kind == "xlsx" and "sheet" in name.lower() and "shared" not in name.lower() else [e.text for e in root.iter() if e.tag.rpartition("}")[2] == "t" and e.text]
        return " ".join(out)


def mail_text(data: bytes) -> str:
    """Five headers, then the plain body, else the HTML body's text."""
    m = email.message_from_bytes(data, policy=email.policy.default)
    body = m.get_body(("plain",)) or m.get_body(("html",))
    text = body.get_content() if body else ""
    if body and body.get_content_type() == "text/html":
        text = html_text(text)
    return "\n".join([*(f"{h}: {m[h]}" for h in ("Subject", "From", "To", "Cc", "Date") if m[h]), "", text])


def sniff(name: str, data: bytes) -> str:
    """Extractor by extension, else by the first bytes; '' for none."""
    ext = name.strip().rsplit(".", 1)[-1].lower() if "." in name else ""
    if ext in KINDS:
        return KINDS[ext]
    if data[:5] == b"%PDF-":
        return "pdf"
    if data[:4] == b"PK\x03\x04":
        return package_kind(data)
    if data[:8] == b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1":
        return "ole"
    if data[:5].lower() == b"{\\rtf":
        return "rtf"
    if data[:1024].lstrip().lower().startswith((b"<!doctype html", b"<html")):
        return "html"
    return "text" if looks_like_text(data) else ""


def _decode(data: bytes) -> str:
    for mark, codec in ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
        if data.startswith(mark):
            return data.decode(codec, "replace")
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        return _guess(data)


def _guess(data: bytes) -> str:
    """By the installed detector of encodings; Windows' Western code page where there is none or it finds nothing."""
    try:
        from charset_normalizer import from_bytes

        best = from_bytes(data).best()
    except ImportError:
        best = None
    return data.decode("cp1252", "replace") if best is None else str(best)


def extract(name: str, data: bytes | None) -> tuple[str, str, int, bool, str]:
    """extractor, text, characters before trimming, whether cut, error. Never raises."""
    if not data:
        return "", "", 0, False, "" if data is not None else "no content"
    kind = sniff(name or "", data)
    try:
        if kind in ("pdf", "msg", "ole"):
            return kind, "", 0, False, "legacy document format, not supported" if kind == "ole" else f"no library for {kind}"
        text = {"html": lambda: html_text(_decode(data)), "rtf": lambda: rtf_plain(data.decode("latin-1")), "eml": lambda: mail_text(data), "text": lambda: _decode(data), "": lambda: ""}.get(kind, lambda: office_text(data, kind))()
    except Exception as e:  # noqa: BLE001  a broken file is a result
        return kind, "", 0, False, f"{type(e).__name__}: {e}"
    text = re.sub(r"\n{3,}", "\n\n", re.sub("[ \\t\u00a0]+", " ", text))
    return kind, text[:MOST_CHARS].strip(), min(len(text), MOST_CHARS), len(text) > MOST_CHARS, ""


def extract_texts(files: DataFrame) -> DataFrame:
    """path, extractor, text, char_count, truncated, error of files (path, name, content)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(p, *extract(n, c)) for p, n, c in zip(*(batch.column(k).to_pylist() for k in ("path", "name", "content")), strict=True)]
            types = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.bool_(), pa.string()]
            columns = zip(*rows, strict=True) if rows else [[]] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=["path", "extractor", "text", "char_count", "truncated", "error"])

    return files.select("path", "name", "content").mapInArrow(run, SCHEMA)


@F.pandas_udf(T.StringType())
def blake2b(content: pd.Series) -> pd.Series:
    """BLAKE2b-512 in hex, which the JVM lacks; NULL stays NULL."""
    return content.map(lambda x: hashlib.blake2b(x).hexdigest(), na_action="ignore")


def file_hashes(files: DataFrame, content: str = "content", algos: tuple[str, ...] = ("md5", "sha1", "sha256")) -> DataFrame:
    """files without the content, with the digests: one pass, JVM expressions but for blake2b."""
    make = {"md5": F.md5, "sha1": F.sha1, "sha256": lambda c: F.sha2(c, 256), "sha512": lambda c: F.sha2(c, 512), "blake2b": blake2b}
    unknown = [a for a in algos if a not in make]
    if unknown:
        raise ValueError("unknown algorithms " + ", ".join(unknown))
    return files.withColumns({a: make[a](F.col(content)) for a in dict.fromkeys(algos)}).drop(content)
