"""Byte-level operators on image pages: printable strings in several encodings, carving by signature."""

from __future__ import annotations

import codecs
import hashlib
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caselode.functions.patterns import indicators
from caselode.sources.ranges import open_range, size_of

#: Encodings swept, by name of the set.
ENCODING_SETS = {
    "ascii_utf16": ("ascii", "utf-16-le", "utf-16-be"),
    "windows": ("ascii", "utf-16-le", "utf-16-be", "utf-8", "cp1252"),
    "full": ("ascii", "utf-16-le", "utf-16-be", "utf-8", "cp1252", "cp932", "cp936", "cp949", "cp950"),
}
DEFAULT_SET = "windows"
MIN_RUN = 6


def encodings_of(name: str) -> tuple[str, ...]:
    return ENCODING_SETS.get(name, ENCODING_SETS[DEFAULT_SET])


_BAD = "\udc80"  # stands for one byte that the encoding cannot read
codecs.register_error("caselode.bytes", lambda e: (_BAD * (e.end - e.start), e.end))


def string_runs(data: bytes, encoding: str, least: int = MIN_RUN) -> Iterator[tuple[int, int, str]]:
    """(first byte, end, text) of printable runs. Code pages that contain ASCII give only runs with a character beyond it, as the others were found as ASCII."""
    byte = rb"[\x09\x20-\x7e]"
    if encoding == "ascii":
        for m in re.finditer(byte + b"{%d,}" % least, data):
            yield m.start(), m.end(), m[0].decode("ascii")
    elif encoding in ("utf-16-le", "utf-16-be"):
        unit = byte + rb"\x00" if encoding.endswith("le") else rb"\x00" + byte
        for m in re.finditer(b"(?:" + unit + b"){%d,}" % least, data):
            yield m.start(), m.end(), m[0].replace(b"\x00", b"").decode("ascii")
    elif encoding in _UNITS:  # told by bytes alone; what only looks so is decoded
        for m in re.finditer(_UNITS[encoding] + b"{%d,}" % least, data):
            if m[0].isascii():
                continue
            try:
                text = m[0].decode(encoding)
            except UnicodeDecodeError:
                text = "\ufffd"
            if "\ufffd" in text:
                yield from ((m.start() + a, m.start() + b, t) for a, b, t in decoded_runs(m[0], encoding, least))
            else:
                yield m.start(), m.end(), text
    else:
        yield from decoded_runs(data, encoding, least)


#: Bytes of one character of encodings that bytes alone tell.
_UNITS = {
    "utf-8": rb"(?:[\x09\x0a\x20-\x7e]|[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3})",
    "cp1252": rb"[\x09\x0a\x20-\x7e\x80\x82-\x8c\x8e\x91-\x9c\x9e-\xff]",
}


def decoded_runs(data: bytes, encoding: str, least: int = MIN_RUN) -> Iterator[tuple[int, int, str]]:
    """Printable runs with a character beyond ASCII of the decoded bytes, with the bytes that they took."""
    text, seen, at = data.decode(encoding, "caselode.bytes"), 0, 0
    for m in re.finditer(r"[^\x00-\x08\x0b-\x1f\x7f\ufffd\ud800-\udfff]{%d,}" % least, text):
        if not m[0].isascii():
            at += _bytes(text[seen : m.start()], encoding)
            end = at + _bytes(m[0], encoding)
            yield at, end, m[0]
            seen, at = m.end(), end


def _bytes(text: str, encoding: str) -> int:
    return len(text.replace(_BAD, "?").encode(encoding, "replace"))


def own_runs(data: bytes, before: int, body: int, margin: int, encoding: str, least: int = MIN_RUN) -> Iterator[tuple[int, str]]:
    """(position in the page, text) of the runs that count in a page: those that begin in its body.

    data: ``before`` bytes that stand before the page, the body and ``margin`` bytes as far as the image goes. A run that began earlier
    counts in the page before, which completes it from its own margin; only what reaches beyond that
    margin goes on here, so that nothing is lost of runs longer than a page.
    """
    for start, end, text in string_runs(data, encoding, least):
        start, end = start - before, end - before
        if 0 <= start < body:
            yield start, text
        elif start < 0 and end > margin > 0:
            width = (end - start) / len(text)
            skip = min(len(text) - 1, int((margin - start) / width))
            yield margin, text[skip:]


def _before(pages: DataFrame) -> DataFrame:
    """Pages with the columns ``before`` and ``margin``, 0 where the source gives none."""
    return pages.withColumns({c: F.lit(0) for c in ("before", "margin") if c not in pages.columns})


_PAGE = ("image", "page_offset", "body_length", "before", "margin", "data")


def _batch(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * len(names), types, strict=True)], names=names)


def page_strings(pages: DataFrame, encodings: str = DEFAULT_SET, least: int = MIN_RUN) -> DataFrame:
    """image, page_offset, encoding, offset (of the run's first byte), text. See ``own_runs`` for what counts where. NULL data has no run."""
    sets = encodings_of(encodings)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for image, at, body, before, margin, data in zip(*(batch.column(c).to_pylist() for c in _PAGE), strict=True):
                rows = [(image, at, e, at + o, t) for e in sets for o, t in own_runs(data or b"", before, body, margin, e, least)]
                if rows:
                    yield _batch(rows, ["image", "page_offset", "encoding", "offset", "text"], [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string()])

    return _before(pages).select(*_PAGE).mapInArrow(run, "image string, page_offset bigint, encoding string, offset bigint, text string")


#: Fixed value: characters of a page's text in each encoding.
PAGE_CHARS = 200_000


def page_text(pages: DataFrame, encodings: str = DEFAULT_SET, least: int = MIN_RUN, most: int = PAGE_CHARS) -> DataFrame:
    """image, page_offset, text, strings, left_out: a page's runs joined by line ends, to be indexed as one document.

    Every encoding has its own budget of ``most`` characters, so that none crowds out another; left_out
    counts the runs beyond it. most = 0 sets no budget.
    """
    sets = encodings_of(encodings)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for image, at, body, before, margin, data in zip(*(batch.column(c).to_pylist() for c in _PAGE), strict=True):
                parts, out = [], 0
                for e in sets:
                    used = 0
                    for _, text in own_runs(data or b"", before, body, margin, e, least):
                        if most and used >= most:
                            out += 1
                        else:
                            parts.append(text)
                            used += len(text) + 1
                rows.append((image, at, "\n".join(parts), len(parts), out))
            yield _batch(rows, ["image", "page_offset", "text", "strings", "left_out"], [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()])

    return _before(pages).select(*_PAGE).mapInArrow(run, "image string, page_offset bigint, text string, strings bigint, left_out bigint")


def page_indicators(strings: DataFrame) -> DataFrame:
    """image, subtype, value, count, first_offset (the page's) of the indicators in page strings."""
    hits = indicators(strings, "text", "image", "page_offset")
    return hits.groupBy("image", F.col("kind").alias("subtype"), "value").agg(F.count(F.lit(1)).alias("count"), F.min("page_offset").alias("first_offset"))


def sweep_stats(pages: DataFrame, strings: DataFrame) -> DataFrame:
    """One row: pages, bytes, strings."""
    return pages.agg(F.count(F.lit(1)).alias("pages"), F.sum("body_length").alias("bytes")).crossJoin(strings.agg(F.count(F.lit(1)).alias("strings")))  # one row each


@dataclass(frozen=True)
class Signature:
    kind: str
    headers: tuple[bytes, ...]
    footer: bytes | None
    largest: int


_MIB = 1024 * 1024
#: Signatures and largest sizes of the kinds carved, the least size, the bitmap header sizes.
SIGNATURES = (
    Signature("jpeg", (b"\xff\xd8\xff\xe0", b"\xff\xd8\xff\xe1", b"\xff\xd8\xff\xe2", b"\xff\xd8\xff\xee", b"\xff\xd8\xff\xdb", b"\xff\xd8\xff\xc0"), b"\xff\xd9", 30 * _MIB),
    Signature("png", (b"\x89PNG\r\n\x1a\n",), b"IEND\xaeB`\x82", 50 * _MIB),
    Signature("gif", (b"GIF89a", b"GIF87a"), b"\x00\x3b", 20 * _MIB),
    Signature("pdf", (b"%PDF-1.",), b"%%EOF", 100 * _MIB),
    Signature("bmp", (b"BM",), None, 50 * _MIB),
)
LEAST_SIZE = 512
BITMAP_HEADERS = (12, 40, 52, 56, 64, 108, 124)
WINDOW = 32 * _MIB
STEP = 4 * _MIB
_BEGIN = re.compile(b"|".join(re.escape(h) for sig in SIGNATURES for h in sig.headers))
_BY_HEADER = {h: sig for sig in SIGNATURES for h in sig.headers}


def _bitmap_size(header: bytes) -> int | None:
    if len(header) < 18:
        return None
    size, reserved, start, dib = struct.unpack_from("<IIII", header, 2)
    return size if reserved == 0 and dib in BITMAP_HEADERS and 26 <= start <= 4096 and LEAST_SIZE <= size <= 50 * _MIB else None


class _Growing:
    """Bytes of which more are read when they are asked for: ``more`` gives those that follow, b"" at the image's end. Without it nobody knows how they go on."""

    def __init__(self, data: bytes, more=None):
        self.data, self.more, self.ended, self.known = bytearray(data), more or (lambda n: b""), more is None, more is not None

    def reach(self, end: int) -> int:
        """Reads on up to ``end`` if it can; gives the bytes at hand."""
        while len(self.data) < end and not self.ended:
            new = self.more(STEP)
            self.data += new
            self.ended = not new
        return len(self.data)

    def find(self, mark: bytes, start: int, end: int) -> int:
        """Position of ``mark`` wholly within start and end, -1 if there is none."""
        at = start
        while True:
            found = self.data.find(mark, at, end)
            if found >= 0 or len(self.data) >= end or self.ended:
                return found
            at = max(start, len(self.data) - len(mark) + 1)
            self.reach(min(end, len(self.data) + STEP))


def carve_bytes(data: bytes | _Growing, body: int, kinds: tuple[str, ...] | None = None) -> list[tuple[str, int, int, bool]]:
    """(kind, offset, size, complete) of the files whose header begins in the first ``body`` bytes; ``data`` goes on behind them.

    A file whose end lies beyond the bytes is there with complete = False and the size at hand. A header
    without its footer in the kind's largest size is no file.
    """
    data = data if isinstance(data, _Growing) else _Growing(data)
    data.reach(body + 8)
    out, feet = [], {}
    for m in _BEGIN.finditer(bytes(data.data[: body + 8])):
        at, sig = m.start(), _BY_HEADER[m[0]]
        if at >= body or kinds and sig.kind not in kinds:
            continue
        if sig.footer is None:
            data.reach(at + 18)
            size = _bitmap_size(bytes(data.data[at : at + 18])) or 0
            at_hand = data.reach(at + size) - at
            if size >= LEAST_SIZE:
                out.append((sig.kind, at, min(size, at_hand), at_hand >= size))
            continue
        # headers come in order: the footer found for the one before serves again if it lies behind this header, and no stretch is searched twice
        last, seen = feet.get(sig.kind, (-1, 0))
        if last < m.end():
            last = data.find(sig.footer, max(m.end(), seen - len(sig.footer) + 1), at + sig.largest)
            feet[sig.kind] = last, (last if last >= 0 else at + sig.largest)
        size = last + len(sig.footer) - at
        if last >= 0 and LEAST_SIZE <= size <= sig.largest:
            out.append((sig.kind, at, size, True))
        elif last < 0 and len(data.data) - at < sig.largest and not data.known:
            out.append((sig.kind, at, len(data.data) - at, False))
    return sorted(out, key=lambda r: (r[1], r[0]))


_CARVED = ["image", "kind", "offset", "size", "complete", "sha256", "md5"]
_CARVED_TYPES = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.string()]
CARVED_SCHEMA = "image string, kind string, offset bigint, size bigint, complete boolean, sha256 string, md5 string"


def _carved(image: str, base: int, data: _Growing, found: list[tuple[str, int, int, bool]]) -> list[tuple]:
    rows = []
    for kind, at, size, complete in found:
        blob = bytes(data.data[at : at + size]) if complete else None  # no digest of half a file
        rows.append((image, kind, base + at, size, complete, blob is not None and hashlib.sha256(blob).hexdigest() or None, blob is not None and hashlib.md5(blob).hexdigest() or None))
    return rows


def carve_image(spark: SparkSession, path: str, window: int = WINDOW, kinds: tuple[str, ...] | None = None, windows_per_task: int = 1) -> DataFrame:
    """image, kind, offset, size, complete, sha256, md5 of files carved from a raw image.

    A header counts in the window it begins in, so that none is found twice; the read goes on beyond
    the window as far as the largest size of the kind asks. Digests are taken where the bytes are; no
    bytes are shuffled. Files that the image's end cuts are not complete and have no digest.
    """
    total = size_of(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with open_range(path) as f:
            for batch in batches:
                for k in batch.column(0).to_pylist():
                    base = k * window
                    f.seek(base)
                    data = _Growing(f.read(window), f.read)
                    yield _batch(_carved(path, base, data, carve_bytes(data, min(window, total - base), kinds)), _CARVED, _CARVED_TYPES)

    n = -(-total // window)
    return spark.range(0, n, 1, max(1, -(-n // windows_per_task))).mapInArrow(run, CARVED_SCHEMA)


def carve_pages(pages: DataFrame, kinds: tuple[str, ...] | None = None) -> DataFrame:
    """The same over pages at hand (as of the page source); what reaches beyond a page's margin is not complete."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for image, at, body, before, margin, data in zip(*(batch.column(c).to_pylist() for c in _PAGE), strict=True):
                grown = _Growing((data or b"")[before:])
                yield _batch(_carved(image, at, grown, carve_bytes(grown, body, kinds)), _CARVED, _CARVED_TYPES)

    return _before(pages).select(*_PAGE).mapInArrow(run, CARVED_SCHEMA)


SWEEP_SCHEMA = "image string, what string, label string, offset bigint, size bigint, text string, complete boolean, sha256 string"


def sweep_and_carve(pages: DataFrame, encodings: str = DEFAULT_SET, least: int = MIN_RUN, kinds: tuple[str, ...] | None = None) -> DataFrame:
    """Strings and carved files in one pass over the pages: image, what ('string' or 'carved'), label (encoding or kind), offset, size in bytes, text, complete, sha256."""
    sets = encodings_of(encodings)
    names, types = [x.split()[0] for x in SWEEP_SCHEMA.split(", ")], [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for image, at, body, before, margin, data in zip(*(batch.column(c).to_pylist() for c in _PAGE), strict=True):
                data = data or b""
                rows = [(image, "string", e, at + o, _bytes(t, e), t, True, None) for e in sets for o, t in own_runs(data, before, body, margin, e, least)]
                grown = _Growing(data[before:])
                rows += [(i, "carved", kind, o, n, None, c, sha) for i, kind, o, n, c, sha, _ in _carved(image, at, grown, carve_bytes(grown, body, kinds))]
                yield _batch(rows, names, types)

    return _before(pages).select(*_PAGE).mapInArrow(run, SWEEP_SCHEMA)


def carve_stats(carved: DataFrame) -> DataFrame:
    return carved.groupBy("kind").agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"))
