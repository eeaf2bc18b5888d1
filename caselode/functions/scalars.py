"""Scalar functions on paths, times, hashes, sizes and text."""

from __future__ import annotations

import hashlib
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Seconds between 1601 and 1970, and the year 2100 beyond which file times are nonsense.
FILETIME_ZERO_S = 11_644_473_600
YEAR_2100_S = 4_102_444_800


def filetime_to_unix(ticks: Column) -> Column:
    """Unix seconds of a FILETIME (100 ns since 1601); NULL outside 1970 to 2099."""
    s = ticks / 1e7 - FILETIME_ZERO_S
    return F.when((s > 0) & (s < YEAR_2100_S), s)


def nanos_to_unix(ns: Column) -> Column:
    """Unix seconds of nanoseconds since 1970; NULL outside 1970 to 2099."""
    s = ns / 1e9
    return F.when((s > 0) & (s < YEAR_2100_S), s)


def header_date(value: Column) -> Column:
    """A header date as ISO text: epoch seconds or milliseconds with ' UTC', six calendar parts without; other text unchanged, NULL and blank as ''."""
    v = F.trim(F.coalesce(value, F.lit("")))
    n = v.try_cast("bigint")
    s = F.when(F.length(v) == 13, F.floor(n / 1000)).otherwise(n)
    at = F.timestamp_add("SECOND", s, F.lit("1970-01-01").cast("timestamp_ntz"))  # whatever the session's zone
    parts = F.split(v, r"\s+")
    pad = lambda i, w: F.lpad(F.get(parts, F.lit(i)), w, "0")
    iso = F.concat(pad(0, 4), F.lit("-"), pad(1, 2), F.lit("-"), pad(2, 2), F.lit(" "), pad(3, 2), F.lit(":"), pad(4, 2), F.lit(":"), pad(5, 2))
    epoch = v.rlike(r"^\d{1,18}$") & (s > 0) & (s < YEAR_2100_S)
    return F.when(epoch, F.concat(F.date_format(at, "yyyy-MM-dd HH:mm:ss"), F.lit(" UTC"))).when(v.rlike(r"^\d{1,4}( +\d{1,2}){5}( |$)"), iso).otherwise(v)


def normalise_hash(value: Column) -> Column:
    """struct(algo, hash): outer blanks and quotes off, lower case; algo by length; NULL for anything else."""
    h = F.lower(F.regexp_replace(value, r"^[\s\"']+|[\s\"']+$", ""))
    algo = F.when(F.length(h) == 32, "md5").when(F.length(h) == 40, "sha1").when(F.length(h) == 64, "sha256")
    return F.when(h.rlike("^[0-9a-f]+$") & algo.isNotNull(), F.struct(algo.alias("algo"), h.alias("hash")))


def origin_of(path: Column) -> Column:
    """Where a document comes from, told by its path: carved, raw/unalloc, in container or file."""
    return F.when(path.rlike(r"^/\(carved\)/[^/]+/0x[0-9a-fA-F]+$"), "carved").when(path.rlike(r"^/\(raw\)/0x[0-9a-fA-F]+$"), "raw/unalloc").when(path.contains("#"), "in container").otherwise("file")


def container_of(path: Column) -> Column:
    """The path without its part after the first #."""
    return F.split(path, "#").getItem(0)


def safe_name(path: Column, default: str = "export.bin") -> Column:
    """The last part of a path with characters that file systems refuse replaced."""
    last = F.element_at(F.split(F.regexp_replace(F.regexp_replace(path, r"\\", "/"), r"/+$", ""), "/"), -1)
    clean = F.regexp_replace(F.regexp_replace(last, r"[<>:\"/\\|?*\x00-\x1f]", "_"), r"^[. ]+|[. ]+$", "")
    return F.when(clean == "", default).otherwise(F.coalesce(clean, F.lit(default)))


def csv_safe(value: Column) -> Column:
    """Text that a spreadsheet would take for a formula gets a leading quotation mark."""
    return F.when(value.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), value)).otherwise(value)


def size_text(n: Column) -> Column:
    """Bytes in the largest unit below 1024 of it; '' for none."""
    units = ("B", "KB", "MB", "GB", "TB", "PB")
    out = F.format_string("%.2f PB", n / 1024.0**5)
    for k in reversed(range(5)):
        out = F.when(n < 1024 ** (k + 1), F.format_string(f"%.2f {units[k]}" if k else "%.0f B", n / 1024.0**k)).otherwise(out)
    return F.when(F.coalesce(n, F.lit(0)) <= 0, "").otherwise(out)


def segment_index(ext: Column) -> Column:
    """1-based number of an image segment from its extension (E01 is 1, EAA is 100; Ex01, L01 alike); -1 if it has none."""
    e = F.regexp_replace(F.upper(F.regexp_replace(ext, r"^\.+", "")), "^([EL])X", "$1")
    tail = F.substring(e, 2, 10)
    letters = 100 + (F.ascii(tail) - 65) * 26 + F.ascii(F.substring(e, 3, 1)) - 65
    return F.when(tail.rlike("^[0-9]{2}$"), tail.try_cast("int")).when(tail.rlike("^[A-Z]{2}$"), letters.cast("int")).otherwise(F.lit(-1))


def expected_extension(index: Column, prefix: Column) -> Column:
    """The extension that segment ``index`` of a set bears."""
    n = index - 100
    return F.when(index < 100, F.concat(prefix, F.lpad(index.cast("string"), 2, "0"))).otherwise(F.concat(prefix, F.char(65 + F.floor(n / 26)), F.char(65 + n % 26)))


def tokens(text: Column) -> Column:
    """Index terms: lower-case runs of letters and digits, up to 39 bytes long. Give text in normal form C (``composed``) where it may not be."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: (t != "") & (F.octet_length(t) < 40))


def tidy_text(text: Column, most: int | None = None) -> Column:
    """Runs of blanks, tabs and no-break spaces as one blank, three or more line ends as two, outer white space off; ``most``: characters kept, all by default."""
    t = F.regexp_replace(F.regexp_replace(text, "[ \\t\u00a0]+", " "), r"\n{3,}", "\n\n")
    return F.regexp_replace(F.substring(t, 1, most) if most else t, r"^\s+|\s+$", "")


def rtf_text(text: Column) -> Column:
    """RTF without escapes, control words and braces."""
    t = F.regexp_replace(text, r"\\'[0-9a-fA-F]{2}", "")
    t = F.regexp_replace(t, r"\\[a-zA-Z]+-?\d* ?", " ")
    return tidy_text(F.regexp_replace(t, r"[{}\\]", " "))


@F.pandas_udf(T.StringType())
def nfc(s: pd.Series) -> pd.Series:
    """Unicode normal form C; NULL stays NULL."""
    return s.map(lambda x: unicodedata.normalize("NFC", x), na_action="ignore")


#: Combining marks and letters that normal form C joins or writes otherwise in the scripts indexed here.
_LOOSE = r"[\u0300-\u036f\u0958-\u095f\u1100-\u11ff\u2126\u212a\u212b\u3099\u309a]"


def composed(text: Column) -> Column:
    """Normal form C. Only texts with loose marks leave the JVM: the others are passed as NULL."""
    loose = text.rlike(_LOOSE)
    return F.coalesce(nfc(F.when(loose, text)), text)


def normalise_query(text: str) -> str:
    """A query as the index has it: normal form C, lower case."""
    return unicodedata.normalize("NFC", text).lower()


@F.pandas_udf(T.LongType())
def _doc_id(s: pd.Series) -> pd.Series:
    return s.map(lambda x: int.from_bytes(hashlib.blake2b(x.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big") & 0x7FFF_FFFF_FFFF_FFFF, na_action="ignore")


def stable_doc_id(*parts: Column) -> Column:
    """Positive 64-bit id of the parts, the same in every run; NULL parts count as ''."""
    return _doc_id(F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))


def duration_text(seconds: Column) -> Column:
    """Seconds as h:mm:ss or m:ss; '' for none."""
    s = F.floor(seconds).cast("bigint")
    tail = F.format_string("%02d:%02d", F.floor(s / 60) % 60, s % 60)
    short = F.format_string("%d:%02d", F.floor(s / 60), s % 60)
    return F.when(s.isNull() | (s < 0), "").when(s >= 3600, F.concat(F.floor(s / 3600).cast("string"), F.lit(":"), tail)).otherwise(short)
