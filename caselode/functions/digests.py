"""Similarity digests: parsing and the published distance, as JVM expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Every second bit.
LOW = 0x5555555555555555
WORDS = ("x0", "x1", "x2", "x3")


def digest_columns(digest: Column) -> dict[str, Column]:
    """x0..x3: the body as four longs; hd: checksum, length and quartiles as one int; all NULL for malformed text."""
    text = F.regexp_replace(F.upper(digest), "^T1(?=[0-9A-F]{70}$)", "")
    ok = text.rlike("^[0-9A-F]{70}$")
    word = lambda i: F.when(ok, F.conv(F.substring(text, 7 + 16 * i, 16), 16, -10).cast("bigint"))
    pair = lambda at: F.reverse(F.substring(text, at, 2))
    head = F.when(ok, F.conv(F.concat(pair(1), pair(3), pair(5)), 16, 10).cast("int"))
    return {f"x{i}": word(i) for i in range(4)} | {"hd": head}


def _cyclic(a: Column, b: Column, size: int) -> Column:
    return F.least(F.abs(a - b), F.lit(size) - F.abs(a - b))


def digest_distance(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Published distance with length of two parsed digests.

    The body's two-bit codes are compared in three thermometer planes, so that a word of 32 codes
    takes a few bit counts; codes three apart weigh six.
    """
    length = _cyclic(F.shiftright(a["hd"], 8).bitwiseAND(F.lit(255)), F.shiftright(b["hd"], 8).bitwiseAND(F.lit(255)), 256)
    out = F.when(length <= 1, length).otherwise(length * 12)
    for shift in (0, 4):
        q = _cyclic(F.shiftright(a["hd"], shift).bitwiseAND(F.lit(15)), F.shiftright(b["hd"], shift).bitwiseAND(F.lit(15)), 16)
        out = out + F.when(q <= 1, q).otherwise((q - 1) * 12)
    out = out + F.when(F.shiftright(a["hd"], 16) != F.shiftright(b["hd"], 16), 1).otherwise(0)
    for w in WORDS:
        planes = []
        for x in (a[w], b[w]):
            hi, lo = F.shiftrightunsigned(x, 1).bitwiseAND(F.lit(LOW)), x.bitwiseAND(F.lit(LOW))
            planes.append((hi.bitwiseOR(lo), hi, hi.bitwiseAND(lo)))
        diff = [p.bitwiseXOR(q) for p, q in zip(*planes, strict=True)]
        out = out + F.bit_count(diff[0]) + F.bit_count(diff[1]) + F.bit_count(diff[2]) + F.bit_count(diff[0].bitwiseAND(diff[1]).bitwiseAND(diff[2])) * 3
    return out
