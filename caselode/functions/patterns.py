"""Indicators in text: ten kinds, as JVM expressions.

A kind is a pattern plus, for cards and phones, a plausibility test. Kinds are independent: the
host of a URL is a domain as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The patterns of the indicator kinds, in scanning order.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,24}",
    "url": r"(?:https?|ftp)://[A-Za-z0-9\-._~:/?#\[\]@!$&'()*+,;=%]+",
    "btc": r"(?<![A-Za-z0-9])(?:[13][A-HJ-NP-Za-km-z1-9]{25,34}|bc1[a-z0-9]{11,71})(?![A-Za-z0-9])",
    "onion": r"(?<![a-z2-7])[a-z2-7]{56}\.onion(?![a-z2-7])",
    "mac": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{2}:){5}[0-9A-Fa-f]{2}(?![0-9A-Fa-f:])",
    "ipv6": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){2,7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "ipv4": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d.])",
    "cc": r"(?<![\dA-Za-z])\d[\d \-]{11,21}\d(?![\dA-Za-z])",
    "phone": r"(?<![\dA-Za-z+.])\+?\d[\d \-()]{6,16}\d(?![\dA-Za-z.])",
    "domain": r"(?<![A-Za-z0-9.\-])(?:[A-Za-z0-9\-]{1,63}\.)+(?:com|net|org|info|biz|gov|edu|mil|io|co|ru|cn|uk|de|fr|jp|in|us|xyz|top|onion|live|app|dev|me)(?![A-Za-z0-9.\-])",
}
KINDS = tuple(PATTERNS)
#: What every pattern's match holds: a text without it needs none of them.
ANY = r"@|://|[A-Za-z0-9]{14}|[0-9A-Fa-f]:[0-9A-Fa-f]|\d[ \-()]{0,20}[\d.]|\.[a-z]{2}"


def luhn(value: Column) -> Column:
    """Whether 13 to 19 digits pass the Luhn check, other characters ignored."""
    digits = F.regexp_replace(value, r"\D", "")
    return F.length(digits).between(13, 19) & F.call_function("luhn_check", digits)


def plausible_phone(value: Column) -> Column:
    """7 to 15 digits, not all alike, not beginning 0000."""
    digits = F.regexp_replace(value, r"\D", "")
    return F.length(digits).between(7, 15) & ~digits.rlike(r"^(\d)\1*$") & ~digits.startswith("0000")


def matches(text: Column, kind: str) -> Column:
    """Array of the kind's plausible values in ``text``; NULL text gives an empty array."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PATTERNS[kind]), F.lit(0))
    if kind == "cc":
        return F.filter(found, luhn)
    if kind == "phone":
        return F.filter(found, plausible_phone)
    return found


def indicators(df: DataFrame, text: str, *keep: str, kinds: tuple[str, ...] = KINDS, most: int = 0) -> DataFrame:
    """``keep`` columns, kind and value, a row for each hit. most > 0 keeps that many hits of a kind in a text.

    NULL and empty texts have no hit. Unknown kinds are an error.
    """
    cut = (lambda a: F.slice(a, 1, most)) if most else (lambda a: a)
    per = F.array(*[F.struct(F.lit(k).alias("kind"), cut(matches(F.col(f"`{text}`"), k)).alias("found")) for k in kinds])
    return df.where(F.col(f"`{text}`").rlike(ANY)).select(*[F.col(f"`{c}`") for c in keep], F.explode(per).alias("h")).select(*keep, "h.kind", F.explode("h.found").alias("value"))
