"""Normalising date renderings to one unambiguous UTC instant.

Text goes through an ordered cascade of anchored patterns. The first pattern that matches
decides; its fields are then parsed strictly (no rolling over of month 13 or minute 61).
Everything runs as JVM expressions and does not depend on the session time zone.

Local readings follow one policy: a wall-clock time that its zone shows twice or never does
not denote an instant and yields NULL.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Instants outside [1990-01-01, 2100-01-01) count as nonsense.
MIN_UTC_S = 631_152_000
MAX_UTC_S = 4_102_444_800
DAY_S = 86_400


@dataclass(frozen=True)
class Unit:
    """A numeric clock: ticks per second and the Unix second of its zero."""

    name: str
    per_second: int
    zero_s: int


#: Numeric clocks told apart by magnitude alone (their windows do not overlap).
UNITS = (
    Unit("unix_s", 1, 0),
    Unit("unix_ms", 1_000, 0),
    Unit("unix_us", 1_000_000, 0),
    Unit("unix_ns", 1_000_000_000, 0),
    Unit("filetime", 10_000_000, -11_644_473_600),
    Unit("webkit_us", 1_000_000, -11_644_473_600),
)

#: Zone abbreviations in the sense of the zones that workstations use here.
ABBREVIATIONS = {
    "Z": 0, "UTC": 0, "GMT": 0, "BST": 3600, "CET": 3600, "CEST": 7200,
    "EST": -18000, "EDT": -14400, "PST": -28800, "PDT": -25200,
    "IST": 19800, "JST": 32400, "AEST": 36000, "AEDT": 39600,
}

MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")
MONTH_NAMES = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
WEEKDAYS = ("Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun")

_ZONE = r"(Z|[A-Z]{3,4}|[+-]\d{2}:?\d{2}|[A-Z][A-Za-z]+(?:/[A-Za-z0-9_+-]+)+)"
_HMS = r"(\d{2}):(\d{2}):(\d{2})(?:[.,]\d{1,9})?"
_MON = "(" + "|".join(MONTHS) + ")"
_MONTH = "(" + "|".join(MONTH_NAMES) + ")"
_DOW = "(" + "|".join(WEEKDAYS) + ")"

#: name, anchored pattern, replacement giving year|month|day|hour|minute|second|half of day|zone|weekday.
#: Ordered: a value is read by the first pattern that matches it.
CASCADE = (
    ("iso", rf"^(\d{{4}})-(\d{{2}})-(\d{{2}})[T ]{_HMS} ?{_ZONE}?$", "$1|$2|$3|$4|$5|$6||$7|"),
    ("iso_minutes", rf"^(\d{{4}})-(\d{{2}})-(\d{{2}})[T ](\d{{2}}):(\d{{2}}) ?{_ZONE}?$", "$1|$2|$3|$4|$5|0||$6|"),
    ("basic", r"^(\d{4})(\d{2})(\d{2})T?(\d{2})(\d{2})(\d{2})(Z|[+-]\d{2}:?\d{2})?$", "$1|$2|$3|$4|$5|$6||$7|"),
    ("spaced", r"^(\d{4}) (\d{1,2}) (\d{1,2}) (\d{1,2}) (\d{1,2}) (\d{1,2})$", "$1|$2|$3|$4|$5|$6|||"),
    ("dotted", rf"^(\d{{1,2}})\.(\d{{1,2}})\.(\d{{4}}) {_HMS}(?: {_ZONE})?$", "$3|$2|$1|$4|$5|$6||$7|"),
    ("slash_12h", r"^(\d{1,2})/(\d{1,2})/(\d{4}) (\d{1,2}):(\d{2}):(\d{2}) ([AP]M)$", "$3|$1|$2|$4|$5|$6|$7||"),
    ("slash_12h_minutes", r"^(\d{1,2})/(\d{1,2})/(\d{4}) (\d{1,2}):(\d{2}) ([AP]M)$", "$3|$1|$2|$4|$5|0|$6||"),
    ("slash", rf"^(\d{{1,2}})/(\d{{1,2}})/(\d{{4}}) {_HMS}(?: {_ZONE})?$", "$3|$1|$2|$4|$5|$6||$7|"),
    ("ctime", rf"^{_DOW} {_MON} {{1,2}}(\d{{1,2}}) {_HMS} (\d{{4}})$", "$7|$2|$3|$4|$5|$6|||$1"),
    ("ctime_zone", rf"^{_DOW} {_MON} {{1,2}}(\d{{1,2}}) {_HMS} {_ZONE} (\d{{4}})$", "$8|$2|$3|$4|$5|$6||$7|$1"),
    ("rfc", rf"^{_DOW}, (\d{{1,2}}) {_MON} (\d{{4}}) {_HMS}(?: {_ZONE})?$", "$4|$3|$2|$5|$6|$7||$8|$1"),
    ("rfc_no_day", rf"^(\d{{1,2}}) {_MON} (\d{{4}}) {_HMS}(?: {_ZONE})?$", "$3|$2|$1|$4|$5|$6||$7|"),
    ("day_mon", rf"^(\d{{1,2}})-{_MON}-(\d{{4}}) {_HMS}(?: {_ZONE})?$", "$3|$2|$1|$4|$5|$6||$7|"),
    ("month_day", rf"^{_MONTH} (\d{{1,2}}), (\d{{4}}) {_HMS}(?: {_ZONE})?$", "$3|$1|$2|$4|$5|$6||$7|"),
)


def _lookup(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def epoch_unit(ticks: Column) -> Column:
    """Name of the clock whose window (1990 to 2099, a day wider on both sides) holds ``ticks``; NULL if none."""
    out = F.lit(None).cast("string")
    for u in reversed(UNITS):
        lo, hi = ((s - u.zero_s) * u.per_second for s in (MIN_UTC_S - DAY_S, MAX_UTC_S + DAY_S))
        out = F.when((ticks >= F.lit(lo)) & (ticks < F.lit(hi)), F.lit(u.name)).otherwise(out)
    return out


def epoch_seconds(ticks: Column, unit: Column) -> Column:
    """Whole Unix seconds, rounded down, of integral ``ticks`` of clock ``unit``."""
    out = F.lit(None).cast("bigint")
    for u in reversed(UNITS):
        whole = F.floor(ticks / F.lit(u.per_second)) if u.per_second == 1 else (ticks - F.pmod(ticks, F.lit(u.per_second))) / F.lit(u.per_second)
        out = F.when(unit == u.name, whole.cast("bigint") + F.lit(u.zero_s)).otherwise(out)
    return out


def known_zone(zone: Column) -> Column:
    """Whether the JVM's time-zone database has the region."""
    return F.try_to_timestamp(F.concat(F.lit("2000-01-01 00:00:00 "), zone), F.lit("yyyy-MM-dd HH:mm:ss VV")).isNotNull()


def _shown(utc_s: Column, zone: Column) -> Column:
    """Wall-clock seconds that ``zone`` shows at an instant."""
    return F.unix_seconds(F.from_utc_timestamp(F.timestamp_seconds(utc_s), zone))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once: a column used several times in a filter that the
    optimizer pushes down would otherwise be written out as often, and nested ones exponentially."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def unique_instant(wall_s: Column, zone: Column) -> Column:
    """The one instant at which ``zone`` (a known one) shows ``wall_s``; NULL if there are two or none.

    The offsets in force a day and a half before and after give both candidates (no zone changes
    twice within three days).
    """

    def at(far: int) -> Column:
        near = wall_s + F.lit(far)
        return let(wall_s - (_shown(near, zone) - near), lambda t: F.when(_shown(t, zone) == wall_s, t))

    return let(
        F.struct(at(-129_600).alias("a"), at(129_600).alias("b")),
        lambda c: F.when(c["a"].isNotNull() & c["b"].isNotNull() & (c["a"] != c["b"]), F.lit(None)).otherwise(F.coalesce(c["a"], c["b"])),
    )


def wall_instant(wall_s: Column, zone: Column) -> Column:
    """As unique_instant, for any readings and zone names: NULL or unknown ones give NULL."""
    return let(
        F.struct(wall_s.alias("w"), zone.alias("z")),
        lambda c: F.when(c["w"].isNotNull() & c["z"].isNotNull(), F.when(known_zone(c["z"]), unique_instant(c["w"], c["z"]))),
    )


def utc_seconds(value: Column, default_zone: Column) -> Column:
    """The whole Unix second that text ``value`` denotes, else NULL.

    A value with its own zone or offset is read by it, one without in ``default_zone`` (an IANA
    name; NULL or unknown names give NULL). Only-digit values are read as the numeric clock that
    their magnitude selects. NULL, empty, meaningless and self-contradicting values (weekday and
    date disagree), readings shown twice or never and instants outside 1990 to 2099 give NULL.
    """
    months = _lookup({m: i + 1 for i, m in enumerate(MONTHS)} | {m: i + 1 for i, m in enumerate(MONTH_NAMES)})

    def fields(v: Column) -> Column:
        canon = F.lit(None).cast("string")
        for _, pattern, order in reversed(CASCADE):
            canon = F.when(v.rlike(pattern), F.regexp_replace(v, F.lit(pattern), F.lit(order))).otherwise(canon)
        return F.when(v.rlike(r"^\d{9,19}$") & ~v.rlike(r"^\d{14}$"), F.array(v)).otherwise(F.split(canon, r"\|", -1))

    def parsed(f: Column) -> Column:
        num = lambda i: F.get(f, F.lit(i)).try_cast("int")
        text = lambda i: F.get(f, F.lit(i))
        hour = F.when(text(6) == "", F.when(num(3) < 24, num(3))).when(num(3).between(1, 12), num(3) % 12 + F.when(text(6) == "PM", 12).otherwise(0))
        day = F.try_make_timestamp_ntz(num(0), F.coalesce(num(1), F.try_element_at(months, text(1))), num(2), F.lit(0), F.lit(0), F.lit(0)).cast("date")
        offset = F.when(
            text(7).rlike(r"^[+-](0\d|1[0-4]):?[0-5]\d$"),
            F.when(text(7).startswith("-"), -1).otherwise(1) * (F.substring(text(7), 2, 2).try_cast("int") * 3600 + F.right(text(7), F.lit(2)).try_cast("int") * 60),
        ).otherwise(F.try_element_at(_lookup(ABBREVIATIONS), text(7)))
        return F.struct(
            F.when(F.size(f) == 1, text(0).try_cast("bigint")).alias("ticks"),
            let(day, lambda d: F.when((text(8) == "") | (F.get(F.array(*map(F.lit, WEEKDAYS)), F.weekday(d)) == text(8)), F.unix_date(d).cast("bigint") * DAY_S)).alias("day"),
            F.when((num(4) < 60) & (num(5) < 60), hour * 3600 + num(4) * 60 + num(5)).alias("second"),
            F.when(text(7) == "", default_zone).when(text(7).contains("/"), text(7)).alias("zone"),
            offset.alias("offset"),
        )

    def instant(c: Column) -> Column:
        wall = c["day"] + c["second"]
        return F.coalesce(epoch_seconds(c["ticks"], epoch_unit(c["ticks"])), wall - c["offset"], wall_instant(wall, c["zone"]))

    trimmed = F.regexp_replace(value, r"^\s+|\s+$", "")
    return let(trimmed, lambda v: let(fields(v), lambda f: let(parsed(f), lambda c: let(instant(c), in_range))))


def in_range(utc_s: Column) -> Column:
    """``utc_s`` if it lies in 1990 to 2099, else NULL."""
    return F.when((utc_s >= F.lit(MIN_UTC_S)) & (utc_s < F.lit(MAX_UTC_S)), utc_s)
