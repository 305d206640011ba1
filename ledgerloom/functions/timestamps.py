"""Timestamps in many written forms, as column expressions.

A stamp is taken apart by one anchored pattern per family of forms, rewritten to one canonical field list, and put together
with integer arithmetic, so that the session time zone never plays a part.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the contract's own form, ISO-8601 with offset.
CONTRACT_PATTERN = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})\z"

# Hours from UTC of zone abbreviations.
ABBREVIATION_HOURS = {
    "Z": 0, "UTC": 0, "GMT": 0, "UT": 0,
    "EST": -5, "EDT": -4, "CST": -6, "CDT": -5, "MST": -7, "MDT": -6, "PST": -8, "PDT": -7,
    "AKST": -9, "AKDT": -8, "HST": -10,
}

_OFFSET = r"[+-]\d{2}(?::?\d{2})?"
_ZONE = rf"(?:\s*({_OFFSET}|[A-Za-z]{{1,5}}))?(?:\[([^\]]*)\])?"
_FRACTION = r"(?:[.,](\d+))?"
_CLOCK = rf"(\d{{1,2}}):(\d{{2}})(?::(\d{{2}}){_FRACTION})?(?:\s*([AaPp])\.?[Mm]\.?)?"
_MONTH = r"([A-Za-z]{3})[A-Za-z]*\.?"

# Each family: anchored pattern and its rewriting to
# year|month|day|hour|minute|second|fraction|half of day|zone or offset|zone in brackets|order of numeric dates
_ISO = (rf"^(\d{{4}})[-/](\d{{1,2}})[-/](\d{{1,2}})(?:[Tt ]\s*{_CLOCK}{_ZONE})?$", "$1|$2|$3|$4|$5|$6|$7|$8|$9|$10|")
_BASIC = (rf"^(\d{{4}})(\d{{2}})(\d{{2}})[Tt ](\d{{2}})(\d{{2}})(?:(\d{{2}}){_FRACTION})?{_ZONE}$", "$1|$2|$3|$4|$5|$6|$7||$8|$9|")
_DIGITS_LOCAL = (r"^(\d{4})(\d{2})(\d{2})(\d{2})(\d{2})(\d{2})$", "$1|$2|$3|$4|$5|$6|||||")
_DAY_MONTH = (
    rf"^(?:[A-Za-z]{{3,9}},?\s+)?(\d{{1,2}})[-\s]{_MONTH}[-\s,]+(\d{{4}}|\d{{2}})(?:[T\s,]+{_CLOCK}{_ZONE})?$",
    "$3|$2|$1|$4|$5|$6|$7|$8|$9|$10|",
)
_MONTH_DAY = (
    rf"^(?:[A-Za-z]{{3,9}},?\s+)?{_MONTH}\s+(\d{{1,2}})(?:,\s*|\s+)(\d{{4}}|\d{{2}})(?:[T\s,]+{_CLOCK}{_ZONE})?$",
    "$3|$1|$2|$4|$5|$6|$7|$8|$9|$10|",
)
_NUMERIC = (
    rf"^(\d{{1,2}})([/.-])(\d{{1,2}})\2(\d{{4}}|\d{{2}})(?:[T\s,]+{_CLOCK}{_ZONE})?$",
    "$4|$1|$3|$5|$6|$7|$8|$9|$10|$11|N",
)
FAMILIES = (_ISO, _NUMERIC, _DAY_MONTH, _MONTH_DAY, _BASIC, _DIGITS_LOCAL)
EPOCH_PATTERN = r"^(?:\d{10}|\d{13}|\d{16})$"


def stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"^[\s\u00a0]+|[\s\u00a0]+$", "")


def canonical_fields(stamp: Column) -> Column:
    """array<string> of the eleven canonical fields, null where no family fits."""
    text = F.lit(None).cast("string")
    for pattern, rewriting in reversed(FAMILIES):
        text = F.when(stamp.rlike(pattern), F.regexp_replace(stamp, pattern, rewriting)).otherwise(text)
    return F.split(text, r"\|", -1)


def _number(c: Column) -> Column:
    """'' counts as zero."""
    return F.when(c == "", F.lit(0)).otherwise(c.try_cast("int"))


def month_number(c: Column) -> Column:
    at = F.instr(F.lit("janfebmaraprmayjunjulaugsepoctnovdec"), F.lower(c))
    return F.when(c.rlike(r"^\d+$"), c.try_cast("int")).when((at > 0) & (at % 3 == 1), (at + 2).cast("int") / 3).cast("int")


def local_micros(fields: Column, date_order: Column) -> Column:
    """Microseconds since 1970 of the wall clock that the fields show; null if there is no such date or time."""
    part = [F.get(fields, i) for i in range(11)]
    numeric = part[10] == "N"
    swapped = numeric & (date_order == "DMY")
    year = F.when(F.length(part[0]) == 2, _number(part[0]) + 2000).otherwise(_number(part[0]))
    month = F.when(swapped, _number(part[2])).otherwise(month_number(part[1]))
    day = F.when(swapped, _number(part[1])).otherwise(_number(part[2]))
    hour, minute, second = (_number(p) for p in part[3:6])
    half = F.lower(part[7])
    hour = F.when(half == "", F.when(hour.between(0, 23), hour)).when(hour.between(1, 12), hour % 12 + F.when(half == "p", 12).otherwise(0))
    zero = F.lit(0)
    date = F.try_make_timestamp_ntz(year, month, day, zero, zero, zero).cast("date")
    known_order = ~numeric | date_order.isin("MDY", "DMY")
    ok = minute.between(0, 59) & second.between(0, 59) & known_order & year.between(1, 9999)
    seconds = F.unix_date(date).cast("long") * 86400 + hour * 3600 + minute * 60 + second
    fraction = F.substring(F.rpad(part[6], 6, "0"), 1, 6).try_cast("long")
    return F.when(ok, seconds * 1_000_000 + fraction)


def written_offset(fields: Column) -> Column:
    """Seconds east of UTC that the stamp names itself, by figures or by abbreviation; null if it names none."""
    zone = F.upper(F.get(fields, 8))
    sign = F.when(F.substring(zone, 1, 1) == "-", -1).otherwise(1)
    digits = F.rpad(F.regexp_replace(zone, "[^0-9]", ""), 4, "0")
    hours, minutes = F.substring(digits, 1, 2).try_cast("int"), F.substring(digits, 3, 2).try_cast("int")
    by_figures = F.when((hours <= 18) & (minutes <= 59), sign * (hours * 3600 + minutes * 60))
    table = F.create_map(*[F.lit(x) for kv in ABBREVIATION_HOURS.items() for x in kv])
    return F.when(zone.rlike(r"^[+-]"), by_figures).when(zone != "", F.try_element_at(table, zone) * 3600).cast("long")


def bracketed_zone(stamp: Column) -> Column:
    """The zone name in brackets at a stamp's end; '' if there is none."""
    return F.regexp_extract(stamp, r"\[([^\]]*)\]\s*$", 1)


def names_zone(fields: Column) -> Column:
    return F.get(fields, 8) != ""


def epoch_micros(stamp: Column) -> Column:
    """10, 13 or 16 digits are seconds, milliseconds or microseconds since 1970."""
    value = stamp.try_cast("long")
    return F.when(stamp.rlike(EPOCH_PATTERN), F.when(F.length(stamp) == 10, value * 1_000_000).when(F.length(stamp) == 13, value * 1000).otherwise(value))


def conforms(stamp: Column) -> Column:
    """Whether a stamp is written in the contract's form; null counts as not."""
    return F.coalesce(stamp.rlike(CONTRACT_PATTERN), F.lit(False))


def contract_micros(stamp: Column) -> Column:
    """The instant of a stamp in the contract's form only; naive or malformed stamps, and dates that don't exist, give null.

    The form is what the engine's own cast reads, so nothing is taken apart; digits past microseconds are dropped.
    """
    return F.when(conforms(stamp) & ~stamp.startswith("0000"), F.unix_micros(stamp.try_cast("timestamp")))
