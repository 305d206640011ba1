"""Scalar expressions: safe parsing, rendering, version order, buckets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Identifier pattern, tokens, event types and coverage states of the contract.
ID_PATTERN = r"\A[A-Za-z0-9._-]{1,128}\z"
ORGS = ("CPL", "TRI", "NDX")
PAYERS = ("AET", "UHC", "HUM", "BCB", "CIG", "MCR", "MCD", "SELF", "")
EVENT_TYPES = (
    "SUBMITTED", "CORRECTED", "PAYMENT_POSTED", "PAYMENT_REVERSED", "VOID_VERSION",
    "CLOSED_NO_PAYMENT", "REOPENED", "ADJUSTMENT", "STATUS_UPDATED", "UNKNOWN",
)
COVERAGE = ("complete", "partial", "unknown")
PAYER_CATEGORY = {
    "AET": "commercial", "UHC": "commercial", "HUM": "commercial", "BCB": "commercial", "CIG": "commercial",
    "MCR": "government", "MCD": "government", "SELF": "self",
}


def safe_long(c: Column) -> Column:
    """Whole number in trimmed text; null otherwise."""
    return F.trim(c.cast("string")).try_cast("long")


def utc_text(us: Column) -> Column:
    """Microseconds as UTC text to the second with offset, as in 2024-01-02T03:04:05+00:00."""
    return F.concat(F.date_format(F.timestamp_micros(us), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00"))


def day_stamp(us: Column) -> Column:
    return F.date_format(F.timestamp_micros(us), "yyyyMMdd")


def version_order(version: Column) -> list[Column]:
    """Sort columns: numbers first and ascending, then text. A 'v' before digits is no text."""
    number = F.regexp_extract(version, r"\A[vV]?([0-9]{1,18})\z", 1).try_cast("long")
    return [number.isNull(), number, version]


def payer_category(c: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in PAYER_CATEGORY.items() for x in kv])
    return F.coalesce(F.try_element_at(table, c), F.lit("unknown"))


def age_bucket(days: Column) -> Column:
    return F.when(days < 15, "under_15").when(days < 45, "15_to_44").otherwise("45_and_over")


def lineage_id(root: Column) -> Column:
    return F.concat(F.lit("run-"), F.substring(root, 1, 8), F.lit("-"), root)


def six_places(c: Column) -> Column:
    return F.format_string("%.6f", c)


def floored_log(p: Column) -> Column:
    return F.ln(F.greatest(p, F.lit(1e-12)))
