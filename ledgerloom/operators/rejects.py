"""Rows that fail to parse, separated with the reason, by patterns generated from a schema.

A raw record is held against one anchored pattern for its whole row, value rules included. What fails goes through patterns of
one more field each: the first prefix that doesn't fit names the first broken field, and with it the reason; where values are
wrong the search goes on behind that field, so that every reason comes out. Every pattern uses possessive repeats, so
that matching takes linear time and constant stack on records of any length.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.session import fresh

_BARE, _QUOTED = r'[^",\r\n]*+', r'"[^"]*+(?:""[^"]*+)*+"'
FIELD = rf"(?:{_QUOTED}|{_BARE})"

#: Value rules: what a whole value must look like, and the reason if it doesn't.
AMOUNT = (r"(?=[0-9]{1,18}(?![0-9]))0*+[1-9][0-9]*+", "bad_amount")
CURRENCY = (r"USD", "bad_currency")
FLAG = (r"(?:true|false|True|False)", "bad_flag")


@dataclass(frozen=True)
class RowSchema:
    """Columns of a feed in order, and the value rule of those that have one."""

    columns: Sequence[str]
    rules: Mapping[str, tuple[str, str]] = field(default_factory=dict)


BILLS = RowSchema(
    "record_id org_token source_system bill_id version_id previous_record_id payer_token service_token billed_amount_minor currency submitted_at available_at source_ref".split(),
    {"billed_amount_minor": AMOUNT, "currency": CURRENCY},
)
EVENTS = RowSchema(
    "event_id org_token source_system bill_record_id event_type event_at available_at amount_minor currency reverses_event_id terminal_flag source_ref".split(),
    {"terminal_flag": FLAG},
)
ALLOCATIONS = RowSchema(
    "allocation_id payment_event_id bill_record_id allocated_amount_minor currency available_at source_ref".split(),
    {"allocated_amount_minor": AMOUNT},
)
FEEDS = {"bills": BILLS, "events": EVENTS, "allocations": ALLOCATIONS}


def _value(rule: str) -> str:
    return rf'(?:{rule}|"{rule}")'


def whole_row(schema: RowSchema) -> str:
    """The anchored pattern of a good record."""
    parts = [_value(schema.rules[c][0]) if c in schema.rules else FIELD for c in schema.columns]
    return r"\A" + ",".join(parts) + r"\z"


def shape(n: int) -> str:
    """Exactly n well-formed fields, whatever they hold."""
    return rf"\A{FIELD}" + (rf"(?:,{FIELD}){{{n - 1}}}" if n > 1 else "") + r"\z"


def prefix(schema: RowSchema, k: int, ruled: Sequence[str] = ()) -> str:
    """The first k fields up to a comma or the end; those named in `ruled` with their value rules."""
    parts = [_value(schema.rules[c][0]) if c in ruled else FIELD for c in schema.columns[:k]]
    return r"\A" + ",".join(parts) + r"(?:,|\z)"


WELL_FORMED = rf"\A{FIELD}(?:,{FIELD})*+\z"


def record(raw: Column) -> Column:
    """The record without the one CR that isn't part of it; null is an empty record."""
    return F.regexp_replace(F.coalesce(raw, F.lit("")), r"\r\z", "")


def _broken_shape(text: Column, schema: RowSchema) -> Column:
    """struct<n, reason>: the first field at which the record stops being well formed, found by prefixes of one more field each.

    A record that ends before the field lacks columns; else the field itself is malformed. n is one past the columns, without
    reason, for a whole record of the right count; what goes on behind the last column has too many, or is malformed there.
    """
    columns, chain = schema.columns, None
    of = lambda n, reason: F.struct(F.lit(n).alias("n"), F.lit(reason).cast("string").alias("reason"))
    for k in range(1, len(columns) + 1):
        short = F.when(text.rlike(shape(k - 1)), of(k, "column_count")).otherwise(of(k, "quoting")) if k > 1 else of(k, "quoting")
        fails = ~text.rlike(prefix(schema, k))
        chain = F.when(fails, short) if chain is None else chain.when(fails, short)
    n = len(columns) + 1
    return chain.when(text.rlike(shape(len(columns))), of(n, None)).when(text.rlike(WELL_FORMED), of(n, "column_count")).otherwise(of(n, "quoting"))


def _broken_values(text: Column, schema: RowSchema) -> Column:
    """array<struct<n, reason>>: the fields of a well-formed record that break their value rule, in order.

    Each ruled column has the prefix that ends with it. The first one that doesn't fit is the first broken field; the search then
    goes on behind it, with that field set free, until the record ends.
    """
    found = []
    for c, (_, reason) in sorted(schema.rules.items(), key=lambda x: schema.columns.index(x[0])):
        n = schema.columns.index(c) + 1
        found.append(F.when(~text.rlike(prefix(schema, n, (c,))), F.struct(F.lit(n).alias("n"), F.lit(reason).alias("reason"))))
    return F.array_compact(F.array(*found)) if found else F.array().cast("array<struct<n:int,reason:string>>")


def check_records(df: DataFrame, raw: str = "raw", feed: str = "feed", feeds: Mapping[str, RowSchema] = FEEDS) -> DataFrame:
    """Adds reasons (array of strings, empty for a good record) and broken_field (name of the first broken column, null if none).

    Reasons: 'quoting' alone, else 'column_count' alone, else every value reason that applies. broken_field is '' when a record
    has fields past its last column. Records of an unknown or null feed have the reason 'unknown_feed'. Repeated rows stay
    repeated; columns named reasons or broken_field are replaced.
    """
    text, bad = fresh(df, "_ll_text"), fresh(df, "_ll_bad")
    out = df.withColumn(text, record(F.col(raw)))
    record_text, broken, known = F.col(text), F.lit(None).cast("array<struct<n:int,reason:string>>"), F.coalesce(F.col(feed).isin(*feeds), F.lit(False))
    for name, schema in feeds.items():
        shaped = _broken_shape(record_text, schema)
        fields = F.when(record_text.rlike(whole_row(schema)), F.array().cast("array<struct<n:int,reason:string>>")).when(record_text.rlike(shape(len(schema.columns))), _broken_values(record_text, schema)).otherwise(F.array(shaped))
        broken = F.when(F.col(feed) == name, fields).otherwise(broken)
    out = out.withColumn(bad, broken)
    names = F.create_map(*[x for name, schema in feeds.items() for x in (F.lit(name), F.array(*map(F.lit, schema.columns), F.lit("")))])
    first = F.get(F.col(bad), F.lit(0))["n"]
    reasons = F.when(known, F.array_distinct(F.transform(bad, lambda b: b["reason"]))).otherwise(F.array(F.lit("unknown_feed")))
    return out.withColumns({"reasons": reasons, "broken_field": F.when(known, F.get(F.try_element_at(names, F.col(feed)), first - 1))}).drop(text, bad)


def load_records(checked: DataFrame, feed_name: str, raw: str = "raw", feed: str = "feed", feeds: Mapping[str, RowSchema] = FEEDS) -> DataFrame:
    """The good records of one feed as columns (all strings, '' is null), beside no others of the input."""
    schema = feeds[feed_name]
    ddl = ", ".join(f"`{c}` string" for c in schema.columns)
    options = {"sep": ",", "quote": '"', "escape": '"', "multiLine": "true", "emptyValue": "", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false", "maxCharsPerColumn": "-1"}
    good = checked.where((F.col(feed) == feed_name) & (F.size("reasons") == 0))
    parsed = good.select(F.from_csv(record(F.col(raw)), ddl, options).alias("_ll_r")).select("_ll_r.*")
    return parsed.select(*[F.when(F.col(c) != "", F.col(c)).alias(c) for c in schema.columns])


def check_columns(df: DataFrame, rules: Mapping[str, tuple[str, str]]) -> DataFrame:
    """Adds reasons to rows that are already columns; null counts as invalid. The same value rules as for raw records."""
    found = [F.when(~F.coalesce(F.col(c).rlike(rf"\A{rule}\z"), F.lit(False)), F.lit(reason)) for c, (rule, reason) in rules.items()]
    return df.withColumn("reasons", F.array_distinct(F.array_compact(F.array(*found))))


def split_rows(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows that load, rows set aside with their reasons)."""
    return checked.where(F.size("reasons") == 0).drop("reasons"), checked.where(F.size("reasons") > 0)
