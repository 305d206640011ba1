"""Contract rows: typed normalisation, isolation of invalid rows, findings, as-of truncation.

Invalid rows are never dropped or repaired: every function returns all rows with a flag, and `split` parts them.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.scalars import COVERAGE, EVENT_TYPES, ID_PATTERN, ORGS, PAYERS, safe_long
from ledgerloom.functions.timestamps import CONTRACT_PATTERN, contract_micros


def instant(df: DataFrame, name: str) -> Column:
    """Microseconds of a column that is contract text or already a timestamp; naive text gives null."""
    return contract_micros(F.trim(F.col(name))) if df.schema[name].dataType.simpleString() == "string" else F.unix_micros(name)


def _is(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def bills(raw: DataFrame) -> DataFrame:
    """Adds submitted_us, available_us, amount and is_valid: both times parse, amount above 0, currency USD."""
    out = raw.withColumns({"submitted_us": instant(raw, "submitted_at"), "available_us": instant(raw, "available_at"), "amount": safe_long(F.col("billed_amount_minor"))})
    return out.withColumn("is_valid", _is(F.col("submitted_us").isNotNull() & F.col("available_us").isNotNull() & (F.col("amount") > 0) & (F.col("currency") == "USD")))


def events(raw: DataFrame) -> DataFrame:
    """Adds event_us, available_us, amount and is_valid: both times parse, amount null or at least 0. Text that is no number is null."""
    out = raw.withColumns({"event_us": instant(raw, "event_at"), "available_us": instant(raw, "available_at"), "amount": safe_long(F.col("amount_minor"))})
    return out.withColumn("is_valid", _is(F.col("event_us").isNotNull() & F.col("available_us").isNotNull() & (F.coalesce("amount", F.lit(0)) >= 0)))


def allocations(raw: DataFrame) -> DataFrame:
    """Adds available_us, amount and is_valid: time parses, amount above 0, currency USD."""
    out = raw.withColumns({"available_us": instant(raw, "available_at"), "amount": safe_long(F.col("allocated_amount_minor"))})
    return out.withColumn("is_valid", _is(F.col("available_us").isNotNull() & (F.col("amount") > 0) & (F.col("currency") == "USD")))


def windows(raw: DataFrame) -> DataFrame:
    """Adds start_us, end_us, extracted_us and is_valid: all times parse and the end isn't before the start."""
    out = raw.withColumns({"start_us": instant(raw, "coverage_start"), "end_us": instant(raw, "coverage_end"), "extracted_us": instant(raw, "extracted_at")})
    return out.withColumn("is_valid", _is((F.col("end_us") >= F.col("start_us")) & F.col("extracted_us").isNotNull()))


def split(normalised: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid rows, isolated rows)."""
    return normalised.where("is_valid").drop("is_valid"), normalised.where("not is_valid")


def as_of(rows: DataFrame, cutoff_us: int | None, known: str = "available_us") -> DataFrame:
    """Rows known by the cutoff; all rows without one."""
    return rows if cutoff_us is None else rows.where(F.col(known) <= cutoff_us)


def _hit(bad: Column, name: str, problem: str, severity: str = "ERROR") -> Column:
    return F.when(F.coalesce(bad, F.lit(True)), F.struct(F.lit(name).alias("field"), F.lit(problem).alias("problem"), F.lit(severity).alias("severity")))


def _id(name: str) -> Column:
    return _hit(~F.col(name).rlike(ID_PATTERN), name, "bad identifier")


def _time(df: DataFrame, name: str) -> Column:
    bad = ~F.col(name).rlike(CONTRACT_PATTERN) if df.schema[name].dataType.simpleString() == "string" else F.col(name).isNull()
    return _hit(bad, name, "not ISO-8601 with offset")


def _org(extra: Iterable[str]) -> Column:
    return _hit(~F.col("org_token").isin(*ORGS, *extra), "org_token", "unknown organisation")


def _amount(name: str, least: int, required: bool) -> Column:
    value = safe_long(F.col(name))
    text = F.coalesce(F.col(name).cast("string"), F.lit(""))
    bad = F.coalesce(value < least, F.lit(True))
    return _hit(bad if required else (text != "") & bad, name, f"not a whole number of at least {least}")


def findings(raw: DataFrame, table: str, ref: str, extra_orgs: Iterable[str] = (), extra_payers: Iterable[str] = ()) -> DataFrame:
    """ref, field, problem, severity: one row per broken rule of a row of bills, events, allocations or windows.

    A row is valid if it has no ERROR. Null and '' both count as missing.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) == ""
    if table == "bills":
        early = F.when(instant(raw, "available_at") < instant(raw, "submitted_at"), F.struct(F.lit("available_at").alias("field"), F.lit("known before it was submitted").alias("problem"), F.lit("WARNING").alias("severity")))
        rules = [_id("record_id"), _org(extra_orgs), _id("bill_id"), _id("version_id"), _hit(~F.coalesce("payer_token", F.lit("")).isin(*PAYERS, *extra_payers), "payer_token", "unknown payer"),
                 _amount("billed_amount_minor", 1, True), _hit(F.col("currency") != "USD", "currency", "not USD"), _time(raw, "submitted_at"), _time(raw, "available_at"), early]
    elif table == "events":
        unknown = F.when(F.col("event_type") == "UNKNOWN", F.struct(F.lit("event_type").alias("field"), F.lit("unmapped code").alias("problem"), F.lit("WARNING").alias("severity")))
        rules = [_id("event_id"), _org(extra_orgs), _hit(~F.col("event_type").isin(*EVENT_TYPES), "event_type", "unknown type"), unknown, _time(raw, "event_at"), _time(raw, "available_at"),
                 _amount("amount_minor", 0, False), _hit(~blank("amount_minor") & blank("currency"), "currency", "amount without currency"),
                 _hit(~blank("reverses_event_id") & ~F.coalesce(F.col("reverses_event_id").rlike(ID_PATTERN), F.lit(False)), "reverses_event_id", "bad identifier"),
                 _hit(~F.col("terminal_flag").isin("true", "false", "True", "False"), "terminal_flag", "not a boolean")]
    elif table == "allocations":
        rules = [_id("allocation_id"), _id("payment_event_id"), _id("bill_record_id"), _amount("allocated_amount_minor", 1, True), _hit(F.col("currency") != "USD", "currency", "not USD"), _time(raw, "available_at")]
    elif table == "windows":
        rules = [_id("window_id"), _org(extra_orgs), _time(raw, "coverage_start"), _time(raw, "coverage_end"), _time(raw, "extracted_at"),
                 _hit(instant(raw, "coverage_end") < instant(raw, "coverage_start"), "coverage_end", "ends before it starts"), _hit(~F.col("coverage_status").isin(*COVERAGE), "coverage_status", "unknown status")]
    else:
        raise ValueError(f"no rules for {table}")
    return raw.select(F.col(ref).cast("string").alias("row_ref"), F.explode(F.array_compact(F.array(*rules))).alias("_ll_hit")).select("row_ref", "_ll_hit.*")


def extra_tokens(raw: DataFrame, column: str, known: Iterable[str]) -> DataFrame:
    """Distinct non-empty tokens beyond the known ones."""
    return raw.select(F.col(column).alias("token")).where(F.col("token").isNotNull() & ~F.col("token").isin("", *known)).distinct()
