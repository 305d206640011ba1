"""One run from contract tables to its outputs and an audit of row counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.scalars import utc_text
from ledgerloom.functions.timestamps import contract_micros
from ledgerloom.operators import normalize
from ledgerloom.plans import reconstruction as rc
from ledgerloom.session import cut_counted, drop_cuts
from ledgerloom.sources import files

TABLES = {"bills": normalize.bills, "billing_events": normalize.events, "allocations": normalize.allocations, "observation_windows": normalize.windows}
#: Columns of outcomes, and of truth, that no feature table may hold.
FORBIDDEN = ("outcome", "outcome_interval", "label", "true_lineage_id", "first_payment_at", "close_at", "same_lineage", "adjudication_status")


def cutoff_of(as_of: str | None) -> int | None:
    """Microseconds of an as-of stamp with offset; None stands for none. A naive or malformed stamp is an error."""
    if not as_of:
        return None
    spark = SparkSession.active()
    found = spark.range(1).select(contract_micros(F.lit(as_of)).alias("us")).first()["us"]
    if found is None:
        raise ValueError(f"not ISO-8601 with offset: {as_of}")
    return found


def guard_features(features: DataFrame, forbidden: tuple[str, ...] = FORBIDDEN) -> DataFrame:
    """features as they are; an error if a column would tell a model what it shall predict."""
    told = sorted({c.lower() for c in features.columns} & set(forbidden))
    if told:
        raise ValueError(f"features hold what they may not know: {', '.join(told)}")
    return features


def truncated(spark: SparkSession, folder: str, out: str, as_of: str | None) -> dict[str, dict[str, int]]:
    """The input tables as known at the cutoff, written as Parquet under `out`; windows are not cut. Raw, valid and kept row counts of each."""
    cutoff, counts = cutoff_of(as_of), {}
    for name, normalise in TABLES.items():
        raw = files.read_table(spark, folder, name)
        rows = normalise(raw)
        kept = rows if name == "observation_windows" or cutoff is None else rows.where(F.coalesce(F.col("available_us") <= cutoff, F.lit(True)))
        facts = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if("is_valid").alias("valid")).first()
        kept.select(*raw.columns).write.mode("overwrite").parquet(f"{out}/{name}.parquet")
        counts[name] = {"raw": facts["n"], "valid": facts["valid"], "invalid": facts["n"] - facts["valid"], "known": spark.read.parquet(f"{out}/{name}.parquet").count()}
    return counts


def run(spark: SparkSession, folder: str, out: str, run_id: str, as_of: str | None = None) -> dict:
    """Writes lineages, links, conflicts, review_queue, events_normalized and allocations_normalized as CSV under `out`, and audit.json; returns the audit.

    Rows that became known after as_of count for nothing. Invalid rows stay in the input tables and are counted, never repaired.
    """
    stage = f"{out}/input"
    audit: dict = {"run_id": run_id, "as_of": as_of or "", "tables": truncated(spark, folder, stage, as_of)}
    known = rc.linked(spark, stage)
    summary = rc.lineage_summary(spark, stage, known)
    money = rc.lineage_amounts(spark, stage, known).withColumnRenamed("owner", "root_id").select("root_id", F.col("gross").alias("gross_posted"), "reversed", F.col("net").alias("net_observed_posted"), "unallocated")
    notes = rc.lineage_notes(spark, stage, known).select("root_id", F.col("n_conflicts").alias("conflict_count"), F.col("n_reviews").alias("review_count"))
    lineages = summary.drop("status").join(rc.lineage_status(spark, stage, known), "root_id").join(notes, "root_id", "left").join(money, "root_id", "left")
    lineages = lineages.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("conflict_count", "review_count", "gross_posted", "reversed", "net_observed_posted", "unallocated")})
    lineages = lineages.select("lineage_id", "record_ids", "org_token", "status", "payer_category", F.col("amount").alias("billed_amount_minor"), "conflict_count", "review_count", "coverage_status", utc_text(F.col("coverage_end_us")).alias("coverage_end"), "gross_posted", "reversed", "net_observed_posted", "unallocated")
    links = known.links.where("verdict = 'accepted'").select(F.col("left_id").alias("left_record_id"), F.col("right_id").alias("right_record_id"), F.lit("accepted").alias("decision"), F.col("rule").alias("rule_ids"), F.when(F.col("is_late_parent"), "predecessor submitted later").otherwise("").alias("reason"))
    events = rc._events(spark, stage).select("event_id", "org_token", "source_system", "bill_record_id", "event_type", utc_text(F.col("event_us")).alias("event_at"), utc_text(F.col("available_us")).alias("available_at"), "amount", "currency", "reverses_event_id")
    allocations = rc._allocations(spark, stage).select("allocation_id", "payment_event_id", "bill_record_id", "amount", "currency", utc_text(F.col("available_us")).alias("available_at"))
    outputs = {"lineages": lineages, "links": links, "conflicts": rc.conflicts(spark, stage, known), "review_queue": rc.review_queue(spark, stage, known), "events_normalized": events, "allocations_normalized": allocations}
    audit["outputs"] = {}
    for name, rows in outputs.items():
        kept, audit["outputs"][name] = cut_counted(rows.select(F.lit(run_id).alias("run_id"), "*"))
        files.write_csv(kept, f"{out}/{name}.csv")
    files.write_json(audit, f"{out}/audit.json")
    drop_cuts(spark)
    return audit
