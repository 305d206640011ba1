"""Linked records to lineages: roots, members and their summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.scalars import lineage_id, payer_category
from ledgerloom.operators import ancestry
from ledgerloom.session import cut


def parents_of(links: DataFrame) -> DataFrame:
    """record_id, parent_id: of several predecessors that of the weakest rule counts, as the link made last; ties by id."""
    last = links.groupBy(F.col("right_id").alias("record_id")).agg(F.max(F.struct("rule", "left_id")).alias("l"))
    return last.select("record_id", F.col("l.left_id").alias("parent_id"))


def roots(records: DataFrame, links: DataFrame) -> DataFrame:
    """record_id, root_id for every record.

    A record on a cycle is its own root; one whose way up runs into a cycle has the record where it enters as root.
    """
    known = records.select("record_id").distinct()
    linked = parents_of(links).join(known, "record_id", "left_semi").join(known.select(F.col("record_id").alias("parent_id")), "parent_id", "left_semi")
    tree = ancestry.forest(cut(linked.select(F.col("record_id").alias("node"), F.col("parent_id").alias("parent"))))
    return known.join(tree.select(F.col("node").alias("record_id"), "root"), "record_id", "left").select("record_id", F.coalesce("root", "record_id").alias("root_id"))


def complete_coverage(windows: DataFrame) -> DataFrame:
    """org_token, coverage_end_us: the complete window that was extracted last."""
    last = windows.where("coverage_status = 'complete'").groupBy("org_token").agg(F.max(F.struct("extracted_us", "window_id", "end_us")).alias("w"))
    return last.select("org_token", F.col("w.end_us").alias("coverage_end_us"))


def summarise(bills: DataFrame, root_of: DataFrame, events: DataFrame, windows: DataFrame) -> DataFrame:
    """One row per lineage: members in order, organisation, payer category, latest amount, status and coverage."""
    members = bills.join(root_of, "record_id")
    rank = F.struct(F.col("submitted_us"), (-F.col("available_us")).alias("m"), F.col("amount"))
    payer = F.min(F.when(F.col("payer_token") != "", F.col("payer_token")))
    base = members.groupBy("root_id").agg(F.array_sort(F.collect_set("record_id")).alias("record_ids"), F.min("org_token").alias("org_token"), payer_category(payer).alias("payer_category"), F.max(rank)["amount"].alias("amount"))
    closed = events.where("event_type = 'CLOSED_NO_PAYMENT'").select(F.col("bill_record_id").alias("record_id")).join(root_of, "record_id").select("root_id").distinct().withColumn("_closed", F.lit(True))
    out = base.join(closed, "root_id", "left").join(F.broadcast(complete_coverage(windows)), "org_token", "left")  # one row per organisation
    status = F.when(F.col("_closed"), "CLOSED_NO_PAYMENT").otherwise("OPEN")
    coverage = F.when(F.col("coverage_end_us").isNotNull(), "complete").otherwise("unknown")
    return out.select(lineage_id(F.col("root_id")).alias("lineage_id"), "root_id", "record_ids", "org_token", status.alias("status"), "payer_category", "amount", coverage.alias("coverage_status"), "coverage_end_us")


def paid_status(status: Column, gross: Column) -> Column:
    """The status of a lineage once its money is known: payments make an open one paid, a closed one reopened."""
    paid = F.coalesce(gross > 0, F.lit(False))
    return F.when(paid & (status == "OPEN"), "PAYMENT_OBSERVED").when(paid & (status == "CLOSED_NO_PAYMENT"), "REOPENED_OR_POST_CLOSE_PAYMENT").otherwise(status)


def notes(*parts: DataFrame) -> DataFrame:
    """kind, record_ids of all parts, each note once."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.distinct()


def touch_counts(record_ids: DataFrame, root_of: DataFrame) -> DataFrame:
    """root_id, n: notes (note_id, record_id) that touch a lineage, each once."""
    return record_ids.join(root_of, "record_id").groupBy("root_id").agg(F.countDistinct("note_id").alias("n"))


def bridge(lineages: DataFrame) -> DataFrame:
    """lineage_id, record_id: lists spread to rows."""
    return lineages.select("lineage_id", F.explode("record_ids").alias("record_id"))
