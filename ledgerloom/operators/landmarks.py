"""Landmark snapshots: features known at a landmark, the first outcome after it, and rows per interval at risk."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DAY_US = 86_400_000_000
PAID, CLOSED = "PAYMENT_POSTED", "CLOSED_NO_PAYMENT"


def effective_times(events: DataFrame, allocations: DataFrame, owner_of: DataFrame) -> DataFrame:
    """owner, event_id, event_type, amount, at_us: every event at each owner from when it could be known there.

    An event belongs to the owner of its own bill, else to all owners that its allocations name. A payment is known to an owner
    no sooner than that owner's first allocation of it. owner_of maps record_id to owner.
    """
    given = allocations.select(F.col("payment_event_id").alias("event_id"), F.col("bill_record_id").alias("record_id"), F.col("available_us").alias("given_us"))
    given = given.join(owner_of, "record_id").groupBy("event_id", "owner").agg(F.min("given_us").alias("given_us"))
    rows = events.select("event_id", F.col("bill_record_id").alias("record_id"), "event_type", "amount", "available_us")
    direct = rows.join(owner_of, "record_id").select("event_id", "event_type", "amount", "available_us", "owner")
    loose = rows.join(owner_of.select("record_id"), "record_id", "left_anti").drop("record_id")
    through = loose.join(given.select("event_id", "owner"), "event_id")
    both = direct.unionByName(through).join(given, ["event_id", "owner"], "left")
    at = F.when(F.col("event_type") == PAID, F.greatest("available_us", F.coalesce("given_us", "available_us"))).otherwise(F.col("available_us"))
    return both.select("owner", "event_id", "event_type", "amount", at.alias("at_us"))


def snapshots(timed: DataFrame, owners: DataFrame, landmark_us: int = 7 * DAY_US, horizon_us: int = 30 * DAY_US, interval_us: int = 5 * DAY_US, as_of_us: int | None = None) -> DataFrame:
    """One row per owner with a submission and no outcome by its landmark (first submission + landmark_us).

    owners: owner, coverage_status, coverage_end_us and any attributes to carry. Outcome: payment, close_no_payment (the first in
    [t, t + horizon), a payment before a close at one instant), still_open if coverage is complete to the horizon, else censored.
    One pass over the events: everything is summed up per owner, so an owner's events never meet in one task.
    """
    n = max(1, horizon_us // interval_us)
    first = timed.where("event_type = 'SUBMITTED'").groupBy("owner").agg((F.min("at_us") + landmark_us).alias("t_us"))
    if as_of_us is not None:
        first = first.where(F.col("t_us") <= as_of_us)
    rows = timed.join(first, "owner")
    known = F.col("at_us") <= F.col("t_us")
    pays = (F.col("event_type") == PAID) & (F.col("amount") > 0)
    outcome = pays | (F.col("event_type") == CLOSED)
    ahead = ~known & outcome & (F.col("at_us") < F.col("t_us") + horizon_us)
    kinds = {"n_corrected": "CORRECTED", "n_voids": "VOID_VERSION", "n_payments": PAID, "n_unknown": "UNKNOWN", "n_status": "STATUS_UPDATED", "n_closes": CLOSED, "n_reopens": "REOPENED"}
    counts = [F.count_if(known & (F.col("event_type") == k)).alias(c) for c, k in kinds.items()]
    event = F.struct("at_us", F.when(pays, 0).otherwise(1).alias("order"), "event_id")
    per = rows.groupBy("owner", "t_us").agg(F.coalesce(F.bool_or(known & outcome), F.lit(False)).alias("decided"), F.max(F.when(known, F.col("at_us"))).alias("max_input_us"), F.min(F.when(ahead, event)).alias("first"), *counts)
    out = per.where("not decided").join(owners, "owner")
    seen = (F.col("coverage_status") == "complete") & (F.col("coverage_end_us") >= F.col("t_us") + horizon_us)
    label = F.when(F.col("first.order") == 0, "payment").when(F.col("first.order") == 1, "close_no_payment").when(seen, "still_open").otherwise("censored")
    number = F.floor((F.col("first.at_us") - F.col("t_us")) / F.lit(interval_us))
    interval = F.when(F.col("first").isNotNull(), F.least(F.greatest(number, F.lit(0)), F.lit(n - 1)).cast("int"))
    return out.withColumns({"outcome": label, "outcome_interval": interval}).drop("first", "decided")


def interval_rows(snaps: DataFrame, n_intervals: int = 6) -> DataFrame:
    """A row per snapshot and interval up to its outcome; the last has the label. Censored snapshots have none."""
    known = snaps.where("outcome <> 'censored'")
    rows = known.withColumn("interval", F.explode(F.sequence(F.lit(0), F.coalesce("outcome_interval", F.lit(n_intervals - 1)))))
    return rows.withColumn("label", F.when(F.col("interval") == F.col("outcome_interval"), F.col("outcome")).otherwise("none"))


def temporal_split(snaps: DataFrame, train: float = 0.6, middle: float = 0.2) -> DataFrame:
    """owner, part: owners in order of time; the first 60 % train, the last 20 % test, none in both.

    Ranks are made from counts per day and ranks within a day, so no task orders all owners.
    """
    starts = snaps.groupBy("owner").agg(F.min("t_us").alias("t_us")).withColumn("day", F.floor(F.col("t_us") / F.lit(DAY_US)))
    days = starts.groupBy("day").agg(F.count(F.lit(1)).alias("n"))
    total = days.agg(F.sum("n")).first()[0] or 0
    days = days.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    rank = F.row_number().over(Window.partitionBy("day").orderBy("t_us", "owner"))
    ranked = starts.withColumn("_ll_r", rank).join(days, "day").withColumn("rank", F.col("before") + F.col("_ll_r") - 1)
    first, last = int(total * train), int(total * (train + middle))
    return ranked.select("owner", F.when(F.col("rank") < first, "train").when(F.col("rank") < last, "middle").otherwise("test").alias("part"))
