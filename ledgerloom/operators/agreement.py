"""Agreement of proposed pairs with known pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.linkage import next_in_group

PAIR = ("left_id", "right_id")


def agreement(proposed: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: n_proposed, n_truth, n_hit, precision and recall in millionths (null where undefined). Pairs count once."""
    a = proposed.select(*PAIR).distinct().withColumn("_p", F.lit(1))
    b = truth.select(*PAIR).distinct().withColumn("_t", F.lit(1))
    counts = a.join(b, list(PAIR), "full").agg(F.count("_p").alias("n_proposed"), F.count("_t").alias("n_truth"), F.count_if(F.col("_p").isNotNull() & F.col("_t").isNotNull()).alias("n_hit"))
    part = lambda c: F.when(F.col(c) > 0, F.floor(F.col("n_hit") * 1_000_000 / F.col(c)).cast("long"))
    return counts.withColumns({"precision_millionths": part("n_proposed"), "recall_millionths": part("n_truth")})


def submission_neighbours(bills: DataFrame) -> DataFrame:
    """Baseline: each bill with the next of its organisation by time. Days are put in order first, then rows within days."""
    day = F.floor(F.col("submitted_us") / F.lit(86_400_000_000)).cast("long")
    rows = bills.select("org_token", "record_id", "submitted_us", day.alias("_ll_day"))
    out = next_in_group(rows, ["org_token"], "_ll_day", [F.col("submitted_us"), F.col("record_id")], "record_id")
    return out.where("next_value is not null").select(F.col("record_id").alias("left_id"), F.col("next_value").alias("right_id"))


def adjacent_versions(bills: DataFrame) -> DataFrame:
    """Known pairs by bill number within an organisation, whatever the source system."""
    number = F.coalesce(F.regexp_extract("version_id", r"\A[vV]?([0-9]{1,18})\z", 1).try_cast("long"), F.lit(0))
    rows = bills.select("org_token", "bill_id", "record_id", number.alias("_ll_v")).withColumn("_ll_chunk", F.floor(F.col("_ll_v") / 64).cast("long"))
    out = next_in_group(rows, ["org_token", "bill_id"], "_ll_chunk", [F.col("_ll_v"), F.col("record_id")], "record_id")
    return out.where("next_value is not null").select(F.col("record_id").alias("left_id"), F.col("next_value").alias("right_id"))


def confirmed_labels(labels: DataFrame) -> DataFrame:
    """Pairs that reviewers confirmed to be of one lineage; a missing adjudication_status column counts as confirmed."""
    state = F.lower(F.trim("adjudication_status")) == "confirmed" if "adjudication_status" in labels.columns else F.lit(True)
    return labels.where((F.lower(F.trim("same_lineage")) == "true") & state).select(F.col("left_record_id").alias("left_id"), F.col("right_record_id").alias("right_id"))


def share_truth(pairs: DataFrame, lineage_of: DataFrame) -> DataFrame:
    """Pairs whose two records have the same true lineage (record_id, true_lineage_id)."""
    left = lineage_of.select(F.col("record_id").alias("left_id"), F.col("true_lineage_id").alias("_l"))
    right = lineage_of.select(F.col("record_id").alias("right_id"), F.col("true_lineage_id").alias("_r"))
    return pairs.join(left, "left_id").join(right, "right_id").where("_l = _r").select(*PAIR)
