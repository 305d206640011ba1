"""Record linkage: duplicates, native predecessors, version chains, weak evidence, and the checks on every link."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.scalars import version_order
from ledgerloom.functions.timestamps import stripped
from ledgerloom.operators import ancestry
from ledgerloom.session import cut

BILL_KEY = ("org_token", "source_system", "bill_id", "version_id")
CONTENT = ("previous_record_id", "payer_token", "service_token", "amount", "currency", "submitted_us", "available_us")
EVENT_KEY = ("org_token", "source_system", "bill_record_id", "event_type", "event_us", "amount", "currency")
#: Order in which rows count as seen.
SEEN = ("available_us", "record_id", "source_ref")
# Names of the rules.
R1, R2, R3, MANUAL = "R1_native_previous_id", "R2_same_bill_id_versions", "R3_amount_date_window", "M1_manual_decision"


def _same(left: str, right: str, keys: Sequence[str]) -> list[Column]:
    return [F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")) for k in keys]


def first_seen(rows: DataFrame, key: Sequence[str], order: Sequence[str], carry: Sequence[str]) -> DataFrame:
    """key and `first`, a struct of order and carry columns of the first row; summed up map-side, so no group meets in one task."""
    return rows.groupBy(*key).agg(F.min(F.struct(*order, *[c for c in carry if c not in order])).alias("first"))


def judge_bills(bills: DataFrame) -> DataFrame:
    """Adds first_id and verdict: 'first', 'DUPLICATE_IMPORT' (same content as the first of its key) or 'CONFLICTING_DUPLICATE_KEY'.

    Content is everything but record_id and source_ref; null equals null. A repeat of the first row under the same record_id
    is a duplicate import as well: only one row per key is 'first', the smallest in order of being known.
    """
    numbered = bills.withColumn("_ll_no", F.monotonically_increasing_id())
    firsts = first_seen(numbered, BILL_KEY, (*SEEN, "_ll_no"), CONTENT)
    joined = numbered.alias("b").join(firsts.alias("f"), _same("b", "f", BILL_KEY)).select("b.*", "f.first")
    equal = F.lit(True)
    for c in CONTENT:
        equal = equal & F.col(c).eqNullSafe(F.col(f"first.{c}"))
    verdict = F.when(F.col("_ll_no") == F.col("first._ll_no"), "first").when(equal, "DUPLICATE_IMPORT").otherwise("CONFLICTING_DUPLICATE_KEY")
    return joined.withColumns({"first_id": F.col("first.record_id"), "verdict": verdict}).drop("first", "_ll_no")


def judge_events(events: DataFrame) -> DataFrame:
    """Adds first_id and is_duplicate: events that say the same as an earlier one under another id. None is dropped."""
    order = ("available_us", "event_id")
    firsts = first_seen(events, EVENT_KEY, order, ())
    joined = events.alias("e").join(firsts.alias("f"), _same("e", "f", EVENT_KEY)).select("e.*", F.col("f.first.event_id").alias("first_id"))
    return joined.withColumn("is_duplicate", F.col("first_id") != F.col("event_id"))


def native_links(bills: DataFrame) -> DataFrame:
    """R1: predecessor named by the record itself."""
    previous = stripped(F.col("previous_record_id"))
    return bills.where(previous != "").select(previous.alias("left_id"), F.col("record_id").alias("right_id"), F.lit(R1).alias("rule"))


def next_in_group(df: DataFrame, keys: Sequence[str], chunk: str, order: Sequence[Column], value: str) -> DataFrame:
    """Adds next_value of the following row of a group, found within chunks of the group and then across chunks.

    chunk must rise with the order; a group of any size is thus spread over tasks by its chunks.
    """
    inside = Window.partitionBy(*keys, chunk).orderBy(*order)
    rows = df.withColumns({"next_value": F.lead(value).over(inside), "_ll_n": F.row_number().over(inside)})
    heads = rows.where("_ll_n = 1").select(*keys, chunk, F.col(value).alias("_ll_head"))
    heads = heads.withColumn("_ll_later", F.lead("_ll_head").over(Window.partitionBy(*keys).orderBy(chunk))).drop("_ll_head")
    out = rows.alias("r").join(heads.alias("h"), _same("r", "h", (*keys, chunk))).select("r.*", "h._ll_later")
    return out.withColumn("next_value", F.coalesce("next_value", "_ll_later")).drop("_ll_later", "_ll_n")


def version_links(bills: DataFrame) -> tuple[DataFrame, DataFrame]:
    """R2: (links between adjacent versions of a bill, members of bills that claim a version twice)."""
    keys = ("org_token", "source_system", "bill_id")
    per_version = bills.groupBy(*keys, "version_id").agg(F.count(F.lit(1)).alias("n"))
    groups = per_version.groupBy(*keys).agg((F.max("n") > 1).alias("is_ambiguous"), F.sum("n").alias("size"))
    marked = bills.alias("b").join(groups.alias("g"), _same("b", "g", keys)).select("b.*", "g.is_ambiguous", "g.size").where("size > 1")
    text, number, version = version_order(F.col("version_id"))
    chains = marked.where("not is_ambiguous").withColumn("_ll_chunk", F.when(text, F.lit(1 << 60)).otherwise(F.floor(number / 64)).cast("long"))
    chains = next_in_group(chains, keys, "_ll_chunk", [text, number, version], "record_id").where("next_value is not null")
    return chains.select(F.col("record_id").alias("left_id"), F.col("next_value").alias("right_id"), F.lit(R2).alias("rule")), marked.where("is_ambiguous").select("record_id", *keys)


def weak_links(bills: DataFrame, window_days: int = 7, percent: int = 8) -> DataFrame:
    """R3 candidates: pairs of equal organisation, source, payer and service, with close amounts and dates.

    Rows are joined on cells of time and of the logarithm of the amount, each with the neighbouring cells, so that only pairs that
    can match meet, however large a block is. The pair is in order of being known. abs(a-b) * 100 <= percent * greatest(a, b)
    is decided in whole numbers.
    """
    keys, span = ("org_token", "source_system", "payer_token", "service_token"), window_days * 86_400_000_000
    rows = bills.where("payer_token <> '' and service_token <> '' and amount > 0").select(*keys, *SEEN, "amount", "submitted_us")
    rows = rows.withColumns({"_ll_t": F.floor(F.col("submitted_us") / F.lit(span)).cast("long"), "_ll_a": F.floor(F.ln("amount") / F.lit(-F.ln(F.lit(1 - percent / 100))))}).withColumn("_ll_a", F.col("_ll_a").cast("long"))
    shifts = F.array(*[F.struct(F.lit(i).alias("t"), F.lit(j).alias("a")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    near = rows.withColumn("_ll_s", F.explode(shifts)).withColumns({"_ll_t": F.col("_ll_t") + F.col("_ll_s.t"), "_ll_a": F.col("_ll_a") + F.col("_ll_s.a")}).drop("_ll_s")
    on = [F.col(f"x.{k}") == F.col(f"y.{k}") for k in (*keys, "_ll_t", "_ll_a")]
    order = lambda s: F.struct(*[F.col(f"{s}.{c}") for c in SEEN])
    close = (F.abs(F.col("x.amount") - F.col("y.amount")) * 100 <= percent * F.greatest("x.amount", "y.amount")) & (F.abs(F.col("x.submitted_us") - F.col("y.submitted_us")) <= span)
    pairs = rows.alias("x").join(near.alias("y"), on).where((order("x") < order("y")) & close)
    return pairs.select(F.col("x.record_id").alias("left_id"), F.col("y.record_id").alias("right_id"), F.lit(R3).alias("rule"))


def unique_pairs(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pairs whose two ends stand in no other pair, all others)."""
    ends = pairs.select(F.col("left_id").alias("end")).unionAll(pairs.select(F.col("right_id").alias("end")))
    degree = ends.groupBy("end").agg(F.count(F.lit(1)).alias("n"))
    left, right = (degree.select(F.col("end").alias(f"{s}_id"), F.col("n").alias(f"n_{s}")) for s in ("left", "right"))
    judged = pairs.join(left, "left_id").join(right, "right_id")
    sole = (F.col("n_left") == 1) & (F.col("n_right") == 1)
    columns = ("left_id", "right_id", "rule")
    return judged.where(sole).select(*columns), judged.where(~sole).select(*columns)


def manual_links(decisions: DataFrame) -> DataFrame:
    """Pairs that a person decided to link."""
    left, right = stripped(F.col("left_record_id")), stripped(F.col("right_record_id"))
    wanted = (F.lower(stripped(F.col("decision"))) == "link") & (left != "") & (right != "")
    return decisions.where(wanted).select(left.alias("left_id"), right.alias("right_id"), F.lit(MANUAL).alias("rule"))


def by_priority(*rules: DataFrame) -> DataFrame:
    """All proposals, one per pair: that of the first rule in the argument order."""
    out = None
    for n, links in enumerate(rules):
        part = links.select("left_id", "right_id", F.struct(F.lit(n).alias("priority"), "rule").alias("r"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("left_id", "right_id").agg(F.min("r").alias("r")).select("left_id", "right_id", "r.*")


def check_links(proposals: DataFrame, bills: DataFrame) -> DataFrame:
    """Adds verdict: DANGLING_REFERENCE, CROSS_ORG_REFERENCE, CYCLE_REFERENCE or accepted, the first that holds; and is_late_parent.

    A link is a cycle if its right record is met on the way over native predecessors that starts at the left one.
    is_late_parent marks links by R1 and R2 whose predecessor was submitted later; they are accepted all the same.
    """
    known = bills.groupBy("record_id").agg(F.min(F.struct("available_us", "org_token", "submitted_us")).alias("b"))
    left = known.select(F.col("record_id").alias("left_id"), F.col("b").alias("_l"))
    right = known.select(F.col("record_id").alias("right_id"), F.col("b").alias("_r"))
    both = cut(proposals.join(left, "left_id", "left").join(right, "right_id", "left"))
    previous = stripped(F.col("previous_record_id"))
    parents = bills.where(previous != "").groupBy(F.col("record_id").alias("node")).agg(F.min(previous).alias("parent"))
    parents = cut(parents.join(known.select(F.col("record_id").alias("parent")), "parent", "left_semi").select("node", "parent"))
    tree = cut(ancestry.forest(parents))
    inside = both.where("_l is not null and _r is not null and _l.org_token = _r.org_token").select("left_id", "right_id")
    cycles = ancestry.reaches(inside, tree, "left_id", "right_id").select(F.col("below").alias("left_id"), F.col("above").alias("right_id"), F.lit(True).alias("_c"))
    judged = both.join(cycles, ["left_id", "right_id"], "left")
    verdict = F.when(F.col("_l").isNull() | F.col("_r").isNull(), "DANGLING_REFERENCE").when(~F.col("_l.org_token").eqNullSafe(F.col("_r.org_token")), "CROSS_ORG_REFERENCE").when(F.col("_c"), "CYCLE_REFERENCE").otherwise("accepted")
    late = F.coalesce(F.col("rule").isin(R1, R2) & (F.col("_l.submitted_us") > F.col("_r.submitted_us")), F.lit(False))
    return judged.select("left_id", "right_id", "rule", verdict.alias("verdict"), late.alias("is_late_parent"))


def several_successors(accepted: DataFrame) -> DataFrame:
    """Records that are the predecessor of more than one."""
    return accepted.groupBy("left_id").agg(F.count(F.lit(1)).alias("n_successors")).where("n_successors > 1")
