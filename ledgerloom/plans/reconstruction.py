"""Reconstruction and forecast over the contract tables, and one query per operator.

Every query runs the operators on whole tables. Owners of money are bills here (org_token, source_system, bill_id), named by one
string, in the queries named by_bill and those on landmarks; `lineage_*` queries use the linked lineages.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.scalars import age_bucket, payer_category, six_places
from ledgerloom.operators import agreement, landmarks, lineages, linkage, money, normalize, redelivery, risk
from ledgerloom.session import cut, table, tune
from ledgerloom.sources import files

AS_OF_US = 1_704_067_200_000_000  # 2024-01-01T00:00:00Z


def _bills(spark: SparkSession, d: str) -> DataFrame:
    """Valid bills with the verdict of deduplication."""
    tune(spark)
    return linkage.judge_bills(normalize.split(normalize.bills(table(spark, d, "bills")))[0])


def _kept(spark: SparkSession, d: str) -> DataFrame:
    return _bills(spark, d).where("verdict <> 'DUPLICATE_IMPORT'")


def _events(spark: SparkSession, d: str) -> DataFrame:
    """Valid events, the first delivery of each."""
    tune(spark)
    columns = ("event_id", "org_token", "source_system", "bill_record_id", "event_type", "event_at", "available_at", "amount_minor", "currency", "reverses_event_id", "delivery_id")
    once = redelivery.rank_copies(table(spark, d, "billing_events").select(*columns), "event_id", ["delivery_id"])[0]
    return normalize.split(normalize.events(once))[0]


def _paying(spark: SparkSession, d: str) -> DataFrame:
    """Events that count for money: those that repeat another's content under a new id are left out."""
    return linkage.judge_events(_events(spark, d)).where("not is_duplicate").drop("first_id", "is_duplicate")


def _allocations(spark: SparkSession, d: str) -> DataFrame:
    tune(spark)
    return normalize.split(normalize.allocations(table(spark, d, "allocations").distinct()))[0]


def _windows(spark: SparkSession, d: str) -> DataFrame:
    tune(spark)
    return normalize.split(normalize.windows(table(spark, d, "observation_windows").distinct()))[0]


def _owner_of(spark: SparkSession, d: str) -> DataFrame:
    """record_id, owner: the bill of each record."""
    return table(spark, d, "bills").groupBy("record_id").agg(F.min(F.concat_ws("|", "org_token", "source_system", "bill_id")).alias("owner"))


def normalize_bills(spark, d):
    return normalize.bills(table(spark, d, "bills")).select("record_id", "submitted_us", "amount", "is_valid")


def normalize_events(spark, d):
    return normalize.events(table(spark, d, "billing_events")).select("delivery_id", "event_us", "amount", "is_valid")


def normalize_allocations(spark, d):
    return normalize.allocations(table(spark, d, "allocations")).select("allocation_id", "amount", "is_valid")


def normalize_windows(spark, d):
    return normalize.windows(table(spark, d, "observation_windows")).select("window_id", "start_us", "end_us", "is_valid")


def validation_findings(spark, d):
    """Broken rules of all four tables, counted."""
    out = None
    for name, rules, ref in (("bills", "bills", "record_id"), ("billing_events", "events", "delivery_id"), ("allocations", "allocations", "allocation_id"), ("observation_windows", "windows", "window_id")):
        part = normalize.findings(table(spark, d, name), rules, ref).groupBy("field", "problem", "severity").agg(F.count(F.lit(1)).alias("n")).select(F.lit(rules).alias("checked"), "*")
        out = part if out is None else out.unionByName(part)
    return out


def extra_payers(spark, d):
    return normalize.extra_tokens(table(spark, d, "bills"), "payer_token", ("AET", "UHC"))


def asof_counts(spark, d):
    """Valid rows known by the cutoff."""
    parts = [("bills", normalize.bills(table(spark, d, "bills"))), ("events", normalize.events(table(spark, d, "billing_events"))), ("allocations", normalize.allocations(table(spark, d, "allocations")))]
    out = None
    for name, rows in parts:
        part = normalize.as_of(rows.where("is_valid"), AS_OF_US).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("counted"), "n")
        out = part if out is None else out.unionByName(part)
    return out


def duplicate_bills(spark, d):
    return _bills(spark, d).where("verdict <> 'first'").select("record_id", "first_id", "verdict")


def duplicate_events(spark, d):
    return linkage.judge_events(_events(spark, d)).where("is_duplicate").select("event_id", "first_id")


def r1_links(spark, d):
    return linkage.native_links(_kept(spark, d)).select("left_id", "right_id").distinct()


def r2_links(spark, d):
    return linkage.version_links(_kept(spark, d))[0].select("left_id", "right_id")


def r2_ambiguous(spark, d):
    return linkage.version_links(_kept(spark, d))[1].select("record_id")


def r3_candidates(spark, d):
    return linkage.weak_links(_kept(spark, d)).select("left_id", "right_id")


def r3_unique(spark, d):
    return linkage.unique_pairs(cut(linkage.weak_links(_kept(spark, d))))[0].select("left_id", "right_id")


def _links(spark: SparkSession, d: str, bills: DataFrame) -> DataFrame:
    """Proposals of all rules in their order, manual decisions last where there is a table of them, with the verdict of the checks."""
    r3 = linkage.unique_pairs(cut(linkage.weak_links(bills)))[0]
    manual = linkage.manual_links(files.read_table(spark, d, "manual_decisions"))
    return cut(linkage.check_links(linkage.by_priority(linkage.native_links(bills), linkage.version_links(bills)[0], r3, manual), bills))


def link_verdicts(spark, d):
    """Every proposed link by its first rule, with the outcome of the checks."""
    bills = cut(_kept(spark, d))
    return _links(spark, d, bills)


def several_successors(spark, d):
    bills = cut(_kept(spark, d))
    return linkage.several_successors(_links(spark, d, bills).where("verdict = 'accepted'"))


@dataclass
class Linked:
    """The linking of one set of tables, computed once: judged bills, those that are kept, link verdicts, record_id and root_id."""

    judged: DataFrame
    bills: DataFrame
    links: DataFrame
    root_of: DataFrame


def linked(spark: SparkSession, d: str) -> Linked:
    judged = cut(_bills(spark, d))
    bills = cut(judged.where("verdict <> 'DUPLICATE_IMPORT'"))
    links = _links(spark, d, bills)
    return Linked(judged, bills, links, cut(lineages.roots(bills, links.where("verdict = 'accepted'"))))


def lineage_roots(spark, d):
    return linked(spark, d).root_of


def _lineages(spark: SparkSession, d: str, known: Linked | None = None) -> DataFrame:
    known = known or linked(spark, d)
    return lineages.summarise(known.bills, known.root_of, _events(spark, d), _windows(spark, d))


def lineage_summary(spark, d, known=None):
    """One row per lineage; its members as one text, in order."""
    return _lineages(spark, d, known).withColumn("record_ids", F.array_join("record_ids", "|"))


def lineage_bridge(spark, d):
    return lineages.bridge(_lineages(spark, d))


def _amounts(spark: SparkSession, d: str, owner_of: DataFrame) -> DataFrame:
    events = cut(_paying(spark, d))
    parts = cut(money.parts_of(money.payments_of(events), money.allocations_of(_allocations(spark, d)), owner_of))
    return money.amounts(parts, money.reversed_by_owner(parts, money.capped(money.reversals_of(events)[0], money.payments_of(events))))


def lineage_amounts(spark, d, known=None):
    """Money per lineage, duplicate events left out; what belongs to none stands under UNLINKED, lineages without money have zeros."""
    root_of = (known or linked(spark, d)).root_of
    found = _amounts(spark, d, root_of.withColumnRenamed("root_id", "owner"))
    every = root_of.select(F.col("root_id").alias("owner")).distinct().join(found, "owner", "full")
    return every.select("owner", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gross", "reversed", "net", "unallocated")])


def lineage_status(spark, d, known=None):
    """Status of every lineage: open or closed, or paid, which a closed one is only after reopening."""
    known = known or linked(spark, d)
    base = _lineages(spark, d, known).select("root_id", "status")
    found = _amounts(spark, d, known.root_of.withColumnRenamed("root_id", "owner")).select(F.col("owner").alias("root_id"), "gross")
    return base.join(found, "root_id", "left").select("root_id", lineages.paid_status(F.col("status"), F.col("gross")).alias("status"))


def _link_conflicts(known: Linked) -> DataFrame:
    judged, links = known.judged, known.links
    pair = F.concat_ws("|", "left_id", "right_id")
    return lineages.notes(
        judged.where("verdict <> 'first'").select(F.col("verdict").alias("kind"), F.concat_ws("|", "first_id", "record_id").alias("record_ids")),
        links.where("verdict in ('CROSS_ORG_REFERENCE', 'CYCLE_REFERENCE')").select(F.col("verdict").alias("kind"), pair.alias("record_ids")),
        links.where("verdict = 'accepted' and is_late_parent").select(F.lit("TIME_ORDER_VIOLATION").alias("kind"), pair.alias("record_ids")),
        linkage.several_successors(links.where("verdict = 'accepted'")).select(F.lit("MULTIPLE_SUCCESSOR").alias("kind"), F.col("left_id").alias("record_ids")),
    )


def _reviews(known: Linked) -> DataFrame:
    judged, bills, links = known.judged, known.bills, known.links
    pair = F.concat_ws("|", "left_id", "right_id")
    return lineages.notes(
        judged.where("verdict = 'CONFLICTING_DUPLICATE_KEY'").select(F.col("verdict").alias("kind"), F.concat_ws("|", "first_id", "record_id").alias("record_ids")),
        links.where("verdict = 'DANGLING_REFERENCE'").select(F.col("verdict").alias("kind"), pair.alias("record_ids")),
        linkage.version_links(bills)[1].select(F.lit("AMBIGUOUS_VERSION_SET").alias("kind"), F.col("record_id").alias("record_ids")),
        linkage.unique_pairs(cut(linkage.weak_links(bills)))[1].select(F.lit("MULTI_CANDIDATE_AMBIGUITY").alias("kind"), pair.alias("record_ids")),
    )


def conflicts(spark, d, known=None):
    """Everything that contradicts itself, as rows: duplicates, links that cross, turn or run back in time, and money."""
    events = cut(_paying(spark, d))
    paid = money.payments_of(events)
    of_money = lineages.notes(
        money.in_usd(events, True)[1].select(F.lit("NON_USD_EVENT").alias("kind"), F.col("event_id").alias("record_ids")),
        money.in_usd(_allocations(spark, d), False)[1].select(F.lit("NON_USD_ALLOCATION").alias("kind"), F.col("allocation_id").alias("record_ids")),
        money.over_allocated(paid, money.allocations_of(_allocations(spark, d))).select(F.lit("OVER_ALLOCATION").alias("kind"), F.col("event_id").alias("record_ids")),
        money.reversals_of(events)[1].select(F.lit("UNRESOLVED_REVERSAL").alias("kind"), F.col("event_id").alias("record_ids")),
    )
    return _link_conflicts(known or linked(spark, d)).unionByName(of_money).select(F.col("kind").alias("conflict_type"), "record_ids")


def review_queue(spark, d, known=None):
    """What a person has to look at, as rows."""
    return _reviews(known or linked(spark, d)).select(F.col("kind").alias("review_type"), "record_ids")


def lineage_notes(spark, d, known=None):
    """Conflicts and reviews of the linking that touch each lineage, each counted once."""
    known = known or linked(spark, d)
    count = lambda rows, name: lineages.touch_counts(rows.select(F.concat_ws(":", "kind", "record_ids").alias("note_id"), F.explode(F.split("record_ids", r"\|")).alias("record_id")), known.root_of).withColumnRenamed("n", name)
    both = count(_link_conflicts(known), "n_conflicts").join(count(_reviews(known), "n_reviews"), "root_id", "full")
    return both.select("root_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_conflicts", "n_reviews")])


def coverage(spark, d):
    return lineages.complete_coverage(_windows(spark, d))


def over_allocation(spark, d):
    return money.over_allocated(money.payments_of(_paying(spark, d)), money.allocations_of(_allocations(spark, d)))


def _parts(spark: SparkSession, d: str, events: DataFrame) -> DataFrame:
    return money.parts_of(money.payments_of(events), money.allocations_of(_allocations(spark, d)), _owner_of(spark, d))


def posted_by_bill(spark, d):
    return money.posted(_parts(spark, d, _paying(spark, d)))


def reversal_cap(spark, d):
    events = cut(_paying(spark, d))
    return money.capped(money.reversals_of(events)[0], money.payments_of(events)).select("reversal_id", "event_id", "taken")


def unresolved_reversals(spark, d):
    return money.reversals_of(_paying(spark, d))[1]


def amounts_by_bill(spark, d):
    """Gross, reversed, net and unallocated amounts; reversals divided over the owners of their payment."""
    return _amounts(spark, d, _owner_of(spark, d))


def _timed(spark: SparkSession, d: str) -> DataFrame:
    return landmarks.effective_times(_events(spark, d), _allocations(spark, d), _owner_of(spark, d))


def effective_times(spark, d):
    return _timed(spark, d).select("owner", "event_id", "at_us")


def _owners(spark: SparkSession, d: str) -> DataFrame:
    """Bills as owners: coverage by organisation, payer category of the smallest payer token, versions."""
    known = lineages.complete_coverage(_windows(spark, d))
    per = table(spark, d, "bills").groupBy(F.concat_ws("|", "org_token", "source_system", "bill_id").alias("owner"), "org_token").agg(F.min(F.when(F.col("payer_token") != "", F.col("payer_token"))).alias("payer"), F.countDistinct("record_id").alias("n_versions"))
    covered = per.join(F.broadcast(known), "org_token", "left")  # one row per organisation
    return covered.select("owner", F.when(F.col("coverage_end_us").isNotNull(), "complete").otherwise("unknown").alias("coverage_status"), "coverage_end_us", payer_category(F.col("payer")).alias("payer_category"), "n_versions")


def _snapshots(spark: SparkSession, d: str) -> DataFrame:
    return landmarks.snapshots(_timed(spark, d), _owners(spark, d))


SNAPSHOT_COLUMNS = ("owner", "t_us", "max_input_us", "n_corrected", "n_voids", "n_payments", "n_unknown", "n_status", "n_closes", "n_reopens", "payer_category", "n_versions", "outcome", "outcome_interval")


def landmark_snapshots(spark, d):
    return _snapshots(spark, d).select(*SNAPSHOT_COLUMNS)


def outcome_histogram(spark, d):
    return _snapshots(spark, d).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


def interval_rows(spark, d):
    return landmarks.interval_rows(_snapshots(spark, d)).select("owner", "interval", "label")


def temporal_split(spark, d):
    return landmarks.temporal_split(cut(_snapshots(spark, d)))


def _training(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    snaps = cut(_snapshots(spark, d))
    parts = landmarks.temporal_split(snaps)
    rows = cut(landmarks.interval_rows(snaps).withColumn("age", age_bucket(F.lit(7.0))).join(parts, "owner"))
    return snaps, rows.where("part = 'train'"), rows.where("part = 'test'")


def b0_rates(spark, d):
    """Empirical risk by payer category and age bucket over the training part."""
    return risk.rates(_training(spark, d)[1], "payer_category", "age").select("payer_category", "age", "support", "n_payment", "n_close")


def b0_scores(spark, d):
    """Scores of the empirical baseline on the test part, to six places."""
    _, train, test = _training(spark, d)
    s = risk.scores(risk.with_rates(test, risk.rates(train, "payer_category", "age"), "payer_category", "age"))
    return s.select("n", "n_abstained", *[F.floor(F.col(c) * 1_000_000 + 0.5).cast("long").alias(f"{c}_millionths") for c in ("log_loss", "brier")])


FEATURES = ["interval", "n_versions", "n_corrected", "n_voids", "n_unknown", "n_status", "n_reopens", "log_age"]


def b1_predictions(spark, d):
    """Probabilities by the end of the horizon from a multinomial model, per snapshot of the test part; ABSTAIN if it can't be fitted."""
    _, train, test = _training(spark, d)
    prepare = lambda df: df.withColumn("log_age", F.lit(7.0))
    predict = risk.fit_multinomial(prepare(train), FEATURES)
    ends = test.select("owner", "t_us", *[c for c in FEATURES if c not in ("interval", "log_age")]).distinct()
    if predict is None:
        return ends.select("owner", F.lit("ABSTAIN").alias("outcome"), *[F.lit("").alias(c) for c in ("p_payment", "p_close", "p_still_open")])
    grid = predict(prepare(ends.withColumn("interval", F.explode(F.sequence(F.lit(0), F.lit(5))))))
    curve = grid.groupBy("owner").agg(F.transform(F.array_sort(F.collect_list(F.struct("interval", "p_payment", "p_close", "p_none"))), lambda p: F.struct(p["p_payment"].alias("p_payment"), p["p_close"].alias("p_close"), p["p_none"].alias("p_none"))).alias("p"))
    last = curve.select("owner", F.element_at(risk.cumulative(F.col("p")), -1).alias("c"))
    return last.select("owner", F.lit("PREDICTED").alias("outcome"), six_places(F.col("c.f_payment")).alias("p_payment"), six_places(F.col("c.f_close")).alias("p_close"), six_places(F.col("c.s")).alias("p_still_open"))


def linkage_agreement(spark, d):
    """Native and version links against adjacent versions."""
    bills = cut(_kept(spark, d))
    proposed = linkage.native_links(bills).unionByName(linkage.version_links(bills)[0])
    return agreement.agreement(proposed, agreement.adjacent_versions(bills))


def a0_agreement(spark, d):
    """The unconstrained baseline against adjacent versions."""
    bills = cut(_kept(spark, d))
    return agreement.agreement(agreement.submission_neighbours(bills), agreement.adjacent_versions(bills))


def exact_id_agreement(spark, d):
    """Native links alone against adjacent versions."""
    bills = cut(_kept(spark, d))
    return agreement.agreement(linkage.native_links(bills), agreement.adjacent_versions(bills))


def bi_measures(spark, d):
    """Report measures per organisation."""
    tune(spark)
    bills = table(spark, d, "bills").groupBy("org_token").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("record_id").alias("n_records"), F.sum(F.col("billed_amount_minor").rlike(r"\A[0-9]{1,18}\z").cast("long") * F.coalesce(F.when(F.col("billed_amount_minor").rlike(r"\A[0-9]{1,18}\z"), F.col("billed_amount_minor")).try_cast("long"), F.lit(0))).alias("billed"))
    links = table(spark, d, "links").join(table(spark, d, "bills").groupBy(F.col("record_id").alias("left_record_id")).agg(F.min("org_token").alias("org_token")), "left_record_id").groupBy("org_token").agg(F.count(F.lit(1)).alias("n_links"), F.count_if(F.lower(F.trim("decision")) == "review").alias("n_review"))
    return bills.join(links, "org_token", "left").withColumn("review_per_million", F.floor(F.try_divide(F.col("n_review") * 1_000_000, F.col("n_links"))).cast("long"))


QUERIES = {
    f.__name__: f
    for f in (
        normalize_bills, normalize_events, normalize_allocations, normalize_windows, validation_findings, extra_payers, asof_counts, duplicate_bills,
        duplicate_events, r1_links, r2_links, r2_ambiguous, r3_candidates, r3_unique, link_verdicts, several_successors, lineage_roots, lineage_summary,
        lineage_bridge, lineage_notes, lineage_amounts, lineage_status, conflicts, review_queue, coverage, over_allocation, posted_by_bill, reversal_cap, unresolved_reversals, amounts_by_bill, effective_times,
        landmark_snapshots, outcome_histogram, interval_rows, temporal_split, b0_rates, b0_scores, b1_predictions, linkage_agreement, a0_agreement,
        exact_id_agreement, bi_measures,
    )
}
