"""The data-preparation queries p1, p2, p3, p4, p6 and p7, each through its operator and over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import hierarchy as hi
from ledgerloom.operators import instants, late_views, redelivery, rejects, valid_at
from ledgerloom.session import cut, table, tune

STAMPS = (("bills", "record_id", "submitted_at"), ("billing_events", "event_id", "event_at"), ("observation_windows", "window_id", "coverage_start"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Stamps that aren't in the contract's form but name an instant."""
    tune(spark)
    systems, parts = table(spark, d, "source_systems"), None
    for name, key, stamp in STAMPS:
        rows = table(spark, d, name).where(instants.nonconforming(stamp)).select(F.lit(name).alias("source_table"), F.col(key).alias("row_key"), F.lit(stamp).alias("field_name"), "source_system", F.col(stamp).alias("stamp"))
        parts = rows if parts is None else parts.unionByName(rows)
    found = instants.to_instants(parts, "stamp", systems)
    return found.where("utc_micros is not null").select("source_table", "row_key", "field_name", "utc_micros").distinct()


def event_log(spark: SparkSession, d: str) -> DataFrame:
    """event_id, event_us, known_us and amount, one row per event: all deliveries of an event agree in them, but the amount may be missing."""
    events = table(spark, d, "billing_events").select("event_id", "source_system", "event_at", F.unix_micros("available_at").alias("known_us"), "amount_minor")
    events = instants.to_instants(events, "event_at", table(spark, d, "source_systems"))
    return events.groupBy("event_id").agg(F.min("utc_micros").alias("event_us"), F.min("known_us").alias("known_us"), F.max("amount_minor").alias("amount"))


P2_KEYS = ["record_kind"]
#: Batch runs over the time in which records become known. The figures after the last run don't depend on it.
RUNS = 4


def _p2_log(spark: SparkSession, d: str) -> DataFrame:
    """record_kind, row_key, event_us, known_us and amount of events and allocations, once each. Stamps are parsed once, for both."""
    events = cut(event_log(spark, d))
    amount = F.when(F.col("allocated_amount_minor").rlike(r"\A[0-9]{1,18}\z"), F.col("allocated_amount_minor").try_cast("long"))
    allocations = table(spark, d, "allocations").select("allocation_id", F.col("payment_event_id").alias("_pay"), F.unix_micros("available_at").alias("known_us"), amount.alias("amount")).distinct()
    paid = allocations.join(events.select(F.col("event_id").alias("_pay"), "event_us"), "_pay")
    log = events.select(F.lit("event").alias("record_kind"), F.col("event_id").alias("row_key"), "event_us", "known_us", "amount")
    return log.unionByName(paid.select(F.lit("allocation").alias("record_kind"), F.col("allocation_id").alias("row_key"), "event_us", "known_us", "amount"))


def _run_views(log: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(routed log, first figures, batch view after the last run, refused figures): RUNS batch runs while records become known, the last past every cut-off."""
    log = cut(late_views.route(log).where("period_us is not null"))
    low, high, last = (int(x or 0) for x in log.agg(F.min("known_us"), F.max("known_us"), F.max("period_us")).first())
    step = max(1, -(-(high - low) // RUNS))
    end = max(high, last + (1 + late_views.CUTOFF_DAYS) * late_views.DAY_US)
    return log, *late_views.layers(log, [*range(low, high, step), end], P2_KEYS, "amount", keep=cut)


def _daily(log: DataFrame) -> DataFrame:
    """Per record_kind and UTC day of event time: first figures, those after the last batch run, whether frozen, and what the cut-off shut out."""
    _, first, view, refused = _run_views(log)
    first = first.select(*P2_KEYS, "period_us", F.col("n").alias("n_first"), F.col("amount").alias("amount_first"))
    refused = refused.select(*P2_KEYS, "period_us", F.col("n").alias("n_too_late"), F.col("amount").alias("amount_too_late"))
    days = view.join(first, [*P2_KEYS, "period_us"], "full").join(refused, [*P2_KEYS, "period_us"], "full")
    day = F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col("period_us") / late_views.DAY_US).cast("int")), "yyyy-MM-dd")
    count = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return days.select(*P2_KEYS, day.alias("day"), count("n_first"), "amount_first", count("n"), "amount", F.coalesce("is_frozen", F.lit(True)).alias("is_frozen"), count("n_too_late"), "amount_too_late")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Events and allocations that batch runs correct ('late') or frozen days refuse ('too_late')."""
    tune(spark)
    return late_views.corrections(*_run_views(_p2_log(spark, d)), P2_KEYS).select("record_kind", "row_key", "late_kind").distinct()


def p2_daily(spark: SparkSession, d: str) -> DataFrame:
    """Per UTC day of event time: events in the first figures, corrected later, and shut out, after the last batch run."""
    tune(spark)
    days = _daily(event_log(spark, d).withColumn("record_kind", F.lit("event")))
    return days.select("day", F.col("n_first").alias("n_on_time"), (F.col("n") - F.col("n_first")).alias("n_late"), "n_too_late")


def p2_views(spark: SparkSession, d: str) -> DataFrame:
    """Per kind of record, events and allocations, and UTC day of event time: numbers and amounts at first, after the last batch run, and shut out."""
    tune(spark)
    return _daily(_p2_log(spark, d))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Rows that don't hold a whole contract record or valid values, with every reason; lines of no known feed are set aside as 'unknown_feed'."""
    tune(spark)
    raw = rejects.check_records(table(spark, d, "raw_lines").select("line_id", "feed", "raw"))
    parts = [rejects.split_rows(raw)[1].select(F.lit("raw_lines").alias("source_table"), F.col("line_id").cast("string").alias("row_key"), "reasons")]
    for name, key, schema in (("bills", "record_id", rejects.BILLS), ("billing_events", "delivery_id", rejects.EVENTS), ("allocations", "allocation_id", rejects.ALLOCATIONS)):
        rows = rejects.check_columns(table(spark, d, name).select(key, *schema.rules), schema.rules)
        parts.append(rejects.split_rows(rows)[1].select(F.lit(name).alias("source_table"), F.col(key).cast("string").alias("row_key"), "reasons"))
    found = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    return found.select("source_table", "row_key", F.explode("reasons").alias("reason")).distinct()


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Every bill record whose parent is in bills: its root and depth, or '' and -1 on or below a cycle."""
    tune(spark)
    tree = hi.hierarchy(table(spark, d, "bills").select("record_id", "previous_record_id"), "record_id", "previous_record_id", with_path=False)
    return tree.where("parent is not null").select(F.col("node").alias("record_id"), F.col("root").alias("root_record_id"), "depth")


def p4_descendants(spark: SparkSession, d: str) -> DataFrame:
    """Path of every record and the number of its descendants."""
    tune(spark)
    tree = hi.hierarchy(table(spark, d, "bills").select("record_id", "previous_record_id"), "record_id", "previous_record_id")
    n = hi.descendants(tree).groupBy(F.col("ancestor").alias("node")).agg(F.count(F.lit(1)).alias("n_descendants"))
    out = tree.join(n, "node", "left")
    return out.select(F.col("node").alias("record_id"), F.array_join("path", "/").alias("path"), "depth", F.coalesce("n_descendants", F.lit(0)).alias("n_descendants"))


BILL_KEYS = ("org_token", "source_system", "bill_id")


def _bill_versions(spark: SparkSession, d: str) -> DataFrame:
    number = F.regexp_extract("version_id", r"(\d+)", 1).try_cast("long")
    amount = F.when(F.col("billed_amount_minor").rlike(r"\A[0-9]{1,18}\z"), F.col("billed_amount_minor").try_cast("long"))
    return table(spark, d, "bills").select(*BILL_KEYS, "record_id", F.unix_micros("available_at").alias("known_us"), F.coalesce(number, F.lit(-1)).alias("number"), "payer_token", amount.alias("amount"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Events that saw an older version than the bill's highest, and snapshots that hold what wasn't known at their time."""
    tune(spark)
    bills = _bill_versions(spark, d)
    # a bill is named by the record of its highest version from here on: one short key instead of three
    top = bills.groupBy(*BILL_KEYS).agg(F.min(F.struct((-F.col("number")).alias("minus"), "record_id"))["record_id"].alias("top_id"))
    same = lambda left: [F.col(f"{left}.{k}").eqNullSafe(F.col(f"t.{k}")) for k in BILL_KEYS]
    versions = bills.alias("b").join(top.alias("t"), same("b")).select("t.top_id", "b.record_id", "b.known_us", "b.number", "b.payer_token", "b.amount")
    rank = F.struct((-F.col("number")).alias("minus"), F.col("record_id").alias("record_id"), F.col("payer_token").alias("payer"), F.col("amount").alias("amount"))
    intervals = valid_at.best_intervals(versions, ["top_id"], "known_us", rank)
    low, high = (int(x or 0) for x in table(spark, d, "bills").agg(F.min(F.unix_micros("available_at")), F.max(F.unix_micros("available_at"))).first())
    cells = cut(valid_at.time_cells(intervals, ["top_id"], low, high + 1))  # read twice: for the masks and for the join
    masks = valid_at.level_masks(cells, ["top_id"])
    entities = top.join(masks, "top_id", "left")
    of_record = bills.select("record_id", *BILL_KEYS).alias("b").join(entities.alias("t"), same("b")).groupBy("b.record_id").agg(F.min("t.top_id").alias("top_id"), F.min("t.mask").alias("mask"))

    events = table(spark, d, "billing_events").select("event_id", "bill_record_id", F.unix_micros("available_at").alias("at_us"))
    events = events.join(of_record.withColumnRenamed("record_id", "bill_record_id"), "bill_record_id")
    snaps = table(spark, d, "snapshots").select("snapshot_id", *BILL_KEYS, F.unix_micros("t").alias("at_us"), F.unix_micros("max_input_available_at").alias("input_us"), "payer_token", "billed_amount_minor")
    snaps = snaps.alias("s").join(entities.alias("t"), same("s"), "left").select("s.*", "t.top_id", "t.mask")

    points = events.select(F.lit("event").alias("record_kind"), F.col("event_id").alias("row_key"), "mask", "at_us", "top_id", F.lit(None).cast("long").alias("input_us"), F.lit(None).cast("string").alias("payer_token"), F.lit(None).cast("long").alias("billed_amount_minor"))
    points = points.unionByName(snaps.select(F.lit("snapshot").alias("record_kind"), F.col("snapshot_id").alias("row_key"), "mask", "at_us", "top_id", "input_us", "payer_token", "billed_amount_minor"))
    known = valid_at.as_known(points, "at_us", "mask", cells, ["top_id"], low, high + 1)
    seen = F.coalesce("best.record_id", F.lit(""))
    stale = (F.col("record_kind") == "event") & (seen != F.col("top_id"))
    later = F.coalesce(F.col("input_us") > F.col("at_us"), F.lit(False))
    differs = ~F.col("payer_token").eqNullSafe(F.col("best.payer")) | ~F.col("billed_amount_minor").eqNullSafe(F.col("best.amount"))
    ahead = (F.col("record_kind") == "snapshot") & (later | differs)
    return known.where(stale | ahead).select("record_kind", "row_key", seen.alias("record_id")).distinct()


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Deliveries of an event beyond its first."""
    tune(spark)
    dropped = redelivery.rank_copies(table(spark, d, "billing_events").select("event_id", "delivery_id"), "event_id", ["delivery_id"])[1]
    return dropped.select("delivery_id")


def p7_kept(spark: SparkSession, d: str) -> DataFrame:
    """The copy of each message that stays when the batch received last meets what is stored: stored copies win over new ones."""
    tune(spark)
    rows = table(spark, d, "billing_events").select("event_id", "delivery_id", "batch_id")
    last = rows.agg(F.max_by("batch_id", "delivery_id")).first()[0]
    is_new = F.col("batch_id").eqNullSafe(F.lit(last))
    return redelivery.keep_one(rows.where(~is_new), rows.where(is_new), "event_id", ["delivery_id"]).select("delivery_id")


QUERIES = {f.__name__: f for f in (p1_found, p2_found, p2_daily, p2_views, p3_found, p4_found, p4_descendants, p6_found, p7_found, p7_kept)}
