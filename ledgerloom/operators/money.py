"""Money between payments, allocations and owners, in whole minor units.

Sums pass through decimal(38,0), so that no product or total overflows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNLINKED = "UNLINKED"


def in_usd(rows: DataFrame, blank_is_usd: bool) -> tuple[DataFrame, DataFrame]:
    """(rows in USD, rows in other currencies). Currencies are never converted."""
    currency = F.coalesce("currency", F.lit(""))
    usd = currency.isin("USD", "") if blank_is_usd else currency == "USD"
    return rows.where(usd), rows.where(~usd)


def payments_of(events: DataFrame) -> DataFrame:
    """event_id, own_record, amount: USD payments above 0; of repeated ids the smallest row."""
    usd, _ = in_usd(events, True)
    paid = usd.where("event_type = 'PAYMENT_POSTED' and amount > 0")
    return paid.groupBy("event_id").agg(F.min(F.struct(F.coalesce("bill_record_id", F.lit("")).alias("own_record"), "amount")).alias("p")).select("event_id", "p.*")


def allocations_of(allocations: DataFrame) -> DataFrame:
    """USD allocations: event_id, record_id ('' if it names none), amount, and their order."""
    usd, _ = in_usd(allocations, False)
    return usd.select(F.col("payment_event_id").alias("event_id"), F.coalesce(F.trim("bill_record_id"), F.lit("")).alias("record_id"), F.col("amount").cast("long").alias("amount"), F.struct("available_us", "allocation_id").alias("seen"))


def over_allocated(payments: DataFrame, allocated: DataFrame) -> DataFrame:
    """event_id, amount, allocated of payments whose allocations, those without a bill too, exceed them."""
    sums = allocated.groupBy("event_id").agg(F.sum(F.col("amount").cast("decimal(38,0)")).alias("allocated"))
    return payments.join(sums, "event_id").where(F.col("allocated") > F.col("amount")).select("event_id", "amount", F.col("allocated").cast("long").alias("allocated"))


def parts_of(payments: DataFrame, allocated: DataFrame, owner_of: DataFrame) -> DataFrame:
    """event_id, owner, amount, position, unallocated: each unblocked payment divided among its owners.

    owner_of maps record_id to owner; what it doesn't map belongs to UNLINKED. Allocations go to the owner of their bill; the
    rest of a payment, allocations without bill included, to the main owner: that of the payment's own bill, else the only one
    that its allocations have, else UNLINKED. Parts of a payment add up to its amount. position numbers the parts by their
    first allocation, the rest last.
    """
    free = payments.join(over_allocated(payments, allocated).select("event_id"), "event_id", "left_anti")
    placed = allocated.where("record_id <> ''").join(owner_of, "record_id", "left").withColumn("owner", F.coalesce("owner", F.lit(UNLINKED)))
    by_owner = placed.groupBy("event_id", "owner").agg(F.sum("amount").alias("amount"), F.min("seen").alias("seen")).join(free.select("event_id"), "event_id")
    totals = by_owner.groupBy("event_id").agg(F.sum("amount").alias("given"), F.count(F.lit(1)).alias("n"), F.min("owner").alias("sole"))
    own = owner_of.select(F.col("record_id").alias("own_record"), F.col("owner").alias("own_owner"))
    whole = free.join(totals, "event_id", "left").join(own, "own_record", "left")
    main = F.when(F.col("own_record") != "", F.coalesce("own_owner", F.lit(UNLINKED))).when(F.col("n") == 1, F.col("sole")).otherwise(UNLINKED)
    rest = whole.select("event_id", main.alias("owner"), (F.col("amount") - F.coalesce("given", F.lit(0))).alias("amount")).where("amount > 0")
    rest = rest.withColumn("seen", F.lit(None).cast(by_owner.schema["seen"].dataType)).withColumn("unallocated", F.col("amount"))
    both = by_owner.withColumn("unallocated", F.lit(0).cast("long")).unionByName(rest)
    joined = both.groupBy("event_id", "owner").agg(F.sum("amount").alias("amount"), F.min("seen").alias("seen"), F.sum("unallocated").alias("unallocated"))
    position = F.row_number().over(Window.partitionBy("event_id").orderBy(F.col("seen").asc_nulls_last(), "owner"))
    return joined.withColumn("position", position).drop("seen")


def posted(parts: DataFrame) -> DataFrame:
    """owner, gross, unallocated."""
    return parts.groupBy("owner").agg(F.sum(F.col("amount").cast("decimal(38,0)")).cast("long").alias("gross"), F.sum(F.col("unallocated").cast("decimal(38,0)")).cast("long").alias("unallocated"))


def reversals_of(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(reversals with a target: reversal_id, event_id, amount, at_us; ids of those that name none)."""
    usd, _ = in_usd(events, True)
    rows = usd.where("event_type = 'PAYMENT_REVERSED'").withColumn("target", F.trim(F.coalesce("reverses_event_id", F.lit(""))))
    aimed = rows.where("target <> ''").select(F.col("event_id").alias("reversal_id"), F.col("target").alias("event_id"), F.coalesce("amount", F.lit(0)).alias("amount"), F.col("available_us").alias("at_us"))
    return aimed, rows.where("target = ''").select("event_id").distinct()


def capped(reversals: DataFrame, payments: DataFrame) -> DataFrame:
    """Adds taken: of each reversal what the payment still holds, in order of being known. Targets that aren't payments drop out."""
    rows = reversals.join(payments.select("event_id", F.col("amount").alias("whole")), "event_id")
    order = Window.partitionBy("event_id").orderBy("at_us", "reversal_id").rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum(F.col("amount").cast("decimal(38,0)")).over(order)
    taken = F.least(total, F.col("whole").cast("decimal(38,0)")) - F.least(total - F.col("amount"), F.col("whole").cast("decimal(38,0)"))
    return rows.withColumn("taken", taken.cast("long")).drop("whole")


def _take(held: Column, gross: Column, amount: Column) -> Column:
    """What each part holds after a reversal of `amount`: floored shares by gross, the last takes what is left; what exceeds a part goes on to others in turn."""
    n = F.size(gross)
    base = F.aggregate(gross, F.lit(0).cast("decimal(38,0)"), lambda a, g: (a + g).cast("decimal(38,0)"))
    floors = F.transform(gross, lambda g: F.floor(amount.cast("decimal(19,0)") * g.cast("decimal(19,0)") / base).cast("long"))
    lead = F.aggregate(F.slice(floors, 1, F.greatest(n - 1, F.lit(0))), F.lit(0).cast("long"), lambda a, s: a + s)
    shares = F.transform(floors, lambda s, i: F.when(i == n - 1, amount - lead).otherwise(s))
    got = F.zip_with(shares, held, lambda s, h: F.least(s, h))
    over = amount - F.aggregate(got, F.lit(0).cast("long"), lambda a, g: a + g)
    room = F.zip_with(held, got, lambda h, g: h - g)
    start = F.struct(over.alias("left"), F.array().cast("array<bigint>").alias("extra"))
    spread = F.aggregate(room, start, lambda a, r: F.struct((a["left"] - F.least(a["left"], r)).alias("left"), F.concat(a["extra"], F.array(F.least(a["left"], r))).alias("extra")))["extra"]
    return F.zip_with(F.zip_with(held, got, lambda h, g: h - g), spread, lambda h, e: h - e)


def reversed_by_owner(parts: DataFrame, reversals: DataFrame) -> DataFrame:
    """event_id, owner, reversed: capped reversals divided over the owners of their payment.

    Each reversal is split in proportion to the parts' amounts (floored, the last part takes the rest); what exceeds what a
    part still holds goes to the others in order. One payment's parts and reversals form one row; owners of a payment are few.
    """
    held = parts.groupBy("event_id").agg(F.array_sort(F.collect_list(F.struct("position", "owner", "amount"))).alias("parts"))
    taken = reversals.where("taken > 0").groupBy("event_id").agg(F.array_sort(F.collect_list(F.struct("at_us", "reversal_id", "taken"))).alias("steps"))
    both = held.join(taken, "event_id").withColumn("gross", F.transform("parts", lambda p: p["amount"]))
    left = F.aggregate("steps", F.col("gross"), lambda h, s: _take(h, F.col("gross"), s["taken"]))
    out = both.withColumn("left", left).select("event_id", F.explode(F.zip_with("parts", "left", lambda p, h: F.struct(p["owner"].alias("owner"), (p["amount"] - h).alias("reversed")))).alias("r"))
    return out.select("event_id", "r.owner", "r.reversed")


def amounts(parts: DataFrame, reversed_rows: DataFrame) -> DataFrame:
    """owner, gross, reversed, net, unallocated."""
    back = reversed_rows.groupBy("owner").agg(F.sum(F.col("reversed").cast("decimal(38,0)")).cast("long").alias("reversed"))
    both = posted(parts).join(back, "owner", "left").withColumn("reversed", F.coalesce("reversed", F.lit(0).cast("long")))
    return both.select("owner", "gross", "reversed", (F.col("gross") - F.col("reversed")).alias("net"), "unallocated")
