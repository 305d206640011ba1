"""Per-day figures by event time that late records correct: a fast layer, a batch layer, and a cut-off.

Fast layer: a batch of newly known records increments the provisional figures of their days. Batch layer: a scheduled run
recomputes every open day from the full log and replaces its figures; a day whose cut-off has passed is frozen, and records that
become known after that are told apart and change nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DAY_US = 86_400_000_000
GRACE_DAYS, CUTOFF_DAYS = 2, 30


def period_end(event_us: Column) -> Column:
    """UTC midnight after the event time, in microseconds."""
    return (F.floor(event_us / F.lit(DAY_US)).cast("long") + 1) * DAY_US


def _day_start(event_us: Column) -> Column:
    return event_us - F.pmod(event_us, F.lit(DAY_US))


def route(log: DataFrame, event_us: str = "event_us", known_us: str = "known_us", grace_days: int = GRACE_DAYS, cutoff_days: int = CUTOFF_DAYS) -> DataFrame:
    """Adds period_us (start of the UTC day) and route.

    'on_time': known up to grace_days after the day's end; the fast layer has it while the day is provisional. 'late': known up to
    cutoff_days after; a batch run corrects the day. 'too_late': beyond the cut-off, when the day is frozen. Null where the event
    time or the time of knowledge is null: such records belong to no day. Repeated rows are kept; callers deduplicate.
    """
    day = _day_start(F.col(event_us))
    lag = F.col(known_us) - (day + DAY_US)
    kind = F.when(lag <= grace_days * DAY_US, "on_time").when(lag <= cutoff_days * DAY_US, "late").when(lag.isNotNull(), "too_late")
    return log.withColumn("period_us", F.when(F.col(known_us).isNotNull(), day)).withColumn("route", kind)


_ACCEPTED = "route in ('on_time', 'late')"


def _figures(rows: DataFrame, keys: Sequence[str], amount: str) -> DataFrame:
    return rows.groupBy(*keys, "period_us").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(amount).cast("decimal(38,0)")).alias("amount"))


def _increment(view: DataFrame | None, added: DataFrame, keys: Sequence[str]) -> DataFrame:
    if view is None:
        return added
    both = view.select(*keys, "period_us", "n", "amount").unionByName(added)
    return both.groupBy(*keys, "period_us").agg(F.sum("n").alias("n"), F.sum("amount").cast("decimal(38,0)").alias("amount"))


def fast_increment(view: DataFrame | None, batch: DataFrame, keys: Sequence[str], amount: str) -> DataFrame:
    """The provisional view after a batch of newly known, routed records. Too late ones never enter. Partial sums shuffle, not rows."""
    return _increment(view, _figures(batch.where(_ACCEPTED), keys, amount), keys)


def refuse_increment(view: DataFrame | None, batch: DataFrame, keys: Sequence[str], amount: str) -> DataFrame:
    """What frozen periods have refused so far, after a batch of newly known, routed records."""
    return _increment(view, _figures(batch.where("route = 'too_late'"), keys, amount), keys)


def batch_recompute(log: DataFrame, frozen: DataFrame | None, now_us: int, keys: Sequence[str], amount: str, known_us: str = "known_us", cutoff_days: int = CUTOFF_DAYS) -> DataFrame:
    """The batch view at now_us: open days recomputed from the whole routed log, frozen days as they were, days that pass their cut-off frozen now.

    log: routed records; only those known by now_us count. frozen: an earlier result of this function. The result has keys,
    period_us, n, amount and is_frozen. Days of `frozen` are never recomputed.
    """
    closes = F.col("period_us") + (1 + cutoff_days) * DAY_US
    known = log.where((F.col(known_us) <= now_us) & F.expr(_ACCEPTED))
    if frozen is not None:
        settled = frozen.where("is_frozen").select(*keys, "period_us", "n", "amount", "is_frozen")
        last = frozen.where("is_frozen").agg(F.max("period_us")).first()[0]
        known = known if last is None else known.where(F.col("period_us") > last)
    view = _figures(known, keys, amount).withColumn("is_frozen", closes <= now_us)
    return view if frozen is None else settled.unionByName(view)


def layers(log: DataFrame, times_us: Sequence[int], keys: Sequence[str], amount: str, known_us: str = "known_us", keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(first figures, batch view, refused figures) after batch runs at times_us, in order.

    First figures: what the fast layer added while each day was provisional, batch by batch. Refused figures: what came to days
    after they were frozen. keep: stores a view after each run, so that plans don't grow with the number of runs.
    """
    first, view, refused, last = None, None, None, None
    for now in times_us:
        new = log.where(F.col(known_us) <= now)
        new = new if last is None else new.where(F.col(known_us) > last)
        first = keep(fast_increment(first, new.where("route = 'on_time'"), keys, amount))
        refused = keep(refuse_increment(refused, new, keys, amount))
        view = keep(batch_recompute(log, view, now, keys, amount, known_us))
        last = now
    return first, view, refused


def scheduled(log: DataFrame, times_us: Sequence[int], keys: Sequence[str], amount: str, known_us: str = "known_us", keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> tuple[DataFrame, DataFrame]:
    """The first figures and the batch view of `layers`."""
    return layers(log, times_us, keys, amount, known_us, keep)[:2]


#: Rows of the table of changed periods that are small for any executor.
SMALL_PERIODS = 200_000


def corrections(log: DataFrame, first: DataFrame, view: DataFrame, refused: DataFrame, keys: Sequence[str], known_us: str = "known_us", grace_days: int = GRACE_DAYS, cutoff_days: int = CUTOFF_DAYS) -> DataFrame:
    """The records by which batch runs changed the first figures ('late'), and those that frozen periods refused ('too_late'), with late_kind.

    first, view, refused: a result of `layers`, after runs past every cut-off. Only periods whose batch figures differ from the
    first ones, or that refused something, are looked at; in them the record's time of knowledge tells which layer it missed.
    Records without period are never corrections; repeated records stay repeated.
    """
    parts = None
    for rows, n, m in ((first, -1, 0), (view, 1, 0), (refused, 0, 1)):
        part = rows.select(*keys, "period_us", (F.col("n") * n).alias("_ll_more"), (F.col("n") * m).alias("_ll_shut"))
        parts = part if parts is None else parts.unionByName(part)
    both = parts.groupBy(*keys, "period_us").agg(F.sum("_ll_more").alias("_ll_more"), F.sum("_ll_shut").alias("_ll_shut"))
    changed = both.where("_ll_more <> 0 or _ll_shut > 0").select(*[F.col(k).alias(f"_ll_{k}") for k in keys], F.col("period_us").alias("_ll_period"), "_ll_more", "_ll_shut")
    same = F.col("period_us") == F.col("_ll_period")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_ll_{k}"))
    side = F.broadcast(changed) if view.count() + refused.count() <= SMALL_PERIODS else changed
    ends = F.col("period_us") + DAY_US
    frozen = F.col(known_us) > ends + cutoff_days * DAY_US
    late = (F.col(known_us) > ends + grace_days * DAY_US) & ~frozen
    kind = F.when((F.col("_ll_more") != 0) & late, "late").when((F.col("_ll_shut") > 0) & frozen, "too_late")
    return log.join(side, same).select(*log.columns, kind.alias("late_kind")).where("late_kind is not null")


def serve(batch_view: DataFrame, fast_view: DataFrame | None, keys: Sequence[str]) -> DataFrame:
    """What a reader sees: the batch view plus the increments of records known since its run."""
    base = batch_view.select(*keys, "period_us", "n", "amount")
    both = base if fast_view is None else base.unionByName(fast_view.select(*keys, "period_us", "n", "amount"))
    return both.groupBy(*keys, "period_us").agg(F.sum("n").alias("n"), F.sum("amount").cast("decimal(38,0)").alias("amount"))


def missed(log: DataFrame) -> DataFrame:
    """Routed records that came after the provisional figures: what batch runs corrected, and what the cut-off shut out."""
    return log.where(F.col("route").isin("late", "too_late"))
