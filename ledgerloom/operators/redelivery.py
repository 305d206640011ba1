"""Exactly one copy of every message that was delivered at least once.

Identifiers are split by their aggregated frequency: those seen once pass straight on, only repeated ones are ranked, and
both are put together. The same aggregation, in the tasks first, finds the first copy of every identifier, so ranking a repeated
group is a comparison with that copy: no task ever holds a group, however often a message was sent, and equal copies are counted,
not gathered.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.session import fresh


def _has_id(name: str) -> Column:
    return F.col(name).isNotNull() & (F.col(name).cast("string") != "")


def _whole(df: DataFrame) -> Column:
    """A hash of the whole row; columns that can't be hashed as they are count by their text."""
    return F.xxhash64(*[F.col(c).cast("string") if "map<" in kind or "variant" in kind else F.col(c) for c, kind in df.dtypes])


def rank_copies(df: DataFrame, key: str, order: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(kept, dropped): kept has one row per identifier, the first by `order` (nulls first); dropped all other rows.

    Rows without identifier (null or '') can't be copies of anything and are kept. Rows that tie in every order column are told
    apart by a hash of the whole row, so a stage that runs again decides alike; of wholly equal rows exactly one is kept. Extra
    columns pass through whatever their names. An empty table gives two empty ones.
    """
    many, first, rank, n, row = (fresh(df, f"_ll_{x}") for x in ("many", "first", "rank", "n", "row"))
    place = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], _whole(df).alias("whole"))
    counts = df.where(_has_id(key)).groupBy(F.col(key).alias(many)).agg(F.count(F.lit(1)).alias(n), F.min(place).alias(first))
    repeated = counts.where(F.col(n) > 1).select(many, first)
    marked = df.select("*", place.alias(rank)).join(repeated, F.col(key) == F.col(many), "left")
    singles = marked.where(F.col(many).isNull()).select(*df.columns)
    leads = F.col(rank).eqNullSafe(F.col(first))
    copies = marked.where(F.col(many).isNotNull())
    winners = copies.where(leads).groupBy(many).agg(F.any_value(F.struct(*df.columns)).alias(row), F.count(F.lit(1)).alias(n))
    fields = [F.col(f"{row}.{c}").alias(c) for c in df.columns]
    kept = singles.unionByName(winners.select(*fields))
    spare = winners.where(F.col(n) > 1).withColumn(n, F.explode(F.sequence(F.lit(2).cast("long"), F.col(n)))).select(*fields)
    return kept, copies.where(~leads).select(*df.columns).unionByName(spare)


def keep_one(stored: DataFrame, new: DataFrame | None, key: str, order: Sequence[str]) -> DataFrame:
    """One copy of each message over what is stored and what has come in; a stored copy wins over a new one."""
    if new is None:
        return rank_copies(stored, key, order)[0]
    age = fresh(stored, "_ll_age")
    both = stored.withColumn(age, F.lit(0)).unionByName(new.withColumn(age, F.lit(1)), allowMissingColumns=True)
    return rank_copies(both, key, [age, *order])[0].drop(age)
