"""Pairwise matches to groups: minimum labels across edges, pointer jumping, and contraction round by round.

Each round every node takes the smallest id among itself and its neighbours, pointers are jumped until they stand still, and the
edges are rewritten to the labels: what fell together disappears, the rest is deduplicated and goes into the next round. A
round leaves at most half of the linked nodes, so all rounds together move little more than the first. Every round is written
to the shared folder. A node that holds much of the edges is summed up map-side before its minimum is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.session import cut


def accepted(decision: Column) -> Column:
    return F.lower(F.regexp_replace(decision, r"^[\s ]+|[\s ]+$", "")) == "accepted"


#: A table of counted size up to this is broadcast; one of an eighth of it is kept in one partition.
SMALL_ROWS = 200_000


def _side(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= SMALL_ROWS else df


def _kept(df: DataFrame, rows: int) -> DataFrame:
    return cut(df.coalesce(1) if rows <= SMALL_ROWS // 8 else df)


def _jump(labels: DataFrame, rows: int) -> DataFrame:
    """node -> root, by doubling pointers; labels has at most `rows` rows. Only pointers to nodes that don't point on themselves move."""
    while True:
        on = labels.select(F.col("node").alias("_ll_via"), F.col("label").alias("_ll_next")).where("_ll_via <> _ll_next")
        moved = labels.join(_side(on, rows), F.col("label") == F.col("_ll_via"), "left")
        labels = _kept(moved.select("node", F.coalesce("_ll_next", "label").alias("label"), F.col("_ll_next").isNotNull().alias("moved")), rows)
        if labels.where("moved").isEmpty():
            return labels.select("node", "label")


def groups(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """node, group: the smallest id (by bytes) that a node reaches over pairs in either direction.

    Pairs with a null or empty id, and of an id with itself, link nothing; a node without other pairs is left out. Repeated
    pairs change nothing. An empty table gives no rows.
    """
    ends = pairs.select(F.col(left).alias("a"), F.col(right).alias("b")).where("a <> '' and b <> '' and a <> b")
    edges = cut(ends.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    rounds: list[DataFrame] = []
    while n := edges.count():
        both = edges.select(F.col("a").alias("node"), F.col("a").alias("label")).union(edges.select(F.col("b").alias("node"), F.col("a").alias("label")))
        labels = _jump(_kept(both.groupBy("node").agg(F.min("label").alias("label")), 2 * n), 2 * n)
        rounds.append(labels)
        to_a, to_b = (labels.select(F.col("node").alias(x), F.col("label").alias(f"l{x}")) for x in "ab")
        moved = edges.join(_side(to_a, 2 * n), "a").join(_side(to_b, 2 * n), "b").where("la <> lb")
        edges = _kept(moved.select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).distinct(), n)
    if not rounds:
        return ends.select(F.col("a").alias("node"), F.col("a").alias("group")).limit(0)
    out = rounds[-1]
    for earlier in reversed(rounds[:-1]):
        later = out.select(F.col("node").alias("_ll_via"), F.col("label").alias("_ll_next"))
        out = earlier.join(later, F.col("label") == F.col("_ll_via"), "left").select("node", F.coalesce("_ll_next", "label").alias("label"))
    return out.select("node", F.col("label").alias("group"))
