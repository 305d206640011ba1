"""Roots, depths and ancestors over parent pointers that may run into cycles, by pointer doubling.

A round doubles the distance that every pointer spans, so a chain of n records takes log2(n) rounds. Records whose pointers never
come to an end hang on a cycle: the records that their pointers name once they span more than all of them are exactly those on
cycles. With these opened, every record has one root and one depth, and an ancestor at a given depth is found by one join per
binary digit of the distance.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.session import cut, cut_counted


def _doubled(pointers: DataFrame, all_pointers: DataFrame) -> DataFrame:
    """pointers (node, to, steps, low) moved on by those of the nodes they name; moved is false where they name one without pointer."""
    on = all_pointers.select(F.col("node").alias("_via"), F.col("to").alias("_to"), F.col("steps").alias("_steps"), F.col("low").alias("_low"), F.col("done").alias("_done"))
    both = pointers.join(on, F.col("to") == F.col("_via"), "left")
    return both.select("node", F.coalesce("_to", "to").alias("to"), (F.col("steps") + F.coalesce("_steps", F.lit(0))).alias("steps"), F.least("low", "_low").alias("low"), F.coalesce("_done", F.lit(True)).alias("done"))


def forest(parents: DataFrame) -> DataFrame:
    """node, parent, root, depth, cycle: one row per node of `parents` (node, parent; nodes distinct, none null).

    Nodes on a cycle are roots of depth 0 here, with the smallest id of their cycle as `cycle` and a null parent; so what hangs
    below a cycle has the node where its way up enters it as root. cycle is null elsewhere. Nodes that only occur as parents have
    no row: they are roots. An empty table gives no rows.
    """
    pointers, n = cut_counted(parents.select("node", F.col("parent").alias("to"), F.lit(1).cast("long").alias("steps"), F.col("node").alias("low"), F.lit(False).alias("done")))
    settled, open_rows, left = pointers.where("done"), pointers, n
    while left:
        known = settled.unionByName(open_rows)
        moved, _ = cut_counted(_doubled(open_rows, known))
        settled = settled.unionByName(moved.where("done"))
        open_rows = moved.where("not done")
        before, left = left, open_rows.count()
        if left == before:  # depths have no gaps, so nothing that is left comes to an end
            break
    if not left:
        return parents.join(settled.select("node", F.col("to").alias("root"), F.col("steps").alias("depth")), "node").select("node", "parent", "root", "depth", F.lit(None).cast(parents.schema["node"].dataType).alias("cycle"))
    spans = 1
    looping = cut(parents.join(open_rows.select("node"), "node", "left_semi").select("node", F.col("parent").alias("to"), F.lit(1).cast("long").alias("steps"), F.col("node").alias("low"), F.lit(False).alias("done")))
    while spans < left:
        looping, spans = cut(_doubled(looping, looping)), 2 * spans
    on_cycle = looping.select(F.col("to").alias("node")).distinct()
    cycles = cut(looping.join(on_cycle, "node", "left_semi").select("node", F.col("low").alias("cycle")))
    opened = parents.join(cycles.select("node"), "node", "left_anti")
    tree = forest(opened)
    roots = cycles.select("node", F.lit(None).cast(parents.schema["parent"].dataType).alias("parent"), F.col("node").alias("root"), F.lit(0).cast("long").alias("depth"), "cycle")
    return tree.unionByName(roots)


def reaches(pairs: DataFrame, tree: DataFrame, below: str, above: str) -> DataFrame:
    """The distinct pairs (below, above) whose `above` is met on the way up from `below`, `below` itself included.

    tree: a result of `forest`. On a cycle every node is met from every other, and from all that hangs below it.
    """
    up = tree.select("node", F.col("root").alias("_root"), F.col("depth").alias("_depth"), F.col("cycle").alias("_cycle"))
    low, high = (up.select(*[F.col(c).alias(f"{c}_{s}") for c in up.columns]) for s in ("b", "a"))
    asked = pairs.select(F.col(below).alias("below"), F.col(above).alias("above")).distinct()
    asked = asked.join(low, F.col("below") == F.col("node_b"), "left").join(high, F.col("above") == F.col("node_a"), "left")
    asked = asked.select("below", "above", F.coalesce("_root_b", "below").alias("root_b"), F.coalesce("_root_a", "above").alias("root_a"), (F.coalesce("_depth_b", F.lit(0)) - F.coalesce("_depth_a", F.lit(0))).alias("steps"), F.col("_cycle_a").alias("cycle_a"))
    ring = tree.where("cycle is not null").select(F.col("node").alias("root_b"), F.col("cycle").alias("cycle_b"))
    asked = cut(asked.join(ring, "root_b", "left"))
    hits = asked.where("below = above or cycle_a = cycle_b").select("below", "above")
    walk = asked.where("below <> above and root_a = root_b and steps > 0 and (cycle_a is null or cycle_b is null or cycle_a <> cycle_b)").select("below", "above", F.col("below").alias("at"), "steps")
    most = walk.agg(F.max("steps")).first()[0] or 0
    step = tree.where("parent is not null").select(F.col("node").alias("at"), F.col("parent").alias("_to"))
    digit = 0
    while most >> digit:
        odd = F.shiftright("steps", digit).bitwiseAND(1) == 1
        moved = walk.where(odd).join(step, "at").select("below", "above", F.col("_to").alias("at"), "steps")
        walk = cut(walk.where(~odd).unionByName(moved))
        digit += 1
        if most >> digit:
            on = step.select(F.col("at").alias("_to"), F.col("_to").alias("_on"))
            step = cut(step.join(on, "_to").select("at", F.col("_on").alias("_to")))
    return hits.unionByName(walk.where("at = above").select("below", "above")).distinct()
