"""Attributes as known at the time of an event, by equi-joins on dyadic time nodes.

Validity intervals are half-open. The time axis is cut into 2^levels units, and every interval into the few nodes of the binary
tree over those units that cover it; a point lies in exactly one node of each level. Points and intervals are thus joined on
equality of (entity, node), with no range join, and the exact half-open bounds decide among what a unit holds. The levels that an entity's intervals
use are summed up in a bit mask, so that a point emits only the nodes that can match.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEVELS = 10
NEVER = (1 << 62) - 1
#: Versions of one entity are put in order within spans of this length and then across them.
CHUNK_US = 30 * 86_400_000_000


def best_intervals(versions: DataFrame, keys: Sequence[str], known_us: str, rank: Column, chunk_us: int = CHUNK_US) -> DataFrame:
    """keys, valid_from, valid_to, best: for every stretch of time the smallest `rank` (a struct) among rows known by then.

    Precedence is deterministic: rank is compared field by field. Rows whose time is null never become known. The running
    minimum is taken within (entity, span of time) and then across spans, so that an entity with a great many versions is
    spread over tasks.
    """
    rows = versions.select(*keys, F.col(known_us).alias("at"), rank.alias("best")).where("at is not null")
    rows = rows.withColumn("chunk", F.floor(F.col("at") / F.lit(chunk_us)).cast("long")).repartition(*keys, "chunk")
    rows = rows.groupBy(*keys, "chunk", "at").agg(F.min("best").alias("best"))
    inside = Window.partitionBy(*keys, "chunk").orderBy("at")
    across = Window.partitionBy(*keys).orderBy("chunk")
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    chunks = rows.groupBy(*keys, "chunk").agg(F.min("best").alias("top"))
    chunks = chunks.withColumn("prior", F.min("top").over(before)).drop("top")
    same = [F.col(f"r.{k}").eqNullSafe(F.col(f"c.{k}")) for k in (*keys, "chunk")]
    joined = rows.alias("r").join(chunks.alias("c"), same).select("r.*", "c.prior")
    last = F.min("best").over(inside.rowsBetween(Window.unboundedPreceding, -1))
    joined = joined.withColumn("last", F.when(last.isNull(), F.col("prior")).when(F.col("prior").isNull(), last).otherwise(F.least(last, F.col("prior"))))
    steps = joined.where(F.col("last").isNull() | (F.col("best") < F.col("last"))).select(*keys, "chunk", "at", "best")
    steps = steps.withColumn("next", F.lead("at").over(inside))
    firsts = steps.groupBy(*keys, "chunk").agg(F.min("at").alias("first")).withColumn("later", F.lead("first").over(across)).drop("first")
    same = [F.col(f"s.{k}").eqNullSafe(F.col(f"f.{k}")) for k in (*keys, "chunk")]
    out = steps.alias("s").join(firsts.alias("f"), same).select("s.*", "f.later")
    return out.select(*keys, F.col("at").alias("valid_from"), F.coalesce("next", "later", F.lit(NEVER)).alias("valid_to"), "best")


def _unit(us: Column, start_us: int, unit_us: int, levels: int) -> Column:
    """Unit of the axis; times outside of it belong to its first or last unit, which keeps every containment."""
    return F.least(F.greatest(F.floor((us - start_us) / F.lit(unit_us)), F.lit(0)), F.lit((1 << levels) - 1)).cast("int")


def dyadic_nodes(first: Column, last: Column, levels: int) -> Column:
    """array<struct<level, idx>>: the canonical nodes that cover units first..last; level 0 are the units themselves.

    At level l the open ends are a = first rounded up to 2^l and b = last+1 rounded down; the node left of a or right of b is
    taken where the end moves as it is rounded at the next level.
    """
    out = []
    for level in range(levels + 1):
        width, top = 1 << level, level == levels
        low, high = F.shiftright(first + (width - 1), level), F.shiftright(last + 1, level)
        left = (low < high) & (F.lit(True) if top else low % 2 == 1)
        out.append(F.when(left, F.struct(F.lit(level).alias("level"), low.alias("idx"))))
        if not top:
            after = F.shiftright(first + (2 * width - 1), level + 1) * 2
            out.append(F.when((high > low) & (high % 2 == 1) & (high - 1 >= after), F.struct(F.lit(level).alias("level"), (high - 1).alias("idx"))))
    return F.array_compact(F.array(*out))


def time_cells(intervals: DataFrame, keys: Sequence[str], start_us: int, end_us: int, levels: int = LEVELS) -> DataFrame:
    """Intervals as rows of (entity, node), with the time before an entity's first interval as one whose best is null.

    Every instant of an entity thus lies in exactly one interval. The two that are open to one side, at most two of an entity,
    stand at the root of the tree, which covers them with one node instead of many; those between are decomposed. start_us..end_us
    is the span of the axis, which matters for speed only.
    """
    unit = max(1, -(-(end_us - start_us) // (1 << levels)))
    early = intervals.groupBy(*keys).agg(F.min("valid_from").alias("valid_to"))
    empty = F.lit(None).cast(intervals.schema["best"].dataType)
    early = early.select(*keys, F.lit(-NEVER).alias("valid_from"), "valid_to", empty.alias("best"))
    total = intervals.select(*keys, "valid_from", "valid_to", "best").unionByName(early)
    first = _unit(F.col("valid_from"), start_us, unit, levels)
    last = _unit(F.col("valid_to") - 1, start_us, unit, levels)
    root = F.array(F.struct(F.lit(levels).alias("level"), F.lit(0).alias("idx")))
    between = (F.col("valid_from") > -NEVER) & (F.col("valid_to") < NEVER)
    nodes = F.when(between, dyadic_nodes(F.col("first"), F.col("last"), levels)).otherwise(root)
    out = total.withColumns({"first": first, "last": last}).withColumn("node", F.explode(nodes))
    return out.select(*keys, "valid_from", "valid_to", "best", F.col("node.level").alias("level"), F.xxhash64(*keys, "node.level", "node.idx").alias("cell"))


def level_masks(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys and mask: bit l is set if the entity has a cell of level l."""
    return cells.groupBy(*keys).agg(F.expr("bit_or(shiftleft(1, level))").alias("mask"))


def as_known(points: DataFrame, at_us: str, mask: str, cells: DataFrame, keys: Sequence[str], start_us: int, end_us: int, levels: int = LEVELS) -> DataFrame:
    """points without their mask, with `best` of the interval of their entity that holds at_us, null if nothing was known then.

    points have the entity's keys and its level mask, null where the entity has no versions at all. The axis must be that of the
    cells. Points whose time or mask is null get null. Points may repeat; none is lost or repeated by the join, since the
    intervals of an entity cover all time and don't overlap.
    """
    unit = max(1, -(-(end_us - start_us) // (1 << levels)))
    own = [c for c in points.columns if c not in ("best", mask)]
    askable = F.col(at_us).isNotNull() & F.col(mask).isNotNull()
    empty = F.lit(None).cast(cells.schema["best"].dataType)
    nodes = [F.when(F.col(mask).bitwiseAND(1 << n) != 0, F.xxhash64(*keys, F.lit(n), F.shiftright("_ll_unit", n))) for n in range(levels + 1)]
    asked = points.where(askable).withColumn("_ll_unit", _unit(F.col(at_us), start_us, unit, levels)).select(*own, F.explode(F.array_compact(F.array(*nodes))).alias("_ll_cell"))
    side = cells.select(*[F.col(k).alias(f"_ll_{k}") for k in keys], F.col("valid_from").alias("_ll_from"), F.col("valid_to").alias("_ll_to"), F.col("cell").alias("_ll_side"), "best")
    exact = (F.col("_ll_from") <= F.col(at_us)) & (F.col(at_us) < F.col("_ll_to"))
    for k in keys:
        exact = exact & F.col(k).eqNullSafe(F.col(f"_ll_{k}"))
    found = asked.join(side, (F.col("_ll_cell") == F.col("_ll_side")) & exact).select(*own, "best")
    return found.unionByName(points.where(~askable).select(*own, empty.alias("best")))
