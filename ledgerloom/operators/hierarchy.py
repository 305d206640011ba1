"""Parent-child rows to full hierarchies, level by level from the roots.

Each round joins the frontier to the edges that leave it. A frontier whose rows, times the ids that each carries, are few is
broadcast; a larger one is shuffled, and the adaptive skew split divides a parent that holds much of the table. Edges whose
child was reached are dropped from the table when the rest has halved, so all rounds together read little more than a constant
number of tables. Once few edges are left, no frontier can be larger than they are, and a round joins several levels in a row
before it is written. Nodes that no round reaches hang on a cycle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.timestamps import stripped
from ledgerloom.session import cut, cut_counted

#: Ids in a frontier, or rows of the remaining edges, that are small for any executor: some 10 MB.
SMALL_IDS = 200_000
#: Levels that one round joins when few edges are left.
LEVELS = 12


def edges_of(df: DataFrame, node: str, parent: str) -> DataFrame:
    """One row per node: node, parent (trimmed; null where there is none). Rows without node id are no nodes.

    A node that repeats keeps its smallest parent id, so contradicting repeats have a defined result.
    """
    trimmed = stripped(F.col(parent))
    pairs = df.select(F.col(node).alias("node"), F.when(trimmed != "", trimmed).alias("parent")).where("node is not null and node <> ''")
    return pairs.groupBy("node").agg(F.min("parent").alias("parent"))


def _small(df: DataFrame, rows: int) -> DataFrame:
    return df.coalesce(1) if rows <= SMALL_IDS // 8 else df


def _below(edges: DataFrame, frontier: DataFrame, small: bool, with_path: bool) -> DataFrame:
    """The children of a frontier: node, parent, root, depth and path."""
    tops = frontier.select(F.col("node").alias("_ll_top"), "root", "depth", *(["path"] if with_path else []))
    joined = edges.select("node", "parent").join(F.broadcast(tops) if small else tops, F.col("parent") == F.col("_ll_top"))
    return joined.select("node", "parent", "root", (F.col("depth") + 1).alias("depth"), *([F.concat("path", F.array("node")).alias("path")] if with_path else []))


def _levels_below(edges: DataFrame, frontier: DataFrame, with_path: bool) -> DataFrame:
    """The nodes of the next LEVELS levels below a frontier, from few edges, which are sent out once and looked up level by level."""
    step = F.broadcast(edges.select(F.col("parent").alias("_ll_up"), F.col("node").alias("_ll_down")))
    rows = frontier.select(F.col("node").alias("_ll_0"), "root", "depth", *(["path"] if with_path else []))
    for n in range(1, LEVELS + 1):
        rows = rows.join(step, F.col(f"_ll_{n - 1}") == F.col("_ll_up"), "left").withColumnRenamed("_ll_down", f"_ll_{n}").drop("_ll_up")
    line = F.array(*[f"_ll_{n}" for n in range(LEVELS + 1)])
    spread = rows.select("root", "depth", line.alias("_ll_line"), *(["path"] if with_path else []), F.posexplode(line).alias("_ll_n", "node")).where("_ll_n > 0 and node is not null")
    parent, path = F.get("_ll_line", F.col("_ll_n") - 1), [F.concat("path", F.slice("_ll_line", 2, F.col("_ll_n"))).alias("path")] if with_path else []
    return spread.select("node", parent.alias("parent"), "root", (F.col("depth") + F.col("_ll_n")).alias("depth"), *path).dropDuplicates(["node"])


def hierarchy(df: DataFrame, node: str, parent: str, with_path: bool = True) -> DataFrame:
    """node, parent, root, depth, is_cyclic and, if asked for, path (array of ids from root to node), one row per node.

    parent is null where it names no node: such a row is a root of depth 0. Nodes on a cycle, their own parent included, or below
    one have root '', depth -1 and an empty path. An empty table gives no rows.
    """
    nodes = cut(edges_of(df, node, parent))
    known = nodes.select(F.col("node").alias("_ll_known"))
    linked = cut(nodes.join(known, F.col("parent") == F.col("_ll_known"), "left").select("node", F.col("_ll_known").alias("parent")))
    start = linked.where("parent is null").select("node", "parent", F.col("node").alias("root"), F.lit(0).alias("depth"))
    if with_path:
        start = start.withColumn("path", F.array("node"))
    edges = linked.where("parent is not null")
    n_edges, n_frontier = edges.count(), start.count()
    tree, levels, frontier, depth, reached = start, [], start, 0, 0
    while n_edges > reached and n_frontier:
        left = n_edges - reached
        ids = 2 + (depth + LEVELS if with_path else 0)  # that a row of this round's frontiers carries
        if left * ids <= SMALL_IDS:
            below, n_below = cut_counted(_levels_below(_small(edges, left), _small(frontier, n_frontier), with_path))
            depth += LEVELS
            frontier = below.where(F.col("depth") == depth)
            n_frontier = frontier.count()
        else:
            below, n_below = cut_counted(_small(_below(edges, frontier, n_frontier * ids <= SMALL_IDS, with_path), n_edges))
            depth += 1
            frontier, n_frontier = below, n_below
        reached += n_below
        levels.append(below)
        if 2 * reached >= n_edges > reached and n_frontier:
            done = _merged(levels).select("node")
            edges, n_edges = cut_counted(_small(edges.join(F.broadcast(done) if reached <= SMALL_IDS else done, "node", "left_anti"), n_edges - reached))
            tree, levels, reached = _merged([tree, *levels]), [], 0
    tree = _merged([tree, *levels])
    if n_edges > reached:
        done = _merged(levels).select("node") if levels else None
        rest = edges.join(done, "node", "left_anti") if levels else edges
        tree = tree.unionByName(rest.select("node", "parent", F.lit("").alias("root"), F.lit(-1).alias("depth"), *([F.array().cast("array<string>").alias("path")] if with_path else [])))
    return tree.withColumn("is_cyclic", F.col("depth") < 0)


def _merged(levels: list[DataFrame]) -> DataFrame:
    out = levels[0]
    for level in levels[1:]:
        out = out.union(level)
    return out


def descendants(tree: DataFrame) -> DataFrame:
    """ancestor, descendant, steps: every pair on a path, from the result of hierarchy(with_path=True). A node is no descendant of itself."""
    pairs = tree.select(F.col("node").alias("descendant"), "depth", F.posexplode("path").alias("_ll_i", "ancestor"))
    return pairs.where(F.col("_ll_i") < F.col("depth")).select("ancestor", "descendant", (F.col("depth") - F.col("_ll_i")).alias("steps"))
