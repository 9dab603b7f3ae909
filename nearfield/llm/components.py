"""Connected components of a table of links, by DataFrame operations alone.

Large-star and small-star steps in turn: each hangs the neighbours of a node below the least of them,
until every node hangs below the least node of its component. Each table is written to the shared
folder, so plans stay short and lost executors cost one step. A node with very many links is met in
joins whose sides are both plain exchanges, which AQE splits; minima are combined before the shuffle.

The steps are many, so over few links nearly all the time would go to tasks with next to no rows. The links
are counted each round anyway: while they are ``FEW`` at most, a step is one task without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm._shared import drop_staged, stage

#: Links up to which a step is one task; some ten MB of rows.
FEW = 1 << 17


def _star(edges: DataFrame, large: bool, few: bool = False) -> DataFrame:
    """One step over edges (a, b) with a > b; in one task if they are few."""
    if few:
        edges = edges.coalesce(1)
    seen = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    # A union of single partitions is several, hence the other coalesces.
    seen = seen.coalesce(1) if few else seen
    least = stage(seen.groupBy("a").agg(F.min("b").alias("least")), "cc-least").withColumnRenamed("a", "node")
    least = least.coalesce(1) if few else least
    met = seen.join(least, F.col("a") == F.col("node"))
    if large:
        # Neighbours above the node move below the least of the neighbours and itself.
        moved = met.where("b > a").select(F.col("b").alias("a"), F.least("a", "least").alias("b"))
    else:
        # Neighbours below the node move below their least; so does the node.
        moved = met.select(F.explode(F.array("a", "b")).alias("a"), F.col("least").alias("b"))
    out = stage(moved.where("a != b").distinct(), "cc-edges")
    drop_staged(least)
    return out


def _print(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node with a link; the component is its least node.

    `links` has columns a and b of one orderable type; loops, repeats and either direction are fine.
    """
    edges = stage(links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc-links")
    before = _print(edges)
    for _ in range(most_rounds):
        few = before[0] <= FEW
        large = _star(edges, True, few)
        small = _star(large, False, few)
        drop_staged(edges)
        drop_staged(large)
        edges, after = small, _print(small)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("b").alias("node")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))
