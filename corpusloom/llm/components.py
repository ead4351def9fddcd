"""Connected components over a table of links, with DataFrame joins only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, join_sized

#: A join's smaller side is broadcast up to this many rows (and common.BROADCAST_BYTES).
BROADCAST_ROWS = 500_000


def components(links: DataFrame) -> DataFrame:
    """``links(a, b)`` -> ``(node, root)``, root being the smallest node reachable.

    Each round points every node at the least of itself and its neighbours, follows the
    pointers to their ends (each step doubles their reach, so that chains take few) and
    contracts the links onto those ends, until no link is left.  A round is a min with
    map-side combine and joins on single nodes; no neighbourhood is collected.
    Nodes without a link do not appear; NULL ends and self-links are ignored.  A node with
    very many links is no hot key: the side of a join with one row for each node is
    broadcast or dealt out.  Runs jobs when it is called.
    """
    edges = cut(links.where("a <> b").select("a", "b").distinct())
    roots = cut(edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().withColumn("root", F.col("node")))
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        jumped = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("to")))
        moved = True
        while moved:
            onward = jumped.select(F.col("node").alias("to"), F.col("to").alias("next"))
            step = cut(join_sized(jumped, onward, ["to"], BROADCAST_ROWS, counted=True).select("node", F.col("next").alias("to"), (F.col("next") != F.col("to")).alias("moved")))
            moved = not step.where("moved").isEmpty()
            jumped = step.drop("moved")
        ends = join_sized(edges, jumped.select(F.col("node").alias("a"), F.col("to").alias("a2")), ["a"], BROADCAST_ROWS, counted=True)
        edges = cut(
            join_sized(ends, jumped.select(F.col("node").alias("b"), F.col("to").alias("b2")), ["b"], BROADCAST_ROWS)
            .where("a2 <> b2").select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).distinct()
        )
        moves = jumped.where("node <> to").select(F.col("node").alias("root"), "to")
        roots = cut(join_sized(roots, moves, ["root"], BROADCAST_ROWS, "left", counted=True).select("node", F.coalesce("to", "root").alias("root")))
    return roots
