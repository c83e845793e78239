"""Connected components of a link table, by hooking to hash-ranked neighbours and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plinth.session import materialize

#: Tables of two numbers a row are broadcast up to this many rows (16 MB); larger ones are joined by shuffle.
BROADCAST_ROWS = 1_000_000
#: Steps up along the hooks in each round.
STEPS = 3


def small(pairs: DataFrame, rows: int) -> DataFrame:
    """``pairs``, of two numbers a row and ``rows`` rows at most, marked for broadcast if that is few."""
    return F.broadcast(pairs) if rows <= BROADCAST_ROWS else pairs


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node that ``links`` (a, b) ties to another; root is the least node of its component.

    In each round every node hooks to its neighbour of least hash, if that is
    under its own; chains of such hooks are short whatever the order of the
    ids, and a few steps along them lead to the nodes that go on. Edges move
    up with their ends, loops and repeats go, and the rounds end with the
    edges, so later rounds work on ever smaller tables. Every round is two
    tables in the shared folder; a hub's edges are combined on the map side.
    """
    a, b = F.col("a").cast("long"), F.col("b").cast("long")
    edges = materialize(links.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).filter("a <> b").distinct(), "cc-edges")
    labels, turn = None, 0
    while rows := edges.count():
        rank = lambda c, t=turn: F.struct(F.xxhash64(F.lit(t), c).alias("k"), c.alias("v"))
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        best = both.groupBy(F.col("a").alias("node")).agg(F.min(rank(F.col("b"))).alias("m"))
        hooks = materialize(best.select("node", F.when(F.col("m") < rank(F.col("node")), F.col("m.v")).otherwise(F.col("node")).alias("up")), "cc-hooks")
        above = small(hooks.select(F.col("node").alias("up"), F.col("up").alias("next")), 2 * rows)
        climbed = hooks
        for _ in range(STEPS):
            climbed = climbed.join(above, "up").select("node", F.col("next").alias("up"))
        climbed = materialize(climbed, "cc-climbed")
        end = lambda name: small(climbed.select(F.col("node").alias(name), F.col("up").alias(f"up_{name}")), 2 * rows)  # noqa: B023, E731
        moved = edges.join(end("a"), "a").join(end("b"), "b").filter("up_a <> up_b")
        edges = materialize(moved.select(F.least("up_a", "up_b").alias("a"), F.greatest("up_a", "up_b").alias("b")).distinct(), "cc-edges")
        if labels is None:
            labels = climbed
        else:
            further = small(climbed.select(F.col("node").alias("up"), F.col("up").alias("next")), 2 * rows)
            labels = labels.join(further, "up", "left").select("node", F.coalesce("next", "up").alias("up"))
        turn += 1
    if labels is None:
        return links.sparkSession.createDataFrame([], "node long, root long")
    least = labels.groupBy("up").agg(F.min("node").alias("root"))
    return labels.join(least, "up").select("node", "root")
