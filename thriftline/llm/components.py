"""Connected components of a link table, by alternating star operations.

Each round keeps the components and replaces links by links to smaller nodes: the
large-star step joins a node's larger neighbours to its smallest neighbour, the
small-star step its smaller ones.  Rounds end when every node links straight to the
smallest node of its component.  Neighbourhoods are never gathered: a node's smallest
neighbour is an aggregate that combines before the shuffle, and a hub's links stay
rows of a join that can be split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thriftline.session import written


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    # Links run from the larger node to a smaller one here.
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    moved = links.join(least, "a").where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return least.select("a", F.col("m").alias("b")).unionByName(moved)


def _downward(links: DataFrame) -> DataFrame:
    """Distinct links from the larger node to the smaller one."""
    return (
        links.where(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )


def roots(links: DataFrame) -> DataFrame:
    """``(a, b)`` pairs of nodes to ``(node, root)``, the smallest node of each linked node's component.

    Links to itself and repeated links change nothing; nodes without a link have no
    row; no links give no rows.  Nodes must not be NULL.
    """
    now = written(_downward(links.select("a", "b")), "links")
    while True:
        after = written(_downward(_small_star(_downward(_large_star(now)))), "links")
        # Stars only: nobody is both linked to a smaller node and linked from a larger one.
        centres = after.select(F.col("b").alias("a")).distinct()
        if after.join(centres, "a", "left_semi").isEmpty() and after.groupBy("a").count().where("count > 1").isEmpty():
            return after.select(F.col("a").alias("node"), F.col("b").alias("root"))
        now = after
