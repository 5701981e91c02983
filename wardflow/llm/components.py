"""Connected components of an edge list, by alternating large-star and small-star rounds.

Every round is two aggregations and two joins over the edges; the edge list is
written to the shared folder after each round, so lineage stays short and a
lost executor rereads files.  The smallest neighbours are written before they are
joined back, so that both sides of the join are plain exchanges and the partition
of a hub, which may hold most edges, can be split.  Only two numbers a round reach
the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardflow.session import write_table

MAX_ROUNDS = 60


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("b", "a")).toDF("u", "v")
    least = write_table(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a != b")


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = write_table(down.groupBy("u").agg(F.min("v").alias("m")))
    moved = down.join(least, "u").where("v != m").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of ``edges(a, b)``; the component is its smallest node.

    An empty edge list gives an empty result.  Self loops, repeated edges and
    edges with a null end do not matter; a node that only has self loops is not
    returned.
    """
    now = write_table(edges.select(F.col("a").cast("long"), F.col("b").cast("long"))
                      .where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    for _ in range(MAX_ROUNDS):
        now = write_table(_small_star(_large_star(now).distinct()).distinct())
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
                now.select("b", "b").distinct()
            )
        seen = state
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
