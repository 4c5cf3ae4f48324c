"""Connected components of an edge table by alternating large-star and small-star steps.

Edges run down, from the larger node to the smaller.  Each step replaces them by edges to the
smallest neighbour seen, so the edge count never grows and the loop ends after a number of rounds
that is logarithmic in the component size.  The smallest neighbours are one row per node, and the
joins that hand them to a hub's edges can be split within the hub.  Every round is written to the
shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fernlake.plans.scratch import Scratch
from fernlake.plans.skew import dealt_anew


def _least(down: DataFrame, node: str) -> DataFrame:
    """(node, m): the smallest neighbour of each node that has a smaller one."""
    return dealt_anew(down.groupBy(F.col("a").alias(node)).agg(F.min("b").alias("m")), node)


def _large_star(down: DataFrame) -> DataFrame:
    """Each larger neighbour of a node gets an edge to the smallest of the node and its neighbours."""
    return down.join(_least(down, "b"), "b", "left").select("a", F.coalesce("m", "b").alias("b"))


def _small_star(down: DataFrame) -> DataFrame:
    """Each smaller neighbour of a node, and the node, get an edge to the smallest neighbour."""
    rows = down.join(_least(down, "a"), "a")
    return rows.select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60, sweep: bool = False) -> DataFrame:
    """(node, component) for every node that has an edge; component = smallest node of it.

    Ids are of one orderable type.  Edges with a null end and self loops link nothing; repeated
    edges count once; an empty table gives an empty result.  `sweep` is that of `Scratch`.
    """
    spark = edges.sparkSession
    with Scratch(spark, sweep) as scratch:
        linked = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
        down = linked.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
        cur = scratch.keep(_small_star(down), "edges")
        before = None
        for _ in range(max_rounds):
            after = cur.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
            if after == before or not after[0]:
                break
            before = after
            new = scratch.keep(_small_star(_large_star(cur)), "edges")
            scratch.drop(cur)
            cur = new
        else:
            raise RuntimeError("components did not settle")
        nodes = cur.select(F.col("a").alias("node"), F.col("b").alias("component"))
        roots = cur.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
        return scratch.keep(nodes.union(roots), "components", last=True)
