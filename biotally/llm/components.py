"""Connected components of a table of links, by alternating large-star and small-star rounds.

Every round is two joins and two groupings over the links; a hub's many rows are joined against one row with its
smallest neighbour, which adaptive execution splits, and smallest values are combined before the shuffle. State is
written to the shared checkpoint folder after each round, so a lost executor costs one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from biotally.session import cut_lineage


def _signature(links: DataFrame) -> tuple:
    r = links.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo") % 2147483647), F.count_if(F.col("hi") == F.col("lo"))).first()
    return tuple(r)


def _star(links: DataFrame, both_ways: bool) -> DataFrame:
    """Large star (``both_ways``): larger neighbours move to the smallest neighbour. Small star: the smaller ones do."""
    if both_ways:
        seen = links.unionByName(links.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
        least = seen.groupBy("hi").agg(F.min("lo").alias("m")).select(F.col("hi").alias("node"), F.least("hi", "m").alias("m"))
        moved = links.join(least, F.col("lo") == F.col("node")).select("hi", F.col("m").alias("lo"))  # hi > lo: hi is the larger neighbour of lo
        return moved.where(F.col("hi") > F.col("lo")).distinct()
    least = links.groupBy("hi").agg(F.min("lo").alias("m")).withColumnRenamed("hi", "node")
    moved = links.join(least, F.col("hi") == F.col("node")).where(F.col("lo") != F.col("m")).select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
    return moved.unionByName(least.select(F.col("node").alias("hi"), F.col("m").alias("lo"))).distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node that has a link; root is the smallest node reachable.

    Links of a node to itself and null ends are ignored; repeated links count once; an empty table gives none.
    """
    now = links.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).where(F.col("hi") > F.col("lo")).where(F.col(a).isNotNull() & F.col(b).isNotNull()).distinct()
    now = cut_lineage(now)
    before = _signature(now)
    while before[0]:
        now = cut_lineage(_star(cut_lineage(_star(now, True)), False))
        after = _signature(now)
        if after == before:
            break
        before = after
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionByName(now.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())
