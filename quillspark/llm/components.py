"""Connected components of a link table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import written


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    moved = links.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def connected(links: DataFrame, rounds: int = 60) -> DataFrame:
    """``a, b`` with b the smallest node that a reaches, for each node a of ``links (a, b)`` but the smallest ones.

    Each round joins every node to the least node next to it (a minimum per node, never a list of neighbours) and is
    written to the shared folder, so a lost executor costs one round. The number of rounds grows with the logarithm of the
    longest chain; beyond ``rounds`` an error is raised.
    """
    order = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    now, mark = written(order, "links"), None
    for _ in range(rounds):
        then = written(_small_star(_large_star(now)), "links")
        # One row: equal marks mean equal link sets.
        seen = then.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first()
        if seen == mark:
            return then
        now, mark = then, seen
    raise RuntimeError(f"components did not settle in {rounds} rounds")
