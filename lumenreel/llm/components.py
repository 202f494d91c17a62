"""Connected components of a link table, by alternating star contractions.

Every round is two joins and two partial aggregates; links are never collected. Each round's links
are written to the shared checkpoint folder, so a lost executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _large_star(e: DataFrame) -> DataFrame:
    both = e.unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = down.groupBy("a").agg(F.min("b").alias("m"))
    joined = down.join(low, "a")
    return joined.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionAll(low.select("a", F.col("m").alias("b"))).distinct()


def connected_components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for each node of `links` (a, b: bigint), component being the smallest node reachable.

    Nodes without a link to another node are not returned. Repeated links, links of a node to itself
    and both directions of a link may occur. No link: no row.
    """
    e = materialize(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    for _ in range(max_rounds):
        e = materialize(_small_star(_large_star(e)))
        # stars only, and the same ones twice: every node points at its root
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        before = now
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
