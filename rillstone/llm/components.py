"""Connected components of a graph held as edges, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillstone.runtime import cut

#: The stars halve paths each round; more rounds than this mean a fault.
MAX_ROUNDS = 60
#: Nodes of more edges than this, or than a hundred-thousandth of all edges, aren't joined by a shuffle: at most 100,000 of them are broadcast.
HOT = 100_000


def _told(edges: DataFrame, least: DataFrame, hot: int | None) -> DataFrame:
    """`edges` (a, b) with m, the least that `least` (k, m, n) gives for a."""
    if hot is None:
        return edges.join(least, F.col("a") == F.col("k")).select("a", "b", "m")
    # a crowded node's edges stay where they are
    least = cut(least)
    crowded = F.broadcast(least.where(F.col("n") > hot))
    rest = edges.join(crowded.select("k"), F.col("a") == F.col("k"), "left_anti").join(least, F.col("a") == F.col("k"))
    return rest.select("a", "b", "m").unionAll(edges.join(crowded, F.col("a") == F.col("k")).select("a", "b", "m"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of the edges (a, b); root is the least node of its component.

    In turn, each node's larger neighbours and then its smaller ones are tied
    to the least node it sees. The edges end as stars around the roots. Rounds
    are checkpointed; only a count and a sum reach the driver.
    """
    now = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    state = None
    for _ in range(MAX_ROUNDS):
        # no node has more edges than there are
        size = state[0] if state is not None else now.count()
        hot = max(HOT, size // 100_000) if 2 * size > HOT else None
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"), "n")
        large = _told(both, least, hot).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # now every edge leads down, a > b
        low = large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")).withColumnRenamed("a", "k")
        small = _told(large, low, hot).select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e"))
        now = cut(small.select("e.a", "e.b").where("a <> b").distinct())
        before, state = state, now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
            return roots.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
    raise RuntimeError("components did not settle")
