"""Breadth-first search that stops when it has its answer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillstone.operators.bodies import without
from rillstone.operators.fixpoint import BROADCAST_CELLS, COMPACT_AFTER, STEPS, DidNotSettle, union
from rillstone.runtime import adaptive, cut, cut_counted


def shortest_lengths(arcs: DataFrame, pairs: DataFrame, max_rounds: int = 10_000) -> DataFrame:
    """(source, target, length) of each distinct pair: steps along arcs (x, y), -1 where there is no way.

    `pairs` has source and target. Each round goes one step from the places
    that the round before reached first, for the sources that still miss a
    target; a source whose targets are all reached goes no further. Nulls
    match nothing. Few places are held against the targets some levels at a time.
    """
    return _search(arcs, pairs, max_rounds)[0]


def _search(arcs: DataFrame, pairs: DataFrame, max_rounds: int) -> tuple[DataFrame, list[DataFrame]]:
    """The lengths, and (source, at, via) of each level's places: `via` is the least place of the level before that leads there."""
    spark = arcs.sparkSession
    wide = int(spark.conf.get("spark.sql.shuffle.partitions"))
    arcs = arcs.select(F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y")).where("x is not null and y is not null").distinct()
    pairs = cut(pairs.select(F.col("source").cast("long").alias("source"), F.col("target").cast("long").alias("target")).distinct())
    with adaptive(spark, False):
        # dealt once: steps and the places seen meet them where they are
        arcs = cut(arcs.repartition(wide, "x").sortWithinPartitions("x"))
        missing = cut(pairs.where("source is not null and target is not null").repartition(wide, "source", "target"))
        frontier, n = cut_counted(pairs.where("source is not null").select("source", F.col("source").alias("at")).distinct().repartition(wide, "source", "at").withColumn("via", F.lit(None).cast("long")))
    seen, found, levels = [frontier.select("source", "at")], [], [frontier]
    pending, held = [], 0  # levels whose places weren't held against the targets yet, and their rows
    for level in range(max_rounds):
        few = 2 * n <= BROADCAST_CELLS
        if n:
            pending.append(frontier.select("source", F.col("at").alias("target"), F.lit(level).cast("long").alias("length")))
            held += n
        # a job for each level costs more than going on from few places for some levels too many
        if pending and (not n or not few or len(pending) == STEPS or level == max_rounds - 1):
            with adaptive(spark, 2 * held > STEPS * BROADCAST_CELLS):
                hit, hits = cut_counted(missing.join(union(pending), ["source", "target"]).select("source", "target", "length"))
                if hits:
                    found.append(hit)
                    missing = cut(missing.join(hit, ["source", "target"], "left_anti"))
                    # sources with nothing left to find drop out
                    frontier = frontier.join(missing.select("source").distinct(), "source", "left_semi")
            pending, held = [], 0
        if n:
            with adaptive(spark, not few):
                reached = (F.broadcast(frontier) if few else frontier).join(arcs, F.col("at") == F.col("x")).groupBy("source", F.col("y").alias("at")).agg(F.min("x").alias("via"))
                # few are grouped without adaptive steps, which leaves them dealt
                frontier, n = cut_counted(without(reached if few else reached.repartition(wide, "source", "at"), union(seen), ["source", "at"], few))
        if not n and not pending:
            lengths = union(found) if found else pairs.withColumn("length", F.lit(0).cast("long")).limit(0)
            rest = pairs.join(lengths, (pairs["source"].eqNullSafe(lengths["source"])) & (pairs["target"].eqNullSafe(lengths["target"])), "left_anti")
            return lengths.unionByName(rest.withColumn("length", F.lit(-1).cast("long"))), levels
        if n:
            seen.append(frontier.select("source", "at"))
            levels.append(frontier)
        if len(seen) > COMPACT_AFTER:
            with adaptive(spark, False):
                seen = [cut(union(seen))]
    raise DidNotSettle(f"the search after {max_rounds} rounds")


def shortest_paths(arcs: DataFrame, pairs: DataFrame, max_rounds: int = 10_000) -> DataFrame:
    """(source, target, path) of each distinct pair: the places on a shortest way, null where there is none.

    Of several shortest ways the one whose last place but one is least, and so
    on backwards. `pairs` as for `shortest_lengths`, whose search keeps by which
    place each one was reached: from each target the way goes back by these.
    """
    spark = arcs.sparkSession
    lengths, levels = _search(arcs, pairs, max_rounds)
    with adaptive(spark, False):
        # the levels stay where they are; the ways are dealt anew for each step
        lengths = cut(lengths.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "source", "target"))
        begun = lengths.select("source", "target", F.col("target").alias("head"), F.array("target").alias("path"), "length")
        longest = max(0, lengths.agg(F.max("length")).first()[0] or 0)
        ways = begun.where(F.col("length") == longest).drop("length")
        for level in range(longest, 0, -1):
            step = levels[level].select(F.col("source").alias("s"), F.col("at").alias("a"), "via")
            ways = ways.join(step, (F.col("source") == F.col("s")) & (F.col("head") == F.col("a"))).select("source", "target", F.col("via").alias("head"), F.concat(F.array("via"), "path").alias("path"))
            ways = ways.unionByName(begun.where(F.col("length") == level - 1).drop("length"))
            if level % STEPS == 1:
                ways = cut(ways)
    return lengths.join(ways.select(F.col("source").alias("s"), F.col("target").alias("t"), "path"), F.col("source").eqNullSafe(F.col("s")) & F.col("target").eqNullSafe(F.col("t")), "left").select("source", "target", "path")
