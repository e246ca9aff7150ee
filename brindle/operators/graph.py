"""Bounded expansion of a directed graph, with reasons.

Each level joins a small frontier with the edges in both directions; the edges
are never collected and their plan is the same at every depth.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import ordinal, stage

MAX_DEPTH = 5
#: Nodes of a level that are sent to all tasks, at most; larger levels are shuffled.
SMALL = 100_000
#: Order of reasons that come from one node.
CALLER, CALLEE = 0, 1


def neighbours(edges: DataFrame) -> DataFrame:
    """(node, kind, other): for each edge src -> dst, src is a caller of dst and dst a callee of src."""
    return edges.select(F.col("dst").alias("node"), F.lit(CALLER).alias("kind"), F.col("src").alias("other")).unionByName(
        edges.select(F.col("src").alias("node"), F.lit(CALLEE).alias("kind"), F.col("dst").alias("other"))
    )


def met(level: DataFrame, edges: DataFrame, n: int) -> DataFrame:
    """The neighbours of a level of ``n`` nodes (node, ...); a small level is sent to the edges, not they to it."""
    return neighbours(edges).join(F.broadcast(level) if n <= SMALL else level, "node")


def within(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(id, distance): nodes within ``depth`` of the seeds (``id``), edges taken both ways; edges may repeat."""
    _check(depth)
    reached = level = stage(seeds.select("id").distinct().withColumn("distance", F.lit(0)), "level")
    for distance in range(1, depth + 1):
        if not (n := level.count()):
            break
        found = met(level.select(F.col("id").alias("node")), edges, n).select(F.col("other").alias("id")).distinct()
        level = stage(found.join(reached.select("id"), "id", "left_anti").withColumn("distance", F.lit(distance)), "level")
        reached = reached.unionByName(level)
    return reached


def expand(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(id, distance, place): as ``within``, with what ``reasons`` needs besides.

    ``place`` orders the nodes as a queue meets them: by the place of the node
    that reached them, callers before callees, then by id.
    """
    _check(depth)
    level = stage(ordinal(seeds.select("id").distinct(), "place", "id").withColumn("distance", F.lit(0)).select("id", "distance", "place"), "level")
    reached, before = level, 0
    for distance in range(1, depth + 1):
        n = level.count()
        if not n:
            break
        before += n
        found = met(level.select(F.col("id").alias("node"), F.col("place").alias("from")), edges, n).groupBy(F.col("other").alias("id")).agg(F.min(F.struct("from", "kind", "other")).alias("first"))
        fresh = found.join(reached.select("id"), "id", "left_anti")
        level = stage(ordinal(fresh, "place", "first").select("id", F.lit(distance).alias("distance"), (F.col("place") + before).alias("place")), "level")
        reached = reached.unionByName(level)
    return reached


def _check(depth: int) -> None:
    if not 0 <= depth <= MAX_DEPTH:
        raise ValueError(f"depth must be between 0 and {MAX_DEPTH}")


def reasons(edges: DataFrame, reached: DataFrame, depth: int) -> DataFrame:
    """(id, distance, reasons): why each node was reached, in the order of the queue."""
    inner = reached.where(F.col("distance") < depth).select(F.col("id").alias("node"), F.col("place").alias("from"))
    why = F.when(F.col("kind") == CALLER, F.concat(F.lit("calls "), "node")).otherwise(F.concat(F.lit("called by "), "node"))
    told = inner.join(neighbours(edges), "node").groupBy(F.col("other").alias("id")).agg(F.array_sort(F.collect_set(F.struct("from", "kind", why.alias("why")))).alias("why"))
    listed = F.coalesce(F.transform("why", lambda w: w["why"]), F.array().cast("array<string>"))
    first = F.when(F.col("distance") == 0, F.array(F.lit("requested seed"))).otherwise(F.array().cast("array<string>"))
    return reached.join(told, "id", "left").select("id", "distance", F.concat(first, listed).alias("reasons"))


def frontier(edges: DataFrame, selected: DataFrame) -> DataFrame:
    """(id): neighbours of the selected ids that aren't selected."""
    near = neighbours(edges).join(selected.select(F.col("id").alias("node")), "node", "left_semi").select(F.col("other").alias("id")).distinct()
    return near.join(selected.select("id"), "id", "left_anti")
