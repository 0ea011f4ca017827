"""Connected components over an edge table, without collecting links anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import remove, written


#: Edges of a node from which on it is a hub, and hubs whose minima are broadcast, some 10 MB.
HUB, MOST_HUBS = 100_000, 200_000


def _with_least(edges: DataFrame, node: str, other: str, hub: int = HUB) -> tuple[DataFrame, str]:
    """(edges with `m`, the least `other` of each node; the path of the table of minima, to be removed once the result is written).

    Minima and degrees are partial sums. Joining them back would bring all edges of a hub to one task, so edges of hubs, a counted list of at most MOST_HUBS, stay
    where they are and get their minimum from a broadcast; only the others are dealt by node. Beyond that number hubs are dealt as well; the minima are a
    table by then, so Spark can split a hub's partition.
    """
    low, path = written(edges.groupBy(node).agg(F.min(other).alias("m"), F.count("*").alias("n")), "least")
    hubs = low.where(F.col("n") > hub).select(node, F.col("m").alias("of_hub"))
    if not 0 < hubs.count() <= MOST_HUBS:
        return edges.join(low.drop("n"), node), path
    marked = edges.join(F.broadcast(hubs), node, "left")
    rest = marked.where("of_hub is null").drop("of_hub").join(low.where(F.col("n") <= hub).drop("n"), node)
    return rest.unionByName(marked.where("of_hub is not null").withColumnRenamed("of_hub", "m")), path


def _large_star(edges: DataFrame, hub: int) -> tuple[DataFrame, str]:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    named, path = _with_least(both, "u", "v", hub)
    return named.where("v > u").select(F.col("v").alias("a"), F.least("u", "m").alias("b")).distinct(), path


def _small_star(edges: DataFrame, hub: int) -> tuple[DataFrame, str]:
    named, path = _with_least(edges, "a", "b", hub)
    return named.select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).distinct(), path


def connected_components(edges: DataFrame, most_rounds: int = 60, hub: int = HUB) -> DataFrame:
    """Rows (node, component) for every node of edges (a, b longs); component is the smallest node reachable.

    Alternating large-star and small-star rounds (Kiveris et al. 2014), each written to the shared folder. A node with more than `hub` edges
    is not dealt by node, see _with_least, so its neighbours meet in no task. Self links are dropped; an empty table gives an empty result.
    """
    spark = edges.sparkSession
    start = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, path = written(start, "components")
    mark = None
    for _ in range(most_rounds):
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == mark or not seen[0]:
            break
        mark = seen
        for star in (_large_star, _small_star):
            made, least = star(now, hub)
            after, at = written(made, "components")
            remove(spark, path, least)
            now, path = after, at
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
