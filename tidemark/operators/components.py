"""Connected components by alternating star contraction.

Follows the large-star / small-star scheme of Kiveris et al., "Connected Components in
MapReduce and Beyond" (2014). Every round only takes minima per node, so a node with very many
neighbours is combined before the shuffle; looking the minimum up again uses a broadcast for
the few nodes that hold a large share of the edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.skew import HOT_PARTS
from tidemark.session import settle

# Edges per node from which a node is treated as hot; below it one task handles it easily.
HOT_EDGES = 1_000_000


def _with_minimum(edges: DataFrame, total: int) -> DataFrame:
    """``(u, v)`` plus ``m``, the smallest of ``u`` and its neighbours ``v``."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    least = least.withColumn("m", F.least("u", "m"))
    threshold = max(total // HOT_PARTS, HOT_EDGES)
    if total <= threshold:
        return edges.join(least.drop("n"), "u")
    # At most HOT_PARTS nodes can hold more than total / HOT_PARTS edges each.
    hot = F.broadcast(least.filter(F.col("n") > threshold).select("u", F.col("m").alias("hot_m")))
    marked = edges.join(hot, "u", "left")
    cold = (
        marked.filter(F.col("hot_m").isNull())
        .drop("hot_m")
        .join(least.filter(F.col("n") <= threshold).drop("n"), "u")
    )
    return cold.unionByName(
        marked.filter(F.col("hot_m").isNotNull()).withColumnRenamed("hot_m", "m")
    )


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    linked = _with_minimum(both, 2 * total)
    return linked.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    downhill = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    linked = _with_minimum(downhill, total)
    return (
        linked.select(F.col("v").alias("u"), F.col("m").alias("v"))
        .union(linked.select("u", F.col("m").alias("v")))
        .filter(F.col("u") != F.col("v"))
        .distinct()
    )


def _signature(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(
        F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")
    ).first()
    return row["n"], row["x"] or 0


def connected_components(edges: DataFrame, *, max_rounds: int = 200) -> DataFrame:
    """Smallest member of every node's component: ``(node, root)``.

    ``edges`` has columns ``u`` and ``v``; nodes without edges are not listed. Each round is
    checkpointed. Ends when a round changes nothing; raises if ``max_rounds`` is not enough.
    """
    current = settle(
        edges.filter(F.col("u") != F.col("v"))
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
    )
    seen = _signature(current)
    for _ in range(max_rounds):
        if seen[0] == 0:
            break
        current = settle(_small_star(_large_star(current, seen[0]), seen[0]))
        now = _signature(current)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"Components did not settle in {max_rounds} rounds")
    stars = current.select(F.col("u").alias("node"), F.col("v").alias("root"))
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return stars.union(roots)
