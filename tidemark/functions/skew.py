"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import settle

# A node, key or group is hot when it holds more than one row in HOT_PARTS; there can be at
# most HOT_PARTS such keys, which bounds what may be broadcast for them.
HOT_PARTS = 256

# Largest number of narrow rows that is sent to every executor.
BROADCAST_ROWS = 1_000_000


def lookup(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join ``left`` to ``right`` where ``right`` has one row per key.

    The join is left to adaptive execution, which splits an oversized ``left`` partition and
    sends the matching ``right`` partition to each part. That holds a hot key as long as
    nothing directly above needs the join's own partitioning, so callers aggregate by other
    keys or not at all. ``right`` must be unique: a hot key then never multiplies rows.
    """
    return left.join(right, list(keys), how)


def by_size(
    small: DataFrame, limit: int = BROADCAST_ROWS, weight: Column | None = None
) -> DataFrame:
    """Mark a table for broadcast if its size is at most ``limit``, else leave it.

    The size is the number of rows, or the sum of ``weight`` where rows hold arrays. Spark
    cannot tell the size of an aggregate beforehand and would shuffle the other side, often
    whole field arrays, to meet it. The table is written first and measured, so the decision
    rests on its real size; beyond the limit the join is an ordinary shuffled one.
    """
    settled = settle(small)
    if weight is None:
        size = settled.limit(limit + 1).count()
    else:
        size = settled.agg(F.sum(weight)).first()[0] or 0
    return F.broadcast(settled) if size <= limit else settled
