"""Exact top-k search by inner product with one KD-tree per shard.

Vectors are dealt to shards of bounded size by a hash of their id. A shard's tree splits at the
median of the widest dimension and keeps the tight box of every node; it is published as a file. The
largest inner product of a query with anything in a box is known, so a search goes best box first and
stops when no box can reach the k-th best score so far.

Every query is first searched in one shard. Its k-th score there is sent along with it to all other
shards, so that they start with a bound. Queries travel to shards in blocks; a shard's tree is read
once for all the blocks that follow each other in a task.
"""

from __future__ import annotations

import heapq
import io
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import Held, publish, scratch, written

SCALE = 1024
SHARD_VECTORS = 4096
LEAF_VECTORS = 32
# Blocks that the queries of a shard are cut into, so that several tasks can search it.
QUERY_BLOCKS = 16
HELD_BYTES = 192 << 20
# Tasks that blocks of queries are dealt to, at most.
TASKS = 20_000

# Sums below this are exact in double precision.
EXACT = 2.0**53
LONG = np.iinfo(np.int64)


class Tree:
    """Median-split tree over the rows of ``vectors``; nodes in heap order of their making."""

    def __init__(self, ids, vectors, low, high, child, first, last):
        self.ids, self.vectors = ids, vectors
        self.low, self.high = low, high  # tight boxes
        self.child = child  # index of the left child, the right one follows; -1 for leaves
        self.first, self.last = first, last  # rows of a leaf
        self.largest = float(np.abs(vectors).max()) if vectors.size else 0.0
        self.bytes = sum(a.nbytes for a in (ids, vectors, low, high, child, first, last))

    @classmethod
    def build(cls, ids: np.ndarray, vectors: np.ndarray, leaf: int = LEAF_VECTORS) -> Tree:
        order = np.arange(len(ids))
        low, high, child, first, last = [], [], [], [], []
        spans = [(0, len(ids))]
        at = 0
        while at < len(spans):
            a, b = spans[at]
            own = vectors[order[a:b]]
            low.append(own.min(axis=0))
            high.append(own.max(axis=0))
            first.append(a)
            last.append(b)
            spread = high[-1] - low[-1]
            if b - a <= leaf or not spread.size or spread.max() == 0:
                child.append(-1)
            else:
                middle = (b - a) // 2
                order[a:b] = order[a:b][np.argpartition(own[:, spread.argmax()], middle)]
                child.append(len(spans))
                spans += [(a, a + middle), (a + middle, b)]
            at += 1
        return cls(
            ids[order],
            vectors[order],
            np.array(low),
            np.array(high),
            np.array(child, dtype=np.int64),
            np.array(first, dtype=np.int64),
            np.array(last, dtype=np.int64),
        )

    def dump(self) -> bytes:
        out = io.BytesIO()
        names = ("ids", "vectors", "low", "high", "child", "first", "last")
        np.savez(out, **{name: getattr(self, name) for name in names})
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> Tree:
        return cls(**dict(np.load(io.BytesIO(data))))

    def search(self, query: np.ndarray, own_id: int, k: int, bound: int | None) -> list[tuple[int, int]]:
        """Up to ``k`` ``(score, id)`` with a score of at least ``bound``, without ``own_id``.

        Equal scores go to smaller ids, so boxes that can only equal the k-th score are opened.
        """
        exact = self.largest * float(np.abs(query).max(initial=0)) * max(1, len(query)) < EXACT
        if not exact:  # whole numbers of any size, slower
            query = np.array([int(x) for x in query], dtype=object)
        above, below = np.maximum(query, 0), np.minimum(query, 0)
        view = (lambda a: a) if exact else _whole
        reach = view(self.high) @ above + view(self.low) @ below
        best: list[tuple[int, int]] = []  # min-heap of (score, -id)
        floor = bound
        boxes = [(-reach[0], 0)]
        while boxes:
            limit, node = heapq.heappop(boxes)
            if floor is not None and -limit < floor:
                break
            left = self.child[node]
            if left >= 0:
                for side in (left, left + 1):
                    if floor is None or reach[side] >= floor:
                        heapq.heappush(boxes, (-reach[side], int(side)))
                continue
            rows = slice(self.first[node], self.last[node])
            for score, vec_id in zip((view(self.vectors[rows]) @ query).tolist(), self.ids[rows].tolist()):
                score = min(max(int(score), LONG.min), LONG.max)
                if vec_id == own_id or (floor is not None and score < floor):
                    continue
                entry = (score, -vec_id)
                if len(best) < k:
                    heapq.heappush(best, entry)
                elif entry > best[0]:
                    heapq.heapreplace(best, entry)
                if len(best) == k and (floor is None or best[0][0] > floor):
                    floor = best[0][0]
        return [(score, -negative) for score, negative in best]


def _whole(a: np.ndarray) -> np.ndarray:
    return np.array([int(x) for x in a.ravel()], dtype=object).reshape(a.shape)


_HELD = Held(HELD_BYTES, Tree.load)


def _tree_name(size: int, part: int) -> str:
    return f"tree-{size}-{part:06d}.npz"


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    """Rows of a list column of equal lengths."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return np.floor(SCALE * flat.astype(np.float64)).reshape(len(column), size)


def usable_vectors(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``(vec_id, size, vector)`` of rows with an id and a vector without null or non-finite parts."""
    x = F.col("vector")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return (
        vectors.select(
            F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector")
        )
        .filter(F.col("vec_id").isNotNull() & x.isNotNull() & ~bad)
        .withColumn("size", F.size(x))
    )


def top_k(
    vectors: DataFrame,
    *,
    k: int = 10,
    every: int = 100,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    shard_vectors: int = SHARD_VECTORS,
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` best of all other rows for every query.

    Queries are the rows whose id is divisible by ``every``; components are
    ``floor(1024 * x)`` and scores their integer inner products; what 64 bits cannot hold counts as
    their largest or smallest number. Rows without id,
    with a null vector or with null or non-finite components take no part. A query only meets
    vectors of its own length, never a row with its own id; equal scores go to smaller ids.
    Repeated rows are each a candidate; of repeated queries with one id the vectors are searched
    together and the best ``k`` of that id remain.
    """
    spark = vectors.sparkSession
    usable = usable_vectors(vectors, id_col, vector_col)
    sizes = usable.groupBy("size").agg(F.ceil(F.count("*") / shard_vectors).cast("int").alias("parts"))
    sizes = written(sizes, "vector-sizes")
    folder = scratch(spark, "trees")

    def build(key: tuple, table: pa.Table) -> pa.Table:
        size, part = (x.as_py() for x in key)
        matrix = _matrix(table.column("vector").combine_chunks(), size)
        data = Tree.build(table.column("vec_id").to_numpy(), matrix).dump()
        publish(folder, _tree_name(size, part), data)
        return pa.table({"size": pa.array([size], pa.int32()), "part": pa.array([part], pa.int32())})

    dealt = usable.join(sizes, "size").withColumn("part", F.pmod(F.xxhash64("vec_id"), "parts").cast("int"))
    made = dealt.groupBy("size", "part").applyInArrow(build, "size int, part int")
    # one pair for each tree; a part that got no vector has none
    trees = frozenset((row["size"], row["part"]) for row in made.collect())

    home = F.pmod(F.xxhash64("vec_id", F.lit(1)), "parts").cast("int")
    queries = usable.filter(F.pmod("vec_id", F.lit(every)) == 0).join(sizes, "size")
    queries = written(queries.withColumn("home", home), "queries")

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = [batch.column(c).to_pylist() for c in ("vec_id", "size", "part", "bound")]
            found: list[list[int]] = [[], [], []]
            lists = batch.column("vector")
            for row, (query_id, size, part, bound) in enumerate(zip(*sides)):
                if (size, part) not in trees:
                    continue
                tree = _HELD.get(folder, _tree_name(size, part))
                if tree is None:
                    raise FileNotFoundError(f"{folder}/{_tree_name(size, part)}")
                query = np.floor(SCALE * np.asarray(lists[row].as_py(), dtype=np.float64))
                for score, vec_id in tree.search(query, query_id, k, bound):
                    found[0].append(query_id)
                    found[1].append(vec_id)
                    found[2].append(score)
            yield pa.RecordBatch.from_arrays(
                [pa.array(column, pa.int64()) for column in found], names=["query_id", "vec_id", "score"]
            )

    def routed(rows: DataFrame) -> DataFrame:
        """Queries at their shards, blocks of one shard next to each other.

        The number of tasks follows the blocks: rows are few, and the search behind them is not seen.
        """
        block = F.pmod(F.xxhash64("vec_id", F.lit(2)), F.lit(QUERY_BLOCKS))
        placed = rows.select("vec_id", "size", "part", "bound", "vector", block.alias("block"))
        tasks = max(1, min(len(trees) * QUERY_BLOCKS, TASKS))
        return placed.repartition(tasks, "size", "part", "block").sortWithinPartitions("size", "part")

    schema = "query_id long, vec_id long, score long"
    none = F.lit(None).cast("long").alias("bound")
    first = written(
        routed(queries.select("vec_id", "size", F.col("home").alias("part"), "vector", none)).mapInArrow(
            search, schema
        ),
        "first-hits",
    )
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    bounds = (
        first.withColumn("rank", F.row_number().over(best))
        .filter(F.col("rank") == k)
        .select(F.col("query_id").alias("vec_id"), F.col("score").alias("bound"))
    )
    others = (
        queries.join(bounds, "vec_id", "left")
        .withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .filter(F.col("part") != F.col("home"))
    )
    hits = first.unionByName(routed(others).mapInArrow(search, schema))
    ranked = hits.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int"), "vec_id", "score")
