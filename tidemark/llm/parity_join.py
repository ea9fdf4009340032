"""N-gram Jaccard join with parity sketches.

A document is the set of its shingles. A sketch of it is an array of bits of which every shingle
toggles one, so two sketches differ in at most as many bits as the sets have different shingles. It
is cut into segments, so wide that unrelated sets hardly ever set the same bit of one, and a segment
is held as the XOR of the hashes of its bits that are set. Sets that link at 3/4 differ in at most a
third of either's shingles, ``d`` say, and so in as many segments: of ``d + 1`` segments that are
not empty, taken in an order that is the same for all sets, two such sets have one in common. Documents with equal sets
are one node; nodes are joined on these segments, within bands of the set size because the number of
segments follows the size, and every candidate is verified on its whole text.

Order of segments: any fixed order is right. Segments that many documents hold, as from passages
that many share, come last, so that they are seldom needed.

Candidates: a segment held by many nodes never makes all their pairs. Its nodes are first chained and
tied to the one with most frequent segments, which in a family of copies is near its origin, and every
node keeps the partner that its sketch is nearest to; the verified links among those pairs give
components. Where one segment's nodes are still in different components, tiles of bounded size hold
the sketches of two parts of them against each other. For some rounds each node sends only its nearest
partner there in another component to be verified, which joins what belongs together quickly; in the
end every pair goes whose Hamming distance still allows a link. Segments with the same nodes, as from
one shared passage, are compared once.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import discard, give_back, lean, release, slices, spread, squeezed, texts, written
from tidemark.operators.components import connected_components

# Fixed by the contract.
SHINGLE_WORDS = 5
LEAST_PERCENT = 75

# Bands of set sizes [8^k, 8^(k+1)), and the fewest segments of a sketch.
BAND = 8
LEAST_SEGMENTS = 4096

# Frequent segments: counted from so many times in one batch of rows and in all; so many of the
# most frequent (16 bytes each) are sent to the tasks. The list only steers the order.
FREQUENT_IN_BATCH = 5
FREQUENT = 8
FREQUENT_LISTED = 200_000
MARK_BITS = 21
# Texts are taken in runs of so many bytes, and segments counted in runs of about so many.
RUN_BYTES = 4 << 20
COUNTED_SEGMENTS = 8 << 20
# Nodes are met under their segments in shards of segments, one for so many shingles of all sets.
SHARD_SHINGLES = 1 << 20
# Nodes of one frequent segment that are chained in one group, nodes verified against one text in
# one group, and nodes on each side of a tile.
GROUP_NODES = 2_000
# Tiles of up to so many nodes are compared pair by pair, which is quicker there.
FEW_NODES = 16
# Rounds in which every node still apart has its nearest partner verified.
NEAREST_ROUNDS = 2
# Ids of texts to verify, 8 bytes each, that are sent to all tasks.
BROADCAST_IDS = 1_000_000
# Partners of a node that are held to their sketches before one is chosen.
PARTNERS = 3

_M64 = (1 << 64) - 1
_FACTORS = np.array(
    [(0x9E3779B97F4A7C15 * (2 * k + 1) ** 3 | 1) & _M64 for k in range(SHINGLE_WORDS)], dtype=np.uint64
)


def _mixed(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def _first_of_runs(values: np.ndarray) -> np.ndarray:
    """Which of sorted values differ from the one before."""
    first = np.ones(len(values), dtype=bool)
    np.not_equal(values[1:], values[:-1], out=first[1:])
    return first


def shingles(text: str) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles; a short text is one shingle of its own."""
    words = text.encode().lower().split()  # bytes: A-Z only, and the six ASCII spaces
    if len(words) < SHINGLE_WORDS:
        whole = [xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))] if words else []
        return np.array(whole, dtype=np.uint64)
    hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    last = len(words) - SHINGLE_WORDS + 1
    total = np.zeros(last, dtype=np.uint64)
    for k in range(SHINGLE_WORDS):
        total += hashed[k : k + last] * _FACTORS[k]
    found = _mixed(total)
    found.sort()
    return found[_first_of_runs(found)]


def node_of(found: np.ndarray) -> int:
    """A signed 64-bit name for a set."""
    return int(np.array(xxhash.xxh3_64_intdigest(found.tobytes()), dtype=np.uint64).view(np.int64))


def bands(size: int) -> list[int]:
    """The bands in which a set of this size can meet partners: its own, and near its lower
    border the one below, where partners of 3/4 of its size may be."""
    own = 0
    while BAND ** (own + 1) <= size:
        own += 1
    return [own, own - 1] if own and 3 * size < 4 * BAND**own else [own]


def segments(found: np.ndarray, band: int) -> np.ndarray:
    """Names of the segments of a set's parity sketch that are not empty."""
    count = max(LEAST_SEGMENTS, 2 * BAND ** (band + 1))
    # The hashes are sorted, and their upper bits name segments in that order.
    segment = ((found >> np.uint64(32)) * np.uint64(count)) >> np.uint64(32)
    starts = np.flatnonzero(_first_of_runs(segment))
    parity = np.bitwise_xor.reduceat(found, starts)
    parity = parity[parity != 0]
    name = (parity ^ (parity >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9 + 2 * band)
    return name ^ (name >> np.uint64(32))


def compare_sketch(found: np.ndarray) -> bytes:
    """A parity sketch of 2 to 4 bits a shingle, to compare two sets by.

    Its width is a power of two, and a wider one folds onto a narrower one by XOR of its parts.
    """
    width = max(64, 1 << (2 * len(found) - 1).bit_length())
    place = (found & np.uint64(width - 1)).view(np.int64)
    return np.packbits(np.bincount(place, minlength=width).astype(np.uint8) & 1).tobytes()


def differs_at_least(x: bytes, y: bytes) -> int:
    """Hamming distance of two sketches: no more than the sets' different shingles."""
    if len(x) < len(y):
        x, y = y, x
    wide, narrow = int.from_bytes(x, "little"), int.from_bytes(y, "little")
    bits, have = 8 * len(y), 8 * len(x)
    while have > bits:
        have //= 2
        wide = (wide >> have) ^ (wide & ((1 << have) - 1))
    return (wide ^ narrow).bit_count()


def most_different(size: int) -> int:
    """Most shingles in which a set of ``size`` can differ from one that it links with."""
    return size // 3


class Frequent:
    """The frequent segments and how often they were seen, to order segments by."""

    def __init__(self, names: np.ndarray, counts: np.ndarray):
        order = np.argsort(names)
        self.names, self.counts = names[order], counts[order]
        # Most segments are not listed, which their upper bits tell.
        self.marked = np.zeros(1 << MARK_BITS, dtype=bool)
        self.marked[names >> np.uint64(64 - MARK_BITS)] = True

    def seen(self, names: np.ndarray) -> np.ndarray:
        seen = np.zeros(len(names), dtype=np.int64)
        maybe = np.flatnonzero(self.marked[names >> np.uint64(64 - MARK_BITS)])
        if len(maybe):
            asked = names[maybe]
            at = np.minimum(np.searchsorted(self.names, asked), len(self.names) - 1)
            seen[maybe] = np.where(self.names[at] == asked, self.counts[at], 0)
        return seen


def needed_segments(found: np.ndarray, band: int, frequent: Frequent):
    """The segments to join on, how often each was seen, and how many of all are frequent.

    A set whose sketch has too few segments that are not empty, because shingles cancelled, gives
    all it has and one that all such sets of the band share.
    """
    names = segments(found, band)
    seen = frequent.seen(names)
    need = most_different(len(found)) + 1
    if len(names) < need:
        spare = _mixed(np.array([band + 1], dtype=np.uint64))
        return np.concatenate([names, spare]), np.concatenate([seen, [0]]), int((seen > 0).sum())
    rare = names[seen == 0]
    if len(rare) >= need:  # no need to sort the others
        least = np.partition(rare, need - 1)[:need]
        return least, np.zeros(need, dtype=np.int64), len(names) - len(rare)
    order = np.lexsort((names, seen))[:need]
    return names[order], seen[order], int((seen > 0).sum())


def _often(fresh: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The segments that ``fresh``, which is emptied, holds ``FREQUENT_IN_BATCH`` times or more, and how often."""
    names = fresh[0] if len(fresh) == 1 else np.concatenate(fresh)
    fresh.clear()
    names.sort()
    more = FREQUENT_IN_BATCH - 1
    often = np.unique(names[more:][names[more:] == names[: max(0, len(names) - more)]])
    return often, np.searchsorted(names, often, "right") - np.searchsorted(names, often)


def signatures(documents: DataFrame) -> DataFrame:
    """Two kinds of rows from one pass over ``(doc, text)``: documents ``(doc, node, size, sketch)``
    and segments frequent in a batch of rows ``(segment, seen)``."""
    names_out = ["doc", "node", "size", "sketch", "segment", "seen"]

    def counted(fresh: list[np.ndarray]) -> pa.RecordBatch:
        names, seen = _often(fresh)
        none = pa.nulls(len(names), pa.int64())
        blank = pa.nulls(len(names), pa.binary())
        own = [pa.array(names.view(np.int64)), pa.array(seen.astype(np.int64))]
        return pa.RecordBatch.from_arrays([none, none, none, blank, *own], names=names_out)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # One block that is sorted in place, filled over all batches of the task.
        fresh, held = np.empty(COUNTED_SEGMENTS, dtype=np.uint64), 0
        for whole in batches:
            known: set[int] = set()
            for batch in slices(whole, 1, RUN_BYTES):
                nodes, sizes, sketches = [], [], []
                for text in texts(batch, 1):
                    found = shingles(text)
                    sizes.append(len(found))
                    sketches.append(compare_sketch(found) if len(found) else None)
                    nodes.append(node_of(found) if len(found) else None)
                    if len(found) and nodes[-1] not in known:
                        known.add(nodes[-1])
                        for own in (segments(found, band) for band in bands(len(found))):
                            while len(own):
                                fits = own[: len(fresh) - held]
                                fresh[held : held + len(fits)] = fits
                                own, held = own[len(fits) :], held + len(fits)
                                if held == len(fresh):
                                    yield counted([fresh])
                                    held = 0
                none = pa.nulls(batch.num_rows, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0),
                        pa.array(nodes, pa.int64()),
                        pa.array(sizes, pa.int64()),
                        pa.array(sketches, pa.binary()),
                        none,
                        none,
                    ],
                    names=names_out,
                )
        if held:
            yield counted([fresh[:held]])

    return documents.mapInArrow(
        lean(run), "doc long, node long, size long, sketch binary, segment long, seen long"
    )


def _frequent(rows: DataFrame) -> Frequent:
    """The most frequent segments, at most ``FREQUENT_LISTED``."""
    listed = (
        rows.filter("segment IS NOT NULL")
        .groupBy("segment")
        .agg(F.sum("seen").alias("seen"))
        .filter(F.col("seen") >= FREQUENT)
        .orderBy(F.desc("seen"), "segment")
        .limit(FREQUENT_LISTED)
        .toPandas()
    )
    return Frequent(
        listed["segment"].to_numpy(dtype=np.int64).view(np.uint64), listed["seen"].to_numpy(dtype=np.int64)
    )


def _memberships(documents: DataFrame, frequent, shards: int | None = None) -> DataFrame:
    """``(segment, split, part, node, size, common)``: every node under each segment it joins on,
    with the number of its frequent segments.

    ``part`` splits the nodes of very frequent segments, marked ``split``, into groups. With ``shards``
    the rows of each are packed into one for every run of texts, which :func:`_met` takes.
    """

    def members(batch: pa.RecordBatch, known: set[int], listed: Frequent) -> Iterator[pa.RecordBatch]:
        names, groups, nodes, sizes, common = [], [], [], [], []
        for text in texts(batch, 1):
            found = shingles(text)
            if not len(found) or (node := node_of(found)) in known:
                continue
            known.add(node)
            for band in bands(len(found)):
                own, seen, frequent_ones = needed_segments(found, band, listed)
                common.append(np.full(len(own), frequent_ones, dtype=np.int32))
                names.append(own)
                groups.append(seen // GROUP_NODES + 1)
                nodes.append(np.full(len(own), node))
                sizes.append(np.full(len(own), len(found), dtype=np.int32))
        if names:
            group, node = np.concatenate(groups), np.concatenate(nodes).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate(names).view(np.int64)),
                    pa.array(group > 1),
                    pa.array((node % group).astype(np.int32)),
                    pa.array(node),
                    pa.array(np.concatenate(sizes)),
                    pa.array(np.concatenate(common)),
                ],
                names=["segment", "split", "part", "node", "size", "common"],
            )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            known: set[int] = set()
            for batch in slices(whole, 1, RUN_BYTES):
                for found in members(batch, known, frequent.value):
                    yield found if shards is None else _pack(found, shards)

    plain = "segment long, split boolean, part int, node long, size int, common int"
    return documents.mapInArrow(lean(run), plain if shards is None else PACKED)


PACKED = "shard int, n int, segments binary, groups binary, places binary, n_nodes int, nodes binary, sizes binary, common binary"


def _pack(members: pa.RecordBatch, shards: int) -> pa.RecordBatch:
    """Rows of :func:`_memberships`, one for each shard: segments sorted, nodes listed once.

    A group is the number of a segment's part, doubled, with the last bit set where it is split.
    """
    segment, split, part, node, size, common = (c.to_numpy(zero_copy_only=False) for c in members.columns)
    segment, part = segment.view(np.uint64), part.astype(np.int64)
    shard = (((segment >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)).astype(np.int64)
    shard = (shard + part) % shards
    # The rows of a set in one band follow each other; it counts its frequent segments in each band.
    owner = np.cumsum(np.diff(node, prepend=node[:1]).astype(bool) | np.diff(common, prepend=common[:1]).astype(bool))
    order = np.lexsort((segment, shard))
    cuts = np.searchsorted(shard[order], np.arange(shards + 1))
    columns: list[list] = [[] for _ in range(9)]
    for number in np.flatnonzero(np.diff(cuts)):
        at = order[cuts[number] : cuts[number + 1]]
        _, first, place = np.unique(owner[at], return_index=True, return_inverse=True)
        own = at[first]
        values = [
            int(number),
            len(at),
            squeezed(np.diff(segment[at], prepend=np.uint64(0))),
            squeezed(2 * part[at] + split[at]),
            squeezed(place.astype(np.int64)),
            len(own),
            squeezed(node[own]),
            squeezed(size[own]),
            squeezed(common[own]),
        ]
        for column, value in zip(columns, values):
            column.append(value)
    kinds = {"int": pa.int32(), "binary": pa.binary()}
    names, types = zip(*(part.split() for part in PACKED.split(", ")))
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(columns, types)], names=list(names))


MET = (
    "segment long, split boolean, part int, node long, size int, common int, "
    "before long, before_size int, least long, least_size int"
)


def _met(packed: pa.Table) -> pa.Table:
    """The members of a shard's segments that meet others there, each with the one before it and the
    first of its part, in ``ORDER``; a split segment's members may also meet those of other parts."""
    rows = packed.to_pylist()
    parts = []
    for row in rows:
        place = spread(row["places"], row["n"], np.int64)
        listed = [spread(row[c], row["n_nodes"], k)[place] for c, k in zip(("nodes", "sizes", "common"), (np.int64, np.int32, np.int32))]
        segment = np.cumsum(spread(row["segments"], row["n"], np.uint64))
        parts.append([segment, spread(row["groups"], row["n"], np.int64), *listed])
    segment, group, node, size, common = map(np.concatenate, zip(*parts))
    del rows, parts
    order = np.argsort(segment)
    ranked = segment[order]
    twice = np.zeros(len(order), bool)
    same = ranked[1:] == ranked[:-1]
    twice[1:] |= same
    twice[:-1] |= same
    kept = order[twice | (group[order] & 1 > 0)]
    segment, group, node, size, common = (x[kept] for x in (segment, group, node, size, common))
    order = np.lexsort((node, size, -common, group, segment))
    segment, group, node, size, common = (x[order] for x in (segment, group, node, size, common))

    def repeats(*keys: np.ndarray) -> np.ndarray:
        out = np.zeros(len(segment), bool)
        out[1:] = np.logical_and.reduce([k[1:] == k[:-1] for k in keys])
        return out

    single = ~repeats(segment, group, node)
    segment, group, node, size, common = (x[single] for x in (segment, group, node, size, common))
    first = ~repeats(segment, group)
    starts = np.flatnonzero(first)
    count = np.diff(np.append(starts, len(segment)))
    least = np.repeat(starts, count)
    stays = (np.repeat(count, count) > 1) | (group & 1 > 0)
    before = np.maximum(np.arange(len(segment)) - 1, 0)
    columns = [
        segment.view(np.int64),
        group & 1 > 0,
        (group >> 1).astype(np.int32),
        node,
        size,
        common,
        pa.array(node[before], mask=first),
        pa.array(size[before], mask=first),
        node[least],
        size[least],
    ]
    names = [part.split()[0] for part in MET.split(", ")]
    table = pa.Table.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=names)
    return table.filter(pa.array(stays))


def _met_lean(packed: pa.Table) -> pa.Table:
    table = _met(packed)
    give_back()
    return table


# Nodes with many frequent segments come first under a segment.
ORDER = ("-common", "size", "node")


def _near_in_size(x: str, y: str):
    """Whether the smaller set is at least three quarters of the larger."""
    return 100 * F.least(x, y) >= LEAST_PERCENT * F.greatest(x, y)


def _partners(members: DataFrame) -> DataFrame:
    """``(a, b)``: for every node the few others it meets most often, as the first under a segment
    or as the one before it there."""
    found = [
        members.filter(F.col(other).isNotNull() & (F.col(other) != F.col("node")))
        .filter(_near_in_size("size", f"{other}_size"))
        .select(F.col("node").alias("a"), F.col(other).alias("b"))
        for other in ("before", "least")
    ]
    # The first nodes of the parts of one segment are chained in their turn.
    order = Window.partitionBy("segment").orderBy(*map(F.expr, ORDER))
    heads = members.filter("split AND least = node").select(
        F.col("node").alias("a"), F.lag("node").over(order).alias("b")
    )
    met = found[0].union(found[1]).groupBy("a", "b").agg(F.count("*").alias("met"))
    heads = heads.filter("b IS NOT NULL").distinct()
    best = Window.partitionBy("a").orderBy(F.desc("met"), "b")
    few = met.withColumn("_n", F.row_number().over(best)).filter(F.col("_n") <= PARTNERS)
    return few.select("a", "b").union(heads).distinct()


def _alike(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs whose sketches allow a link, with their ``distance``."""
    side = lambda name: nodes.select(
        F.col("node").alias(name), F.col("size").alias(f"{name}_size"), F.col("sketch").alias(f"{name}_sketch")
    )
    both = pairs.join(side("a"), "a").join(side("b"), "b")

    @F.pandas_udf("long")
    def distance(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series(list(map(differs_at_least, x, y)), dtype="int64")

    measured = both.withColumn("distance", distance("a_sketch", "b_sketch"))
    allowed = 7 * F.col("distance") <= F.col("a_size") + F.col("b_size")
    return measured.filter(allowed).select("a", "b", "distance")


def _nearest(pairs: DataFrame) -> DataFrame:
    """``(a, b)``: for every node ``a`` its nearest partner."""
    both = pairs.select("a", "b", "distance").union(pairs.select("b", "a", "distance"))
    nearest = both.groupBy("a").agg(F.min(F.struct("distance", "b")).alias("_p"))
    return nearest.select("a", F.col("_p.b").alias("b"))


def _words(sketches: list[bytes], width: int) -> np.ndarray:
    """Sketches as rows of ``width`` words, folded where they are wider."""
    rows = [np.frombuffer(x, np.uint64).reshape(-1, width) for x in sketches]
    return np.stack([row[0] if len(row) == 1 else np.bitwise_xor.reduce(row, axis=0) for row in rows])


def _few_pairs(left: list[tuple], right: list[tuple] | None) -> Iterator[tuple[int, int, int]]:
    """Like :func:`_tile_pairs`, one pair after the other."""
    for at, (node, size, root, sketch, avoid) in enumerate(left):
        for other, other_size, other_root, other_sketch, other_avoid in (
            left[at + 1 :] if right is None else right
        ):
            if other in avoid or node in other_avoid:
                continue
            small, large = (size, other_size) if size < other_size else (other_size, size)
            if root == other_root or 100 * small < LEAST_PERCENT * large:
                continue
            distance = differs_at_least(sketch, other_sketch)
            if 7 * distance <= size + other_size:
                yield min(node, other), max(node, other), distance


def _tile_pairs(left: list[tuple], right: list[tuple] | None) -> Iterator[tuple[int, int, int]]:
    """``(a, b, distance)`` of pairs of a tile that may link and are in different components.

    Members are ``(node, size, root, sketch, avoid)``, the last the partners it chose in vain; without ``right`` the tile is a part against itself. Sets that can link have sketches of one width, or one of twice the other's.
    """
    by_width: list[dict[int, list[tuple]]] = [{}, {}]
    for side, members in enumerate((left, left if right is None else right)):
        for member in members:
            by_width[side].setdefault(len(member[3]) // 8, []).append(member)
    for width, first in by_width[0].items():
        for other, second in by_width[1].items():
            if other not in (width, 2 * width, width // 2) or (right is None and other < width):
                continue
            narrow = min(width, other)
            x, y = (_words([m[3] for m in side], narrow) for side in (first, second))
            roots, sizes, nodes = (np.array([m[k] for m in second]) for k in (2, 1, 0))
            for row, (node, size, root, _, avoid) in zip(x, first):
                at = np.flatnonzero(
                    (roots != root)
                    & (nodes != node)
                    & (100 * np.minimum(sizes, size) >= LEAST_PERCENT * np.maximum(sizes, size))
                )
                if right is None and other == width:
                    at = at[nodes[at] > node]
                if not len(at):
                    continue
                distance = np.bitwise_count(y[at] ^ row).sum(axis=1, dtype=np.int64)
                for k in np.flatnonzero(7 * distance <= sizes[at] + size):
                    other_node = int(nodes[at[k]])
                    if other_node not in avoid and node not in second[at[k]][4]:
                        yield min(node, other_node), max(node, other_node), int(distance[k])


def _nearest_of(pairs: Iterable[tuple[int, int, int]]) -> set[tuple[int, int, int]]:
    """For every node of the pairs the one with its nearest partner."""
    best: dict[int, tuple[int, int, int]] = {}
    for a, b, distance in pairs:
        for node in (a, b):
            if node not in best or (distance, a, b) < best[node]:
                best[node] = (distance, a, b)
    return {(a, b, distance) for distance, a, b in best.values()}


def _apart_pairs(left: DataFrame, nearest: bool) -> DataFrame:
    """``(segment, a, b, distance)`` among nodes of one segment in different components.

    ``left``: ``segment, tiles, node, size, root, sketch, avoid``. A segment's nodes are dealt to
    ``tiles`` parts, and every two parts meet in a tile, so a task holds two parts at a time. With
    ``nearest`` only every node's nearest partner in a tile is returned.
    """
    part = F.pmod(F.xxhash64("node"), "tiles").cast("int")
    placed = left.withColumn("part", part).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("tiles").cast("int") - 1))
    )
    tiles = placed.select(
        "segment",
        F.least("part", "other").alias("x"),
        F.greatest("part", "other").alias("y"),
        (F.col("part") > F.col("other")).alias("second"),
        "node",
        "size",
        "root",
        "sketch",
        "avoid",
    )
    stream = tiles.repartition("segment", "x", "y").sortWithinPartitions("segment", "x", "y")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sides, rows = None, ([], []), []

        def finish() -> Iterator[pa.RecordBatch]:
            if key is None:
                return
            second = None if key[1] == key[2] else sides[1]
            compare = _few_pairs if len(sides[0]) + len(sides[1]) <= FEW_NODES else _tile_pairs
            found = compare(sides[0], second)
            for a, b, distance in _nearest_of(found) if nearest else found:
                rows.append((key[0], a, b, distance))
                if len(rows) >= 10_000:
                    yield out()

        def out() -> pa.RecordBatch:
            columns = [pa.array(c, pa.int64()) for c in (zip(*rows) if rows else ((), (), (), ()))]
            rows.clear()
            return pa.RecordBatch.from_arrays(columns, names=["segment", "a", "b", "distance"])

        for batch in batches:
            for segment, x, y, second, *member, avoid in zip(*(c.to_pylist() for c in batch.columns)):
                if (segment, x, y) != key:
                    yield from finish()
                    key, sides = (segment, x, y), ([], [])
                sides[second].append((*member, frozenset(avoid or ())))
        yield from finish()
        yield out()

    return stream.mapInArrow(lean(run), "segment long, a long, b long, distance long")


def _rooted(rows: DataFrame, component: DataFrame) -> DataFrame:
    """``rows`` with the ``root`` of their node's component."""
    found = rows.join(component, "node", "left")
    return found.withColumn("root", F.coalesce("root", "node"))


def _families(members: DataFrame, component: DataFrame) -> DataFrame:
    """``(segment, tiles, node, size, root)``: the nodes that one segment brings together and that are
    still in different components.

    A text has many segments, and those of one passage hold nearly the same nodes, so each would
    compare the same pairs again. Segments whose nodes have one least hash, as sets share it the
    likelier the more they have in common, and that are of like size are one family with the nodes of
    all. ``segment`` names the family; no pair of a segment is lost in it.
    """
    placed = _rooted(members.select("segment", "node", "size"), component)
    apart = placed.groupBy("segment").agg(
        F.min("root").alias("x"),
        F.max("root").alias("y"),
        F.count("*").alias("n"),
        F.min(F.xxhash64("node", F.lit(2))).alias("least"),
        F.bit_xor(F.xxhash64("node")).alias("h"),
        F.bit_xor(F.xxhash64("node", F.lit(1))).alias("k"),
    )
    # One segment for each set of nodes, told apart by 128 bits of hash.
    kept = apart.filter("x <> y").groupBy("n", "h", "k", "least").agg(F.min("segment").alias("segment"))
    family = F.xxhash64("least", F.floor(F.log2("n"))).alias("family")
    named = placed.join(kept.select("segment", family), "segment")
    named = named.select(F.col("family").alias("segment"), "node", "size", "root").distinct()
    tiles = F.ceil(F.count("*").over(Window.partitionBy("segment")) / GROUP_NODES)
    return named.withColumn("tiles", tiles)


def _live(left: DataFrame, picks: DataFrame) -> DataFrame:
    """The rows of ``left`` whose node had a near partner, without ``root``. A pair that may link in
    a later round might have linked in this one, so both its nodes are in ``picks``."""
    picked = picks.select("segment", F.explode(F.array("a", "b")).alias("node")).distinct()
    return left.drop("root").join(picked, ["segment", "node"], "left_semi")


def _with_avoided(rows: DataFrame, tried: DataFrame, links: DataFrame) -> DataFrame:
    """``rows`` with the partners that their node chose in vain."""
    linked = links.select("u", "v").union(links.select("v", "u")).toDF("a", "b")
    failed = tried.join(linked, ["a", "b"], "left_anti")
    # ``a`` chose ``b``, once in each round, so these are few.
    avoided = failed.groupBy(F.col("a").alias("node")).agg(F.collect_set("b").alias("avoid"))
    return rows.join(avoided, "node", "left")


def _verified(pairs: DataFrame, documents: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs that link, either way round, decided on the shingles of their whole texts.

    Texts travel to the pairs' ``b``, whose own text comes first there, so a task holds one set and
    streams the others past it; many pairs of one ``b`` are several groups.
    """
    # Of pairs given both ways round one is verified, at the node that more are verified against.
    popular = pairs.groupBy("b").agg(F.count("*").alias("_n"))
    asked = pairs.join(popular, "b").join(popular.select(F.col("b").alias("a"), F.col("_n").alias("_m")), "a", "left")
    turn = F.coalesce("_m", F.lit(0)) > F.col("_n")
    pairs = asked.select(
        F.when(turn, F.col("b")).otherwise(F.col("a")).alias("a"),
        F.when(turn, F.col("a")).otherwise(F.col("b")).alias("b"),
    ).distinct()
    crowd = pairs.groupBy("b").agg(F.ceil(F.count("*") / GROUP_NODES).alias("groups"))
    dealt = pairs.join(crowd, "b").withColumn("group", F.pmod(F.xxhash64("a"), "groups").cast("int"))
    head = dealt.select("b", "group", F.col("b").alias("node"), F.lit(False).alias("compared"))
    roles = head.distinct().union(dealt.select("b", "group", "a", F.lit(True)))
    wanted = written(roles.join(nodes.select("node", "doc"), "node"), "wanted")
    asked = wanted.select("doc").distinct()
    if asked.count() <= BROADCAST_IDS:
        # Few: the other texts need not travel. Many: the join below deals out all.
        documents = documents.join(F.broadcast(asked), "doc", "left_semi")
    stream = (
        documents.join(wanted, "doc")
        .select("b", "group", "compared", "node", "text")
        .repartition("b", "group")
        .sortWithinPartitions("b", "group", "compared")
    )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, None
        for batch in (piece for whole in batches for piece in slices(whole, 4, RUN_BYTES)):
            links: list[tuple[int, int]] = []
            for b, group, compared, node, text in zip(*(c.to_pylist() for c in batch.columns)):
                found = shingles(text or "")
                # An id may repeat with another text: only the node's own text counts.
                if node_of(found) != node:
                    continue
                if not compared:
                    key, held = (b, group), found
                elif key == (b, group):
                    common = len(np.intersect1d(held, found, assume_unique=True))
                    if 100 * common >= LEAST_PERCENT * (len(held) + len(found) - common):
                        links.append((node, b))
            u, v = zip(*links) if links else ((), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"]
            )

    return stream.mapInArrow(lean(run), "u long, v long").distinct()


def link_documents(
    documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``(id, n_shingles, component_id)`` of every row.

    Two rows link when 100 times the common shingles are at least 75 times all their shingles;
    ``component_id`` is the smallest id that links reach. Null, empty and blank texts have no
    shingles and link with nothing. Equal sets link, so repeated rows share a component. Rows
    without id are counted but link with nothing, and their component is null. Other columns are
    not read.
    """
    spark: SparkSession = documents.sparkSession
    source = documents.select(
        F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text")
    )
    rows = written(signatures(source), "signatures")
    signed = rows.filter("segment IS NULL").select("doc", "node", "size")
    # One row per different set, with its smallest id.
    nodes = written(
        rows.filter("node IS NOT NULL AND doc IS NOT NULL")
        .groupBy("node", "size")
        .agg(F.min("doc").alias("doc"), F.first("sketch").alias("sketch")),
        "nodes",
    )
    frequent = spark.sparkContext.broadcast(_frequent(rows))  # FREQUENT_LISTED bounds it

    shingled = nodes.agg(F.coalesce(F.sum("size"), F.lit(1))).first()[0]
    packed = _memberships(source.filter("doc IS NOT NULL"), frequent, -(-shingled // SHARD_SHINGLES))
    # A node alone under a segment meets nobody there, unless the segment has other parts.
    members = packed.groupBy("shard").applyInArrow(_met_lean, MET)
    members = written(members, "members")
    del packed
    release(spark)

    tried = written(_nearest(_alike(_partners(members), nodes)), "partners")
    links = written(_verified(tried, source, nodes), "first-links")
    release(spark)
    component = connected_components(links)

    left = written(_families(members, component).join(nodes.select("node", "sketch"), "node"), "apart")
    discard(members)

    for _ in range(NEAREST_ROUNDS):
        picks = written(_apart_pairs(_with_avoided(left, tried, links), True), "picks")
        if picks.isEmpty():
            break
        near = written(_nearest(picks), "nearest")
        links = written(links.union(_verified(near, source, nodes)), "links")
        tried = written(tried.union(near).distinct(), "tried")
        component = connected_components(links)
        done, left = [left, picks], written(_rooted(_live(left, picks), component), "apart")
        for table in done:
            discard(table)
    else:
        rest = _apart_pairs(_with_avoided(left, tried, links), False).select("a", "b").distinct()
        more = written(_verified(written(rest, "rest-pairs"), source, nodes), "rest-links")
        release(spark)
        if not more.isEmpty():
            component = connected_components(links.union(more))

    rooted = nodes.join(component, "node")
    names = rooted.groupBy("root").agg(F.min("doc").alias("component_id"))
    labels = rooted.join(names, "root").select("node", "component_id")
    of_node = nodes.join(labels, "node", "left").select(
        "node", F.coalesce("component_id", "doc").alias("component_id")
    )
    out = signed.join(of_node, "node", "left")
    alone = F.col("node").isNull() | F.col("doc").isNull()
    return out.select(
        F.col("doc").alias(id_col),
        F.col("size").alias("n_shingles"),
        F.when(alone, F.col("doc")).otherwise(F.col("component_id")).alias("component_id"),
    )


def one_of_each(
    documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The rows of ``documents`` with the smallest id of their component, columns unchanged.

    Rows without shingles or without id all stay; of rows that repeat id and text, one stays.
    """
    linked = link_documents(documents, id_col=id_col, text_col=text_col)
    heads = linked.filter(F.col(id_col) == F.col("component_id")).select(id_col).distinct()
    named = documents.filter(F.col(id_col).isNotNull()).join(heads, id_col, "left_semi")
    kept = named.dropDuplicates([id_col, text_col])
    return kept.select(*documents.columns).unionByName(documents.filter(F.col(id_col).isNull()))
