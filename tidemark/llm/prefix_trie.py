"""The trie of all conversation prefixes, built from adaptive radix trees over sorted ranges.

A turn is named by 16 bytes of the digest of its role and text, so a conversation is a byte string
of fixed-width turn ids. Spark sorts these strings into ranges; equal conversations of a hot group
may fall into several. Every task builds adaptive radix trees over pieces of bounded size of its
range: nodes grow from 4 over 16 and 48 to 256 children, and bytes without a fork are kept as a span
of one of the keys below. Only byte depths at turn borders become nodes of the result.

Strings are sorted, so pieces share nothing but prefixes of the keys beside their borders. A task
knows the keys next to its range, and every node is counted as new in the first piece that has it
and as a leaf in the last. All figures, subtree sums too, then simply add up over the pieces, and
only the few nodes at borders have to be added up by Spark.
"""

from __future__ import annotations

import hashlib
import io
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import fetch, filesystem, publish, scratch, written
from tidemark.session import settle

# Bytes of a turn id.
WIDTH = 16
# Bytes of distinct keys in one tree.
PIECE_BYTES = 16 << 20
# Fixed by the contract of the query: families of conversation ids and the longest shared head.
FAMILY = 100
HEADS = 6

ROOT = bytes(16)
NOTHING = hashlib.sha256(b"").hexdigest()

LAYOUTS = (4, 16, 48, 256)


class Node:
    """A node of a radix tree; its path ends at byte ``end`` of the key of ``row``."""

    __slots__ = ("row", "end", "terminal", "layout", "index", "kids")

    def __init__(self, row: int, end: int, terminal: int | None = None):
        self.row, self.end, self.terminal = row, end, terminal
        self.layout = LAYOUTS[0]
        self.index = bytearray()  # sorted bytes; for 48 children the place + 1 of each byte
        self.kids: list[Node | None] = []

    def child(self, byte: int) -> Node | None:
        if self.layout <= 16:
            at = self.index.find(byte)
            return self.kids[at] if at >= 0 else None
        if self.layout == 48:
            at = self.index[byte]
            return self.kids[at - 1] if at else None
        return self.kids[byte]

    def put(self, byte: int, node: Node) -> None:
        """Add a child or replace the one at ``byte``."""
        if self.layout <= 16:
            at = bisect_left(self.index, byte)
            if at < len(self.index) and self.index[at] == byte:
                self.kids[at] = node
            elif len(self.kids) < self.layout:
                self.index.insert(at, byte)
                self.kids.insert(at, node)
            else:
                self._grow()
                self.put(byte, node)
        elif self.layout == 48:
            if at := self.index[byte]:
                self.kids[at - 1] = node
            elif len(self.kids) < self.layout:
                self.kids.append(node)
                self.index[byte] = len(self.kids)
            else:
                self._grow()
                self.put(byte, node)
        else:
            self.kids[byte] = node

    def _grow(self) -> None:
        pairs = list(self.ordered())
        self.layout = LAYOUTS[LAYOUTS.index(self.layout) + 1]
        if self.layout == 48:
            self.index = bytearray(256)
            for place, (byte, _) in enumerate(pairs):
                self.index[byte] = place + 1
            self.kids = [node for _, node in pairs]
        elif self.layout == 256:
            self.index, self.kids = bytearray(), [None] * 256
            for byte, node in pairs:
                self.kids[byte] = node

    def ordered(self) -> Iterator[tuple[int, Node]]:
        """Children by byte."""
        if self.layout <= 16:
            yield from zip(self.index, self.kids)
        elif self.layout == 48:
            yield from ((b, self.kids[at - 1]) for b, at in enumerate(self.index) if at)
        else:
            yield from ((b, node) for b, node in enumerate(self.kids) if node is not None)


def common_prefix(a: bytes, b: bytes) -> int:
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[:middle] == b[:middle]:
            low = middle
        else:
            high = middle - 1
    return low


class RadixTree:
    """Adaptive radix tree over distinct byte strings, known by their number."""

    def __init__(self, keys: list[bytes]):
        self.keys, self.root = keys, Node(0, 0)
        for row in range(len(keys)):
            self._insert(row)

    def _insert(self, row: int) -> None:
        key, node, start, above = self.keys[row], self.root, 0, None
        while True:
            own = self.keys[node.row]
            if key[start : node.end] != own[start : node.end]:
                at = start + common_prefix(key[start : node.end], own[start : node.end])
                fork = Node(node.row, at)
                fork.put(own[at], node)
                if at == len(key):
                    fork.terminal = row
                else:
                    fork.put(key[at], Node(row, len(key), row))
                above.put(key[start], fork)  # the root's path is empty, so there is one above
                return
            if len(key) == node.end:
                node.terminal = row
                return
            below = node.child(key[node.end])
            if below is None:
                node.put(key[node.end], Node(row, len(key), row))
                return
            above, start, node = node, node.end, below

    def prefixes(self, width: int) -> Iterator[tuple[int, int, int, int | None]]:
        """``(parent, depth, row, terminal)`` of every prefix of whole ids, parents first.

        ``parent`` is the place of the parent in this order, ``row`` a key with the prefix and
        ``terminal`` the key that ends there.
        """
        count, stack = 0, [(self.root, 0, -1)]
        while stack:
            node, start, parent = stack.pop()
            ends = range((start // width + 1) * width, node.end + 1, width) if count else range(1)
            for end in ends:
                at_end = node.terminal if end == node.end else None
                yield parent, end // width, node.row, at_end
                parent = count
                count += 1
            stack.extend((kid, node.end, parent) for _, kid in reversed(list(node.ordered())))


def pack_turns(
    conversations: DataFrame,
    *,
    id_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """``(conv_id, turns)``: every conversation as an array of ``(turn, id, chars)`` in order.

    Turns are ordered by number, null first, equal ones by their ids. Rows without conversation id
    take no part. No text is shuffled, only its id and number of code points.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    rows = conversations.select(
        F.col(id_col).cast("long").alias("conv_id"),
        F.col(turn_col).cast("long").alias("turn"),
        turn_id(role, text).alias("id"),
        F.char_length(text).alias("chars"),
    ).filter(F.col("conv_id").isNotNull())
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "id", "chars"))).alias("turns"))


def turn_id(role, text):
    """Hexadecimal id of a turn; the length of the role keeps both parts apart."""
    named = F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text)
    return F.substring(F.sha2(named, 256), 1, 2 * WIDTH)


def rebuild(packed: DataFrame) -> DataFrame:
    """Conversations that begin with the first turns of their family's first one.

    Conversation c takes h = crc32(c) % 6 turns of c - c % 100, all if there are fewer, and then
    its own turns after its first h. Remainders have the sign of c.
    """
    settled = written(packed, "packed-turns")
    family = F.col("conv_id") - F.col("conv_id") % FAMILY
    heads = settled.filter(F.col("conv_id") % FAMILY == 0).select(
        F.col("conv_id").alias("family"), F.slice("turns", 1, HEADS - 1).alias("head")
    )
    h = (F.crc32(F.col("conv_id").cast("string")) % HEADS).cast("int")
    own = F.slice("turns", h + 1, F.greatest(F.size("turns"), F.lit(1)))
    head = F.when(F.col("head").isNull(), F.slice("turns", 1, 0)).otherwise(F.slice("head", 1, h))
    joined = settled.withColumn("family", family).join(heads, "family", "left")
    return joined.select("conv_id", F.concat(head, own).alias("turns"))


NODE_FIELDS = [
    ("part", pa.int64()),
    ("piece", pa.int64()),
    ("node", pa.binary()),
    ("parent", pa.binary()),
    ("depth", pa.int64()),
    ("turn_id", pa.binary()),
    ("open", pa.bool_()),
    ("conv_id", pa.int64()),
    ("parent_conv_id", pa.int64()),
    ("n_convs", pa.int64()),
    ("n_children", pa.int64()),
    ("n_leaves", pa.int64()),
    ("saved_tokens", pa.int64()),
    ("ends_sha256", pa.string()),
    ("ends_file", pa.string()),
]
NODE_SCHEMA = (
    "part long, piece long, node binary, parent binary, depth long, turn_id binary, open boolean, conv_id long, "
    "parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, "
    "ends_file string"
)


class Piece:
    """Distinct keys of a sorted run, with the number, the least and the digest of their members."""

    def __init__(self, before: bytes | None):
        self.before, self.size = before, 0
        self.keys, self.chars, self.counts, self.least, self.ends, self.files = [], [], [], [], [], []

    def open_key(self, key: bytes, chars: list[int], conv_id: int) -> None:
        self.keys.append(key)
        self.chars.append(chars)
        self.counts.append(0)
        self.least.append(conv_id)
        self.size += len(key) + 64

    def nodes(self, after: bytes | None, part: int, number: int) -> pa.RecordBatch:
        keys, last = self.keys, len(self.keys) - 1
        old = -1 if self.before is None else common_prefix(keys[0], self.before) // WIDTH
        shared = -1 if after is None else common_prefix(keys[last], after) // WIDTH
        places = list(RadixTree(keys).prefixes(WIDTH))
        size = len(places)
        n, least = [0] * size, [None] * size
        children, has_child, leaves, saved = [0] * size, [False] * size, [0] * size, [0] * size
        low, high = [last] * size, [0] * size  # first and last key below
        opened, ends, files = [False] * size, [None] * size, [None] * size
        for at in range(size - 1, -1, -1):
            parent, depth, row, terminal = places[at]
            if terminal is not None:
                n[at] += self.counts[terminal]
                own = self.least[terminal]
                least[at] = own if least[at] is None else min(least[at], own)
                low[at], high[at] = min(low[at], terminal), max(high[at], terminal)
                ends[at], files[at] = self.ends[terminal], self.files[terminal]
                if not has_child[at] and not (
                    terminal == last and after is not None and after.startswith(keys[last])
                ):
                    leaves[at] += 1
            is_old = low[at] == 0 and depth <= old
            opened[at] = is_old or (high[at] == last and depth <= shared)
            if depth:
                chars = self.chars[row][depth - 1]
                saved[at] += (n[at] - (not is_old)) * chars
                n[parent] += n[at]
                least[parent] = least[at] if least[parent] is None else min(least[parent], least[at])
                low[parent], high[parent] = min(low[parent], low[at]), max(high[parent], high[at])
                has_child[parent] = True
                children[parent] += not is_old
                leaves[parent] += leaves[at]
                saved[parent] += saved[at]
        names, turns = [ROOT] * size, [None] * size
        for at, (parent, depth, row, _) in enumerate(places):
            if depth:
                turns[at] = keys[row][(depth - 1) * WIDTH : depth * WIDTH]
                names[at] = xxhash.xxh3_128_digest(names[parent] + turns[at])
        above = [p[0] for p in places]
        columns = [
            [part] * size,
            [number] * size,
            names,
            [names[p] if p >= 0 else None for p in above],
            [p[1] for p in places],
            turns,
            opened,
            least,
            [least[p] if p >= 0 and not opened[p] else None for p in above],
            n,
            children,
            leaves,
            saved,
            ends,
            files,
        ]
        arrays = [pa.array(c, kind) for c, (_, kind) in zip(columns, NODE_FIELDS)]
        return pa.RecordBatch.from_arrays(arrays, names=[name for name, _ in NODE_FIELDS])


def _border_name(part: int) -> str:
    return f"border-{part:08d}.npz"


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, bytes, list[int]]]:
    for batch in batches:
        chars = batch.column(2)
        for at, (conv_id, key) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
            yield conv_id, key, chars[at]


def prefix_nodes(sequences: DataFrame, *, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """One row per distinct prefix of the packed conversations ``(conv_id, turns)``.

    ``node`` and ``parent`` name a prefix and the one a turn shorter; ``turn_id`` is its last turn.
    ``conv_id`` and ``parent_conv_id`` are the smallest members of both, ``n_convs`` counts the
    conversations that start with the prefix, ``n_children`` the prefixes a turn longer and
    ``n_leaves`` the childless ones among it and those below. ``saved_tokens`` adds up, over them
    all, the code points of the last turn for every member but one. ``ends_sha256`` is the digest
    of the ids of the conversations that are exactly this prefix, ascending, with commas.

    Turnless conversations belong to the root alone; without conversations there is no row. A
    conversation's ids are one row, 16 bytes a turn; conversation ids must be distinct.
    """
    spark = sequences.sparkSession
    keyed = sequences.select(
        "conv_id",
        F.unhex(F.array_join(F.transform("turns", lambda t: t["id"]), "")).alias("ids"),
        F.transform("turns", lambda t: t["chars"]).alias("chars"),
    )
    ordered = settle(keyed.repartitionByRange("ids", "conv_id").sortWithinPartitions("ids", "conv_id"))
    folder = scratch(spark, "trie-borders")

    def borders(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = last = None
        for batch in batches:
            if batch.num_rows:
                first = batch.column(0)[0].as_py() if first is None else first
                last = batch.column(0)[batch.num_rows - 1].as_py()
        if first is not None:
            part, out = TaskContext.get().partitionId(), io.BytesIO()
            np.savez(out, first=np.frombuffer(first, np.uint8), last=np.frombuffer(last, np.uint8))
            publish(folder, _border_name(part), out.getvalue())
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32())], names=["part"])

    # one number for each partition that has rows
    parts = sorted(r[0] for r in ordered.select("ids").mapInArrow(borders, "part int").collect())

    def beside(part: int, step: int, which: str) -> bytes | None:
        at = parts.index(part) + step
        if not 0 <= at < len(parts):
            return None
        data = fetch(folder, _border_name(parts[at]))
        if data is None:
            raise FileNotFoundError(f"{folder}/{_border_name(parts[at])}")
        return np.load(io.BytesIO(data))[which].tobytes()

    def build(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, key = TaskContext.get().partitionId(), 0, None
        piece = digest = None
        before = after = None
        text: list[bytes] = []

        def close_key() -> None:
            """The members of the key that ends here, as a digest or, if others have more, a file."""
            spans = key == before or key == after
            if spans:
                name = f"ends-{part:08d}-{number}-{len(piece.keys)}"
                publish(folder, name, b",".join(text))
                piece.files.append(name)
                piece.ends.append(None)
            else:
                piece.files.append(None)
                piece.ends.append(digest.hexdigest())
            text.clear()

        for conv_id, ids, chars in _rows(batches):
            if piece is None:
                before, after = beside(part, -1, "last"), beside(part, 1, "first")
                piece = Piece(before)
            if ids != key:
                if key is not None:
                    close_key()
                    if piece.size >= piece_bytes:
                        yield piece.nodes(ids, part, number)
                        piece, number = Piece(key), number + 1
                key, digest = ids, hashlib.sha256()
                piece.open_key(ids, chars.as_py(), conv_id)
            member = str(conv_id).encode()
            if key == before or key == after:
                text.append(member)
            else:
                digest.update(b"," + member if piece.counts[-1] else member)
            piece.counts[-1] += 1
        if piece is not None:
            close_key()
            yield piece.nodes(after, part, number)

    found = written(ordered.mapInArrow(build, NODE_SCHEMA), "trie-pieces")
    at_border = found.filter("open")
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    same = [F.first(c).alias(c) for c in ("parent", "depth", "turn_id")]
    one = [F.min("conv_id").alias("conv_id"), F.max("ends_sha256").alias("ends_sha256")]
    digests = _joined_ends(found.filter(F.col("ends_file").isNotNull()), folder)
    merged = written(
        at_border.groupBy("node").agg(*same, *sums, *one)
        .join(digests, "node", "left")
        .withColumn("ends_sha256", F.coalesce("whole_sha256", "ends_sha256")),
        "trie-borders-merged",
    )
    up = merged.select(F.col("node").alias("parent"), F.col("conv_id").alias("above"))
    # pairs of piece and border node, so that no parent meets the children of other pieces
    pairs = at_border.select("part", "piece", F.col("node").alias("parent")).join(up, "parent")
    inside = found.filter(~F.col("open")).join(pairs, ["part", "piece", "parent"], "left")
    columns = [
        "node", "parent", "turn_id", "conv_id", "depth",
        F.coalesce("parent_conv_id", "above").alias("parent_conv_id"),
        "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(NOTHING)).alias("ends_sha256"),
    ]
    edge = merged.withColumn("parent_conv_id", F.lit(None).cast("long")).join(up, "parent", "left")
    return inside.select(*columns).unionByName(edge.select(*columns))


def _joined_ends(rows: DataFrame, folder: str) -> DataFrame:
    """``(node, whole_sha256)``: one digest over the files of a node, in the order of the ranges.

    The digest runs through a file at a time; rows hold only names.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = filesystem(folder)
        node, digest = None, None

        def out() -> pa.RecordBatch:
            columns = [pa.array([node], pa.binary()), pa.array([digest.hexdigest()])]
            return pa.RecordBatch.from_arrays(columns, names=["node", "whole_sha256"])

        for batch in batches:
            for own, file in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if own != node:
                    if node is not None:
                        yield out()
                    node, digest = own, hashlib.sha256()
                else:
                    digest.update(b",")
                with store.open_input_stream(f"{root}/{file}", compression=None) as source:
                    while piece := source.read(1 << 20):
                        digest.update(piece)
        if node is not None:
            yield out()

    dealt = rows.repartition("node").sortWithinPartitions("node", "part")
    return dealt.select("node", "ends_file").mapInArrow(run, "node binary, whole_sha256 string")


def with_turns(
    nodes: DataFrame, conversations: DataFrame, *, role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """``nodes`` with ``role`` and ``text`` of their last turn, both null for the root."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    turns = conversations.select(F.unhex(turn_id(role, text)).alias("turn_id"), role.alias("role"), text.alias("text"))
    return nodes.join(turns.dropDuplicates(["turn_id"]), "turn_id", "left")


def conversation_trie(conversations: DataFrame, **columns: str) -> DataFrame:
    """The prefix trie of conversations as they are; see :func:`pack_turns` and :func:`prefix_nodes`."""
    return prefix_nodes(pack_turns(conversations, **columns))
