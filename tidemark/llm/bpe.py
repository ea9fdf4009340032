"""Byte-level BPE over whole texts: encoding, decoding and their round trip.

A text is split by the tokenizer's pattern, and every match is merged on its own. A segment
tree over the byte positions of the match holds at each node the smallest ``rank, position`` of
the pairs below it, so its root is the leftmost pair of least rank. A merge changes three leaves:
the merged position, its live neighbour to the left and the position that dies.

Matches repeat, so each Python worker remembers the ids of those it has merged in two
generations of bounded size; forgetting one costs time, never a result. Short matches that are
new are merged in lockstep, their trees side by side in one array; long ones one by one.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import lean, texts

# Matches up to this many bytes are merged in lockstep and remembered, so many in a generation.
LOCKSTEP_BYTES = 64
REMEMBERED = 400_000
RUN_CHARS = 1_000_000

NO_PAIR = 1 << 62


def merge_ranks(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The token ids of one match of the pattern."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    size = 1 << max(1, (n - 1).bit_length())
    shift = size.bit_length() - 1
    tree = [NO_PAIR] * (2 * size)
    get = ranks.get
    for i in range(n - 1):
        rank = get(piece[i : i + 2])
        if rank is not None:
            tree[size + i] = (rank << shift) | i
    for k in range(size - 1, 0, -1):
        left, right = tree[2 * k], tree[2 * k + 1]
        tree[k] = left if left < right else right
    after = list(range(1, n + 1))  # start of the next live token
    before = list(range(-1, n - 1))

    def put(i: int, value: int) -> None:
        k = size + i
        tree[k] = value
        k >>= 1
        while k:
            left, right = tree[2 * k], tree[2 * k + 1]
            least = left if left < right else right
            if tree[k] == least:
                return
            tree[k] = least
            k >>= 1

    mask = size - 1
    while tree[1] < NO_PAIR:
        i = tree[1] & mask
        dead = after[i]
        end = after[dead]
        after[i] = end
        if end < n:
            before[end] = i
            rank = get(piece[i : after[end]])
        else:
            rank = None
        if tree[size + dead] < NO_PAIR:
            put(dead, NO_PAIR)
        put(i, NO_PAIR if rank is None else (rank << shift) | i)
        p = before[i]
        if p >= 0:
            rank = get(piece[p:end])
            put(p, NO_PAIR if rank is None else (rank << shift) | p)
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : after[i]]])
        i = after[i]
    return out


class _Lockstep:
    """Merges many short matches at once: every step takes one merge in each match not yet done.

    The trees of all matches of a width are rows of one array, and a step's point updates walk
    up all rows together. Same merges as :func:`merge_ranks`, with token pairs looked up by id.
    """

    def __init__(self, ranks: dict[bytes, int]):
        keys, found = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    keys.append((left << 32) | right)
                    found.append(rank)
        order = np.argsort(np.array(keys, dtype=np.int64))
        self.keys = np.array(keys, dtype=np.int64)[order]
        self.found = np.array(found, dtype=np.int64)[order]
        self.bytes = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)

    def pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair's merged token, or -1."""
        key = (left << 32) | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.found[at], -1)

    def merge(self, pieces: list[bytes], size: int) -> list[bytes]:
        """Packed ids of matches of 2 to ``size`` bytes, ``size`` a power of two."""
        n, shift = len(pieces), size.bit_length() - 1
        lengths = np.fromiter(map(len, pieces), np.int64, n)
        padded = b"".join(piece.ljust(size, b"\0") for piece in pieces)
        raw = np.frombuffer(padded, dtype=np.uint8).reshape(n, size)
        place = np.arange(size)
        live = place < lengths[:, None]
        token = self.bytes[raw]
        after = np.broadcast_to(place + 1, (n, size)).copy()
        before = np.broadcast_to(place - 1, (n, size)).copy()
        tree = np.full((n, 2 * size), NO_PAIR, dtype=np.int64)
        rank = self.pair(token[:, :-1], token[:, 1:])
        usable = (rank >= 0) & live[:, 1:]
        tree[:, size : 2 * size - 1][usable] = ((rank << shift) | place[:-1])[usable]
        width = size
        while width > 1:
            half = width // 2
            np.minimum(tree[:, width : 2 * width : 2], tree[:, width + 1 : 2 * width : 2], out=tree[:, half:width])
            width = half

        def put(rows: np.ndarray, at: np.ndarray, value: np.ndarray | int) -> None:
            k = at + size
            tree[rows, k] = value
            for _ in range(shift):
                k = k >> 1
                tree[rows, k] = np.minimum(tree[rows, 2 * k], tree[rows, 2 * k + 1])

        def leaf(rank: np.ndarray, at: np.ndarray) -> np.ndarray:
            return np.where(rank < 0, NO_PAIR, (rank << shift) | at)

        rows = np.flatnonzero(tree[:, 1] < NO_PAIR)
        while len(rows):
            root = tree[rows, 1]
            i = root & (size - 1)
            dead = after[rows, i]
            end = after[rows, dead]
            token[rows, i] = root >> shift
            after[rows, i] = end
            live[rows, dead] = False
            followed = end < lengths[rows]
            before[rows[followed], end[followed]] = i[followed]
            put(rows, dead, NO_PAIR)
            right = token[rows, np.minimum(end, size - 1)]
            put(rows, i, leaf(np.where(followed, self.pair(root >> shift, right), -1), i))
            led = before[rows, i] >= 0
            own, p = rows[led], before[rows, i][led]
            put(own, p, leaf(self.pair(token[own, p], token[own, i[led]]), p))
            rows = rows[tree[rows, 1] < NO_PAIR]
        packed = token[live].astype("<u4").tobytes()
        ends = np.cumsum(live.sum(axis=1)) * 4
        return [packed[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]


class Codec:
    """Encoder and decoder for one rank file and pattern."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            pairs = (line.split() for line in lines if line.strip())
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in pairs}
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.pattern = regex.compile(pattern)
        self.lockstep = _Lockstep(self.ranks)
        self.merged: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _learn(self, pieces: set[str]) -> dict[str, bytes]:
        """Ids of the given matches; those worth it are remembered."""
        found, widths = {}, {}
        for piece in pieces:
            packed = self.older.get(piece)
            if packed is None:
                raw = piece.encode()
                rank = self.ranks.get(raw)
                if rank is not None:
                    packed = rank.to_bytes(4, "little")
                elif len(raw) > LOCKSTEP_BYTES:
                    packed = np.array(merge_ranks(raw, self.ranks), dtype="<u4").tobytes()
                else:
                    widths.setdefault(1 << (len(raw) - 1).bit_length(), []).append((piece, raw))
                    continue
            found[piece] = packed
        for size, members in widths.items():
            packed = self.lockstep.merge([raw for _, raw in members], size)
            found.update(zip([piece for piece, _ in members], packed))
        if len(self.merged) + len(found) > REMEMBERED:
            self.older, self.merged = self.merged, {}
        kept = {k: v for k, v in found.items() if len(k) <= LOCKSTEP_BYTES}
        self.merged.update(kept)
        return found

    def encode_all(self, texts: Iterable[str]) -> list[bytes]:
        """Ids of every text as little-endian unsigned 32-bit integers.

        Taken in runs of about ``RUN_CHARS`` characters, so that the matches of a large batch
        never lie in memory together.
        """
        out, run, chars = [], [], 0
        for text in texts:
            run.append(text)
            chars += len(text)
            if chars >= RUN_CHARS:
                out += self._encode_run(run)
                run, chars = [], 0
        return out + self._encode_run(run)

    def _encode_run(self, texts: list[str]) -> list[bytes]:
        split = [self.pattern.findall(text) for text in texts]
        pieces = set().union(*split)
        ids = {piece: packed for piece in pieces if (packed := self.merged.get(piece)) is not None}
        if len(ids) < len(pieces):
            ids.update(self._learn(pieces - ids.keys()))
        return [b"".join(map(ids.__getitem__, found)) for found in split]

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def decode(self, packed: bytes) -> bytes:
        ids = np.frombuffer(packed, dtype="<u4").tolist()
        return b"".join(map(self.tokens.__getitem__, ids))


@lru_cache(maxsize=4)
def codec(path: str, pattern: str) -> Codec:
    """The codec of this process; a worker reads the rank file once."""
    return Codec(path, pattern)


def _ids(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, dtype="<u4").astype(np.int32)


def encode(
    documents: DataFrame, path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``(id, ids)`` with the token ids of every whole text as ``array<int>``.

    Null and empty texts give an empty array, repeated rows one row each; other columns of the
    input, whatever their names, are not read. The rank file must be readable on every node.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            rows = [_ids(packed) for packed in own.encode_all(texts(batch, 1))]
            offsets = np.cumsum([0, *map(len, rows)], dtype=np.int32)
            flat = np.concatenate(rows) if rows else np.empty(0, np.int32)
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=[id_col, "ids"])

    kind = documents.schema[id_col].dataType.simpleString()
    source = documents.select(id_col, F.col(text_col).cast("string"))
    return source.mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def decode(
    encoded: DataFrame, path: str, pattern: str, *, id_col: str = "doc_id", ids_col: str = "ids"
) -> DataFrame:
    """``(id, decoded)`` with the bytes of every id array; null arrays give empty bytes."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            out = [
                own.decode(np.asarray(ids or [], dtype="<u4").tobytes())
                for ids in batch.column(1).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(out, pa.binary())], names=[id_col, "decoded"]
            )

    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {kind}, decoded binary")


def round_trip(
    documents: DataFrame, path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Encode every text, decode its ids, and return the count and the digests of both.

    Like :func:`encode` followed by :func:`decode`, but ids never leave the task. One row per
    input row: ``(id, n_tokens, ids_sha256, decoded_sha256)``; null and empty texts have no
    tokens and the digests of nothing.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            counts, ids_sha, text_sha = [], [], []
            for packed in own.encode_all(texts(batch, 1)):
                counts.append(len(packed) // 4)
                ids_sha.append(hashlib.sha256(packed).hexdigest())
                text_sha.append(hashlib.sha256(own.decode(packed)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha), pa.array(text_sha)],
                names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    kind = documents.schema[id_col].dataType.simpleString()
    source = documents.select(id_col, F.col(text_col).cast("string"))
    return source.mapInArrow(
        lean(run), f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
