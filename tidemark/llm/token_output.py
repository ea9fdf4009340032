"""Token ids as binary shards in training order.

All texts in the table's own order, each closed by a separator, are one stream of tokens that is cut
into sequences of fixed length. A keyed Feistel permutation over the numbers of all sequences gives
each its global slot; where the Feistel network leaves the range it is applied again (cycle-walking),
so slots are a permutation without gaps and anyone with the key can compute either way. Shards are
ranges of slots, and a shard file is its sequences one after the other in a fixed stride: training
reads files from front to back and resumes at any slot by seeking.

The first pass encodes every text once and keeps the ids compressed, in runs that know their place
in their partition of the scan; with the tokens of the partitions before it, each run knows its place
in the stream, and the second pass cuts the kept ids and sends every piece of a sequence straight to
its shard. Tokens are moved once, and never sorted by one task.
Files are written under temporary names and appear in the manifest only when all are complete.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import tiktoken
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import discard, fetch, filesystem, move_files, publish, slices, texts, written

SEQUENCE_TOKENS = 1024
SHARD_SEQUENCES = 8192
ROUNDS = 4
KEY = 9
SEPARATOR = 50256  # free in the 50k vocabularies
MANIFEST = "manifest.json"
RUN_BYTES = 4 << 20
# How hard ids are compressed: whole runs, which are kept for the second pass, and pieces of sequences.
KEPT_LEVEL = 5
PIECE_LEVEL = 1


class Permutation:
    """A keyed permutation of ``0 .. n-1``: a balanced Feistel network with cycle-walking."""

    def __init__(self, n: int, key: int = KEY, rounds: int = ROUNDS):
        self.n = n
        self.half = np.uint64(max(1, -(-max(1, (n - 1).bit_length()) // 2)))
        self.mask = np.uint64((1 << int(self.half)) - 1)
        digest = hashlib.sha256(f"feistel:{key}:{n}".encode()).digest()
        # More keys than a digest holds are made from its successors.
        while len(digest) < 8 * rounds:
            digest += hashlib.sha256(digest).digest()
        self.keys = np.frombuffer(digest, dtype="<u8")[:rounds]

    def _mix(self, half: np.ndarray, key: np.uint64) -> np.ndarray:
        z = half + key
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return (z ^ (z >> np.uint64(31))) & self.mask

    def _forward(self, x: np.ndarray) -> np.ndarray:
        left, right = x >> self.half, x & self.mask
        for key in self.keys:
            left, right = right, left ^ self._mix(right, key)
        return (left << self.half) | right

    def _backward(self, x: np.ndarray) -> np.ndarray:
        left, right = x >> self.half, x & self.mask
        for key in self.keys[::-1]:
            left, right = right ^ self._mix(left, key), left
        return (left << self.half) | right

    def _walk(self, x: np.ndarray, step) -> np.ndarray:
        out = step(np.asarray(x, dtype=np.uint64))
        while (outside := out >= self.n).any():
            out[outside] = step(out[outside])
        return out.astype(np.int64)

    def slots(self, numbers: np.ndarray) -> np.ndarray:
        """The slot of every sequence number."""
        return self._walk(numbers, self._forward)

    def numbers(self, slots: np.ndarray) -> np.ndarray:
        """The sequence number in every slot."""
        return self._walk(slots, self._backward)


@lru_cache(maxsize=4)
def _encoding(path: str, pattern: str) -> tiktoken.Encoding:
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, lines)}
    # One special token, which no text is searched for: without any tiktoken tries each position.
    special = {"<|separator|>": max(ranks.values()) + 1}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)


def _streams(batch: pa.RecordBatch, text: int, path: str, pattern: str, separator: int):
    """The token ids of every text of a batch, closed by the separator."""
    encode = _encoding(path, pattern).encode_to_numpy
    for value in texts(batch, text):
        ids = encode(value, disallowed_special=())
        closed = np.empty(len(ids) + 1, dtype=np.uint16)
        closed[:-1], closed[-1] = ids, separator
        yield closed


@lru_cache(maxsize=4)
def _compressor(level: int) -> zstandard.ZstdCompressor:
    # Matches of two ids count: repeated words are short.
    how = zstandard.ZstdCompressionParameters.from_level(level, min_match=4, write_content_size=True)
    return zstandard.ZstdCompressor(compression_params=how)


def _packed(ids: np.ndarray, level: int) -> bytes:
    return _compressor(level).compress(ids.astype("<u2").tobytes())


def _unpacked(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def _encoded(source: DataFrame, path: str, pattern: str, separator: int) -> DataFrame:
    """``(part, place, tokens, docs, sizes, ids)``: the ids of runs of texts, each run with its place in
    its partition of the scan."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, place = TaskContext.get().partitionId(), 0
        for batch in (piece for whole in batches for piece in slices(whole, 1, RUN_BYTES)):
            own = list(_streams(batch, 1, path, pattern, separator))
            stream = np.concatenate(own)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([part], pa.int32()),
                    pa.array([place], pa.int64()),
                    pa.array([len(stream)], pa.int64()),
                    pa.array([batch.column(0).to_pylist()], pa.list_(pa.int64())),
                    pa.array([list(map(len, own))], pa.list_(pa.int64())),
                    pa.array([_packed(stream, KEPT_LEVEL)], pa.binary()),
                ],
                names=["part", "place", "tokens", "docs", "sizes", "ids"],
            )
            place += len(stream)

    return source.mapInArrow(
        run, "part int, place long, tokens long, docs array<long>, sizes array<long>, ids binary"
    )


_PIECES = "shard int, slot long, at int, ids binary, docs array<long>"
_FILES = "shard int, first_slot long, sequences long, bytes long, sha256 string, temporary string, name string"


def write_shards(
    documents: DataFrame,
    folder: str,
    path: str,
    pattern: str,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    sequence_tokens: int = SEQUENCE_TOKENS,
    shard_sequences: int = SHARD_SEQUENCES,
    key: int = KEY,
    separator: int = SEPARATOR,
) -> DataFrame:
    """Write the shards below ``folder`` and return ``(slot, sequence, shard, n_tokens, doc_ids)``.

    ``documents`` is scanned once, in the order in which Spark gives it. Null and empty texts are a separator alone;
    the last sequence is filled up with separators, which ``n_tokens`` does not count; an empty
    table gives no shard. Ids may repeat or be null. Other columns are not read. Ids are
    little-endian unsigned 16-bit integers, so the vocabulary and separator must be below 65,536.
    """
    source = documents.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    kept = written(_encoded(source, path, pattern, separator), "token-ids")
    counts = kept.groupBy("part").agg(F.sum("tokens").alias("tokens")).collect()  # one a partition
    starts, total = {}, 0
    for part, tokens in sorted(map(tuple, counts)):
        starts[part] = total
        total += tokens
    n = -(-total // sequence_tokens)
    order = Permutation(n, key)
    shards = -(-n // shard_sequences)
    length = sequence_tokens

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                part, place, tokens, doc_ids, sizes, ids = (c[row].as_py() for c in batch.columns)
                place += starts[part]
                stream = np.frombuffer(_unpacked(ids), dtype="<u2")
                ends = place + np.cumsum(sizes)
                first, last = place // length, (place + tokens - 1) // length
                borders = np.maximum(np.arange(first, last + 2) * length, place)
                borders[-1] = place + tokens
                # The texts that reach into each piece.
                begin = np.searchsorted(ends, borders[:-1], side="right")
                end = np.searchsorted(ends, borders[1:] - 1, side="right")
                numbers = np.arange(first, last + 1)
                slots = order.slots(numbers)
                pieces = [_packed(stream[a - place : b - place], PIECE_LEVEL) for a, b in zip(borders, borders[1:])]
                docs = [doc_ids[a : b + 1] for a, b in zip(begin, end)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array((slots // shard_sequences).astype(np.int32)),
                        pa.array(slots),
                        pa.array((borders[:-1] - numbers * length).astype(np.int32)),
                        pa.array(pieces, pa.binary()),
                        pa.array(docs, pa.list_(pa.int64())),
                    ],
                    names=["shard", "slot", "at", "ids", "docs"],
                )

    def assemble(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sequences in the order of slots, each put together from its pieces."""
        writer, held = None, None
        for batch in batches:
            rows = []
            for shard, slot, _, packed, docs in zip(*(c.to_pylist() for c in batch.columns)):
                ids = _unpacked(packed)
                if held is not None and held["slot"] == slot:
                    held["ids"].append(ids)
                    held["docs"] += docs[held["docs"][-1:] == docs[:1] :]
                    continue
                if held is not None:
                    rows.append(writer.add(held))
                if writer is None or writer.shard != shard:
                    rows += writer.close() if writer else []
                    writer = _ShardFile(folder, shard, shard_sequences, length, separator)
                held = {"slot": slot, "ids": [ids], "docs": docs}
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=_ROWS)
        if held is not None:
            yield pa.RecordBatch.from_pylist([writer.add(held), *writer.close()], schema=_ROWS)

    pieces = kept.mapInArrow(cut, _PIECES)
    sorted_ = pieces.repartitionById(max(1, shards), F.col("shard")).sortWithinPartitions("slot", "at")
    rows = written(sorted_.mapInArrow(assemble, f"slot long, n_tokens int, doc_ids array<long>, {_FILES}"), "shards")
    discard(kept)
    files = rows.filter("slot IS NULL")
    move_files(files, folder)
    listed = files.select("shard", "first_slot", "sequences", "bytes", "sha256", "name").orderBy("shard").toPandas()
    about = {
        "sequences": n,
        "tokens": total,
        "sequence_tokens": length,
        "shard_sequences": shard_sequences,
        "dtype": "<u2",
        "separator": separator,
        "key": key,
        "rounds": ROUNDS,
        "files": listed.to_dict("records"),
    }
    publish(folder, MANIFEST, json.dumps(about).encode())

    @F.pandas_udf("long")
    def number_of(slots: pd.Series) -> pd.Series:
        return pd.Series(order.numbers(slots.to_numpy()))

    return rows.filter("slot IS NOT NULL").select(
        "slot", number_of("slot").alias("sequence"), "shard", "n_tokens", "doc_ids"
    )


_ROWS = pa.schema(
    [
        ("slot", pa.int64()),
        ("n_tokens", pa.int32()),
        ("doc_ids", pa.list_(pa.int64())),
        ("shard", pa.int32()),
        ("first_slot", pa.int64()),
        ("sequences", pa.int64()),
        ("bytes", pa.int64()),
        ("sha256", pa.string()),
        ("temporary", pa.string()),
        ("name", pa.string()),
    ]
)


class _ShardFile:
    """One shard under a temporary name; slots must come in order and without gaps."""

    def __init__(self, folder: str, shard: int, per_shard: int, length: int, separator: int):
        self.shard, self.first, self.length = shard, shard * per_shard, length
        self.fill = np.array([separator], dtype="<u2").tobytes()
        self.name = f"tokens-{shard:06d}.bin"
        self.temporary = f"_temporary/{self.name}.{uuid.uuid4().hex}"
        self.store, root = filesystem(folder)
        self.store.create_dir(f"{root}/_temporary", recursive=True)
        self.out = self.store.open_output_stream(f"{root}/{self.temporary}", compression=None)
        self.sha, self.count = hashlib.sha256(), 0

    def add(self, held: dict) -> dict:
        if held["slot"] != self.first + self.count:
            raise ValueError(f"Slot {held['slot']} follows {self.first + self.count - 1}")
        ids = b"".join(held["ids"])
        n_tokens = len(ids) // 2
        ids += self.fill * (self.length - n_tokens)
        self.out.write(ids)
        self.sha.update(ids)
        self.count += 1
        return {"slot": held["slot"], "n_tokens": n_tokens, "doc_ids": held["docs"], "shard": self.shard}

    def close(self) -> list[dict]:
        self.out.close()
        return [
            {
                "shard": self.shard,
                "first_slot": self.first,
                "sequences": self.count,
                "bytes": 2 * self.length * self.count,
                "sha256": self.sha.hexdigest(),
                "temporary": self.temporary,
                "name": self.name,
            }
        ]


def read_shards(spark: SparkSession, folder: str, *, from_slot: int = 0, run: int = 1024) -> DataFrame:
    """``(slot, ids)`` from ``from_slot`` on, ``ids`` as packed bytes; no earlier byte is read.

    Rows come in the order of slots within each task, which reads whole runs of sequences.
    """
    about = json.loads(fetch(folder, MANIFEST))
    stride = 2 * about["sequence_tokens"]
    runs = []
    for file in about["files"]:
        end = file["first_slot"] + file["sequences"]
        for slot in range(max(from_slot, file["first_slot"]), end, run):
            runs.append((file["name"], (slot - file["first_slot"]) * stride, slot, min(run, end - slot)))
    listed = spark.createDataFrame(runs, "name string, offset long, slot long, n long")

    def load(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = filesystem(folder)
        for batch in batches:
            for name, offset, slot, n in zip(*(c.to_pylist() for c in batch.columns)):
                with store.open_input_file(f"{root}/{name}") as source:
                    data = source.read_at(n * stride, offset)
                ids = [data[k : k + stride] for k in range(0, len(data), stride)]
                slots = pa.array(np.arange(slot, slot + n))
                yield pa.RecordBatch.from_arrays([slots, pa.array(ids, pa.binary())], names=["slot", "ids"])

    spread = listed.repartition(max(1, min(len(runs), 10_000)))
    return spread.mapInArrow(load, "slot long, ids binary")
