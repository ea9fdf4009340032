"""Line dedup over a corpus with a sharded minimal perfect hash.

One pass turns every line worth looking at into 128 bits of hash; counting documents per hash
leaves the repeated lines. Their hashes are dealt to shards of bounded size, and each shard
becomes a minimal perfect hash with three flat arrays: fingerprints, document counts and the
document that keeps the line. A second pass over the documents probes these arrays; neither
lines nor texts are shuffled for it.

The perfect hash is the usual cascade of bit arrays: a key takes the bit its level's hash gives
it unless another key wants the same, which sends both to the next level; the number of set bits
before a key's bit is its slot. A probe finds a slot for any key, so the 64-bit fingerprint,
which no level uses, tells members from others.
"""

from __future__ import annotations

import io
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import SPACE, Held, lean, publish, scratch, texts, written

LEAST_CHARS = 20
LEAST_DOCUMENTS = 3

# Keys per shard; an index of a shard this size takes about 6 MB.
SHARD_KEYS = 262_144
# Bytes of shards that a Python worker keeps; others are read again when they are needed.
HELD_BYTES = 192 << 20

NO_DOCUMENT = np.iinfo(np.int64).min


def line_key(line: str) -> bytes:
    """What makes two lines equal: ASCII white space stripped, A-Z lower-cased, UTF-8."""
    return line.strip(SPACE).encode().lower()


def _code_points(key: bytes) -> int:
    return len(key) if key.isascii() else len(key.decode())


def _hashes(text: str) -> list[tuple[int, int, int]]:
    """``(line number, high, low)`` of every line of ``text`` that is long enough."""
    found = []
    for number, line in enumerate(text.split("\n")):
        if len(line) >= LEAST_CHARS:
            key = line_key(line)
            if len(key) >= LEAST_CHARS and _code_points(key) >= LEAST_CHARS:
                digest = xxhash.xxh3_128_intdigest(key)
                found.append((number, digest >> 64, digest & 0xFFFFFFFFFFFFFFFF))
    return found


def _mix(keys: np.ndarray, level: int) -> np.ndarray:
    """A fresh 64-bit hash of ``keys`` for each level (finalizer of splitmix64)."""
    z = keys + np.uint64((0x9E3779B97F4A7C15 * (level + 1)) & 0xFFFFFFFFFFFFFFFF)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit keys; equal keys must not be given."""

    def __init__(self, widths: np.ndarray, bits: np.ndarray):
        self.widths = widths  # bits of each level, multiples of 64
        self.bits = bits  # all levels' bits as one array of words
        ones = np.bitwise_count(bits).astype(np.int64)
        self.before = np.cumsum(ones) - ones  # set bits before each word

    @classmethod
    def build(cls, keys: np.ndarray, spread: float = 2.0) -> PerfectHash:
        widths, words, level = [], [], 0
        while len(keys):
            width = max(64, int(len(keys) * spread) // 64 * 64 + 64)
            at = (_mix(keys, level) % np.uint64(width)).astype(np.int64)
            wanted = np.bincount(at, minlength=width)
            alone = wanted[at] == 1
            bits = np.packbits(wanted == 1, bitorder="little").view(np.uint64)
            widths.append(width)
            words.append(bits)
            keys = keys[~alone]
            level += 1
        return cls(
            np.array(widths, dtype=np.int64),
            np.concatenate(words) if words else np.empty(0, np.uint64),
        )

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of every key; -1 for those that no level takes, which are no members."""
        out = np.full(len(keys), -1, dtype=np.int64)
        open_ = np.arange(len(keys))
        start = 0
        for level, width in enumerate(self.widths):
            if not len(open_):
                break
            at = (_mix(keys[open_], level) % np.uint64(width)).astype(np.int64) + start
            word, bit = at >> 6, (at & 63).astype(np.uint64)
            found = (self.bits[word] >> bit) & np.uint64(1) == 1
            below = self.bits[word[found]] & ((np.uint64(1) << bit[found]) - np.uint64(1))
            out[open_[found]] = self.before[word[found]] + np.bitwise_count(below)
            open_ = open_[~found]
            start += int(width)
        return out


class Shard:
    """A perfect hash with the arrays its slots index."""

    def __init__(self, hash_: PerfectHash, fingerprints, counts, keepers):
        self.hash, self.fingerprints, self.counts, self.keepers = hash_, fingerprints, counts, keepers
        self.bytes = sum(a.nbytes for a in (hash_.bits, hash_.before, fingerprints, counts, keepers))

    @classmethod
    def build(cls, high, low, counts, keepers) -> Shard:
        hash_ = PerfectHash.build(_position(high, low))
        slot = hash_.slots(_position(high, low))
        placed = [np.empty(len(slot), a.dtype) for a in (low, counts, keepers)]
        for target, values in zip(placed, (low, counts, keepers)):
            target[slot] = values
        return cls(hash_, *placed)

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(
            out,
            widths=self.hash.widths,
            bits=self.hash.bits,
            fingerprints=self.fingerprints,
            counts=self.counts,
            keepers=self.keepers,
        )
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> Shard:
        a = np.load(io.BytesIO(data))
        return cls(PerfectHash(a["widths"], a["bits"]), a["fingerprints"], a["counts"], a["keepers"])

    def probe(self, high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Whether each key is a member, its document count and its keeper."""
        slot = self.hash.slots(_position(high, low))
        at = np.maximum(slot, 0)
        member = (slot >= 0) & (self.fingerprints[at] == low)
        return member, np.where(member, self.counts[at], 0), np.where(member, self.keepers[at], 0)


def _position(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """What the perfect hash takes: both halves mixed, so keys that share one still part."""
    return high ^ (low * np.uint64(0xD6E8FEB86659FD93))


def repeated_lines(
    documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``(high, low, n_documents, keeper)`` of every line key in enough documents.

    A document is a distinct id; all rows without id count as one document, which keeps a line
    only if no row with an id holds it (``keeper`` is then null). A line in a third of all
    documents is counted in parts, because counts are combined before they are shuffled.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, high, low = [], [], []
            for number, text in enumerate(texts(batch, 1)):
                for h, l in {(h, l) for _, h, l in _hashes(text)}:
                    row.append(number)
                    high.append(h)
                    low.append(l)
            halves = [pa.array(np.array(x, dtype=np.uint64).view(np.int64)) for x in (high, low)]
            ids = batch.column(0).take(pa.array(row, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, *halves], names=["doc", "high", "low"])

    source = documents.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    return (
        source.mapInArrow(lean(run), "doc long, high long, low long")
        .distinct()
        .groupBy("high", "low")
        .agg(F.count("*").alias("n_documents"), F.max("doc").alias("keeper"))
        .filter(F.col("n_documents") >= LEAST_DOCUMENTS)
    )


def _shard_name(shard: int) -> str:
    return f"shard-{shard:06d}.npz"


def build_index(
    lines: DataFrame, folder: str, *, shard_keys: int = SHARD_KEYS
) -> tuple[int, frozenset[int]]:
    """Write the index of ``repeated_lines`` below ``folder``.

    Returns the number of shards and which of them have keys and so a file.

    Shards are groups of about ``shard_keys`` keys by hash, so none grows with the corpus. Each
    is written under a temporary name and moved, so a repeated task replaces equal content.
    """
    settled = written(lines, "repeated-lines")
    shards = max(1, -(-settled.count() // shard_keys))

    def build(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        halves = [table.column(x).to_numpy().view(np.uint64) for x in ("high", "low")]
        keepers = table.column("keeper").fill_null(int(NO_DOCUMENT)).to_numpy()
        counts = table.column("n_documents").to_numpy().astype(np.uint32)
        data = Shard.build(*halves, counts, keepers).dump()
        publish(folder, _shard_name(shard), data)
        return pa.table({"shard": pa.array([shard], pa.int32()), "bytes": pa.array([len(data)], pa.int64())})

    dealt = settled.withColumn("shard", F.pmod(F.col("high"), F.lit(shards)).cast("int"))
    built = dealt.groupBy("shard").applyInArrow(build, "shard int, bytes long")
    return shards, frozenset(row["shard"] for row in built.select("shard").collect())


_HELD = Held(HELD_BYTES, Shard.load)


def _drop(rows: list[str], ids: list[int | None], folder: str, shards: int, built: frozenset[int]):
    """Kept text, line count and dropped count of every row."""
    where, numbers, high, low = [], [], [], []
    for row, text in enumerate(rows):
        for number, h, l in _hashes(text):
            where.append(row)
            numbers.append(number)
            high.append(h)
            low.append(l)
    high, low = np.array(high, dtype=np.uint64), np.array(low, dtype=np.uint64)
    # Shards are dealt by Spark's pmod of the signed value.
    shard = np.mod(high.view(np.int64), np.int64(shards))
    order = np.argsort(shard, kind="stable")
    borders = np.flatnonzero(np.diff(shard[order])) + 1
    doomed: dict[int, set[int]] = {}
    for part in np.split(order, borders) if len(order) else []:
        number = int(shard[part[0]])
        if number not in built:  # no line of this shard is repeated
            continue
        index = _HELD.get(folder, _shard_name(number))
        if index is None:
            raise FileNotFoundError(f"{folder}/{_shard_name(number)}")
        member, _, keepers = index.probe(high[part], low[part])
        for at, keeper in zip(part[member].tolist(), keepers[member].tolist()):
            own = NO_DOCUMENT if ids[where[at]] is None else ids[where[at]]
            if own != keeper:
                doomed.setdefault(where[at], set()).add(numbers[at])
    kept, n_lines, n_dropped = [], [], []
    for row, text in enumerate(rows):
        gone = doomed.get(row, ())
        n_lines.append(text.count("\n") + 1)
        n_dropped.append(len(gone))
        if gone:
            text = "\n".join(x for k, x in enumerate(text.split("\n")) if k not in gone)
        kept.append(text)
    return kept, n_lines, n_dropped


def dedup_lines(
    documents: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    shard_keys: int = SHARD_KEYS,
) -> DataFrame:
    """``(id, kept, n_lines, n_dropped)``: every text without the lines another document keeps.

    A line key of at least 20 code points in at least 3 documents stays only in the largest id
    that holds it, there as often as it occurs. Null and empty texts are one empty line. Rows
    without id count as one document below all others. Repeated rows are the same document, so
    both keep a line or both lose it. Other columns are not read.
    """
    source = documents.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string"))
    folder = scratch(documents.sparkSession, "line-index")
    shards, built = build_index(
        repeated_lines(documents, id_col=id_col, text_col=text_col), folder, shard_keys=shard_keys
    )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, n_lines, n_dropped = _drop(
                texts(batch, 1), batch.column(0).to_pylist(), folder, shards, built
            )
            arrays = [pa.array(kept, pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *arrays], names=[id_col, "kept", "n_lines", "n_dropped"]
            )

    return source.mapInArrow(lean(run), f"`{id_col}` long, kept string, n_lines long, n_dropped long")


def replace_texts(
    documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = "n_chars"
) -> DataFrame:
    """All rows and columns of ``documents`` with repeated lines dropped from the text.

    ``chars_col``, if the table has it, is set to the new length. Null texts stay null.
    """
    folder = scratch(documents.sparkSession, "line-index")
    shards, built = build_index(repeated_lines(documents, id_col=id_col, text_col=text_col), folder)
    text_at = documents.columns.index(text_col)
    chars_at = documents.columns.index(chars_col) if chars_col in documents.columns else None

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(id_col).to_pylist()
            kept, _, dropped = _drop(texts(batch, text_col), ids, folder, shards, built)
            old = batch.column(text_col).to_pylist()
            kept = [new if gone else was for new, gone, was in zip(kept, dropped, old)]
            columns = list(batch.columns)
            columns[text_at] = pa.array(kept, columns[text_at].type)
            if chars_at is not None:
                was = columns[chars_at].to_pylist()
                counts = [len(t) if gone else n for t, gone, n in zip(kept, dropped, was)]
                columns[chars_at] = pa.array(counts, columns[chars_at].type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return documents.mapInArrow(lean(run), documents.schema)
