"""Removal of repeated passages, found through fixed-block anchors.

Every window of 20 words holds one whole block of 10 words among those that start at multiples of
10 of its text. These non-overlapping blocks are indexed by hash; all rolling windows of 10 words
probe the index, dealt to shards by the same hash. What is met more than once goes back to the
texts that asked, where each hit on a block is extended to both sides as long as the rolling windows
go on being repeated. A maximal repeat of 20 words or more gives the windows whose first place in
the corpus has to be known; their 128-bit hashes are dealt to shards, too, and the answer tells each
text which of its windows start earlier elsewhere.

Texts travel nowhere. They are cut into batches of bounded size, whose words are kept as numbers in
files of shared storage. A batch sends every hash once however often it occurs in it, so a passage
in a third of all documents meets in a shard once for each batch. Rows between the steps hold sorted
hashes as differences, byte planes apart and compressed.
"""

from __future__ import annotations

import io
import re
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import fetch, publish, scratch, slices, texts, written

WINDOW = 20

# Bytes of text in a batch and, on average, behind a shard of hashes.
BATCH_BYTES = 8 << 20
SHARD_BYTES = 16 << 20
# A very long text is split into words in steps of so many bytes.
STEP_BYTES = 4 << 20
# Tasks that batches or shards are dealt to, at most.
TASKS = 20_000

# The index of blocks keeps so many bits of a hash. Chance hits only cost a look at their windows.
ANCHOR_BITS = 48

_SPACE = re.compile(rb"[\x20\x09-\x0d]")
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = 0xFFFFFFFFFFFFFFFF


class _Numbers(dict):
    """Words numbered in the order of their first use."""

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number


def _word_numbers(text: str, numbers: _Numbers) -> np.ndarray:
    data, parts, at = text.encode(), [], 0
    while at < len(data):
        end = at + STEP_BYTES
        border = _SPACE.search(data, end) if end < len(data) else None
        end = border.start() if border else len(data)
        words = data[at:end].split()  # bytes split at ASCII white space only
        parts.append(np.fromiter(map(numbers.__getitem__, words), np.int32, len(words)))
        at = end
    return np.concatenate(parts) if parts else np.empty(0, np.int32)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def rolling(values: np.ndarray, width: int) -> np.ndarray:
    """Polynomial hashes of all windows of ``width`` values, in about ``2 log width`` steps."""
    done, size = None, 0
    piece, length = values, 1
    while True:
        power = np.uint64(pow(_BASE, length, 1 << 64))
        if width & length:
            if done is None:
                done, size = piece, length
            else:
                n = max(0, len(values) - size - length + 1)
                done, size = done[:n] * power + piece[size : size + n], size + length
        if 2 * length > width:
            return _mixed(done)
        n = max(0, len(piece) - length)
        piece, length = piece[:n] * power + piece[length : length + n], 2 * length


def pack_planes(values: np.ndarray) -> bytes:
    """Numbers compressed with equal bytes of all next to each other."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize)
    return zstandard.ZstdCompressor(1).compress(np.ascontiguousarray(planes.T).tobytes())


def unpack_planes(data: bytes, kind: type) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(size, len(raw) // size).T).view(kind).ravel()


def pack_sorted(values: np.ndarray) -> bytes:
    return pack_planes(np.diff(values, prepend=np.uint64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack_planes(data, np.uint64), dtype=np.uint64)


def _borders(values: np.ndarray, bits: int, shards: int) -> list[int]:
    """Where each shard's range begins in sorted hashes of ``bits`` bits, and their end."""
    limits = [-(-(s << bits) // shards) for s in range(1, shards)]
    inner = np.searchsorted(values, np.array(limits, np.uint64)) if limits else []
    return [0, *map(int, inner), len(values)]


def _groups(*sorted_keys: np.ndarray) -> np.ndarray:
    """First places of equal runs."""
    if not len(sorted_keys[0]):
        return np.empty(0, np.int64)
    new = np.zeros(len(sorted_keys[0]), bool)
    new[0] = True
    for key in sorted_keys:
        new[1:] |= key[1:] != key[:-1]
    return np.flatnonzero(new)


class Batch:
    """Texts as word numbers, one after another."""

    def __init__(self, ids: np.ndarray, known: np.ndarray, sizes: np.ndarray, words: np.ndarray, vocabulary: list):
        self.ids, self.known, self.sizes, self.words, self.vocabulary = ids, known, sizes, words, vocabulary
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(
            out,
            ids=self.ids,
            known=self.known,
            sizes=self.sizes,
            words=np.frombuffer(pack_planes(self.words), np.uint8),
            lengths=np.array([len(w) for w in self.vocabulary], np.int64),
            vocabulary=np.frombuffer(zstandard.ZstdCompressor(1).compress(b"".join(self.vocabulary)), np.uint8),
        )
        return out.getvalue()

    @classmethod
    def load(cls, folder: str, name: str) -> Batch:
        a = np.load(io.BytesIO(_needed(folder, name)))
        data, vocabulary, at = zstandard.ZstdDecompressor().decompress(a["vocabulary"].tobytes()), [], 0
        for length in a["lengths"].tolist():
            vocabulary.append(data[at : at + length])
            at += length
        return cls(a["ids"], a["known"], a["sizes"], unpack_planes(a["words"].tobytes(), np.int32), vocabulary)

    def hashes(self) -> tuple[np.ndarray, np.ndarray]:
        """Two independent hashes of every word."""
        digests = b"".join(map(xxhash.xxh3_128_digest, self.vocabulary))
        halves = np.frombuffer(digests, ">u8").astype(np.uint64).reshape(-1, 2)
        return halves[self.words, 0], halves[self.words, 1]

    def rooms(self) -> np.ndarray:
        """Words from each place to the end of its text; none in texts without a whole window."""
        ends = np.repeat(np.where(self.sizes >= WINDOW, self.ends, -1), self.sizes)
        return ends - np.arange(len(self.words))

    def anchors(self, low: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of rolling block-sized windows and their hashes."""
        places = np.flatnonzero(self.rooms() >= block)
        hashes = rolling(low, block) >> np.uint64(64 - ANCHOR_BITS)
        return places, hashes[places]


def _needed(folder: str, name: str) -> bytes:
    data = fetch(folder, name)
    if data is None:
        raise FileNotFoundError(f"{folder}/{name}")
    return data


def _file(batch: str, kind: str) -> str:
    return f"{kind}-{batch}.npz"


def _probes(batch: Batch, block: int, shards: int) -> Iterator[tuple[int, bytes]]:
    """Distinct rolling hashes of a batch by shard, with bits for blocks and for repetition inside."""
    places, hashes = batch.anchors(batch.hashes()[1], block)
    if not len(places):
        return
    starts = np.repeat(batch.starts, batch.sizes)[places]
    is_block = ((places - starts) % block == 0).astype(np.uint64)
    marked = np.sort((hashes << np.uint64(1)) | is_block)
    hashes = marked >> np.uint64(1)
    first = _groups(hashes)
    last = np.append(first[1:], len(hashes)) - 1
    again = (last > first).astype(np.uint64)
    # of equal hashes the one marked as a block sorts last
    codes = (hashes[first] << np.uint64(2)) | (again << np.uint64(1)) | (marked[last] & np.uint64(1))
    borders = _borders(hashes[first], ANCHOR_BITS, shards)
    for shard, (a, b) in enumerate(zip(borders, borders[1:])):
        if b > a:
            yield shard, pack_sorted(codes[a:b])


def _batches(documents: DataFrame, folder: str, batch_bytes: int) -> DataFrame:
    """Write the batch files; one row with the name of each."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, words, numbers, size = [], [], _Numbers(), 0

        def close() -> pa.RecordBatch:
            nonlocal numbers
            known = np.array([x is not None for x in ids], bool)
            batch = Batch(
                np.array([x or 0 for x in ids], np.int64),
                known,
                np.array([len(w) for w in words], np.int64),
                np.concatenate(words),
                list(numbers),
            )
            name = uuid.uuid4().hex
            publish(folder, _file(name, "words"), batch.dump())
            ids.clear()
            words.clear()
            numbers = _Numbers()
            return pa.RecordBatch.from_arrays([pa.array([name])], names=["batch"])

        for arrow in batches:
            for piece in slices(arrow, 1, batch_bytes):
                for doc_id, text in zip(piece.column(0).to_pylist(), texts(piece, 1)):
                    ids.append(doc_id)
                    words.append(_word_numbers(text, numbers))
                    size += len(text)
                    if size >= batch_bytes:
                        yield close()
                        size = 0
        if ids:
            yield close()

    return documents.mapInArrow(run, "batch string")


def _probed(listed: DataFrame, folder: str, block: int, shards: int) -> DataFrame:
    """``(batch, shard, codes)``: what every batch sends to the index; see :func:`_probes`."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for arrow in batches:
            for name in arrow.column(0).to_pylist():
                for shard, codes in _probes(Batch.load(folder, _file(name, "words")), block, shards):
                    columns = [pa.array([name]), pa.array([shard], pa.int32()), pa.array([codes], pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, names=["batch", "shard", "codes"])

    return listed.mapInArrow(run, "batch string, shard int, codes binary")


def _repeated(table: pa.Table) -> pa.Table:
    """The hashes of one shard that occur more than once, for every batch that sent them."""
    names = table.column("batch").to_pylist()
    sent = [unpack_sorted(x) for x in table.column("codes").to_pylist()]
    source = np.repeat(np.arange(len(sent), dtype=np.int32), [len(x) for x in sent])
    codes = np.concatenate(sent)
    order = np.argsort(codes >> np.uint64(2), kind="stable")
    codes, source = codes[order], source[order]
    first = _groups(codes >> np.uint64(2))
    sizes = np.diff(np.append(first, len(codes)))
    met = sizes + np.maximum.reduceat((codes >> np.uint64(1)) & np.uint64(1), first).astype(np.int64)
    indexed = np.maximum.reduceat(codes & np.uint64(1), first)
    hit = np.repeat(met >= 2, sizes)
    answer = ((codes >> np.uint64(2)) << np.uint64(1) | np.repeat(indexed, sizes))[hit]
    source = source[hit]
    order = np.argsort(source, kind="stable")
    answer, source = answer[order], source[order]
    first = _groups(source)
    parts = np.split(answer, first[1:]) if len(first) else []
    return pa.table({
        "batch": pa.array([names[s] for s in source[first].tolist()], pa.string()),
        "hits": pa.array([pack_sorted(x) for x in parts], pa.binary()),
    })


def _extended(batch: Batch, hits: np.ndarray, block: int) -> np.ndarray:
    """Starts of the windows inside maximal runs of repeated words around a hit on an indexed block."""
    places, hashes = batch.anchors(batch.hashes()[1], block)
    known = hits >> np.uint64(1)
    at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
    found = known[at] == hashes
    repeated = np.zeros(len(batch.words) + 1, np.int64)
    anchored = np.zeros(len(batch.words) + 1, np.int64)
    repeated[places[found] + 1] = 1
    anchored[places[found] + 1] = (hits[at[found]] & np.uint64(1)).astype(np.int64)
    # A run of r repeated rolling windows covers r + block - 1 words.
    need = WINDOW - block + 1
    np.cumsum(repeated, out=repeated)
    np.cumsum(anchored, out=anchored)
    starts = np.flatnonzero(batch.rooms() >= WINDOW)
    whole = repeated[starts + need] - repeated[starts] == need
    return starts[whole & (anchored[starts + need] > anchored[starts])]


QUESTION = "batch string, shard int, number int, high binary, low binary, doc binary, known binary, start binary"
QUESTION_KINDS = (pa.string(), pa.int32(), pa.int32(), *[pa.binary()] * 5)


def _questions(name: str, folder: str, hits: np.ndarray, block: int, shards: int) -> list[tuple]:
    """What a batch asks about its candidate windows: hash and first place of each distinct one."""
    batch = Batch.load(folder, _file(name, "words"))
    starts = _extended(batch, hits, block)
    if not len(starts):
        return []
    high, low = (rolling(h, WINDOW)[starts] for h in batch.hashes())
    doc = np.repeat(np.arange(len(batch.ids)), batch.sizes)[starts]
    inside = starts - batch.starts[doc]
    order = np.lexsort((inside, batch.ids[doc], ~batch.known[doc], low, high))
    starts, high, low, doc, inside = (x[order] for x in (starts, high, low, doc, inside))
    first = _groups(high, low)
    group = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(starts))))
    lead = first[group]
    later = (
        (batch.ids[doc] != batch.ids[doc[lead]])
        | (batch.known[doc] != batch.known[doc[lead]])
        | (inside != inside[lead])
    )
    out, along = io.BytesIO(), np.argsort(starts)
    packed = (
        pack_sorted(starts[along].astype(np.uint64)),
        pack_planes(group[along].astype(np.int32)),
        pack_planes(later[along]),
    )
    np.savez(out, **{k: np.frombuffer(x, np.uint8) for k, x in zip(("starts", "group", "later"), packed)})
    publish(folder, _file(name, "windows"), out.getvalue())
    rows = []
    borders = _borders(high[first], 64, shards)
    for shard, (a, b) in enumerate(zip(borders, borders[1:])):
        if b > a:
            own = first[a:b]
            rows.append((
                name, shard, a, pack_sorted(high[own]), low[own].tobytes(), pack_planes(batch.ids[doc[own]]),
                pack_planes(batch.known[doc[own]]), pack_planes(inside[own]),
            ))
    return rows


def _later_elsewhere(table: pa.Table) -> pa.Table:
    """For every batch that asked a shard, the numbers of its windows that start earlier in another."""
    names, base = table.column("batch").to_pylist(), table.column("number").to_pylist()
    high = [unpack_sorted(x) for x in table.column("high").to_pylist()]
    sizes = [len(x) for x in high]
    source = np.repeat(np.arange(len(sizes)), sizes)
    number = np.concatenate([np.arange(b, b + n, dtype=np.int64) for b, n in zip(base, sizes)])
    high = np.concatenate(high)
    low = np.concatenate([np.frombuffer(x, np.uint64) for x in table.column("low").to_pylist()])
    doc, known, start = (
        np.concatenate([unpack_planes(x, kind) for x in table.column(c).to_pylist()])
        for c, kind in (("doc", np.int64), ("known", np.bool_), ("start", np.int64))
    )
    order = np.lexsort((start, doc, ~known, low, high))
    high, low, doc, known, start = (x[order] for x in (high, low, doc, known, start))
    first = _groups(high, low)
    lead = np.repeat(first, np.diff(np.append(first, len(high))))
    late = order[(doc != doc[lead]) | (known != known[lead]) | (start != start[lead])]
    late = late[np.lexsort((number[late], source[late]))]
    borders = np.searchsorted(source[late], np.arange(1, len(names)))
    parts = np.split(number[late].astype(np.uint64), borders)
    return pa.table({
        "batch": pa.array(names, pa.string()),
        "numbers": pa.array([pack_sorted(x) for x in parts], pa.binary()),
    })


def _kept(name: str, folder: str, answers: list[bytes]) -> tuple[list, list, list, list]:
    """Id, words, removed words and kept text of every document of a batch.

    Every shard that a batch asks answers; a batch without candidate windows has no answer.
    """
    batch = Batch.load(folder, _file(name, "words"))
    gone = np.zeros(len(batch.words) + 1, np.int64)
    if answers:
        a = np.load(io.BytesIO(_needed(folder, _file(name, "windows"))))
        starts = unpack_sorted(a["starts"].tobytes()).astype(np.int64)
        group, later = (unpack_planes(a[k].tobytes(), t) for k, t in (("group", np.int32), ("later", np.bool_)))
        elsewhere = np.zeros(int(group.max()) + 1, bool)
        for answer in answers:
            elsewhere[unpack_sorted(answer).astype(np.int64)] = True
        covered = starts[later | elsewhere[group]]
        np.add.at(gone, covered, 1)
        np.subtract.at(gone, covered + WINDOW, 1)
        np.cumsum(gone, out=gone)
    stays = gone[:-1] == 0
    vocabulary, kept, removed = batch.vocabulary, [], []
    for a, b in zip(batch.starts.tolist(), batch.ends.tolist()):
        own = batch.words[a:b][stays[a:b]]
        removed.append(b - a - len(own))
        kept.append(b" ".join(map(vocabulary.__getitem__, own.tolist())).decode())
    ids = [x if k else None for x, k in zip(batch.ids.tolist(), batch.known.tolist())]
    return ids, batch.sizes.tolist(), removed, kept


def remove_repeats(
    documents: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    batch_bytes: int = BATCH_BYTES,
    shard_bytes: int = SHARD_BYTES,
) -> DataFrame:
    """``(id, n_words, n_removed, kept)``: every text without words that a repeated window covers.

    Words are parted by ASCII white space. A window of 20 words is repeated if its words also start
    at a smaller id or earlier in the same document. ``kept`` joins the other words by one space.
    Null and empty texts have no words and are returned empty. Rows without id come after all ids
    and count as one document, as do repeated ids: of two rows with one id and one text, neither is
    earlier. Other columns are not read. Single texts may be of any length that fits a task; their
    words take some 100 bytes each there.
    """
    spark = documents.sparkSession
    block = (WINDOW + 1) // 2
    source = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    size = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-size // shard_bytes))
    folder = scratch(spark, "repeats")
    # Settled, because the files have new names whenever they are written. All that follows may be
    # repeated for a lost executor: it reads these files and answers equal questions equally.
    listed = written(_batches(source, folder, batch_bytes), "repeat-batches")
    batches = max(1, min(listed.count(), TASKS))
    tasks = min(shards, TASKS)

    probes = _probed(listed.repartition(batches, "batch"), folder, block, shards).repartition(tasks, "shard")
    hits = written(probes.groupBy("shard").applyInArrow(_repeated, "batch string, hits binary"), "repeat-hits")

    def ask(table: pa.Table) -> pa.Table:
        name = table.column("batch")[0].as_py()
        sent = np.sort(np.concatenate([unpack_sorted(x) for x in table.column("hits").to_pylist()]))
        rows = _questions(name, folder, sent, block, shards)
        columns = list(zip(*rows)) if rows else [[]] * len(QUESTION_KINDS)
        names = [field.split()[0] for field in QUESTION.split(", ")]
        return pa.table([pa.array(c, t) for c, t in zip(columns, QUESTION_KINDS)], names=names)

    questions = hits.repartition(batches, "batch").groupBy("batch").applyInArrow(ask, QUESTION)
    compared = questions.repartition(tasks, "shard").groupBy("shard")
    answers = compared.applyInArrow(_later_elsewhere, "batch string, numbers binary")

    def finish(own: pa.Table, replies: pa.Table) -> pa.Table:
        columns = _kept(own.column("batch")[0].as_py(), folder, replies.column("numbers").to_pylist())
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
        names = [id_col, "n_words", "n_removed", "kept"]
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)

    left = listed.repartition(batches, "batch").groupBy("batch")
    right = answers.repartition(batches, "batch").groupBy("batch")
    return left.cogroup(right).applyInArrow(finish, f"`{id_col}` long, n_words long, n_removed long, kept string")
