"""Ranked lexical search: the best documents for every item of a query set.

Documents are indexed in shards of bounded size. A shard holds, for every term that an item asks
for, the documents with that term and its occurrences in them; it is published as a file and
Spark adds up the counts of all shards. The items then meet each shard in turn, term lists
shortest first. Short lists are taken term by term into summed accumulators, which are
materialised in document order and from then on act as one more list with a bound. That list and
the long ones are walked document by document, by blocks: a block is skipped when the largest
scores of all lists in it cannot reach the k-th best score so far.

A part of the shards is searched first. The k-th score that an item has there bounds it in all
others, so that most of them return few documents.

Items are searched in blocks whose terms have a bounded size; each block reads the documents
once more.
"""

from __future__ import annotations

import io
import math
import re
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import fetch, publish, scratch, slices, texts, written

# Fixed by the contract: maximal runs of ASCII letters, digits and all characters beyond ASCII.
TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")

# A shard ends at whichever comes first.
SHARD_DOCUMENTS = 16_384
SHARD_BYTES = 32 << 20
# Bytes of item terms that one pass over the documents looks for.
ITEM_BYTES = 8 << 20
# Lists are short while all of them together have at most this share of the shard's documents.
SHORT_SHARE = 0.25
BLOCK = 512
# One shard in so many is searched first, for the bounds.
FIRST_SHARDS = 16
# Tasks that shards are dealt to, at most.
TASKS = 20_000


def terms_of(text: str) -> list[bytes]:
    """The terms of a text in order, A-Z lower-cased, as UTF-8."""
    return TERM.findall(text.encode().lower())


def length_measure(n: int, documents: int, total: int) -> int:
    """``m`` of a document with ``n`` terms; in whole numbers of any size."""
    return 50 + (50 * n * documents) // total


def term_weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


class Shard:
    """Term lists over the documents of one shard, in their order of reading."""

    def __init__(self, ids: np.ndarray, known: np.ndarray, lengths: np.ndarray, lists: dict):
        self.ids, self.known, self.lengths = ids, known, lengths
        self.lists = lists  # term number -> (positions, occurrences)

    def dump(self) -> bytes:
        order = sorted(self.lists)
        empty = [np.empty(0, np.int32)]
        out = io.BytesIO()
        np.savez_compressed(
            out,
            ids=self.ids,
            known=self.known,
            lengths=self.lengths,
            terms=np.array(order, np.int32),
            sizes=np.array([len(self.lists[t][0]) for t in order], np.int64),
            positions=np.concatenate([self.lists[t][0] for t in order] or empty),
            occurrences=np.concatenate([self.lists[t][1] for t in order] or empty),
        )
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> Shard:
        a = np.load(io.BytesIO(data))
        borders = np.cumsum(a["sizes"])[:-1]
        pairs = zip(np.split(a["positions"], borders), np.split(a["occurrences"], borders))
        return cls(a["ids"], a["known"], a["lengths"], dict(zip(a["terms"].tolist(), pairs)))


class Searcher:
    """A shard with the scores that each posting adds, computed when a term is first asked for."""

    def __init__(self, shard: Shard, documents: int, total: int, weights: np.ndarray):
        self.shard, self.weights = shard, weights
        self.measure = np.array(
            [length_measure(n, documents, total) for n in shard.lengths.tolist()], dtype=np.int64
        )
        self.blocks = -(-len(shard.ids) // BLOCK)
        self.ready: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}

    def list_of(self, term: int):
        """Positions, scores, first posting of each block and largest score in each block."""
        if term not in self.ready:
            at, tf = self.shard.lists[term]
            tf = tf.astype(np.int64)
            score = self.weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * self.measure[at]))
            self.ready[term] = (at, score, *self._blocks(at, score))
        return self.ready[term]

    def _blocks(self, at: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts = np.searchsorted(at, np.arange(self.blocks + 1) * BLOCK)
        most = np.zeros(self.blocks, np.int64)
        full = np.flatnonzero(starts[1:] > starts[:-1])
        if len(full):
            most[full] = np.maximum.reduceat(score, starts[full])
        return starts, most

    def _accumulated(self, lists: list):
        """Short lists, term at a time, as one list of summed scores in document order."""
        at = np.concatenate([x[0] for x in lists])
        score = np.concatenate([x[1] for x in lists])
        order = np.argsort(at, kind="stable")
        at, score = at[order], score[order]
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        at, score = at[first], np.add.reduceat(score, first)
        return (at, score, *self._blocks(at, score))

    def search(self, terms: list[int], k: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions and scores of the best ``k`` documents with a score of ``floor`` or more.

        Equal scores go to smaller ids, so blocks that can only equal the k-th score are opened.
        """
        lists = sorted((self.list_of(t) for t in terms if t in self.shard.lists), key=lambda x: len(x[0]))
        room, short = int(len(self.shard.ids) * SHORT_SHARE), 0
        while short < len(lists) and (room := room - len(lists[short][0])) >= 0:
            short += 1
        walked = lists[short:]
        if short:
            walked.append(self._accumulated(lists[:short]))
        best_at, best = np.empty(0, np.int64), np.empty(0, np.int64)
        if not walked:
            return best_at, best
        reach = np.sum([most for *_, most in walked], axis=0)
        for block in np.flatnonzero(reach >= floor).tolist():
            if reach[block] < floor:  # the floor has risen since
                continue
            sums = np.zeros(BLOCK, np.int64)
            for at, score, starts, _ in walked:
                a, b = starts[block], starts[block + 1]
                sums[at[a:b] - block * BLOCK] += score[a:b]
            found = np.flatnonzero(sums >= floor)
            if not len(found):
                continue
            best_at = np.concatenate([best_at, found + block * BLOCK])
            best = np.concatenate([best, sums[found]])
            if len(best) > k:
                ids, known = self.shard.ids[best_at], self.shard.known[best_at]
                order = np.lexsort((ids, ~known, -best))[:k]
                best_at, best = best_at[order], best[order]
            if len(best) == k:
                floor = max(floor, int(best.min()))
        return best_at, best


def _items(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(item_id, term)``: the distinct terms of every item."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted({t.decode() for t in terms_of(text)}) for text in texts(batch, 1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(found, pa.list_(pa.string()))], names=["item_id", "terms"]
            )

    source = items.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    listed = source.mapInArrow(run, "item_id long, terms array<string>")
    return listed.select("item_id", F.explode("terms").alias("term")).distinct()


def _item_blocks(items: DataFrame, limit: int) -> tuple[DataFrame, int]:
    """Items with a block number; the terms of a block have about ``limit`` bytes.

    An item alone beyond the limit has its block to itself as far as the hash allows.
    """
    settled = written(items, "item-terms")
    size = settled.agg(F.sum(F.octet_length("term") + 16)).first()[0] or 0
    blocks = -(-size // limit)
    return settled.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(max(blocks, 1)))), blocks


def _index(documents: DataFrame, folder: str, numbers: dict[bytes, int], shard_documents: int, shard_bytes: int):
    """Write the shards; ``(file, n_documents, total, terms, holding)`` for each."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, lengths, lists, size = [], [], {}, 0

        def close() -> pa.RecordBatch:
            known = np.array([x is not None for x in ids], bool)
            postings = {
                t: (np.array(at, np.int32), np.array(tf, np.int32)) for t, (at, tf) in lists.items()
            }
            shard = Shard(np.array([x or 0 for x in ids], np.int64), known, np.array(lengths, np.int64), postings)
            name = f"shard-{uuid.uuid4().hex}.npz"
            publish(folder, name, shard.dump())
            order = sorted(postings)
            columns = [[name], [len(ids)], [sum(lengths)], [order], [[len(postings[t][0]) for t in order]]]
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64())]
            for state in (ids, lengths, lists):
                state.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, kinds)],
                names=["file", "n_documents", "total", "terms", "holding"],
            )

        for batch in batches:
            for piece in slices(batch, 1, shard_bytes):
                for doc_id, text in zip(piece.column(0).to_pylist(), texts(piece, 1)):
                    found = terms_of(text)
                    if not found:
                        continue
                    for term, n in Counter(found).items():
                        if (t := numbers.get(term)) is not None:
                            at, tf = lists.setdefault(t, ([], []))
                            at.append(len(ids))
                            tf.append(n)
                    ids.append(doc_id)
                    lengths.append(len(found))
                    size += len(text)
                    if len(ids) >= shard_documents or size >= shard_bytes:
                        yield close()
                        size = 0
        if ids:
            yield close()

    source = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return source.mapInArrow(
        run, "file string, n_documents long, total long, terms array<int>, holding array<long>"
    )


def _best(rows: DataFrame, k: int, *order: Column) -> DataFrame:
    place = Window.partitionBy("item_id").orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= k)


def search_documents(
    documents: DataFrame,
    items: DataFrame,
    *,
    k: int = 50,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    shard_documents: int = SHARD_DOCUMENTS,
    shard_bytes: int = SHARD_BYTES,
    item_bytes: int = ITEM_BYTES,
) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the ``k`` best documents with a score for every item.

    Terms, weights and scores are those of :func:`terms_of`, :func:`term_weight` and
    :func:`length_measure`. Equal scores go to smaller ids, rows without id last. Null and empty
    texts have no terms and take no part, neither do items without terms. An item is an id (null
    is one, too): the texts of repeated rows are taken together, each term once. Repeated
    documents are each a candidate. Other columns are not read.
    """
    spark = documents.sparkSession
    source = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    wanted, blocks = _item_blocks(_items(items, item_col, item_text_col), item_bytes)
    schema = "item_id long, doc_id long, score long"
    results = []
    for block in range(blocks):
        listed = wanted.filter(F.col("block") == block).select("item_id", "term").collect()
        numbers: dict[bytes, int] = {}
        asked: dict[int | None, list[int]] = {}
        for item_id, term in listed:  # ``item_bytes`` at most
            asked.setdefault(item_id, []).append(numbers.setdefault(term.encode(), len(numbers)))
        folder = scratch(spark, "lexical-index")
        shards = written(_index(source, folder, numbers, shard_documents, shard_bytes), "lexical-shards")
        totals = shards.agg(F.sum("n_documents"), F.sum("total"), F.count("*")).first()
        if not totals[0]:
            continue
        n_documents, total = int(totals[0]), int(totals[1])
        tasks = min(2 * totals[2], TASKS)
        pairs = shards.select(F.explode(F.arrays_zip("terms", "holding")).alias("x"))
        held = pairs.groupBy(F.col("x.terms").alias("term")).agg(F.sum("x.holding").alias("holding"))
        weights = np.zeros(len(numbers), np.int64)
        for term, holding in held.collect():  # one row for each term of the block
            weights[term] = term_weight(n_documents, holding)

        def searched(part: DataFrame, floors: dict, weights=weights, asked=asked, folder=folder,
                     n_documents=n_documents, total=total, tasks=tasks) -> DataFrame:
            def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    for file in batch.column(0).to_pylist():
                        data = fetch(folder, file)
                        if data is None:
                            raise FileNotFoundError(f"{folder}/{file}")
                        searcher = Searcher(Shard.load(data), n_documents, total, weights)
                        shard, out = searcher.shard, []
                        for item_id, terms in asked.items():
                            at, score = searcher.search(terms, k, max(1, floors.get(item_id, 1)))
                            ids = pa.array(shard.ids[at], pa.int64(), mask=~shard.known[at])
                            item = pa.array([item_id] * len(at), pa.int64())
                            out.append(pa.RecordBatch.from_arrays(
                                [item, ids, pa.array(score)], names=["item_id", "doc_id", "score"]
                            ))
                        yield from pa.Table.from_batches(out).combine_chunks().to_batches() if out else ()

            # rows are file names, so Spark cannot see the work behind them
            return part.select("file").repartition(tasks, "file").mapInArrow(run, schema)

        chosen = F.pmod(F.xxhash64("file"), F.lit(FIRST_SHARDS)) == 0
        ranked = written(_best(searched(shards.filter(chosen), {}), k, F.desc("score"), F.asc_nulls_last("doc_id")), "first-hits")
        floors = {r[0]: r[1] for r in ranked.filter(F.col("rank") == k).select("item_id", "score").collect()}
        rest = searched(shards.filter(~chosen), floors)
        results.append(ranked.drop("rank").unionByName(rest))
    if not results:
        empty = spark.createDataFrame([], schema)
        results.append(empty)
    hits = results[0]
    for more in results[1:]:
        hits = hits.unionByName(more)
    ranked = _best(hits, k, F.desc("score"), F.asc_nulls_last("doc_id"))
    return ranked.select("item_id", F.col("rank").cast("int"), "doc_id", "score")
