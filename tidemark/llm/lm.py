"""Language-model scores from a weighted backoff automaton.

Counts, smoothed by absolute discounting with interpolation, make an automaton. Its states are
contexts; an arc adds the log-probability of a word and leads to the longest context that then
holds; where a state has no arc for a word, its failure arc adds the backoff weight and leads to the
context without its first word.

By default n-grams are those of words over all training texts, whatever their counts, so what is
counted grows with the input. Arcs and failure arcs are tables in shared storage, one for each length,
and texts meet them by shuffled joins: nothing of them is collected or broadcast. An n-gram that
only unseen texts hold gets a row with count 0, whose weight follows its failure arcs; so each token
of a text has one row to look up.

With ``class_share`` the n-grams are over classes instead: the words that make up at least that
share of all tokens, the end of a text, and one class for all other words. That model is bounded at
any input size and sent to the tasks; a batch of texts goes through it from left to right, all texts
one token further in a step. A word without a class of its own then gets its share of the class of
all others, by its count. Words in at least ``known_share`` of all tokens have their counts sent; those
of all other words are joined, and only sums come back to a text.
"""

from __future__ import annotations

import functools
import math
import uuid
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import fold, release, runs, slices, spread, squeezed, texts, written

FOLDS = 7
HELD_OUT_FOLD = 2

ORDER = 3
# Only for models over classes: at most 50,000 words with known counts.
KNOWN_SHARE = 2e-5

# Texts are taken through the automaton in runs of so many bytes.
RUN_BYTES = 6 << 20
# N-grams are counted in shards of about so many tokens, words after a context told apart by so many bits.
SHARD_TOKENS = 2 << 20
WORD_BITS = np.uint64((1 << 40) - 1)
# Long texts are read in runs of so many tokens.
RUN_TOKENS = 256

# The token that ends a text; no word is empty.
END = int(np.array(xxhash.xxh3_64_intdigest(b""), dtype=np.uint64).view(np.int64))


def word_hashes(text: str) -> np.ndarray:
    """Signed 64-bit hashes of the words, A-Z lower-cased."""
    words = text.encode().lower().split()  # bytes: A-Z only, and the six ASCII spaces
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)).view(np.int64)


def _token_batch(rows: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of all texts in a row, each text closed by END, and their numbers."""
    hashed = [np.append(word_hashes(text), END) for text in rows]
    lengths = np.fromiter(map(len, hashed), np.int64, len(hashed))
    return (np.concatenate(hashed) if hashed else np.empty(0, np.int64)), lengths


def _counted(values: np.ndarray, name: str) -> pa.RecordBatch:
    keys, counts = np.unique(values, return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], names=[name, "n"])


def count_words(training: DataFrame) -> DataFrame:
    """``(word, c)`` over the texts in column 0; ends are counted as a word."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _counted(_token_batch(texts(batch, 0))[0], "word")

    counted = training.mapInArrow(run, "word long, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("c"))


class Lookup:
    """Values by sorted 64-bit key."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, missing):
        order = np.argsort(keys)
        self.keys, self.values, self.missing = keys[order], values[order], missing

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(keys), self.missing, dtype=self.values.dtype)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.values[at], self.missing)


class Classes:
    """Class numbers of words: 0 for words without one, 1 for the end, then the others."""

    def __init__(self, words: np.ndarray):
        words = words[words != END]
        self.base = len(words) + 2
        numbers = np.arange(1, self.base, dtype=np.int64)
        self.of = Lookup(np.concatenate([[END], words]), numbers, 0)


def _windows(classes: np.ndarray, lengths: np.ndarray, order: int, base: int) -> list[np.ndarray]:
    """Packed n-grams of each length up to ``order``; texts begin after an end."""
    begun = np.insert(classes, np.cumsum(lengths) - lengths, 1)
    owner = np.repeat(np.arange(len(lengths)), lengths + 1)
    first = np.concatenate([[True], owner[1:] != owner[:-1]]) if len(owner) else np.empty(0, bool)
    out = []
    for n in range(1, order + 1):
        last = len(begun) - n + 1
        if last <= 0:
            break
        key = np.ones(last, dtype=np.int64)
        for k in range(n):
            key = key * base + begun[k : k + last]
        # An n-gram lies in one text and does not end on its beginning.
        out.append(key[(owner[:last] == owner[n - 1 :]) & ~first[n - 1 :]])
    return out


def count_ngrams(training: DataFrame, classes: Classes, order: int) -> DataFrame:
    """``(gram, n)`` of packed class n-grams of every length; few enough to collect."""
    shared = training.sparkSession.sparkContext.broadcast(classes)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            tokens, lengths = _token_batch(texts(batch, 0))
            for grams in _windows(known.of(tokens), lengths, order, known.base):
                yield _counted(grams, "gram")

    return training.mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


class Automaton:
    """States, arcs and failure arcs of a smoothed n-gram model.

    A context of classes ``h1 .. hk`` is packed as ``((1*B + h1)*B + ..)*B + hk``, the empty one
    as 1, and the arc of class ``w`` from it as ``context*B + w``.
    """

    def __init__(self, grams: np.ndarray, counts: np.ndarray, base: int, order: int):
        self.base, self.order = base, order
        length = np.floor(np.log(np.maximum(grams, 1)) / math.log(base) + 1e-9).astype(np.int64)
        floor = np.power(np.int64(base), length)
        length = np.where(grams < floor, length - 1, length)
        arcs, weights, states, failures = [], [], [], []
        # Of no context: add-one over all classes, so that every class has an arc.
        single = length == 1
        seen = Lookup(grams[single], counts[single], 0)
        every = np.arange(base, base + base, dtype=np.int64)
        lower_keys, lower = every, (seen(every) + 1) / (counts[single].sum() + base)
        arcs.append(every)
        weights.append(np.log10(lower))
        for n in range(2, order + 1):
            mine = length == n
            if not mine.any():
                break
            gram, count = grams[mine], counts[mine].astype(np.float64)
            once, twice = (count == 1).sum(), (count == 2).sum()
            discount = once / (once + 2 * twice) if once and twice else 0.5
            context, group = np.unique(gram // base, return_inverse=True)
            total = np.bincount(group, weights=count)
            kinds = np.bincount(group)
            backoff = discount * kinds / total
            shorter = self.shorter(gram, n)
            below = Lookup(lower_keys, lower, 0.0)(shorter)
            weight = (count - discount) / total[group] + backoff[group] * below
            arcs.append(gram)
            weights.append(np.log10(weight))
            states.append(context)
            failures.append(np.log10(backoff))
            lower_keys, lower = gram, weight
        self.arc = Lookup(np.concatenate(arcs), np.concatenate(weights), np.nan)
        none = np.empty(0, np.int64)
        self.failure = Lookup(np.concatenate(states or [none]), np.concatenate(failures or [none * 1.0]), np.nan)

    def shorter(self, packed: np.ndarray, length) -> np.ndarray:
        """The packed classes without the first of ``length``."""
        floor = np.power(np.int64(self.base), np.asarray(length, dtype=np.int64) - 1)
        return floor + packed % floor

    def _hold(self, state: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The longest suffix of each context that is a state."""
        while True:
            lost = (length > 0) & ((length > self.order - 1) | np.isnan(self.failure(state)))
            if not lost.any():
                return state, length
            state = np.where(lost, self.shorter(state, np.maximum(length, 1)), state)
            length = length - lost

    def score(self, classes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Summed log10 weights of every text, whose classes follow each other in ``classes``."""
        order = np.argsort(-lengths, kind="stable")
        starts = (np.cumsum(lengths) - lengths)[order]
        longest = lengths[order]
        total = np.zeros(len(lengths))
        begin = np.full(len(lengths), self.base + 1, dtype=np.int64)  # after an end
        state, held = self._hold(begin, np.ones(len(lengths), dtype=np.int64))
        active = len(lengths)
        for step in range(int(longest[0]) if len(longest) else 0):
            while longest[active - 1] <= step:
                active -= 1
            word = classes[starts[:active] + step]
            now, size = state[:active], held[:active]
            open_ = np.arange(active)
            while len(open_):
                weight = self.arc(now[open_] * self.base + word[open_])
                failed = np.isnan(weight)
                total[open_[~failed]] += weight[~failed]
                open_ = open_[failed]
                if len(open_):
                    total[open_] += self.failure(now[open_])
                    now[open_] = self.shorter(now[open_], size[open_])
                    size[open_] -= 1
            state[:active], held[:active] = self._hold(now * self.base + word, size + 1)
        out = np.empty(len(lengths))
        out[order] = total
        return out


def _arrays(df: DataFrame, *kinds: type) -> list[np.ndarray]:
    found = df.toPandas()
    return [found[c].to_numpy(dtype=kind) for c, kind in zip(df.columns, kinds)]


def _mixed(z: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64."""
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


class Level(NamedTuple):
    """The n-grams of one length in a batch of texts, numbered by the ``code`` of their first words' number and last word.

    ``at`` has the number of the n-gram that ends on each word, texts beginning after an end, and -1
    where the text has too few words before; ``n`` counts those of training texts.
    """

    at: np.ndarray
    prefix: np.ndarray
    word: np.ndarray
    suffix: np.ndarray
    hash: np.ndarray
    n: np.ndarray


def pack_texts(source: DataFrame) -> DataFrame:
    """``(batch, ids, held_out, lengths, words, tokens, n_tokens, n_train)``: texts of about ``RUN_BYTES`` in a row.

    ``words`` has the hashes of the different words, frequent ones first and each as its difference to the
    one before, which takes little space; ``tokens`` has all texts as places in it.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in runs(batches, 2, RUN_BYTES):
            tokens, lengths = _token_batch(texts(batch, 2))
            words, place, count = np.unique(tokens, return_inverse=True, return_counts=True)
            order = np.lexsort((words, -count))
            rank = np.empty_like(order)
            rank[order] = np.arange(len(order))
            held = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            whole = lambda column: pa.ListArray.from_arrays([0, batch.num_rows], column)
            binary = [squeezed(x) for x in (lengths, np.diff(words[order], prepend=0), rank[place])]
            numbers = [uuid.uuid4().int >> 65, len(words), len(tokens), int(lengths[~held].sum())]
            yield pa.RecordBatch.from_arrays(
                [whole(batch.column(0)), whole(batch.column(1)), *(pa.array([x]) for x in [*binary, *numbers])],
                names=["ids", "held_out", "lengths", "words", "tokens", "batch", "n_words", "n_tokens", "n_train"],
            )

    kind = source.schema["id"].dataType.simpleString()
    return source.select("id", "held_out", "text").mapInArrow(
        run,
        f"ids array<{kind}>, held_out array<boolean>, lengths binary, words binary, tokens binary, "
        "batch long, n_words long, n_tokens long, n_train long",
    )


class Batch:
    """The texts of one row of :func:`pack_texts` and their n-grams up to ``order`` words."""

    def __init__(self, row: dict, order: int):
        self.words = np.cumsum(spread(row["words"], row["n_words"], np.int64))
        self.held = np.array(row["held_out"], dtype=bool)
        self.lengths = spread(row["lengths"], len(self.held), np.int64)
        tokens = spread(row["tokens"], row["n_tokens"], np.int64)
        end = np.flatnonzero(self.words == END)[0]
        self.stream = np.insert(tokens, np.cumsum(self.lengths) - self.lengths, end)
        self.starts = np.cumsum(self.lengths + 1) - self.lengths - 1
        self.within = np.arange(len(self.stream)) - np.repeat(self.starts, self.lengths + 1)
        trains = np.repeat(~self.held, self.lengths + 1)
        base, none = len(self.words), np.zeros(len(self.words), np.int64)
        counted = np.bincount(self.stream[trains & (self.within > 0)], minlength=base)
        named = _mixed(self.words.view(np.uint64))
        self.levels = [None, Level(self.stream, none, np.arange(base), none, named, counted)]
        for k in range(2, order + 1):
            below, last = self.levels[-1], np.flatnonzero(self.within >= k - 1)
            codes, first, number = np.unique(
                below.at[last - 1] * base + self.stream[last], return_index=True, return_inverse=True
            )
            at = np.full(len(self.stream), -1)
            at[last] = number
            prefix, word = np.divmod(codes, base)
            chained = _mixed(below.hash[prefix] * np.uint64(0x9E3779B97F4A7C15) + named[word])
            n = np.bincount(number[trains[last]], minlength=len(codes))
            self.levels.append(Level(at, prefix, word, below.at[last[first]], chained, n))

    def layout(self, level: int, shards: int):
        """The n-grams of ``level`` by hash, those one word longer in the order of their first words,
        how many each has, and where the shards begin among either."""
        hashes = self.levels[level].hash
        order = np.argsort(hashes, kind="stable")
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        prefix = self.levels[level + 1].prefix if 1 < level < len(self.levels) - 1 else np.empty(0, np.int64)
        longer = np.argsort(rank[prefix], kind="stable")
        sizes = np.bincount(prefix, minlength=len(order))[order]
        shard = ((hashes[order] >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)
        cuts = np.searchsorted(shard, np.arange(shards + 1))
        return order, longer, sizes, cuts, np.concatenate([[0], np.cumsum(sizes)])[cuts]


PACKED = "batch long, shard int, contexts long, arcs long, hashes binary, n binary, kinds binary, sizes binary, words binary, m binary"


def _packed(batch: Batch, number: int, level: int, shards: int, kinds: np.ndarray) -> Iterator[dict]:
    """The n-grams of ``level`` and those one word longer, a row for each shard of their hashes."""
    order, longer, sizes, cuts, ends = batch.layout(level, shards)
    own = batch.levels[level]
    hashes, n, kinds = own.hash[order], own.n[order], kinds[order]
    words = m = np.empty(0, np.int64)
    if level > 1:
        arcs = batch.levels[level + 1]
        words, m = batch.levels[1].hash[arcs.word[longer]] & WORD_BITS, arcs.n[longer]
    for shard in np.flatnonzero(np.diff(cuts)):
        a, b, c, d = cuts[shard], cuts[shard + 1], ends[shard], ends[shard + 1]
        yield {
            "batch": number,
            "shard": int(shard),
            "contexts": int(b - a),
            "arcs": int(d - c),
            "hashes": squeezed(np.diff(hashes[a:b], prepend=np.uint64(0))),
            **{name: squeezed(x[a:b]) for name, x in (("n", n), ("kinds", kinds), ("sizes", sizes))},
            "words": squeezed(words[c:d]),
            "m": squeezed(m[c:d]),
        }


COUNTED = (
    "batch long, level int, shard int, contexts long, arcs long, totals binary, kinds binary, owned binary, counts binary, "
    "seen long, once long, twice long, arcs_once long, arcs_twice long"
)


def _counted_shard(rows: list[dict], level: int) -> Iterator[dict]:
    """For every batch of a shard the counts over all batches.

    ``totals`` and ``kinds`` say how often an n-gram was in training and how many words followed it,
    ``counts`` the n-grams one word longer; ``owned`` marks an n-gram of training in one batch.
    """
    whole = lambda name, size, kind: np.concatenate([spread(r[name], r[size], kind) for r in rows])
    hashes = np.concatenate([np.cumsum(spread(r["hashes"], r["contexts"], np.uint64)) for r in rows])
    n, kinds, sizes = (whole(name, "contexts", np.int64) for name in ("n", "kinds", "sizes"))
    words, m = whole("words", "arcs", np.uint64), whole("m", "arcs", np.int64)
    names, own = np.unique(hashes, return_inverse=True)
    total = _sums(own, n, len(names))
    trained = np.flatnonzero(n)
    owned = np.zeros(len(n), np.int64)
    owned[trained[np.unique(own[trained], return_index=True)[1]]] = 1
    context = np.repeat(own, sizes)
    order = np.lexsort((words, context))
    c, w = context[order], words[order]
    new = np.ones(len(order), bool)
    new[1:] = (c[1:] != c[:-1]) | (w[1:] != w[:-1])
    arc = np.empty_like(order)
    arc[order] = np.cumsum(new) - 1
    count = _sums(arc, m, int(new.sum()))
    kind = _sums(own, kinds, len(names)) + np.bincount(c[new][count > 0], minlength=len(names))
    facts = [(total > 0).sum(), *((x == k).sum() for x in (total, count) for k in (1, 2))]
    a = d = 0
    for row in rows:
        b, e = a + row["contexts"], d + row["arcs"]
        yield {
            **{name: row[name] for name in ("batch", "shard", "contexts", "arcs")},
            "level": level,
            "totals": squeezed(total[own[a:b]]),
            "kinds": squeezed(kind[own[a:b]]),
            "owned": squeezed(owned[a:b]),
            "counts": squeezed(count[arc[d:e]]),
            **dict(zip(("seen", "once", "twice", "arcs_once", "arcs_twice"), map(int, facts))),
        }
        a, d, facts = b, e, [0] * 5


def _sums(groups: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    return np.bincount(groups, weights=values, minlength=size).astype(np.int64)


def _counted_level(packed: DataFrame, level: int) -> DataFrame:
    """The rows of :func:`_packed` with the counts over all batches."""
    names = [part.split()[0] for part in COUNTED.split(", ")]

    def count(shard: pa.Table) -> pa.Table:
        columns = [c.to_pylist() for c in shard.columns]
        rows = [dict(zip(shard.column_names, row)) for row in zip(*columns)]
        rows.sort(key=lambda row: row["batch"])
        return pa.Table.from_pylist(list(_counted_shard(rows, level)), schema=_arrow(COUNTED)).select(names)

    return packed.groupBy("shard").applyInArrow(count, COUNTED)


def _facts(counts: DataFrame) -> dict[str, int]:
    """How many n-grams were in training at all, once and twice, and how many one word longer once and twice."""
    names = ("seen", "once", "twice", "arcs_once", "arcs_twice")
    return counts.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names)).first().asDict()


def _arrow(schema: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    return pa.schema([(name, kinds[kind]) for name, kind in (part.split() for part in schema.split(", "))])


class Counts:
    """Of one batch and level: how often each n-gram was in training, by how many words it was followed,
    and how often those one word longer were in training."""

    def __init__(self, batch: Batch, level: int, rows: list[dict], shards: int):
        order, longer, *_ = batch.layout(level, shards)
        rows = [r for r in rows if r["level"] == level]
        self.total = _placed(rows, "totals", "contexts", order)
        self.kinds = _placed(rows, "kinds", "contexts", order)
        self.counts = _placed(rows, "counts", "arcs", longer)


def _placed(rows: list[dict], name: str, size: str, at: np.ndarray) -> np.ndarray:
    """The numbers that all shards sent for the n-grams of a batch, which are ``at`` in their order."""
    values = np.empty(len(at), np.int64)
    parts = [spread(r[name], r[size], np.int64) for r in sorted(rows, key=lambda r: r["shard"])]
    values[at] = np.concatenate(parts)
    return values


class WordAutomaton:
    """The states, arcs and failure arcs that the texts of one batch can meet.

    State 0 is the empty context, and those of each length follow it in the order of their numbers.
    """

    def __init__(self, batch: Batch, counts: dict[int, Counts], chances: float, discounts: dict[int, float], order: int):
        self.batch, self.order, self.base = batch, order, len(batch.words)
        levels = batch.levels
        first = np.cumsum([0, 1, *(len(level.hash) for level in levels[1:order])])  # of the states of a length
        holds, self.failure, self.backoff = [np.ones(1, bool)], [np.zeros(1, np.int64)], [np.zeros(1)]
        keys, weights, targets = [], [], []
        for k in range(1, order + 1):
            level = levels[k]
            if k == 1:
                count, chance, shorter = counts[1].total, (counts[1].total + 1.0) / chances, None
                real = np.ones(len(count), bool)
            else:
                count = counts[k - 1].counts if k > 2 else counts[2].total
                real = count > 0
                total, kinds = counts[k - 1].total[level.prefix], counts[k - 1].kinds[level.prefix]
                above = np.maximum(count - discounts[k], 0.0) / np.maximum(total, 1)
                chance = above + discounts[k] * kinds / np.maximum(total, 1) * shorter[level.suffix]
            keys.append(((first[k - 1] + level.prefix) * self.base + level.word)[real])
            weights.append(np.log10(chance[real]))
            if k < order:
                own = count > 0
                kinds, total = counts[k].kinds, np.maximum(counts[k].total, 1)
                with np.errstate(divide="ignore"):  # what no word follows is no state that a text is left in
                    back = np.log10(discounts[k + 1] * kinds / total)
                holds.append(own)
                self.failure.append(first[k - 1] + level.suffix if k > 1 else np.zeros(len(count), np.int64))
                self.backoff.append(np.where(own & (kinds > 0), back, 0.0))
                target = first[k] + np.arange(len(count))
            else:
                target = first[k - 1] + level.suffix if k > 1 else np.zeros(len(count), np.int64)
            targets.append(target[real])
            shorter = chance
        holds, self.failure, self.backoff = map(np.concatenate, (holds, self.failure, self.backoff))
        self.key, self.weight, self.target = map(np.concatenate, (keys, weights, targets))
        while not holds[self.target].all():  # an arc leads to the longest context that holds
            self.target = np.where(holds[self.target], self.target, self.failure[self.target])

    def score(self) -> np.ndarray:
        """Summed log10 weights of every text, read from left to right.

        Texts are read side by side, long ones in runs that begin with the last words before them,
        which is all that a state can hold.
        """
        batch = self.batch
        runs_of = -(-batch.lengths // RUN_TOKENS)
        text = np.repeat(np.arange(len(runs_of)), runs_of)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(runs_of) - runs_of, runs_of)
        begin = batch.starts[text] + 1 + nth * RUN_TOKENS
        stop = np.minimum(begin + RUN_TOKENS, batch.starts[text] + 1 + batch.lengths[text])
        at = np.maximum(begin - max(self.order - 1, 1), batch.starts[text])
        total, state, reading = np.zeros(len(text)), np.zeros(len(text), np.int64), np.arange(len(text))
        while len(reading):
            word, counted = batch.stream[at[reading]], at[reading] >= begin[reading]
            moving = np.arange(len(reading))
            while len(moving):
                runs_ = reading[moving]
                key = state[runs_] * self.base + word[moving]
                found = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
                met = self.key[found] == key
                add = np.where(met, self.weight[found], self.backoff[state[runs_]])
                total[runs_] += np.where(counted[moving], add, 0.0)
                state[runs_] = np.where(met, self.target[found], self.failure[state[runs_]])
                moving = moving[~met]
            at[reading] += 1
            reading = reading[at[reading] < stop[reading]]
        return np.bincount(text, weights=total, minlength=len(runs_of))


def _score_by_words(source: DataFrame, id_col: str, order: int) -> DataFrame:
    """Every text read by the automaton over all words.

    Batches of texts send their different n-grams to shards of them, where they are counted, and get
    back the counts of just those; from these a batch builds the part of the automaton it can meet.
    """
    packed = written(pack_texts(source), "packed-texts")
    row = packed.agg(F.sum("n_tokens"), F.sum("n_train")).first()
    shards, tokens = -(-(row[0] or 1) // SHARD_TOKENS), row[1] or 0
    reach = max(order, 3)
    counted, facts = [], {}
    for level in range(2, reach):

        def send(batches: Iterable[pa.RecordBatch], level: int = level) -> Iterator[pa.RecordBatch]:
            for table in batches:
                for piece in range(table.num_rows):
                    one = table.slice(piece, 1).to_pylist()[0]
                    batch = Batch(one, level + 1)
                    none = np.zeros(len(batch.levels[level].hash), np.int64)
                    for out in _packed(batch, one["batch"], level, shards, none):
                        yield pa.RecordBatch.from_pylist([out], schema=_arrow(PACKED))

        counted.append(written(_counted_level(packed.mapInArrow(send, PACKED), level), f"counts-{level}"))
        facts[level] = _facts(counted[-1])
        release(source.sparkSession)

    def send_words(key, texts_: pa.Table, counts: pa.Table) -> pa.Table:
        one = texts_.to_pylist()[0]
        batch = Batch(one, 2)
        owned = _placed(counts.to_pylist(), "owned", "contexts", batch.layout(2, shards)[0])
        kinds = _sums(batch.levels[2].prefix, owned, len(batch.words))
        return pa.Table.from_pylist(list(_packed(batch, one["batch"], 1, shards, kinds)), schema=_arrow(PACKED))

    by_batch = packed.groupBy("batch")
    owners = counted[0].select("batch", "shard", "contexts", "owned")
    words = by_batch.cogroup(owners.groupBy("batch")).applyInArrow(send_words, PACKED)
    counted.append(written(_counted_level(words, 1), "counts-1"))
    del words
    facts[1] = _facts(counted[-1])
    release(source.sparkSession)

    counts = functools.reduce(DataFrame.unionByName, counted).drop("owned")
    kinds, discounts = facts[1]["seen"], {}
    for k in range(2, order + 1):
        fact, prefix = (facts[k], "") if k in facts else (facts[k - 1], "arcs_")
        once, twice = fact[f"{prefix}once"], fact[f"{prefix}twice"]
        discounts[k] = once / (once + 2 * twice) if once and twice else 0.5
    log_base = math.log10(tokens + kinds + 1)
    out = ["ids", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def score(key, texts_: pa.Table, counts_: pa.Table) -> pa.Table:
        one = texts_.to_pylist()[0]
        batch, rows = Batch(one, reach), counts_.to_pylist()
        found = {level: Counts(batch, level, rows, shards) for level in range(1, reach)}
        machine = WordAutomaton(batch, found, tokens + max(kinds, 1) + 1.0, discounts, order)
        count, token = found[1].total[batch.stream], batch.within > 0
        text = np.repeat(np.arange(len(batch.lengths)), batch.lengths + 1)[token]
        summed = lambda x: np.bincount(text, weights=x[token], minlength=len(batch.lengths))
        ids = texts_.column("ids").combine_chunks().flatten()
        base_score = summed(np.log10(count + 1.0)) - batch.lengths * log_base
        known, train = summed(count > 0).astype(np.int64), np.full(len(ids), tokens, np.int64)
        columns = [batch.held, batch.lengths, known, train, base_score, machine.score()]
        return pa.Table.from_arrays([ids, *map(pa.array, columns)], names=[id_col, *out[1:]])

    kind = source.schema["id"].dataType.simpleString()
    return by_batch.cogroup(counts.groupBy("batch")).applyInArrow(
        score,
        f"`{id_col}` {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, "
        "base_score double, score double",
    )


def score_documents(
    documents: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    order: int = ORDER,
    class_share: float | None = None,
    known_share: float = KNOWN_SHARE,
) -> DataFrame:
    """``(id, held_out, n_tokens, n_known, train_tokens, base_score, score)`` of every row.

    Learns from all rows outside the held-out fold. Null and empty texts are the end token alone.
    Rows without id are in fold 0, so they train. Without training rows every token is unknown and
    the base score 0, the score that of equal chances. Without ``class_share``
    the model is over words, all of them. Repeated rows get equal scores; other
    columns are not read.
    """
    spark = documents.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    held_out = (fold(id_col, FOLDS) == HELD_OUT_FOLD).alias("held_out")
    source = documents.select(
        F.col(id_col).alias("id"), held_out, F.xxhash64(id_col, text).alias("row"), text
    )
    if class_share is None:
        return _score_by_words(source, id_col, order)
    training = source.filter("NOT held_out").select("text")

    words = written(count_words(training), "word-counts")
    row = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    tokens, kinds = row[0], row[1]
    often = (F.col("c") >= max(1, math.ceil(known_share * tokens))) | (F.col("word") == END)
    known_words, known_counts = _arrays(words.filter(often), np.int64, np.int64)  # 1 / known_share
    classes = Classes(known_words[known_counts >= max(1, class_share * tokens)])
    grams, counts = _arrays(count_ngrams(training, classes, order), np.int64, np.int64)
    automaton = Automaton(grams, counts, classes.base, order)
    in_class = classes.of(known_words) > 0
    other_tokens = tokens - int(known_counts[in_class].sum())
    other_kinds = kinds - int(in_class.sum())
    # Chances are (c + 1) of all, with one more kind for all words never seen.
    log_base = math.log10(tokens + kinds + 1)
    log_other = math.log10(other_tokens + other_kinds + 1)

    shared = spark.sparkContext.broadcast(
        (Lookup(known_words, known_counts, 0), classes, automaton)  # bounded by the two shares
    )

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count_of, own, machine = shared.value
        for batch in (part for whole in batches for part in slices(whole, 3, RUN_BYTES)):
            tokens_, lengths = _token_batch(texts(batch, 3))
            owner = np.repeat(np.arange(len(lengths)), lengths)
            count = count_of(tokens_)
            number = own.of(tokens_)
            known = count > 0

            def summed(values: np.ndarray) -> np.ndarray:
                return np.bincount(owner, weights=values, minlength=len(lengths))

            logs = np.where(known, np.log10(count + 1.0), 0.0)
            loose = number == 0  # words of the common class share its chance by their counts
            path = machine.score(number, lengths) + summed(np.where(loose, logs - log_other, 0.0))
            columns = [lengths, summed(known).astype(np.int64), summed(~known).astype(np.int64)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], *map(pa.array, [*columns, summed(logs), path])],
                names=["id", "held_out", "row", "n_tokens", "n_known", "n_rare", "logs", "path"],
            )

    def rare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count_of = shared.value[0]
        for batch in (part for whole in batches for part in slices(whole, 1, RUN_BYTES)):
            tokens_, lengths = _token_batch(texts(batch, 1))
            rows = np.repeat(batch.column(0).to_numpy(), lengths)
            loose = count_of(tokens_) == 0
            order = np.lexsort((tokens_[loose], rows[loose]))
            word, row = tokens_[loose][order], rows[loose][order]
            new = np.ones(len(word), dtype=bool)
            new[1:] = (word[1:] != word[:-1]) | (row[1:] != row[:-1])
            at = np.flatnonzero(new)
            n = np.diff(np.append(at, len(word))).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(word[at]), pa.array(row[at]), pa.array(n)], names=["word", "row", "n"]
            )

    kind = documents.schema[id_col].dataType.simpleString()
    scored = source.mapInArrow(
        score,
        f"id {kind}, held_out boolean, row long, n_tokens long, n_known long, n_rare long, "
        "logs double, path double",
    )
    sums = (
        source.select("row", "text")
        .mapInArrow(rare, "word long, row long, n int")
        .join(words, "word", "left")
        .groupBy("row")
        .agg(
            F.sum("n").alias("met"),
            F.sum(F.when(F.col("c").isNotNull(), F.col("n"))).alias("rare_known"),
            F.sum(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + 1.0)).alias("rare_logs"),
        )
    )
    # Rows that repeat id and text share their sums, so each takes one part of them.
    share = F.when(F.col("n_rare") > 0, F.col("n_rare") / F.col("met")).otherwise(0.0)
    part = lambda c: F.coalesce(F.col(c) * share, F.lit(0.0))
    return (
        scored.join(sums, "row", "left")
        .withColumn("logs", F.col("logs") + part("rare_logs"))
        .select(
            F.col("id").alias(id_col),
            "held_out",
            "n_tokens",
            (F.col("n_known") + F.round(part("rare_known")).cast("long")).alias("n_known"),
            F.lit(tokens).cast("long").alias("train_tokens"),
            (F.col("logs") - F.col("n_tokens") * log_base).alias("base_score"),
            (F.col("path") + part("rare_logs")).alias("score"),
        )
    )
