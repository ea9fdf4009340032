import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import lm

from .brute import words

END = ""


def _texts():
    random.seed(7)
    out = []
    for k in range(120):
        chain = ["a"]
        for _ in range(random.randint(0, 40)):
            chain.append({"a": "b", "b": "c"}.get(chain[-1], random.choice(["a", "b", f"rare{random.randint(0, 500)}"])))
        out.append(" ".join(chain))
    return out + [None, "", "  ", "never seen words", "A B C", "x " * 5000, out[0]]


def reference(rows, order, class_share):
    """Base figures and the interpolated model by plain dictionaries."""
    tokens = {i: [*words(t), END] for i, t in rows}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in tokens}
    c = Counter(w for i, ws in tokens.items() if not held[i] for w in ws)
    n, v = sum(c.values()), len(c)
    named = {w for w in c if c[w] >= max(1, class_share * n)} | {END}
    cls = lambda w: w if w in named else None
    grams = [Counter() for _ in range(order + 1)]
    for i, ws in tokens.items():
        if not held[i]:
            seq = [END, *map(cls, ws)]
            for size in range(1, order + 1):
                grams[size].update(tuple(seq[k : k + size]) for k in range(len(seq) - size + 1) if k + size > 1)
    other = sum(x for w, x in c.items() if w not in named) + sum(w not in named for w in c) + 1
    base = len(named) + 1
    total = {s: Counter() for s in range(2, order + 1)}
    kinds = {s: Counter() for s in range(2, order + 1)}
    cut = {}
    for s in range(2, order + 1):
        for g, x in grams[s].items():
            total[s][g[:-1]] += x
            kinds[s][g[:-1]] += 1
        once, twice = (sum(x == k for x in grams[s].values()) for k in (1, 2))
        cut[s] = once / (once + 2 * twice) if once and twice else 0.5

    def chance(history, w):
        s = len(history) + 1
        if s == 1:
            return (grams[1][(w,)] + 1) / (sum(grams[1].values()) + base)
        below = chance(history[1:], w)
        if history not in total[s]:
            return below
        spare = cut[s] * kinds[s][history] / total[s][history]
        x = grams[s][(*history, w)]
        return (max(x - cut[s], 0) / total[s][history] if x else 0) + spare * below

    out = {}
    for i, ws in tokens.items():
        seq, score = [END, *map(cls, ws)], 0.0
        for k, w in enumerate(ws):
            history = tuple(seq[max(0, k + 2 - order) : k + 1]) if order > 1 else ()
            score += math.log10(chance(history, cls(w)))
            if cls(w) is None:
                score += math.log10((c[w] + 1) / other)
        out[i] = (held[i], len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), score)
    return out


@pytest.mark.parametrize("order", [2, 3])
def test_matches_plain_model(make, order):
    rows = list(enumerate(_texts()))
    want = reference(rows, order, 0.01)
    got = lm.score_documents(make([t for _, t in rows]), order=order, class_share=0.01, known_share=0.004)
    for r in got.collect():
        held, n_tokens, n_known, total, base, score = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n_tokens, n_known, total)
        assert r.base_score == pytest.approx(base, rel=1e-9, abs=1e-9)
        assert r.score == pytest.approx(score, rel=1e-9, abs=1e-9)


@pytest.mark.parametrize("order", [1, 3])
def test_word_model_matches_plain_model(make, order):
    rows = list(enumerate([*_texts(), "rare1 rare2 rare3 rare4", "rare4 rare2 rare1 rare3"]))
    want = reference(rows, order, 0)
    got = {r.doc_id: r for r in lm.score_documents(make([t for _, t in rows]), order=order).collect()}
    assert len(got) == len(rows)
    for i, (held, n_tokens, n_known, total, base, score) in want.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n_tokens, n_known, total)
        assert r.base_score == pytest.approx(base, rel=1e-9, abs=1e-9)
        assert r.score == pytest.approx(score, rel=1e-9, abs=1e-9)


@pytest.mark.parametrize("order", [2, 4])
def test_small_batches_shards_and_runs_change_nothing(make, monkeypatch, order):
    rows = list(enumerate([*_texts(), *_texts()[:40]]))
    want = reference(rows, order, 0)
    monkeypatch.setattr(lm, "RUN_BYTES", 2_000)
    monkeypatch.setattr(lm, "SHARD_TOKENS", 3_000)
    monkeypatch.setattr(lm, "RUN_TOKENS", 7)
    documents = make([t for _, t in rows]).coalesce(2)
    got = {r.doc_id: r for r in lm.score_documents(documents, order=order).collect()}
    assert len(got) == len(rows)
    for i, (held, n_tokens, n_known, total, base, score) in want.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n_tokens, n_known, total)
        assert r.base_score == pytest.approx(base, rel=1e-9, abs=1e-9)
        assert r.score == pytest.approx(score, rel=1e-9, abs=1e-9)


class _Packed:
    """Runs the mapped function of a table here, on batches of texts."""

    schema = {"id": type("_", (), {"dataType": type("_", (), {"simpleString": staticmethod(lambda: "bigint")})})}

    def __init__(self, texts):
        rows = pa.array(range(len(texts))), pa.array([k % 3 == 0 for k in range(len(texts))]), pa.array(texts)
        self.batches = pa.Table.from_arrays(list(rows), names=["id", "held_out", "text"]).to_batches(10)

    def select(self, *names):
        return self

    def mapInArrow(self, run, schema):
        return [row for out in run(self.batches) for row in out.to_pylist()]


def test_counts_of_shards_are_those_of_all_texts_and_smaller_than_rows(monkeypatch):
    random.seed(5)
    held = [" ".join(random.choices([f"w{k}" for k in range(60)], k=random.randint(0, 90))) for _ in range(300)]
    monkeypatch.setattr(lm, "RUN_BYTES", 8_000)
    packed = lm.pack_texts(_Packed(held))
    assert len(packed) > 5 and [i for row in packed for i in row["ids"]] == list(range(300))
    grams, shards, sent = Counter(), 3, {}
    for row in packed:
        batch = lm.Batch(row, 3)
        sent[row["batch"]] = list(lm._packed(batch, row["batch"], 2, shards, np.zeros(len(batch.levels[2].hash), np.int64)))
    for k, text in enumerate(held):
        if k % 3:
            seq = [END, *words(text), END]
            grams.update(tuple(seq[i : i + n]) for n in (2, 3) for i in range(len(seq) - n + 1))
    got = [row for s in range(shards) for row in lm._counted_shard([r for own in sent.values() for r in own if r["shard"] == s], 2)]
    owned = 0
    for row in packed:
        batch = lm.Batch(row, 3)
        mine = [r for r in got if r["batch"] == row["batch"]]
        counts = lm.Counts(batch, 2, mine, shards)
        owned += lm._placed(mine, "owned", "contexts", batch.layout(2, shards)[0]).sum()
        tokens = lambda at: [END if w == lm.END else names[w] for w in batch.words[batch.stream[at]]]
        names = {int(lm.word_hashes(w)[0]): w for w in (f"w{k}" for k in range(60))}
        for level, found in ((2, counts.total), (3, counts.counts)):
            for at in np.flatnonzero(batch.levels[level].at >= 0)[::7]:
                gram = tuple(tokens(slice(at - level + 1, at + 1)))
                assert found[batch.levels[level].at[at]] == grams[gram]
    assert owned == sum(len(g) == 2 for g in grams)
    size = sum(len(v) for own in sent.values() for r in own for v in r.values() if isinstance(v, bytes))
    assert size < 12 * sum(r["n_tokens"] for r in packed)  # 36 bytes each as rows


def test_order_of_rare_words_counts(make):
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 7 == 2][:2]
    passage = " ".join(f"rare{k}" for k in range(12))
    texts = ["a b c " * 200 + f"d{i}" for i in range(max(held) + 30)]
    texts[held[0]], texts[held[1]] = passage, " ".join(reversed(passage.split()))
    got = {r.doc_id: r for r in lm.score_documents(make([*texts, passage, passage])).collect()}
    assert got[held[0]].base_score == pytest.approx(got[held[1]].base_score)
    assert got[held[0]].score > got[held[1]].score + 3


def test_held_out_texts_score_above_the_base(make):
    got = [r for r in lm.score_documents(make(_texts())).collect() if r.held_out]
    assert got and sum(r.score for r in got) > sum(r.base_score for r in got)


def test_chances_of_every_state_add_up():
    rng = np.random.default_rng(3)
    base, order = 5, 3
    classes = rng.integers(0, base, 400)
    classes[classes == 1] = 2
    lengths = np.full(40, 10)
    classes[9::10] = 1
    grams = np.concatenate(lm._windows(classes, lengths, order, base))
    keys, counts = np.unique(grams, return_counts=True)
    machine = lm.Automaton(keys, counts, base, order)
    for first in range(base):
        for second in range(base):
            scores = [machine.score(np.array([first, second, w]), np.array([3]))[0] for w in range(base)]
            prefix = machine.score(np.array([first, second]), np.array([2]))[0]
            assert sum(10 ** (s - prefix) for s in scores) == pytest.approx(1)


def test_repeats_nulls_and_empty_tables(make):
    row = lambda i, t: (i, t, "en", "s", 0)
    docs = make([row(1, "a b zz"), row(1, "a b zz"), row(None, "a b"), row(3, "q q zz")])
    got = lm.score_documents(docs, known_share=0.9, class_share=0.9).collect()
    assert len(got) == 4
    pair = [r for r in got if r.doc_id == 1]
    assert pair[0] == pair[1] and pair[0].n_tokens == 4 and pair[0].n_known == 4
    assert lm.score_documents(make([])).count() == 0
    held = next(i for i in range(50) if zlib.crc32(str(i).encode()) % 7 == 2)
    alone = lm.score_documents(make([row(held, "a b")])).collect()[0]
    assert (alone.train_tokens, alone.n_known, alone.base_score) == (0, 0, 0.0) and alone.score <= 0
