import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tidemark.llm import mixing

from .brute import words


def targets(sizes):
    """Water-filling by source; ``None`` sorts last."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    full, total = set(), sum(sizes.values())
    while True:
        free = [s for s in order if s not in full]
        rest = total - sum(3 * sizes[s] for s in full)
        of = sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * rest > 3 * sizes[s] * of}
        if not over:
            return {s: float(3 * sizes[s]) if s in full else weight[s] * rest / of for s in order}
        full |= over


def sainte_lague(weights, seats):
    got = Counter({k: 0 for k in weights})
    for _ in range(seats):
        best = min(weights, key=lambda k: (-weights[k] / (2 * got[k] + 1), k))
        got[best] += 1
    return dict(got)


@pytest.mark.parametrize("seed", range(3))
def test_apportionment_matches_highest_quotients(spark, seed):
    random.seed(seed)
    rows, seats = [], {"x": 37, "y": 2, "z": 0, "w": 500}
    for g in seats:
        rows += [(g, k, float(random.choice([0, 1, 1, 2, 5, 30])) + 1, seats[g]) for k in range(9)]
    df = spark.createDataFrame(rows, "g string, k int, w double, n int")
    got = {(r.g, r.k): r._seats for r in mixing.apportion(df, ["g"], ["k"], "w", "n").collect()}
    for g, n in seats.items():
        want = sainte_lague({k: w for h, k, w, _ in rows if h == g}, n)
        assert {k: got[g, k] for k in want} == want


def _documents(seed=1):
    random.seed(seed)
    rows, sources = [], {"src0": 300, "src1": 20, "Z": 60, "é": 60, None: 40, "tiny": 1, "empty": 2}
    for s, n in sources.items():
        for _ in range(n):
            count = 0 if s == "empty" else random.randint(0, 60)
            if s == "tiny":
                count = 10
            rows.append((len(rows), " \t".join(f"w{k}" for k in range(count)), "en", s, 1))
    return rows + [(len(rows), None, "en", "src0", None), rows[0], rows[0]]


@pytest.mark.parametrize("shard_words", [200_000, 300])
def test_targets_and_taken(make, shard_words):
    rows = _documents()
    got = mixing.mix(make(rows), shard_words=shard_words).collect()
    again = mixing.mix(make(rows[::-1]).repartition(5), shard_words=shard_words).collect()
    key = lambda r: (r.doc_id, r.taken)
    assert sorted(map(key, got)) == sorted(map(key, again))
    size, source = {}, {}
    for i, text, _, s, _ in rows:
        size[i], source[i] = len(words(text)), s
    sizes, taken = Counter(), Counter()
    for i, _, _, s, _ in rows:
        sizes[s] += size[i]
    want = targets(sizes)
    for r in got:
        assert r.size == size[r.doc_id] and r.source_size == sizes[source[r.doc_id]]
        assert r.target == pytest.approx(want[source[r.doc_id]], rel=1e-12)
        assert 0 <= r.taken <= 3 * r.size
        taken[source[r.doc_id]] += r.taken
    for s, t in want.items():
        assert abs(taken[s] - t) <= max(10, 0.01 * t)


def test_mixed_documents_hold_what_was_taken(spark):
    rows = [(i, t, s, n, n, "own") for i, t, _, s, n in _documents(2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars int, size int, taken string")
    mixed = mixing.mixed_documents(docs)
    assert mixed.schema.simpleString() == docs.schema.simpleString()
    count = F.sum(mixing.word_count(F.col("text")))
    got = {r[0]: r[1] for r in mixed.groupBy("doc_id").agg(count).collect()}
    want = defaultdict(int)
    for r in mixing.mix(docs).collect():
        want[r.doc_id] += r.taken
    assert {k: v for k, v in got.items() if v} == {k: v for k, v in want.items() if v}
    texts = {r[0]: r[1] for r in rows}
    for r in mixed.collect():
        assert r.text == texts[r.doc_id] or set(words(r.text)) <= set(words(texts[r.doc_id]))


def test_small_sources_leave_the_runs_of_large_ones(make):
    small = [(None, 3), ("tiny", 10)]
    rows = [(i, " ".join(f"{i}-{k}" for k in range(700)), "en", f"s{i % 3}", 0) for i in range(90)]
    rows += [(len(rows) + j, "x " * n, "en", s, 0) for j, (s, n) in enumerate(small)]
    docs = make(rows)
    gaps = taken = 0
    for r in mixing.mixed_documents(docs).filter("source like 's%'").collect():
        at = [int(w.split("-")[1]) for w in words(r.text)]
        taken += len(at)
        gaps += sum(b != a + 1 for a, b in zip(at, at[1:]))
    assert taken and gaps <= taken / mixing.BLOCK_WORDS
    got = Counter()
    want = {}
    for r in mixing.mix(docs).collect():
        source = rows[r.doc_id][3]
        got[source] += r.taken
        want[source] = r.target
    assert all(abs(got[s] - want[s]) <= 1 for s in want)


def test_empty_and_wordless_tables(make):
    assert mixing.mix(make([])).count() == 0
    got = mixing.mix(make([None, "", " "])).collect()
    assert [(r.size, r.target, r.taken) for r in got] == [(0, 0.0, 0)] * 3
    assert mixing.mixed_documents(make([None, ""])).count() == 2


def test_no_python_in_the_plan(make):
    plan = mixing.mixed_documents(make(["a b", "c"]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
