import math
import random
import re

import pytest

from tidemark.llm import lexical

from .brute import lower

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def brute(documents, items, k=50):
    found = [(i, TERM.findall(lower(t or ""))) for i, t in documents]
    found = [(i, terms) for i, terms in found if terms]
    n_docs, total = len(found), sum(len(t) for _, t in found)
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(TERM.findall(lower(text or "")))
    out = []
    for item, terms in asked.items():
        df = {t: sum(t in set(own) for _, own in found) for t in terms}
        hits = []
        for i, own in found:
            m = 50 + (50 * len(own) * n_docs) // total
            score = 0
            for t in terms:
                if tf := own.count(t):
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += w * ((1_000_000_000 * tf) // (1000 * tf + 20 * m))
            if score > 0:
                hits.append((-score, i is None, i or 0))
        for rank, (score, unknown, i) in enumerate(sorted(hits)[:k], 1):
            out.append((item, rank, None if unknown else i, -score))
    return sorted(out, key=repr)


def run(spark, documents, items, **options):
    d = spark.createDataFrame([(i, t, 1, "x") for i, t in documents], "doc_id long, text string, score long, item_id string")
    q = spark.createDataFrame([(i, t, "y") for i, t in items], "item_id long, text string, doc_id string")
    return sorted((tuple(r) for r in lexical.search_documents(d.repartition(3), q, **options).collect()), key=repr)


def corpus(seed):
    random.seed(seed)
    vocabulary = [f"w{n}" for n in range(150)] + ["É", "über", "Straße", "x1y2"]
    weights = [1 / (n + 1) for n in range(len(vocabulary))]
    text = lambda n: " ,;\x00~".join(random.choices(vocabulary, weights, k=n)).replace("w7", "W7")
    documents = [(i, text(random.randint(1, 90))) for i in range(400)]
    documents += [(1000 + i, documents[5][1]) for i in range(70)]  # ties beyond k
    documents += [(None, documents[5][1]), (7, documents[5][1]), (2000, None), (2001, ""), (2002, "?! -"), (2003, text(30_000))]
    items = [(i, text(random.randint(1, 25))) for i in range(30)]
    items += [(100, None), (101, "..."), (102, "nowhere"), (3, "w1 w2 w149"), (None, "É STRAßE"), (103, documents[5][1]), (4, items[4][1])]
    return documents, items


@pytest.mark.parametrize("options", [{}, {"shard_documents": 7}, {"shard_bytes": 900, "item_bytes": 2000, "k": 5}])
def test_matches_brute_force(spark, options):
    documents, items = corpus(len(options))
    assert run(spark, documents, items, **options) == brute(documents, items, options.get("k", 50))


@pytest.mark.parametrize("share", [0.0, 0.05, 10.0])
def test_any_split_into_short_and_long_lists(spark, monkeypatch, share):
    monkeypatch.setattr(lexical, "SHORT_SHARE", share)
    monkeypatch.setattr(lexical, "BLOCK", 16)
    documents, items = corpus(9)
    numbers = {}
    for _, text in items:
        for term in lexical.terms_of(text or ""):
            numbers.setdefault(term, len(numbers))
    found = [(i, lexical.terms_of(t or "")) for i, t in documents]
    found = [(i, t) for i, t in found if t]
    lists = {}
    for at, (_, terms) in enumerate(found):
        for term in set(terms) & set(numbers):
            lists.setdefault(numbers[term], []).append((at, terms.count(term)))
    import numpy as np

    lists = {t: tuple(np.array(x, np.int32) for x in zip(*pairs)) for t, pairs in lists.items()}
    known = np.array([i is not None for i, _ in found])
    ids, lengths = np.array([i or 0 for i, _ in found]), np.array([len(t) for _, t in found])
    shard = lexical.Shard.load(lexical.Shard(ids, known, lengths, lists).dump())
    weights = np.zeros(len(numbers), np.int64)
    for t, (at, _) in lists.items():
        weights[t] = lexical.term_weight(len(found), len(at))
    searcher = lexical.Searcher(shard, len(found), int(lengths.sum()), weights)
    want = {}
    for item, rank, i, score in brute(documents, items):
        want.setdefault(item, []).append((score, i))
    for item, text in items:
        if item in (3, 4):  # asked by two texts
            continue
        terms = sorted({numbers[t] for t in lexical.terms_of(text or "")})
        at, score = searcher.search(terms, 50, 1)
        got = sorted((s, ids[a].item() if known[a] else None) for a, s in zip(at.tolist(), score.tolist()))
        assert sorted(want.get(item, []), key=repr) == sorted(got, key=repr)


def test_empty_tables(spark):
    assert run(spark, [], [(1, "a")]) == []
    assert run(spark, [(1, "a")], []) == []
    assert run(spark, [(1, None)], [(1, "a")]) == []


def test_length_measure_beyond_64_bits():
    assert lexical.length_measure(10**9, 10**12, 10**14) == 50 + 50 * 10**7
