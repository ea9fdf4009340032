import random
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest

from tidemark.llm import common
from tidemark.llm import parity_join as pj

from .brute import components, shingle_set


def _corpus(seed=3):
    random.seed(seed)
    word = lambda: "".join(random.choices("abcdefgh", k=4))
    passage = [word() for _ in range(60)]
    texts = []
    for size in (4, 7, 12, 40, 70, 200, 600):
        base = [word() for _ in range(size)]
        for edits in (0, 0, 1, 2, size // 20, size // 12, size // 6):
            copy = list(base)
            for _ in range(edits):
                copy[random.randrange(size)] = word()
            texts.append(" ".join(copy[: size - random.randint(0, size // 8)]))
    texts += [" ".join([word() for _ in range(30)] + passage + [word() for _ in range(n)]) for n in range(0, 60, 4)]
    return texts + ["", None, " \n\t ", "one", "One", "one two", "ONE  two", texts[0].upper()]


def _result(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


def test_matches_brute_force(make):
    texts = _corpus()
    assert _result(pj.link_documents(make(texts))) == components(list(enumerate(texts)))


@pytest.mark.parametrize("group", [1, 2])
def test_split_groups_and_frequent_segments(make, monkeypatch, group):
    monkeypatch.setattr(pj, "GROUP_NODES", group)
    monkeypatch.setattr(pj, "FREQUENT_IN_BATCH", 1)
    monkeypatch.setattr(pj, "FREQUENT", 1)
    texts = _corpus(group)
    assert _result(pj.link_documents(make(texts))) == components(list(enumerate(texts)))


class _Batches:
    """Stands for a table whose batches are given to the mapped function here."""

    def __init__(self, texts):
        ids = pa.array(range(len(texts)), pa.int64())
        self.batch = pa.RecordBatch.from_arrays([ids, pa.array(texts, pa.string())], names=["doc", "text"])

    def mapInArrow(self, run, schema):
        return list(run([self.batch]))


def test_batches_are_bounded_by_bytes_and_lose_nothing(monkeypatch):
    docs = _Batches(_corpus(5))
    none = pj.Frequent(np.empty(0, np.uint64), np.empty(0, np.int64))
    members = lambda: pj._memberships(docs, SimpleNamespace(value=none))
    signed = lambda: [b.slice(0).filter(pc.is_valid(b["doc"])) for b in pj.signatures(docs)]
    whole = pa.Table.from_batches(members()), pa.Table.from_batches(signed())
    monkeypatch.setattr(pj, "RUN_BYTES", 2_000)
    monkeypatch.setattr(pj, "COUNTED_SEGMENTS", 500)
    found = members(), signed()
    assert max(b.num_rows for b in found[0]) < whole[0].num_rows / 4
    assert max(b.num_rows for b in found[1]) < whole[1].num_rows / 2
    assert [pa.Table.from_batches(part) for part in found] == list(whole)


def test_packed_members_are_those_of_plain_rows_in_less_space(monkeypatch):
    monkeypatch.setattr(pj, "GROUP_NODES", 3)
    monkeypatch.setattr(pj, "RUN_BYTES", 3_000)
    texts = _corpus(6)
    names = np.concatenate([pj.segments(pj.shingles(t or ""), b) for t in texts if pj.shingles(t or "").size for b in (1, 2)])
    often = pj.Frequent(*np.unique(names, return_counts=True))
    docs, listed, shards = _Batches(texts), SimpleNamespace(value=often), 3
    rows = {tuple(r.values()) for b in pj._memberships(docs, listed) for r in b.to_pylist()}
    packed = pj._memberships(docs, listed, shards)
    got = []
    for shard in range(shards):
        own = pa.Table.from_pylist([r for b in packed for r in b.to_pylist() if r["shard"] == shard])
        got += pj._met(own).to_pylist()
    groups = {}
    for segment, split, part, node, size, common in rows:
        groups.setdefault((segment, part), []).append((-common, size, node, split))
    want = set()
    for (segment, part), nodes in groups.items():
        nodes.sort()
        for k, (common, size, node, split) in enumerate(nodes):
            before, before_size = (nodes[k - 1][2], nodes[k - 1][1]) if k else (None, None)
            if len(nodes) > 1 or split:
                want.add((segment, split, part, node, size, -common, before, before_size, nodes[0][2], nodes[0][1]))
    assert {tuple(r.values()) for r in got} == want and len(got) == len(want)
    assert any(r["split"] for r in got) and len({r["part"] for r in got}) > 1
    one = pj._memberships(_Batches([" ".join(map(str, range(2_000)))] * 2), SimpleNamespace(value=often), 1)
    plain = pj._memberships(_Batches([" ".join(map(str, range(2_000)))] * 2), SimpleNamespace(value=often))
    assert sum(b.nbytes for b in one) < sum(b.nbytes for b in plain) / 3


def test_often_counts_like_unique():
    rng = np.random.default_rng(4)
    for size in (1, 3, 4, 5, 6, 400):
        parts = [rng.integers(0, 40, size).astype(np.uint64) for _ in range(2)] + [np.empty(0, np.uint64)]
        names, seen = np.unique(np.concatenate(parts), return_counts=True)
        often = seen >= pj.FREQUENT_IN_BATCH
        got = pj._often(parts)
        assert got[0].tolist() == names[often].tolist() and got[1].tolist() == seen[often].tolist() and parts == []


def test_sketches_never_exceed_the_difference():
    random.seed(2)
    for _ in range(60):
        base = [str(random.random()) for _ in range(random.randint(1, 300))]
        other = base[random.randint(0, 20) :] + [str(random.random()) for _ in range(random.randint(0, 80))]
        a, b = pj.shingles(" ".join(base)), pj.shingles(" ".join(other) or "x")
        different = len(np.setxor1d(a, b))
        assert pj.differs_at_least(pj.compare_sketch(a), pj.compare_sketch(b)) <= different
        for band in range(3):
            x, y = set(pj.segments(a, band).tolist()), set(pj.segments(b, band).tolist())
            assert len(x - y) <= different and len(y - x) <= different


def test_bands_meet_across_borders():
    for small in range(1, 700):
        for large in range(small, 4 * small // 3 + 1):
            assert set(pj.bands(small)) & set(pj.bands(large))


def test_cancelled_sketches_share_a_segment():
    none = pj.Frequent(np.empty(0, np.uint64), np.empty(0, np.int64))
    doubled = np.array([5, 5], dtype=np.uint64)  # cancels wholly
    first, _, _ = pj.needed_segments(doubled, 1, none)
    second, _, _ = pj.needed_segments(np.array([9, 9], dtype=np.uint64), 1, none)
    assert set(first.tolist()) & set(second.tolist())


def test_null_ids_repeats_and_clashing_columns(spark):
    text = "a b c d e f g h i j k l m n o p q r s t"
    rows = [(5, text, 1), (3, text + " u", 2), (None, text, 3), (3, text + " u", 4), (8, "", 5), (7, None, 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, node long")
    got = sorted(((r.doc_id, r.component_id, r.n_shingles) for r in pj.link_documents(docs).collect()), key=str)
    assert got == [(3, 3, 17), (3, 3, 17), (5, 3, 16), (7, 7, 0), (8, 8, 0), (None, None, 16)]
    kept = pj.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or -1) for r in kept.collect()) == [-1, 3, 7, 8]
    assert pj.link_documents(docs.limit(0)).count() == 0


def test_shingle_counts():
    for text in _corpus():
        assert len(pj.shingles(text or "")) == len(shingle_set(text))


def test_tiles_agree_with_single_pairs():
    random.seed(8)
    base = [str(random.random()) for _ in range(90)]
    members = []
    for k in range(60):
        own = list(base[: random.randint(60, 90)])
        for _ in range(random.randint(0, 3)):
            own[random.randrange(len(own))] = str(random.random())
        found = pj.shingles(" ".join(own))
        members.append((k, len(found), k % 7, pj.compare_sketch(found), {k + 8}))
    assert set(pj._tile_pairs(members, None)) == set(pj._few_pairs(members, None))
    left, right = members[:25], members[25:]
    assert set(pj._tile_pairs(left, right)) == set(pj._few_pairs(left, right))
    assert len(set(pj._few_pairs(members, None))) > 20


def test_segments_of_one_passage_compare_their_nodes_once(make, monkeypatch):
    random.seed(12)
    word = lambda: "".join(random.choices("abcdefgh", k=5))
    passage = [word() for _ in range(120)]
    texts = [" ".join([word() for _ in range(30 + k)] + passage[k % 7 :]) for k in range(24)]
    left, compared = [], pj._apart_pairs
    monkeypatch.setattr(pj, "_apart_pairs", lambda rows, nearest: left.append(rows.count()) or compared(rows, nearest))
    assert _result(pj.link_documents(make(texts))) == components(list(enumerate(texts)))
    # Each text meets the others under some dozens of segments.
    assert left and left[0] <= 10 * len(texts)


def test_families_hold_every_pair_that_is_apart(spark):
    random.seed(13)
    groups = {k: random.sample(range(30), random.randint(2, 12)) for k in range(60)}
    groups[60] = [1, 2, 3]
    members = spark.createDataFrame([(s, n, 10) for s, own in groups.items() for n in own], "segment long, node long, size int")
    roots = {n: 1 if n < 4 else n for n in range(30)}
    component = spark.createDataFrame(list(roots.items()), "node long, root long")
    rows = pj._families(members, component).collect()
    held = {}
    for r in rows:
        assert r.root == roots[r.node] and r.size == 10 and r.tiles == 1
        held.setdefault(r.segment, set()).add(r.node)
    assert sum(map(len, held.values())) == len(rows) < sum(map(len, groups.values()))
    for own in groups.values():
        if len({roots[n] for n in own}) > 1:
            assert any(set(own) <= family for family in held.values())


def test_nodes_without_a_near_partner_leave(spark):
    left = spark.createDataFrame([(7, n, n) for n in range(4)] + [(8, 0, 0)], "segment long, node long, root long")
    picks = spark.createDataFrame([(7, 0, 2, 5)], "segment long, a long, b long, distance long")
    assert sorted(map(tuple, pj._live(left, picks).collect())) == [(7, 0), (7, 2)]


@pytest.mark.parametrize("ids", [0, 1_000])
def test_verified_with_few_and_many_texts(spark, monkeypatch, ids):
    monkeypatch.setattr(pj, "BROADCAST_IDS", ids)
    base = [f"w{k}" for k in range(60)]
    texts = [" ".join(base), " ".join(base[:-2]), " ".join(base[30:]), " ".join(base[1:])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc long, text string")
    names = [pj.node_of(pj.shingles(t)) for t in texts]
    nodes = spark.createDataFrame(list(zip(names, range(4))), "node long, doc long")
    pairs = spark.createDataFrame([(names[0], names[1]), (names[2], names[0]), (names[1], names[3])], "a long, b long")
    found = {frozenset((names.index(r.u), names.index(r.v))) for r in pj._verified(pairs, docs, nodes).collect()}
    assert found == {frozenset((0, 1)), frozenset((1, 3))}


def test_frequent_segments_are_counted_over_the_batches_of_a_task(monkeypatch):
    passage = " ".join(f"p{k}" for k in range(40))
    docs = _Batches([f"{k} {passage}" for k in range(12)])
    docs.mapInArrow = lambda run, schema: list(run([docs.batch.slice(k, 3) for k in range(0, 12, 3)]))
    counted = [b["seen"].drop_null().to_pylist() for b in pj.signatures(docs)]
    assert 12 in sum(counted, [])
    # A text of more segments than are held at once is counted in pieces.
    monkeypatch.setattr(pj, "COUNTED_SEGMENTS", 7)
    rows = [r for b in pj.signatures(docs) for r in b.to_pylist()]
    assert sorted(r["doc"] for r in rows if r["doc"] is not None) == list(range(12))


def test_order_of_segments_is_by_times_seen_then_name():
    rng = np.random.default_rng(5)
    found = pj.shingles(" ".join(map(str, range(900))))
    for listed in (0, 20, 600, 900):
        names = pj.segments(found, 3)
        often = pj.Frequent(np.sort(names)[:listed], rng.integers(8, 30, min(listed, len(names))))
        own, seen, common = pj.needed_segments(found, 3, often)
        counts = dict(zip(often.names.tolist(), often.counts.tolist()))
        want = sorted((counts.get(n, 0), n) for n in names.tolist())[: len(own)]
        assert sorted(zip(seen.tolist(), own.tolist())) == want and common == min(listed, len(names))
        assert len(own) == len(found) // 3 + 1


def test_workers_give_memory_back_at_the_end_of_a_task(monkeypatch):
    given = []
    monkeypatch.setattr(common, "give_back", lambda: given.append(1))
    docs = _Batches(_corpus(7))
    assert len(pj.signatures(docs)) and len(given) == 1
    none = pj.Frequent(np.empty(0, np.uint64), np.empty(0, np.int64))
    assert len(pj._memberships(docs, SimpleNamespace(value=none), 2)) and len(given) == 2
