import random

import numpy as np

from tidemark.llm import line_dedup

from .brute import drop_lines, sha

LONG = "this line is certainly long enough"


def _corpus():
    random.seed(5)
    lines = [f"shared passage number {k} of the corpus" for k in range(30)] + ["short", "", "ünïcode lines count code points"]
    texts = ["\n".join(random.choices(lines, k=random.randint(1, 8))) for _ in range(60)]
    return texts + [None, "", LONG, f"  {LONG.upper()}\t", f"{LONG}\n{LONG}", "a" * 300_000]


def _run(docs, **options):
    return {r.doc_id: (r.kept, r.n_lines, r.n_dropped) for r in line_dedup.dedup_lines(docs, **options).collect()}


def test_matches_brute_force_with_many_small_shards(make):
    texts = _corpus()
    assert _run(make(texts), shard_keys=3) == drop_lines(list(enumerate(texts)))
    assert _run(make(texts)) == drop_lines(list(enumerate(texts)))


def test_perfect_hash_is_minimal_and_probes_reject_strangers():
    rng = np.random.default_rng(1)
    high, low = (rng.integers(0, 1 << 63, 5000, dtype=np.uint64) for _ in range(2))
    shard = line_dedup.Shard.build(high, low, np.arange(5000, dtype=np.uint32), np.arange(5000))
    slots = shard.hash.slots(line_dedup._position(high, low))
    assert sorted(slots.tolist()) == list(range(5000))
    again = line_dedup.Shard.load(shard.dump())
    member, counts, keepers = again.probe(high, low)
    assert member.all() and (counts == np.arange(5000)).all() and (keepers == np.arange(5000)).all()
    assert not again.probe(high, low + np.uint64(1))[0].any()
    empty = line_dedup.PerfectHash.build(np.empty(0, np.uint64))
    assert (empty.slots(high) == -1).all()


def test_null_and_repeated_ids(make):
    row = lambda i: (i, LONG, "en", "s", len(LONG))
    # All rows without id are one document, and so are rows that share an id.
    assert all(r.n_dropped == 0 for r in line_dedup.dedup_lines(make([row(None)] * 4)).collect())
    assert all(r.n_dropped == 0 for r in line_dedup.dedup_lines(make([row(1), row(1), row(2)])).collect())
    got = line_dedup.dedup_lines(make([row(None), row(1), row(2), row(2)])).collect()
    assert sorted((r.doc_id or -1, r.n_dropped) for r in got) == [(-1, 1), (1, 1), (2, 0), (2, 0)]


def test_replaced_texts_keep_the_schema(spark):
    rows = [(i, LONG if i else LONG + "\nown words", len(LONG), "k") for i in range(4)] + [(9, None, None, "h")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, high string")
    got = line_dedup.replace_texts(docs)
    assert got.schema == docs.schema
    texts = {r.doc_id: (r.text, r.n_chars) for r in got.collect()}
    assert texts == {0: ("own words", 9), 1: ("", 0), 2: ("", 0), 3: (LONG, len(LONG)), 9: (None, None)}
    assert line_dedup.replace_texts(docs.limit(0)).count() == 0
    assert sha("") == sha(b"")


def test_a_lost_shard_is_an_error(tmp_path):
    import pytest

    line = "a line that is long enough to count"
    with pytest.raises(FileNotFoundError):
        line_dedup._drop([line], [1], str(tmp_path), 1, frozenset({0}))
    # a shard that has no keys has no file either
    assert line_dedup._drop([line], [1], str(tmp_path), 1, frozenset()) == ([line], [1], [0])
