import math

import numpy as np
import pytest

from tidemark.llm import topk


def brute(rows, k=10, every=100):
    ints = {}
    for n, (i, v) in enumerate(rows):
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            ints[n] = (i, [math.floor(1024 * x) for x in v])
    out = {}
    for i, q in ints.values():
        if i % every == 0:
            hits = [
                (sum(a * b for a, b in zip(q, v)), j) for j, v in ints.values() if j != i and len(v) == len(q)
            ]
            out[i] = [(j, s) for s, j in sorted(hits, key=lambda h: (-h[0], h[1]))[:k]]
    return out


def run(spark, rows, **options):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    out = {}
    for r in topk.top_k(df, **options).orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


@pytest.mark.parametrize("shard", [4096, 40])
def test_matches_brute_force(spark, shard):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=8).round(1).tolist(), "x") for i in range(350)]
    rows += [(400 + i, rows[7][1], "tie") for i in range(30)]  # many equal scores
    rows += [(900, None, "n"), (901, [1.0, None] * 4, "n"), (1000, [math.nan] * 8, "n"), (1100, [math.inf] * 8, "n")]
    rows += [(2000, [1.0, 2.0], "short"), (2001, [3.0, 1.0], "short"), (None, [1.0] * 8, "no id")]
    want = {k: v for k, v in brute([r[:2] for r in rows]).items() if v}
    assert run(spark, rows, shard_vectors=shard) == want


def test_huge_components_stay_exact(spark):
    rows = [(0, [1e12, -1e12, 3.0], "")] + [(i, [1e12 + i, 1e12, float(i)], "") for i in range(1, 50)]
    hits = brute([r[:2] for r in rows], k=50)[0]
    held = [(j, max(-(2**63), min(s, 2**63 - 1))) for j, s in hits]
    want = {0: sorted(held, key=lambda h: (-h[1], h[0]))[:10]}
    assert run(spark, rows) == want


def test_few_and_no_rows(spark):
    assert run(spark, [(0, [1.0], ""), (1, [2.0], "")]) == {0: [(1, 2 * 1024 * 1024)]}
    empty = spark.createDataFrame([], "vec_id long, embedding array<double>")
    assert topk.top_k(empty).count() == 0


def test_tree_prunes_and_boxes_are_tight():
    rng = np.random.default_rng(0)
    points = rng.integers(-50, 50, (500, 4)).astype(float)
    tree = topk.Tree.build(np.arange(500), points, leaf=8)
    for low, high, a, b in zip(tree.low, tree.high, tree.first, tree.last):
        assert (tree.vectors[a:b].min(axis=0) == low).all() and (tree.vectors[a:b].max(axis=0) == high).all()
    q = rng.integers(-50, 50, 4).astype(float)
    best = sorted((points @ q).astype(int).tolist(), reverse=True)[:5]
    assert sorted((s for s, _ in tree.search(q, -1, 5, None)), reverse=True) == best
    assert sorted((s for s, _ in tree.search(q, -1, 5, best[2])), reverse=True)[:3] == best[:3]
