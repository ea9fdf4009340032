import random

from tidemark.operators import components


def _roots(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    return {(n, find(n)) for n in parent}


def _check(spark, edges):
    df = spark.createDataFrame(edges, "u string, v string")
    got = {tuple(r) for r in components.connected_components(df).collect()}
    assert got == {p for p in _roots([e for e in edges if e[0] != e[1]])}


def test_chain_settles(spark):
    _check(spark, [(f"n{i:04d}", f"n{i + 1:04d}") for i in range(1000)])


def test_random_graph_and_hub(spark):
    rnd = random.Random(1)
    edges = [(f"a{rnd.randint(0, 150)}", f"a{rnd.randint(0, 150)}") for _ in range(90)]
    edges += [("hub", f"h{i}") for i in range(120)]
    _check(spark, edges)


def test_hot_nodes_take_the_broadcast_path(spark, monkeypatch):
    monkeypatch.setattr(components, "HOT_EDGES", 5)
    monkeypatch.setattr(components, "HOT_PARTS", 20)
    _check(spark, [("hub", f"h{i}") for i in range(60)] + [("x", "y"), ("y", "z")])


def test_no_edges(spark):
    df = spark.createDataFrame([], "u string, v string")
    assert components.connected_components(df).count() == 0
