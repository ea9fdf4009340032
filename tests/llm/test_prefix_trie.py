import random
import zlib

import pytest

from tidemark.llm import prefix_trie as pt

from .brute import sha

SCHEMA = "conv_id long, turn long, role string, text string, depth string"


def nodes_of(sequences):
    """The contract's rows from {conv_id: [(role, text)]}, by prefix."""
    members = {}
    for c, turns in sequences.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    for path, own in members.items():
        below = [p for p in members if p[: len(path)] == path]
        childless = [p for p in below if not any(len(q) == len(p) + 1 and q[: len(p)] == p for q in members)]
        ends = sorted(c for c in own if len(sequences[c]) == len(path))
        out.append((
            min(own), len(path), min(members[path[:-1]]) if path else None, len(own),
            sum(len(q) == len(path) + 1 and q[: len(path)] == path for q in members), len(childless),
            sum((len(members[p]) - 1) * len(p[-1][1]) for p in below if p), sha(",".join(map(str, ends))),
        ))
    return sorted(out, key=repr)


def plain(rows):
    """Turns in order by conversation of (conv_id, turn, role, text) rows without equal turns."""
    out = {}
    for c, turn, role, text in rows:
        if c is not None:
            out.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [t[2:] for t in sorted(turns)] for c, turns in out.items()}


def rebuilt(own):
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        head = own.get(int(c / 100) * 100, [])  # remainders have the sign of c, as in SQL
        out[c] = head[:h] + turns[h:]
    return out


def found(df):
    columns = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def table(spark, rows, partitions=3):
    full = [(*r, "clash") for r in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(partitions)


def corpus(seed, convs=90):
    random.seed(seed)
    rows = []
    for c in range(convs):
        kind = random.random()
        base = 1 if kind < 0.35 else 2 if kind < 0.5 else random.randint(0, 8)  # large groups of copies
        turns = [("user" if t % 2 else "system", f"é{base * t % 5}" * (t % 4)) for t in range(1 + base)]
        if kind > 0.9:
            turns += [("user", str(t)) for t in range(random.randint(1, 60))]
        rows += [(c, t, role, text) for t, (role, text) in enumerate(turns)]
    rows += [(500, None, None, None), (500, 0, "user", "x" * 3000), (None, 1, "user", "lost"), (-3, 5, "user", "")]
    return rows


@pytest.mark.parametrize("piece", [1 << 20, 200])
@pytest.mark.parametrize("partitions", [1, 9])
def test_matches_brute_force(spark, piece, partitions):
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # else the ranges are merged into one
    try:
        rows = corpus(partitions)
        packed = pt.pack_turns(table(spark, rows))
        assert found(pt.prefix_nodes(packed, piece_bytes=piece)) == nodes_of(plain(rows))
        assert found(pt.prefix_nodes(pt.rebuild(packed), piece_bytes=piece)) == nodes_of(rebuilt(plain(rows)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_empty_and_turnless(spark):
    assert found(pt.prefix_nodes(pt.rebuild(pt.pack_turns(table(spark, []))))) == []
    # 117 takes no head, as there is no conversation 100, and loses its only turns before h
    lone = next(c for c in range(101, 199) if zlib.crc32(str(c).encode()) % 6 == 3)
    rows = [(lone, 0, "user", "a"), (lone, 1, "user", "b")]
    got = found(pt.prefix_nodes(pt.rebuild(pt.pack_turns(table(spark, rows)))))
    assert got == [(lone, 0, None, 1, 0, 1, 0, sha(str(lone)))]


def test_repeated_rows_are_turns_of_their_own(spark):
    rows = [(1, 0, "user", "a"), (1, 0, "user", "a"), (2, 0, "user", "a")]
    got = found(pt.conversation_trie(table(spark, rows)))
    assert [(r[0], r[1], r[3]) for r in got] == [(1, 0, 2), (1, 1, 2), (1, 2, 1)]


def test_texts_of_the_last_turn(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "bot", "b"), (2, 0, "user", "a")]
    conversations = table(spark, rows)
    named = pt.with_turns(pt.conversation_trie(conversations), conversations).orderBy("depth").collect()
    assert [(r["depth"], r["role"], r["text"]) for r in named] == [(0, None, None), (1, "user", "a"), (2, "bot", "b")]


@pytest.mark.parametrize("width,letters", [(1, 256), (2, 60), (3, 17), (4, 4)])
def test_tree_holds_every_prefix(width, letters):
    random.seed(width)
    make = lambda: bytes(random.randrange(letters) for _ in range(width * random.randint(0, 5)))
    keys = sorted({make() for _ in range(900)} | {bytes([b]) * width for b in range(letters)})
    places = list(pt.RadixTree(keys).prefixes(width))
    paths = []
    for parent, depth, row, terminal in places:
        paths.append(keys[row][: depth * width])
        assert (parent == -1) == (depth == 0)
        if depth:
            assert paths[parent] == paths[-1][:-width]
        assert (terminal is None) == (paths[-1] not in set(keys)) and (terminal is None or keys[terminal] == paths[-1])
    assert sorted(paths) == sorted({k[: d * width] for k in keys for d in range(len(k) // width + 1)})


def test_layouts_grow():
    node, seen = pt.Node(0, 0), set()
    for n, byte in enumerate(random.Random(1).sample(range(256), 256), 1):
        node.put(byte, pt.Node(byte, 1))
        seen.add(node.layout)
        assert node.child(byte).row == byte and len(list(node.ordered())) == n
    assert seen == {4, 16, 48, 256}
    assert [b for b, _ in node.ordered()] == list(range(256))
