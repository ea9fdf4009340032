import random

import numpy as np
import pytest

from tidemark.llm import substring_dedup as sd

from .brute import WORD


def brute(rows):
    """(id, words, removed, kept) of every (id, text); rows of one id are one document."""
    order = lambda i, at: (i is None, i or 0, at)
    words = [WORD.findall(t or "") for _, t in rows]
    first = {}
    for (i, _), own in zip(rows, words):
        for at in range(len(own) - 19):
            window = tuple(own[at : at + 20])
            first[window] = min(first.get(window, order(i, at)), order(i, at))
    out = []
    for (i, _), own in zip(rows, words):
        gone = set()
        for at in range(len(own) - 19):
            if first[tuple(own[at : at + 20])] < order(i, at):
                gone |= set(range(at, at + 20))
        out.append((i, len(own), len(gone), " ".join(w for k, w in enumerate(own) if k not in gone)))
    return sorted(out, key=repr)


def run(spark, rows, partitions=4, **options):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, kept string, batch long")
    got = sd.remove_repeats(df.repartition(partitions), **options)
    return sorted((tuple(r) for r in got.collect()), key=repr)


def corpus(seed):
    random.seed(seed)
    word = lambda: random.choice(("a", "B", "é", "ß x", " ")) + str(random.randrange(400))
    text = lambda n: [word() for _ in range(n)]
    passages = [text(n) for n in (19, 20, 21, 30, 55, 130)]
    rows, docs = [], []
    for i in range(120):
        own = text(random.randint(0, 60))
        for _ in range(random.randint(0, 3)):
            passage = random.choice(passages)
            cut = random.randint(0, 6)
            at = random.randint(0, len(own))
            own[at:at] = passage[cut:] if random.random() < 0.5 else passage
        docs.append(own)
    docs += [docs[3]] * 40 + [text(15) + ["z"] * 70 + text(5)] * 3 + [["q", "r", "s"] * 40]
    for i, own in enumerate(docs):
        rows.append((i * 7 % 1009, random.choice((" ", "\n", " \t\x0b ")).join(own)))
    random.shuffle(rows)
    rows += [(5000, None), (5001, ""), (5002, " \n "), (None, " ".join(docs[7])), (None, " ".join(docs[8]))]
    rows += [(rows[0][0], rows[0][1]), (3, " ".join(passages[4]))]
    return rows


@pytest.mark.parametrize("options", [{}, {"batch_bytes": 1500, "shard_bytes": 2000}, {"batch_bytes": 1}])
def test_matches_brute_force(spark, options):
    rows = corpus(len(options))
    assert run(spark, rows, **options) == brute(rows)


def test_long_texts_split_in_steps(spark, monkeypatch):
    random.seed(5)
    passage = " ".join(f"p{n}" for n in range(60))
    long = " ".join([*(f"w{random.randrange(10**6)}" for _ in range(20_000)), passage, *("v" * n for n in range(300))])
    rows = [(1, passage + " end"), (2, long), (3, "x" * 200_000), (4, "  " + long)]
    assert run(spark, rows) == brute(rows)
    numbers = sd._Numbers()
    whole = sd._word_numbers(long, numbers)
    monkeypatch.setattr(sd, "STEP_BYTES", 37)
    assert np.array_equal(sd._word_numbers(long, numbers), whole)


def test_shared_anchor_hashes_only_cost_time(spark, monkeypatch):
    monkeypatch.setattr(sd, "ANCHOR_BITS", 8)
    rows = corpus(4)[:60]
    # in this process, where the monkeypatch holds
    assert _local(rows) == brute(rows)


def _local(rows):
    """The steps of one batch without Spark."""
    import tempfile

    folder = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    numbers = sd._Numbers()
    words = [sd._word_numbers(t or "", numbers) for _, t in rows]
    batch = sd.Batch(
        np.array([i or 0 for i, _ in rows]), np.array([i is not None for i, _ in rows]),
        np.array([len(w) for w in words]), np.concatenate(words), list(numbers),
    )
    sd.publish(folder, "words-b.npz", batch.dump())
    import pyarrow as pa

    sent = [codes for _, codes in sd._probes(batch, 10, 1)]
    hits = sd._repeated(pa.table({"batch": ["b"] * len(sent), "codes": pa.array(sent, pa.binary())}))
    questions = sd._questions("b", folder, sd.unpack_sorted(hits.column("hits")[0].as_py()), 10, 1)
    names = [f.split()[0] for f in sd.QUESTION.split(", ")]
    table = pa.table([pa.array(c, t) for c, t in zip(zip(*questions), sd.QUESTION_KINDS)], names=names)
    answers = sd._later_elsewhere(table).column("numbers").to_pylist()
    return sorted(zip(*sd._kept("b", folder, answers)), key=repr)


def test_rolling_hashes_equal_windows():
    rng = np.random.default_rng(1)
    values = rng.integers(0, 2**63, 400).astype(np.uint64)
    values[200:250] = values[20:70]
    for width in (1, 2, 3, 10, 19, 20):
        h = sd.rolling(values, width)
        assert len(h) == 400 - width + 1
        assert np.array_equal(h[20 : 70 - width + 1], h[200 : 250 - width + 1])
        assert len(np.unique(h)) == len(h) - (50 - width + 1)
    assert len(sd.rolling(values[:5], 20)) == 0


def test_packing_round_trip():
    values = np.sort(np.random.default_rng(2).integers(0, 2**62, 1000).astype(np.uint64))
    assert np.array_equal(sd.unpack_sorted(sd.pack_sorted(values)), values)
    assert np.array_equal(sd.unpack_planes(sd.pack_planes(values[:0]), np.uint64), values[:0])


def test_empty_table(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, None)]) == [(1, 0, 0, "")]


def test_missing_file_is_an_error(tmp_path):
    with pytest.raises(FileNotFoundError):
        sd.Batch.load(str(tmp_path), "words-none.npz")
