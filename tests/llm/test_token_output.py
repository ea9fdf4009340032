import base64
import hashlib
import json

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark import cloudpickle

from tidemark.llm import common, token_output

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
TEXTS = ["some words of a text " * 9, "", None, "short", "x y z " * 700, "tail é 漢"] * 4


@pytest.mark.parametrize("n", [1, 2, 3, 20, 255, 1000])
def test_permutation_and_its_inverse(n):
    order = token_output.Permutation(n)
    slots = order.slots(np.arange(n))
    assert sorted(slots.tolist()) == list(range(n))
    assert (order.numbers(slots) == np.arange(n)).all()
    if n >= 20:
        assert (slots != token_output.Permutation(n, key=1).slots(np.arange(n))).any()


def test_shards_match_brute_force(make):
    docs = make(TEXTS)
    docs = common.written(docs.repartition(3), "docs")  # the scan's order is the stream's
    in_order = [(r.doc_id, r.text) for r in docs.collect()]
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    codec = tiktoken.Encoding("t", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    stream, owner = [], []
    for i, text in in_order:
        ids = [*codec.encode_ordinary(text or ""), 50256]
        stream += ids
        owner += [i] * len(ids)
    length, per_shard = 16, 50
    n = -(-len(stream) // length)
    slots = token_output.Permutation(n).slots(np.arange(n))
    folder = common.scratch(docs.sparkSession, "tokens")
    index = token_output.write_shards(
        docs, folder, PATH, PATTERN, sequence_tokens=length, shard_sequences=per_shard
    ).collect()
    assert len(index) == n
    for r in index:
        span = slice(r.sequence * length, (r.sequence + 1) * length)
        assert r.slot == slots[r.sequence] and r.shard == r.slot // per_shard
        assert r.doc_ids == list(dict.fromkeys(owner[span])) and r.n_tokens == len(stream[span])
    padded = np.array(stream + [50256] * (n * length - len(stream)), dtype="<u2").reshape(n, length)
    got = {r.slot: bytes(r.ids) for r in token_output.read_shards(docs.sparkSession, folder, run=7).collect()}
    assert got == {int(slots[q]): padded[q].tobytes() for q in range(n)}
    later = {r.slot for r in token_output.read_shards(docs.sparkSession, folder, from_slot=61, run=7).collect()}
    assert later == set(range(61, n))
    about = json.loads(common.fetch(folder, token_output.MANIFEST))
    for file in about["files"]:
        data = common.fetch(folder, file["name"])
        assert len(data) == file["bytes"] == file["sequences"] * 2 * length
        assert hashlib.sha256(data).hexdigest() == file["sha256"]


def test_every_text_is_encoded_once(make, monkeypatch, tmp_path):
    encode = token_output._streams

    def noted(batch, *args):
        with open(tmp_path / "encoded", "a") as log:
            log.writelines(f"{i}\n" for i in batch.column(0).to_pylist())
        return encode(batch, *args)

    monkeypatch.setattr(token_output, "_streams", noted)
    # By value, so that workers run the function above.
    cloudpickle.register_pickle_by_value(token_output)
    try:
        docs = common.written(make(TEXTS).repartition(3), "docs")
        folder = common.scratch(docs.sparkSession, "tokens")
        token_output.write_shards(docs, folder, PATH, PATTERN, sequence_tokens=16, shard_sequences=50).count()
    finally:
        cloudpickle.unregister_pickle_by_value(token_output)
    seen = sorted(map(int, (tmp_path / "encoded").read_text().split()))
    assert seen == sorted(r.doc_id for r in docs.collect())


def test_the_name_of_the_separator_is_plain_text(make, spark):
    text = "<|separator|> a<|separator|>"
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    codec = tiktoken.Encoding("t", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    folder = common.scratch(spark, "tokens")
    token_output.write_shards(make([text]), folder, PATH, PATTERN, sequence_tokens=64).count()
    ids = np.frombuffer(token_output.read_shards(spark, folder).collect()[0].ids, "<u2")
    assert ids.tolist()[: len(codec.encode_ordinary(text))] == codec.encode_ordinary(text)


def test_empty_table(make, spark):
    folder = common.scratch(spark, "tokens")
    assert token_output.write_shards(make([]), folder, PATH, PATTERN).count() == 0
    assert token_output.read_shards(spark, folder).count() == 0
