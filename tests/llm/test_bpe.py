import base64

import public_tokenizers
import pytest
import tiktoken

from tidemark.llm import bpe

from .brute import sha

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
TEXTS = [
    "Hello world, it's 12345 o'clock!",
    "",
    None,
    "a" * 5000,
    "ab" * 3000 + " \t\n  x",
    "naïve ünïcode 漢字仮名 \U0001f600\U0001f600 ʼn\x1c\x85  z",
    "  leading   and trailing   ",
    "Hello world, it's 12345 o'clock!",
    "\x00\x01 <|endoftext|>",
]


@pytest.fixture(scope="module")
def expected():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("t", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_ids_and_bytes_match_the_library(make, expected):
    docs = make(TEXTS)
    encoded = {r[0]: r[1] for r in bpe.encode(docs, PATH, PATTERN).collect()}
    for i, text in enumerate(TEXTS):
        assert encoded[i] == expected.encode_ordinary(text or "")
    decoded = bpe.decode(bpe.encode(docs, PATH, PATTERN), PATH, PATTERN).collect()
    assert {r[0]: bytes(r[1]) for r in decoded} == {i: (t or "").encode() for i, t in enumerate(TEXTS)}


def test_round_trip_digests(make, expected):
    rows = {r.doc_id: r for r in bpe.round_trip(make(TEXTS), PATH, PATTERN).collect()}
    for i, text in enumerate(TEXTS):
        ids = expected.encode_ordinary(text or "")
        packed = b"".join(x.to_bytes(4, "little") for x in ids)
        assert rows[i].n_tokens == len(ids)
        assert rows[i].ids_sha256 == sha(packed)
        assert rows[i].decoded_sha256 == sha(text or "")


def test_scalar_and_lockstep_merges_agree():
    codec = bpe.codec(PATH, PATTERN)
    pieces = [b"hello", b" therheanish", b"zz", "ünïcödé".encode(), bytes(range(33, 96)), b"aaaaaaaaaaaaaaab"]
    for piece in pieces:
        size = 1 << (len(piece) - 1).bit_length()
        packed = codec.lockstep.merge([piece], size)[0]
        ids = [int.from_bytes(packed[k : k + 4], "little") for k in range(0, len(packed), 4)]
        codec_ids = bpe.merge_ranks(piece, {k: v for k, v in codec.ranks.items() if k != piece})
        if piece not in codec.ranks:
            assert ids == codec_ids


def test_forgetting_changes_nothing(monkeypatch, expected):
    monkeypatch.setattr(bpe, "REMEMBERED", 5)
    monkeypatch.setattr(bpe, "RUN_CHARS", 20)
    own = bpe.Codec(PATH, PATTERN)
    texts = ["one two three four five six seven", "two three eight nine ten eleven", "one twelve"] * 3
    for text, packed in zip(texts, own.encode_all(texts)):
        ids = [int.from_bytes(packed[k : k + 4], "little") for k in range(0, len(packed), 4)]
        assert ids == expected.encode_ordinary(text)


def test_empty_table_and_clashing_columns(make, spark):
    assert bpe.round_trip(make([]), PATH, PATTERN).count() == 0
    clash = spark.createDataFrame([(1, "x", "y")], "doc_id long, text string, n_tokens string")
    assert bpe.round_trip(clash, PATH, PATTERN).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
