import hashlib
import json

import pytest

from tidemark.llm import common, warc

from .brute import sha

LARGE = "<html>" + "x" * 200 + "</html>"
ROWS = [
    (1, "http://a/1", "small", "z"),
    (2, "http://a/2", "small", "z"),
    (7, "http://a/7", LARGE, "z"),
    (3, "http://a/\r\n3 é", LARGE, "z"),
    (9, None, LARGE, "z"),
    (4, "http://a/4", None, "z"),
    (5, "http://a/5", "", "z"),
    (6, "http://a/6", "\r\n\r\n" + "é" * 300_000, "z"),
    (8, "http://a/8", "u" * 99, "z"),
    (10, "http://a/10", "u" * 99, "z"),
    (None, "http://a/n", LARGE, "z"),
    (3, "http://a/again", LARGE, "z"),
]
SCHEMA = "page_id long, url string, html string, digest string"


def _read(spark, folder):
    return warc.read_archives(spark, folder).collect()


@pytest.mark.parametrize("shard_bytes", [1 << 30, 500])
def test_round_trip_and_revisits(spark, shard_bytes):
    folder = common.scratch(spark, "warc")
    manifest = warc.write_archives(
        spark.createDataFrame(ROWS, SCHEMA), folder, shard_bytes=shard_bytes, file_bytes=400
    )
    files = manifest.collect()
    assert sum(f.records for f in files) == len(ROWS) and len(files) > 2
    got = _read(spark, folder)
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    seen = sorted(((r.page_id, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest) for r in got), key=key)
    texts = [(i, h or "") for i, _, h, _ in ROWS]
    want = []
    first_three = False
    for i, h in texts:
        revisit = h == LARGE and (i != 3 or first_three)
        first_three |= i == 3
        want.append((i, "revisit" if revisit else "response", 3 if revisit else None, len(h.encode()), sha(h)))
    assert seen == sorted(want, key=key)
    for r in got:
        if r.record_type == "response":
            assert hashlib.sha256(bytes(r.payload)).hexdigest() == r.payload_digest
        assert "\r" not in r.target_uri and " " not in r.target_uri


def test_equal_tables_give_equal_files(spark):
    names = []
    for df in (spark.createDataFrame(ROWS, SCHEMA), spark.createDataFrame(ROWS[::-1], SCHEMA).repartition(7)):
        folder = common.scratch(spark, "warc")
        rows = warc.write_archives(df, folder, shard_bytes=700, file_bytes=300).collect()
        names.append(sorted((r.name, r.bytes, r.sha256) for r in rows))
        stored = {e["name"]: common.fetch(folder, e["name"]) for e in json.loads(common.fetch(folder, warc.MANIFEST))}
        assert all(hashlib.sha256(stored[n]).hexdigest() == h for n, _, h in names[-1])
    assert names[0] == names[1]


def test_commit_may_be_repeated_and_damage_is_found(spark):
    folder = common.scratch(spark, "warc")
    warc.write_archives(spark.createDataFrame(ROWS[:3], SCHEMA), folder)
    entries = json.loads(common.fetch(folder, warc.MANIFEST))
    listed = spark.createDataFrame([("_temporary/gone", e["name"]) for e in entries], "temporary string, name string")
    common.move_files(listed, folder)
    data = common.fetch(folder, entries[0]["name"])
    members = list(warc._members(__import__("io").BytesIO(data)))
    assert warc.parse_record(members[0]) is None
    with pytest.raises(ValueError):
        warc.parse_record(members[1].replace(b"small", b"smaLl"))
    with pytest.raises(ValueError):
        list(warc._members(__import__("io").BytesIO(data[:-5])))


def test_empty_table(spark):
    folder = common.scratch(spark, "warc")
    assert warc.write_archives(spark.createDataFrame([], SCHEMA), folder).count() == 0
    assert warc.read_archives(spark, folder).count() == 0
