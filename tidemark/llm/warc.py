"""Deterministic WARC archives, written by shards and read back.

Pages are put in order of their id and cut into shards of about equal payload by exact ranks, so the
same table gives the same shards however it is partitioned. A shard is one task's sorted stream; it
is written as gzip members, one per record, and rolls to a new file whenever the compressed size is
reached. Every header and digest is made anew from the payload.

Of records with equal payloads only the one with the smallest id carries it; the others are revisits.
Which those are is found on narrow rows, and travels to the writer as marks among the pages.

Files are written under temporary names. The rows that come back from the successful attempts name
them, are kept as a table, and only then are the files moved to their final names and listed in a
manifest, which is moved last. A reader goes by the manifest, so what lost attempts left is unseen.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from collections.abc import Iterable, Iterator
from urllib.parse import quote

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import fetch, filesystem, global_rank, move_files, publish, written

# Payloads from this size are kept once.
LEAST_REVISIT_BYTES = 100
SHARD_BYTES = 32 << 20
FILE_BYTES = 8 << 20
GZIP_LEVEL = 6
# Archives of equal tables are equal, so the date is a parameter and not the clock.
DATE = "1970-01-01T00:00:00Z"

REVISIT_PROFILE = "http://netpreservefoundation.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "manifest.json"
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # RFC 4122, names that are URLs


def record_id(page_id: int | None, digest: str, copy: int = 0) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'page:{page_id}:{digest}:{copy}')}>"


def _safe_url(url: str | None, page_id: int | None) -> str:
    """A URL without anything that would end a header line."""
    return quote(url, safe="!#$%&'()*+,/:;=?@[]~") if url else f"urn:page:{page_id}"


def _member(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One record as a gzip member; the same input gives the same bytes."""
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in headers), f"Content-Length: {len(block)}", "", ""]
    packer = zlib.compressobj(GZIP_LEVEL, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(lines).encode() + block + b"\r\n\r\n") + packer.flush()


def _digest_header(data: bytes) -> str:
    return f"sha256:{hashlib.sha256(data).hexdigest()}"


def make_record(
    page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, copy: int, date: str
) -> bytes:
    """A response record, or a revisit if it refers to another page's record."""
    http = (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        f"Content-Length: {len(payload)}\r\n\r\n"
    ).encode()
    block = http if refers_to is not None else http + payload
    headers = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", record_id(page_id, digest, copy)),
        ("WARC-Date", date),
        ("WARC-Target-URI", _safe_url(url, page_id)),
        ("WARC-Block-Digest", _digest_header(block)),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("X-Page-Id", "" if page_id is None else str(page_id)),
    ]
    if refers_to is not None:
        headers += [
            ("WARC-Profile", REVISIT_PROFILE),
            ("WARC-Refers-To", record_id(refers_to, digest)),
            ("X-Refers-To-Page-Id", str(refers_to)),
        ]
    return _member(headers, block)


class _RollingFiles:
    """Files of one shard under temporary names, each closed once it has its size."""

    def __init__(self, folder: str, shard: int, file_bytes: int, date: str):
        self.store, self.root = filesystem(folder)
        self.store.create_dir(f"{self.root}/_temporary", recursive=True)
        self.shard, self.limit, self.date = shard, file_bytes, date
        self.part, self.out, self.done = 0, None, []

    def add(self, member: bytes) -> None:
        if self.out is None:
            name = f"pages-{self.shard:06d}-{self.part:05d}.warc.gz"
            self.entry = {
                "shard": self.shard,
                "part": self.part,
                "name": name,
                "temporary": f"_temporary/{name}.{uuid.uuid4().hex}",
                "records": 0,
                "bytes": 0,
            }
            self.sha = hashlib.sha256()
            self.out = self.store.open_output_stream(
                f"{self.root}/{self.entry['temporary']}", compression=None
            )
            self._put(self._info(name))
        self._put(member)
        self.entry["records"] += 1
        if self.entry["bytes"] >= self.limit:
            self.close()

    def _info(self, name: str) -> bytes:
        fields = f"software: tidemark\r\nformat: WARC File Format 1.1\r\nisPartOf: shard {self.shard}\r\n"
        headers = [
            ("WARC-Type", "warcinfo"),
            ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(_NAMESPACE, name)}>"),
            ("WARC-Date", self.date),
            ("WARC-Filename", name),
            ("WARC-Block-Digest", _digest_header(fields.encode())),
            ("Content-Type", "application/warc-fields"),
        ]
        return _member(headers, fields.encode())

    def _put(self, member: bytes) -> None:
        self.out.write(member)
        self.sha.update(member)
        self.entry["bytes"] += len(member)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.done.append(self.entry | {"sha256": self.sha.hexdigest()})
            self.part, self.out = self.part + 1, None


_FILE_SCHEMA = (
    "shard int, part int, name string, temporary string, records long, bytes long, sha256 string"
)


def _shard_bounds(keys: DataFrame, shard_bytes: int) -> np.ndarray:
    """The smallest page id of every shard but the first.

    Ranks are exact, so the bounds do not depend on partitions or samples. Rows with one id
    share a shard. The list has one number per ``shard_bytes`` of payload.
    """
    row = keys.agg(F.count("*"), F.coalesce(F.sum("payload_bytes"), F.lit(0))).first()
    shards = max(1, min(row[0], -(-row[1] // shard_bytes)))
    if shards == 1:
        return np.empty(0, dtype=np.int64)
    per_shard = -(-row[0] // shards)
    ranked = global_rank(keys.select("page_id"), [F.asc_nulls_first("page_id")], "_rank")
    firsts = ranked.filter((F.col("_rank") % per_shard == 0) & (F.col("_rank") > 0))
    found = [r[0] for r in firsts.select("page_id").collect() if r[0] is not None]
    return np.unique(np.array(found, dtype=np.int64))


def _marks(keys: DataFrame) -> DataFrame:
    """``(page_id, digest, first)`` for pages whose payload occurs more than once."""
    large = keys.filter(F.col("payload_bytes") >= LEAST_REVISIT_BYTES)
    firsts = (
        large.groupBy("digest")
        .agg(F.min("page_id").alias("first"), F.count("*").alias("_n"))
        .filter("_n > 1 AND first IS NOT NULL")
        .drop("_n")
    )
    return large.select("page_id", "digest").distinct().join(firsts, "digest")


def write_archives(
    pages: DataFrame,
    folder: str,
    *,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    shard_bytes: int = SHARD_BYTES,
    file_bytes: int = FILE_BYTES,
    date: str = DATE,
) -> DataFrame:
    """Write one record per row below ``folder`` and return the manifest.

    Payloads are UTF-8, null as empty. Of payloads of at least 100 bytes that are equal, the
    smallest id is the response and the rest are revisits of it; of rows that repeat id and
    payload, one. Rows without id come first, never are what others refer to, and are responses
    if no copy has an id. An empty table gives an empty manifest. Other columns are not read.
    """
    spark = pages.sparkSession
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary")
    records = pages.select(
        F.col(id_col).cast("long").alias("page_id"),
        F.col(url_col).cast("string").alias("url"),
        payload.alias("payload"),
        F.sha2(payload, 256).alias("digest"),
    )
    keys = written(
        records.select("page_id", "digest", F.octet_length("payload").cast("long").alias("payload_bytes")),
        "page-keys",
    )
    bounds = _shard_bounds(keys, shard_bytes)

    @F.pandas_udf("int")
    def shard_of(ids: pd.Series) -> pd.Series:
        found = np.searchsorted(bounds, ids.fillna(np.iinfo(np.int64).min).to_numpy("int64"), side="right")
        return pd.Series(found.astype("int32"))

    marks = _marks(keys).select(
        "page_id",
        "digest",
        F.col("first"),
        F.lit(False).alias("is_record"),
        F.lit(None).cast("string").alias("url"),
        F.lit(None).cast("binary").alias("payload"),
    )
    rows = records.withColumn("first", F.lit(None).cast("long")).withColumn("is_record", F.lit(True))
    stream = (
        rows.unionByName(marks)
        .withColumn("shard", shard_of("page_id"))
        .repartitionById(len(bounds) + 1, F.col("shard"))
        .sortWithinPartitions("shard", F.asc_nulls_first("page_id"), "digest", "is_record", "url")
        .select("shard", "page_id", "digest", "first", "is_record", "url", "payload")
    )

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, mark, copies = None, None, (None, 0)
        done: list[dict] = []
        for batch in batches:
            for shard, page_id, digest, first, is_record, url, body in zip(
                *(column.to_pylist() for column in batch.columns)
            ):
                if not is_record:
                    mark = (page_id, digest, first)
                    continue
                if files is None or files.shard != shard:
                    if files is not None:
                        files.close()
                        done += files.done
                    files = _RollingFiles(folder, shard, file_bytes, date)
                copy = copies[1] + 1 if copies[0] == (page_id, digest) else 0
                copies = ((page_id, digest), copy)
                refers_to = None
                if mark is not None and mark[:2] == (page_id, digest) and (mark[2] != page_id or copy):
                    refers_to = mark[2]
                files.add(make_record(page_id, url, body, digest, refers_to, copy, date))
        if files is not None:
            files.close()
            done += files.done
        if done:
            yield pa.RecordBatch.from_pylist(done, schema=_arrow_schema())

    manifest = written(stream.mapInArrow(write, _FILE_SCHEMA), "archive-files")
    commit(manifest, folder)
    return manifest.drop("temporary")


def _arrow_schema() -> pa.Schema:
    kinds = {"int": pa.int32(), "string": pa.string(), "long": pa.int64()}
    return pa.schema([(n, kinds[k]) for n, k in (field.split() for field in _FILE_SCHEMA.split(", "))])


def commit(manifest: DataFrame, folder: str) -> None:
    """Move the files of ``manifest`` to their names, then publish the list of them."""
    move_files(manifest, folder)
    listed = manifest.drop("temporary").orderBy("shard", "part").toPandas()  # one row per file
    publish(folder, MANIFEST, json.dumps(listed.to_dict("records"), indent=0).encode())


def _members(stream) -> Iterator[bytes]:
    """The records of a WARC file, each inflated on its own."""
    unpacker, parts, data = zlib.decompressobj(31), [], b""
    while True:
        data = data or stream.read(1 << 20)
        if not data:
            break
        parts.append(unpacker.decompress(data))
        data = b""
        if unpacker.eof:
            yield b"".join(parts)
            data, unpacker, parts = unpacker.unused_data, zlib.decompressobj(31), []
    if parts and any(parts):
        raise ValueError("The archive ends within a record")


def parse_record(data: bytes) -> dict | None:
    """The page of a record, or None for a record about the file; digests are verified."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("Not a WARC record")
    headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines)
    block = rest[: int(headers["Content-Length"])]
    if headers["WARC-Block-Digest"] != _digest_header(block):
        raise ValueError(f"Block digest of {headers['WARC-Record-ID']} does not match")
    kind = headers["WARC-Type"]
    if kind == "warcinfo":
        return None
    http, _, payload = block.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])
    digest = headers["WARC-Payload-Digest"]
    if kind == "response" and digest != _digest_header(payload):
        raise ValueError(f"Payload digest of {headers['WARC-Record-ID']} does not match")
    refers_to = headers.get("X-Refers-To-Page-Id")
    return {
        "page_id": int(headers["X-Page-Id"]) if headers["X-Page-Id"] else None,
        "target_uri": headers["WARC-Target-URI"],
        "record_type": kind,
        "payload_bytes": int(fields["Content-Length"]),
        "payload_digest": digest.partition(":")[2],
        "refers_to": int(refers_to) if refers_to else None,
        "payload": payload if kind == "response" else None,
    }


def read_archives(spark: SparkSession, folder: str, *, payloads: bool = True) -> DataFrame:
    """The records of the files that the manifest below ``folder`` lists, digests verified.

    Files are read one record at a time, each by one task.
    """
    names = [(entry["name"],) for entry in json.loads(fetch(folder, MANIFEST))]
    listed = spark.createDataFrame(names, "name string")
    fields = [
        ("page_id", pa.int64()),
        ("target_uri", pa.string()),
        ("record_type", pa.string()),
        ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()),
        ("refers_to", pa.int64()),
    ] + ([("payload", pa.binary())] if payloads else [])
    schema = pa.schema(fields)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = filesystem(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows, size = [], 0
                with files.open_input_stream(f"{base}/{name}", compression=None) as source:
                    for member in _members(source):
                        page = parse_record(member)
                        if page is None:
                            continue
                        rows.append(page if payloads else {k: page[k] for k in schema.names})
                        size += len(member)
                        if size >= 8 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    kinds = "page_id long, target_uri string, record_type string, payload_bytes long, payload_digest string, refers_to long"
    spread = listed.repartition(max(1, min(len(names), 10_000)))
    return spread.mapInArrow(run, kinds + (", payload binary" if payloads else ""))
