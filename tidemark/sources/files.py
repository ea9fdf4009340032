"""Files that tasks read or write themselves, through Arrow's file systems.

Spark lists the files and spreads them over tasks; only paths, sizes and digests travel.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Bytes of a file that a task holds while it is hashed.
CHUNK_BYTES = 8 << 20
# Tasks that list the folders of a path, at most, and the folders that one of them lists where
# there are more than cores: a task costs as much as listing many small folders.
TASKS = 10_000
FOLDERS = 64
# The error of a path without a file.
ABSENT = "FileNotFoundError"
# Rows and bytes of content after which a task passes on what it found.
BATCH_ROWS = 10_000
BATCH_BYTES = 8 << 20
SPARK_SCHEMA = b"org.apache.spark.sql.parquet.row.metadata"


def filesystem(uri: str):
    """The Arrow file system of ``uri`` and the path in it.

    Hadoop renders local paths as ``file:/x``, which Arrow wants as ``file:///x``; ``s3a`` is
    Hadoop's name of ``s3``.
    """
    from pyarrow import fs

    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:") :]
    if uri.startswith("s3a://"):
        uri = "s3://" + uri[len("s3a://") :]
    return fs.FileSystem.from_uri(uri)


def list_names(spark: SparkSession, path: str) -> DataFrame:
    """``(path, length)`` of what is directly in ``path``, spread over tasks; a folder has no length.

    The driver sees these names. Those that start with a dot or an underscore are hidden.
    """
    from pyarrow import fs

    path = path.rstrip("/")
    store, root = filesystem(path)
    prefix = path.removesuffix(root)
    tops = store.get_file_info(fs.FileSelector(root))
    rows = [(prefix + x.path, x.size if x.is_file else None) for x in tops if not _hidden(x.base_name)]
    spread = max(spark.sparkContext.defaultParallelism, min(len(rows) // FOLDERS, TASKS))
    named = spark.createDataFrame(rows, "path string, length long")
    return named.repartition(max(1, min(len(rows), spread)))


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """``(path, length)`` of all files below ``path``, empty ones too; only metadata is read.

    The driver sees the names directly in ``path``; folders are listed in tasks. Names that start
    with a dot or an underscore are hidden, with all that is below them.
    """
    from pyarrow import fs

    def table(found: list[tuple[str, int]]) -> pa.RecordBatch:
        columns = [pa.array([n for n, _ in found], pa.string()), pa.array([k for _, k in found], pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names=["path", "length"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[str, int]] = []
        for batch in batches:
            for name, length in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if length is None:
                    store, inner = filesystem(name)
                    prefix = name.removesuffix(inner)
                    inside = store.get_file_info(fs.FileSelector(inner, recursive=True))
                    found += [(prefix + x.path, x.size) for x in inside if x.is_file and not _hidden_below(x.path, inner)]
                else:
                    found.append((name, length))
                if len(found) >= BATCH_ROWS:
                    yield table(found)
                    found = []
        yield table(found)

    return list_names(spark, path).mapInArrow(run, "path string, length long")


def _hidden(name: str) -> bool:
    return name.startswith((".", "_"))


def _hidden_below(path: str, top: str) -> bool:
    return any(map(_hidden, path[len(top) + 1 :].split("/")))


def _reason(error: BaseException) -> str:
    return type(error).__name__


def file_digests(files: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``files`` with ``sha256`` of the bytes at ``path`` and ``error`` where they cannot be read.

    A file is hashed in chunks, so it may be of any size. One that cannot be opened or read to its
    end has a null digest and the kind of error; it does not end the job.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, errors = [], []
            for path in batch.column("path").to_pylist():
                digest = hashlib.sha256()
                try:
                    store, inner = filesystem(path)
                    with store.open_input_stream(inner, compression=None) as source:
                        while chunk := source.read(chunk_bytes):
                            digest.update(chunk)
                    digests.append(digest.hexdigest())
                    errors.append(None)
                except (OSError, pa.ArrowException) as error:
                    digests.append(None)
                    errors.append(_reason(error))
            columns = [*batch.columns, pa.array(digests, pa.string()), pa.array(errors, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "sha256", "error"])

    schema = T.StructType([*files.schema.fields, T.StructField("sha256", T.StringType()), T.StructField("error", T.StringType())])
    # rows are narrow, but the bytes behind them are not
    tasks = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return files.repartition(tasks, "path").mapInArrow(run, schema)


def read_files(files: DataFrame) -> DataFrame:
    """``files`` with the ``content`` of the document at ``path`` and ``error`` where there is none.

    Documents are read whole, so this is for small ones. Spark's own readers open one file for
    each partition entry and plan them on the driver; here only names travel. One that cannot
    be read has null content and the kind of error, :data:`ABSENT` where no file is.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def table(start: int, contents: list, errors: list) -> pa.RecordBatch:
            own = batch.slice(start, len(contents)).columns
            columns = [*own, pa.array(contents, pa.binary()), pa.array(errors, pa.string())]
            return pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "content", "error"])

        for batch in batches:
            start, size, contents, errors = 0, 0, [], []
            for path in batch.column("path").to_pylist():
                try:
                    store, inner = filesystem(path)
                    with store.open_input_file(inner) as source:
                        contents.append(source.readall())
                    errors.append(None)
                    size += len(contents[-1])
                except (OSError, pa.ArrowException) as error:
                    contents.append(None)
                    errors.append(_reason(error))
                if size >= BATCH_BYTES:
                    yield table(start, contents, errors)
                    start, size, contents, errors = start + len(contents), 0, [], []
            yield table(start, contents, errors)

    schema = T.StructType([*files.schema.fields, T.StructField("content", T.BinaryType()), T.StructField("error", T.StringType())])
    # rows are narrow, but opening what they name is not
    tasks = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return files.repartition(tasks, "path").mapInArrow(run, schema)


def footer_schemas(files: DataFrame) -> DataFrame:
    """``(path, schema, error)``: the Spark schema, as JSON, of every Parquet file at ``path``.

    Footers are read in tasks. A file that Spark did not write has the schema that its Arrow types
    have in Spark; an unreadable one has an error instead.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq
        from pyspark.sql.pandas.types import from_arrow_schema

        for batch in batches:
            paths, schemas, errors = batch.column(0).to_pylist(), [], []
            for path in paths:
                try:
                    store, inner = filesystem(path)
                    found = pq.read_schema(inner, filesystem=store)
                    own = (found.metadata or {}).get(SPARK_SCHEMA)
                    kind = T.StructType.fromJson(json.loads(own)) if own else from_arrow_schema(found)
                    for field in kind.fields:  # comments and null marks make no other schema
                        field.metadata, field.nullable = {}, True
                    schemas.append(kind.json())
                    errors.append(None)
                except (OSError, pa.ArrowException) as error:
                    schemas.append(None)
                    errors.append(_reason(error))
            columns = [pa.array(c, pa.string()) for c in (paths, schemas, errors)]
            yield pa.RecordBatch.from_arrays(columns, names=["path", "schema", "error"])

    return files.select("path").mapInArrow(run, "path string, schema string, error string")


def write_files(rows: DataFrame, root: str) -> DataFrame:
    """Write ``content`` (bytes or text) to ``path`` below ``root``; ``(path, length)`` of each.

    Tasks write under a temporary name and move the file to its own, so readers never see half a
    file and a repeated task replaces equal content. The rows are written when they are read; a
    path must occur once.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = filesystem(root)
        made: set[str] = set()
        for batch in batches:
            lengths = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                folder = f"{base}/{path}".rpartition("/")[0]
                if folder not in made:
                    store.create_dir(folder, recursive=True)
                    made.add(folder)
                temporary = f"{base}/{path}.{uuid.uuid4().hex}.tmp"
                with store.open_output_stream(temporary, compression=None) as out:
                    out.write(content)
                store.move(temporary, f"{base}/{path}")
                lengths.append(len(content))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lengths, pa.int64())], names=["path", "length"])

    content = F.coalesce(F.col("content").cast("binary"), F.lit(b""))
    return rows.select("path", content.alias("content")).mapInArrow(run, "path string, length long")


def remove_files(paths: DataFrame) -> int:
    """Delete the files at ``path``; the number that were there."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gone = 0
            for path in batch.column(0).to_pylist():
                store, inner = filesystem(path)
                if store.get_file_info(inner).is_file:
                    store.delete_file(inner)
                    gone += 1
            yield pa.RecordBatch.from_arrays([pa.array([gone], pa.int64())], names=["gone"])

    found = paths.select("path").mapInArrow(run, "gone long").agg(F.sum("gone")).first()[0]
    return int(found or 0)
