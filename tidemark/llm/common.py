"""Shared pieces of the training-data operators: scratch tables, shared files, ranks."""

from __future__ import annotations

import ctypes
import gc
import time
import uuid
from collections import OrderedDict
from collections.abc import Callable, Iterable, Iterator, Sequence
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.session import checkpoint_dir, settle

# Fixed by the contracts: what separates words, and how documents are folded for training splits.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = " \t\n\x0b\x0c\r"

RELEASE_SECONDS = 0.5


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder; it goes when the driver's JVM ends."""
    path = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to shared storage and read again.

    Cuts the lineage like ``checkpoint()`` but stays columnar and compressed.
    """
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the table that :func:`written` made, once nothing needs it any more.

    Also lets the driver drop plans that nobody holds, and with them their shuffle files.
    """
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(file).getParent()
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
    release(spark)


def release(spark: SparkSession) -> None:
    """Let the driver find plans that nobody holds, so that their shuffle files are removed.

    Listeners hold a query a moment longer than it runs, and a collection that comes too early finds nothing.
    """
    gc.collect()
    time.sleep(RELEASE_SECONDS)
    spark.sparkContext._jvm.System.gc()


def filesystem(uri: str):
    """The Arrow file system of ``uri`` and the path in it, for tasks that read or write files.

    Hadoop renders local paths as ``file:/x``, which Arrow wants as ``file:///x``.
    """
    from pyarrow import fs

    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:") :]
    return fs.FileSystem.from_uri(uri)


def fold(column: str, parts: int) -> Column:
    """The fold of a row: crc32 of the id as text, modulo ``parts``; rows without id are in fold 0."""
    text = F.coalesce(F.col(column).cast("string"), F.lit(""))
    return (F.crc32(text) % parts).cast("int")


def global_rank(df: DataFrame, order: Sequence[Column], name: str, parts: int = 16) -> DataFrame:
    """Number the rows from 0 in the given order without bringing them to one task.

    Rows are range-partitioned and settled; only the row counts of the ``parts`` partitions are
    added up in one place.
    """
    ordered = settle(df.repartitionByRange(parts, *order).sortWithinPartitions(*order))
    placed = ordered.withColumn("_part", F.spark_partition_id())
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy("_part")
        .agg(F.count("*").alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .drop("_n")
    )
    local = Window.partitionBy("_part").orderBy(*order)
    return (
        placed.withColumn("_local", F.row_number().over(local))
        .join(F.broadcast(offsets), "_part")  # at most ``parts`` rows
        .withColumn(name, F.col("_before") + F.col("_local") - 1)
        .drop("_part", "_local", "_before")
    )


def texts(batch: pa.RecordBatch, column: int | str) -> list[str]:
    """The texts of a batch, nulls as empty."""
    return [value or "" for value in batch.column(column).to_pylist()]


def publish(folder: str, name: str, data: bytes) -> None:
    """Write a small file below ``folder`` under a temporary name and move it to its own.

    A repeated task replaces equal content, and readers never see half a file.
    """
    store, root = filesystem(folder)
    store.create_dir(root, recursive=True)
    temporary = f"{root}/{name}.{uuid.uuid4().hex}.tmp"
    with store.open_output_stream(temporary, compression=None) as out:
        out.write(data)
    store.move(temporary, f"{root}/{name}")


def fetch(folder: str, name: str) -> bytes | None:
    """The content of a published file, None if there is none."""
    store, root = filesystem(folder)
    try:
        with store.open_input_stream(f"{root}/{name}", compression=None) as source:
            return source.read()
    except FileNotFoundError:
        return None


class Held:
    """Published files as objects with ``bytes``, the least recently used leaving first."""

    def __init__(self, limit: int, load: Callable[[bytes], Any]):
        self.limit, self.load, self.bytes, self.items = limit, load, 0, OrderedDict()

    def get(self, folder: str, name: str) -> Any:
        """The object of a file, None if the file does not exist."""
        key = (folder, name)
        if key in self.items:
            self.items.move_to_end(key)
            return self.items[key]
        data = fetch(folder, name)
        found = None if data is None else self.load(data)
        self.items[key] = found
        self.bytes += found.bytes if found else 0
        while self.bytes > self.limit and len(self.items) > 1:
            _, dropped = self.items.popitem(last=False)
            self.bytes -= dropped.bytes if dropped else 0
        return found


def move_files(manifest: DataFrame, folder: str) -> None:
    """Move every ``temporary`` file of ``manifest`` below ``folder`` to its ``name``.

    May be repeated: a file that has its name already is left. Files of lost attempts are in no
    manifest and keep their temporary names.
    """

    def move(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = filesystem(folder)
        for batch in batches:
            moved = 0
            for temporary, name in zip(*(column.to_pylist() for column in batch.columns)):
                if not store.get_file_info(f"{root}/{name}").is_file:
                    store.move(f"{root}/{temporary}", f"{root}/{name}")
                    moved += 1
            yield pa.RecordBatch.from_arrays([pa.array([moved], pa.int64())], names=["moved"])

    named = manifest.select("temporary", "name")
    named.mapInArrow(move, "moved long").agg(F.sum("moved")).collect()


def slices(batch: pa.RecordBatch, column: int | str, limit: int) -> Iterator[pa.RecordBatch]:
    """Runs of rows of ``batch`` with about ``limit`` bytes of text, one row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    run = np.cumsum(sizes, dtype=np.int64) // limit
    starts = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]])) if len(run) else []
    for a, b in zip(starts, [*starts[1:], batch.num_rows]):
        yield batch.slice(a, b - a)


def runs(batches: Iterable[pa.RecordBatch], column: int | str, limit: int) -> Iterator[pa.RecordBatch]:
    """All rows of a task in runs of about ``limit`` bytes of text, one row at least."""
    held, size = [], 0

    def whole() -> pa.RecordBatch:
        return pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for piece in (part for batch in batches if batch.num_rows for part in slices(batch, column, limit)):
        more = pc.sum(pc.binary_length(piece.column(column))).as_py() or 0
        if held and size + more > limit:
            yield whole()
            held, size = [], 0
        held.append(piece)
        size += more
    if held:
        yield whole()


def give_back() -> None:
    """Return memory that this Python worker has freed to the system.

    Workers outlive their tasks, several for each core of an executor, and what one keeps for itself is
    missing to the next.
    """
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc
    if trim:
        trim(0)


def lean(run: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``run`` for ``mapInArrow``, giving memory back when the task has ended."""

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return task


def squeezed(values: np.ndarray) -> bytes:
    """Numbers compressed byte by byte place, so that small ones and sorted ones take little."""
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T)
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def spread(data: bytes, length: int, kind) -> np.ndarray:
    """The ``length`` numbers of type ``kind`` that :func:`squeezed` took."""
    width = np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(data, length * width, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(width, length).T).view(kind).reshape(length)
