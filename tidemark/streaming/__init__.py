"""Structured Streaming: sources, idempotent sinks and stateful operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.session import checkpoint_dir

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_table(spark: SparkSession, sf_dir: str, name: str, files_per_trigger: int | None = None) -> DataFrame:
    """A Parquet table, a file or a folder of files, as a file stream; new files are picked up as they appear."""
    path = f"{sf_dir}/{name}.parquet"
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where).isDirectory():
        return reader.parquet(path)
    # Spark follows folders only: of the one the file is in, the file alone passes
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the shared checkpoint folder."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def state_settings(spark: SparkSession, partitions: int | None = None):
    """State store settings while a stateful query starts.

    The number of state partitions is fixed by the first batch for the life of the stream:
    ``partitions``, or the session's shuffle partitions. It does not follow the cores that
    happen to be there at the start.
    """
    names = ("spark.sql.streaming.stateStore.providerClass", "spark.sql.shuffle.partitions")
    before = {n: spark.conf.get(n, None) for n in names}
    spark.conf.set(names[0], ROCKSDB)
    if partitions is not None:
        spark.conf.set(names[1], str(partitions))
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def write_batches(
    stream: DataFrame,
    path: str,
    checkpoint: str,
    *,
    mode: str = "append",
    prepare: Callable[[DataFrame, int], DataFrame] | None = None,
    partitions: int | None = None,
) -> StreamingQuery:
    """Write every micro-batch to its own ``batch_id`` folder.

    A batch that is replayed after a failure overwrites its own folder and nothing else, so
    the table holds each batch once.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = prepare(batch, batch_id) if prepare else batch
        rows.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    with state_settings(stream.sparkSession, partitions):
        return (
            stream.writeStream.foreachBatch(write)
            .outputMode(mode)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )


def drain(query: StreamingQuery) -> None:
    """Wait until everything available is processed; a failed query raises."""
    query.awaitTermination()


def run_to_table(stream: DataFrame, name: str, *, mode: str = "append", prepare=None) -> DataFrame:
    """Process what is available now and return the written table."""
    spark = stream.sparkSession
    base = scratch(spark, name)
    drain(write_batches(stream, f"{base}/table", f"{base}/checkpoint", mode=mode, prepare=prepare))
    return read_batches(spark, f"{base}/table")


def read_batches(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def latest(table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The newest version of every key of an update-mode table."""
    values = [c for c in table.columns if c not in (*keys, "batch_id")]
    newest = F.max_by(F.struct(*values), "batch_id")
    return table.groupBy(*keys).agg(newest.alias("_r")).select(*keys, "_r.*")


# -- compacted update tables ------------------------------------------------------

# Batches written after a snapshot before another one is due.
COMPACT_EVERY = 16


def _numbers(spark: SparkSession, path: str, name: str) -> list[int]:
    """Numbers ``n`` of the complete folders ``name=n`` below ``path``, ascending."""
    jvm = spark._jvm
    pattern = jvm.org.apache.hadoop.fs.Path(f"{path}/{name}=*/_SUCCESS")
    found = pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern) or []
    return sorted(int(f.getPath().getParent().getName().split("=")[1]) for f in found)


def _since(spark: SparkSession, path: str) -> tuple[DataFrame | None, int | None, list[int]]:
    """The newest snapshot, its last batch, and the batches after it."""
    snapshots = _numbers(spark, f"{path}_snapshots", "upto")
    upto = snapshots[-1] if snapshots else None
    batches = [b for b in _numbers(spark, path, "batch_id") if upto is None or b > upto]
    snapshot = None if upto is None else spark.read.parquet(f"{path}_snapshots/upto={upto}")
    return snapshot, upto, batches


def latest_table(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """The newest version of every key of an update-mode table at ``path``.

    Reads the newest snapshot of :func:`compact` and the batches after it, not the whole history.
    """
    snapshot, _, batches = _since(spark, path)
    rows = snapshot
    if batches:
        folders = [f"{path}/batch_id={b}" for b in batches]
        newer = spark.read.option("basePath", path).parquet(*folders)
        newer = newer.withColumn("batch_id", F.col("batch_id").cast("long"))
        rows = newer if rows is None else rows.unionByName(newer)
    if rows is None:
        raise FileNotFoundError(f"No batch was written to {path}")
    return latest(rows, keys)


def compact(spark: SparkSession, path: str, keys: Sequence[str], *, after: int = COMPACT_EVERY) -> bool:
    """Write a snapshot of the newest versions once ``after`` batches follow the last one.

    A snapshot is its own folder, named after the last batch in it, and counts from the moment it
    is complete; batches and earlier snapshots stay for readers that started before. An attempt
    that was interrupted is repeated under the same name.
    """
    _, _, batches = _since(spark, path)
    if len(batches) < after:
        return False
    newest = latest_table(spark, path, keys).withColumn("batch_id", F.lit(batches[-1]).cast("long"))
    newest.write.mode("overwrite").parquet(f"{path}_snapshots/upto={batches[-1]}")
    return True


def for_each_batch(stream: DataFrame, callback: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Call ``callback(rows, batch_id)`` for every micro-batch of saved frames."""
    with state_settings(stream.sparkSession):
        return (
            stream.writeStream.foreachBatch(callback)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )
