"""Mirroring verified runs to an object store and back.

Plans are joins of local and remote object listings. Copies run in tasks through a store
object; a run's marker is written only after all of its artifacts are in place, and readers
treat the marker as the only sign that a run is complete.
"""

from __future__ import annotations

import hashlib
import os
import uuid
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.integrity import content_key, marker_key
from tidemark.sources.files import filesystem

ACTIONS = ("upload", "reuse", "conflict", "extra")


class ObjectStore(Protocol):
    """What a mirror needs from a store. Instances are created inside tasks."""

    def read_optional(self, key: str) -> bytes | None: ...

    def put_immutable(self, key: str, data: bytes) -> bool:
        """Create the object; False if identical bytes exist; raise if others do."""
        ...


class FolderStore:
    """Objects as files below ``root``, a path or URI that all executors can reach.

    Local folders, which have to be shared mounts on a cluster, get exclusive creation from hard
    links. Other file systems are written under a temporary name, moved, and read again.
    """

    def __init__(self, root: str):
        self.store, self.root = filesystem(root)

    def _path(self, key: str) -> str:
        return "/".join([self.root.rstrip("/"), *key.split("/")])

    def read_optional(self, key: str) -> bytes | None:
        try:
            with self.store.open_input_stream(self._path(key), compression=None) as source:
                return source.read()
        except FileNotFoundError:
            return None

    def put_immutable(self, key: str, data: bytes) -> bool:
        path = self._path(key)
        found = self.read_optional(key)
        if found is None:
            self.store.create_dir(path.rpartition("/")[0], recursive=True)
            staged = f"{path}.{uuid.uuid4().hex}"
            with self.store.open_output_stream(staged, compression=None) as target:
                target.write(data)
            if self._take(staged, path):
                return True
            found = self.read_optional(key)
        if found != data:
            raise FileExistsError(f"Object has different bytes: {key}")
        return False

    def _take(self, staged: str, path: str) -> bool:
        """Give the staged file its name; False if another one has it now."""
        if self.store.type_name != "local":
            self.store.move(staged, path)
            return False
        try:
            os.link(staged, path)  # fails if the object exists
            return True
        except FileExistsError:
            return False
        finally:
            os.unlink(staged)


Factory = Callable[[], ObjectStore]
RESULT = "run_id string, path string, key string, outcome string"


def with_keys(manifest: DataFrame, prefix: str) -> DataFrame:
    """Object keys of manifest rows ``run_id, path, sha256, manifest_sha256``."""
    run: Column = F.col("run_id").cast("string")
    return manifest.withColumns(
        {
            "key": content_key(prefix, run, F.col("manifest_sha256"), F.col("path")),
            "marker": marker_key(prefix, run),
        }
    )


def mirror_plan(local: DataFrame, remote: DataFrame) -> DataFrame:
    """``upload``, ``reuse``, ``conflict`` or ``extra`` per object key.

    Both sides have ``key, sha256``; one full outer join.
    """
    here = local.select("key", F.col("sha256").alias("_local"))
    there = remote.select("key", F.col("sha256").alias("_remote"))
    return here.join(there, "key", "full").select(
        "key",
        F.when(F.col("_local").isNull(), "extra")
        .when(F.col("_remote").isNull(), "upload")
        .when(F.col("_local") == F.col("_remote"), "reuse")
        .otherwise("conflict")
        .alias("action"),
    )


def ready_runs(planned: DataFrame) -> DataFrame:
    """Runs without a conflicting object: ``run_id, key, action``."""
    blocked = planned.filter(F.col("action") == "conflict").select("run_id").distinct()
    return planned.join(blocked, "run_id", "left_anti")


def copy_objects(work: DataFrame, source: Factory, target: Factory) -> DataFrame:
    """Copy ``source_key`` to ``key`` for every row of ``run_id, path, source_key, key, sha256``.

    Bytes go from store to store inside the task and are hashed on the way; they never pass
    through the shuffle or the driver. Repeating a copy is harmless.
    """

    def copy(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader, writer = source(), target()
        for pdf in batches:
            outcomes = []
            for source_key, key, digest in zip(pdf["source_key"], pdf["key"], pdf["sha256"]):
                data = reader.read_optional(source_key)
                if data is None:
                    outcomes.append("missing")
                elif hashlib.sha256(data).hexdigest() != digest:
                    outcomes.append("hash mismatch")
                else:
                    try:
                        outcomes.append("uploaded" if writer.put_immutable(key, data) else "reused")
                    except FileExistsError:
                        outcomes.append("conflict")
            yield pd.DataFrame(
                {
                    "run_id": pdf["run_id"].astype(str),
                    "path": pdf["path"],
                    "key": pdf["key"],
                    "outcome": outcomes,
                }
            )

    columns = [F.col("run_id").cast("string").alias("run_id"), "path", "source_key", "key", "sha256"]
    return work.select(*columns).mapInPandas(copy, RESULT)


def complete_runs(results: DataFrame) -> DataFrame:
    """Runs all of whose objects were uploaded or reused, with the counts."""
    good = F.col("outcome").isin("uploaded", "reused")
    return (
        results.groupBy("run_id")
        .agg(
            F.count_if(F.col("outcome") == "uploaded").alias("uploaded_objects"),
            F.count_if(F.col("outcome") == "reused").alias("reused_objects"),
            F.count_if(~good).alias("failed_objects"),
        )
        .filter(F.col("failed_objects") == 0)
        .drop("failed_objects")
    )


def write_markers(markers: DataFrame, target: Factory) -> DataFrame:
    """Write ``marker`` objects with the manifest text of complete runs, last of all.

    ``resumed`` says that the marker was there already; a marker with other bytes is refused.
    """

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store = target()
        for pdf in batches:
            outcomes = []
            for key, text in zip(pdf["marker"], pdf["manifest"]):
                try:
                    new = store.put_immutable(key, text.encode("utf-8"))
                    outcomes.append("committed" if new else "resumed")
                except FileExistsError:
                    outcomes.append("different manifest")
            yield pd.DataFrame({"run_id": pdf["run_id"].astype(str), "outcome": outcomes})

    columns = [F.col("run_id").cast("string").alias("run_id"), "marker", "manifest"]
    return markers.select(*columns).mapInPandas(write, "run_id string, outcome string")


def restorable(remote_markers: DataFrame, local: DataFrame, local_problems: DataFrame) -> DataFrame:
    """What a restore may do per run that has a committed marker.

    ``remote_markers`` and ``local``: ``run_id, manifest_sha256``. A local run that fails
    verification or has another manifest is refused; an equal one is already there.
    """
    have = local.select("run_id", F.col("manifest_sha256").alias("_local"))
    bad = local_problems.select("run_id").distinct().withColumn("_bad", F.lit(True))
    return (
        remote_markers.join(have, "run_id", "left")
        .join(bad, "run_id", "left")
        .select(
            "run_id",
            F.when(F.col("_local").isNull(), "download")
            .when(F.col("_bad"), "refuse: failed verification")
            .when(F.col("_local") != F.col("manifest_sha256"), "refuse: different manifest")
            .otherwise("resumed")
            .alias("action"),
        )
    )
