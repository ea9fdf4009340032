"""Artifacts against manifests, digests and stored sizes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.exprs import is_safe_path, object_key

# Problem kinds in the order in which they are tested, and the artifacts that
# each kind of bundle must list.
PROBLEM_KINDS = (
    "unsafe path",
    "missing",
    "symbolic link",
    "hash mismatch",
    "unreadable",
    "unexpected",
)
REQUIRED_ARTIFACTS = {
    "experiment": (),
    "dataset": ("metadata.json",),
    "model": ("checkpoint.pt", "report.json"),
    "acquisition": ("metadata.json", "source.hdf5"),
    "tensor_subset": ("metadata.json", "receipt", "source"),
}


def artifact_problems(manifest: DataFrame, actual: DataFrame) -> DataFrame:
    """Differences between listed and stored artifacts.

    ``manifest``: ``run_id, path, sha256``; ``actual``: ``run_id, path, sha256`` where a NULL
    digest is an unreadable file, and optionally ``is_link``. One full outer join on
    ``(run_id, path)``, which spreads even a run with very many artifacts.
    """
    m = manifest.select("run_id", "path", F.col("sha256").alias("expected"), F.lit(True).alias("_m"))
    link = F.col("is_link") if "is_link" in actual.columns else F.lit(False)
    a = actual.select(
        "run_id", "path", F.col("sha256").alias("found"), link.alias("_link"), F.lit(True).alias("_a")
    )
    problem = (
        F.when(F.col("_m").isNull(), "unexpected")
        .when(~is_safe_path("path"), "unsafe path")
        .when(F.col("_a").isNull(), "missing")
        .when(F.col("_link"), "symbolic link")
        .when(F.col("found").isNull(), "unreadable")
        .when(F.col("found") != F.col("expected"), "hash mismatch")
    )
    return (
        m.join(a, ["run_id", "path"], "full")
        .withColumn("problem", problem)
        .filter(F.col("problem").isNotNull())
        .select("run_id", "path", "problem")
    )


def manifest_problems(manifests: DataFrame) -> DataFrame:
    """Runs whose manifest itself is unusable: their only problem."""
    return manifests.filter(~F.col("valid")).select(
        "run_id", F.lit(None).cast("string").alias("path"), F.lit("invalid manifest").alias("problem")
    )


def required_missing(manifest: DataFrame, bundles: DataFrame) -> DataFrame:
    """Required artifacts that a bundle's manifest does not list.

    ``bundles``: ``run_id, kind``, one row per bundle.
    """
    required = F.lit(None).cast("array<string>")
    for kind, names in REQUIRED_ARTIFACTS.items():
        names_array = F.array(*map(F.lit, names)).cast("array<string>")
        required = F.when(F.col("kind") == kind, names_array).otherwise(required)
    wanted = bundles.select("run_id", "kind", F.explode(required).alias("path"))
    return wanted.join(manifest.select("run_id", "path"), ["run_id", "path"], "left_anti").select(
        "run_id", "path", F.lit("not listed").alias("problem")
    )


def unexpected_artifacts(manifest: DataFrame, actual: DataFrame) -> DataFrame:
    """Stored artifacts that no manifest lists."""
    return actual.select("run_id", "path").join(
        manifest.select("run_id", "path"), ["run_id", "path"], "left_anti"
    )


def problem_summary(runs: DataFrame, problems: DataFrame) -> DataFrame:
    """Valid flag and number of problems per kind for every run.

    The problems themselves stay rows of :func:`artifact_problems`; a run may have any number.
    """
    counts = problems.groupBy("run_id").agg(
        F.count("*").alias("problems"),
        *[
            F.count_if(F.col("problem") == kind).alias(kind.replace(" ", "_"))
            for kind in PROBLEM_KINDS
        ],
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    names = ["problems", *[k.replace(" ", "_") for k in PROBLEM_KINDS]]
    return (
        runs.select("run_id")
        .distinct()
        .join(counts, "run_id", "left")
        .select("run_id", *[zero(c) for c in names])
        .withColumn("valid", F.col("problems") == 0)
    )


def stored_sizes(artifacts: DataFrame, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    """Bytes and file counts; needs file metadata only."""
    return artifacts.groupBy(*keys).agg(
        F.sum("length").alias("stored_bytes"), F.count("*").alias("artifact_files")
    )


# -- value fingerprints -----------------------------------------------------------

# Frames per partial digest: a run of any length becomes short blocks of digests first.
FINGERPRINT_BLOCK = 1024


def frame_digests(frames: DataFrame, text: Column) -> DataFrame:
    """SHA-256 of every frame's values, computed where the frame is read."""
    return frames.select("run_id", "field", "frame", F.sha2(text, 256).alias("frame_sha256"))


def run_fingerprints(digests: DataFrame) -> DataFrame:
    """Ordered digest of all named arrays of a run, independent of file layout.

    Frames are digested first, then blocks of ``FINGERPRINT_BLOCK`` consecutive frames, then
    blocks of those: no list holds more than the block size, however long a run is.
    """
    level = digests.select(
        "run_id", "field", F.col("frame").cast("long").alias("at"), F.col("frame_sha256").alias("h")
    )

    def fold(df: DataFrame) -> DataFrame:
        block = F.floor(F.col("at") / FINGERPRINT_BLOCK).cast("long")
        ordered = F.array_sort(F.collect_list(F.struct("at", "h")))
        return (
            df.groupBy("run_id", "field", block.alias("block"))
            .agg(F.sha2(F.concat_ws("", F.transform(ordered, lambda s: s["h"])), 256).alias("h"))
            .withColumnRenamed("block", "at")
        )

    # Three levels cover 1024**3 frames of one field.
    for _ in range(3):
        level = fold(level)
    ordered = F.array_sort(F.collect_list(F.struct("field", "at", "h")))
    return level.groupBy("run_id").agg(
        F.sha2(
            F.concat_ws(
                "", F.transform(ordered, lambda s: F.concat(s["field"], F.lit(":"), s["h"]))
            ),
            256,
        ).alias("values_sha256")
    )


def chunk_of(position: Column, width: int = 64) -> Column:
    """Chunk number of a cell or frame position."""
    return F.floor(position / F.lit(width)).cast("long")


# -- mirror keys ------------------------------------------------------------------


def content_key(prefix: str, run_id: Column, manifest_sha256: Column, path: Column) -> Column:
    return object_key(prefix, F.lit("artifacts"), run_id, manifest_sha256, path)


def marker_key(prefix: str, run_id: Column) -> Column:
    return object_key(prefix, F.lit("experiments"), run_id, F.lit("manifest.json"))
