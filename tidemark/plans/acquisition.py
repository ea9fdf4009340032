"""Subsets of external tensors: drawn, published with a receipt, and verified against it.

A tensor of ``(samples, times, cells)`` is stored row by row; the time prefix of one sample is one
byte range of it. The receipt has a row for every range that was asked for, with its bounds, the
bytes that came and a digest of their values, so that data, receipt and metadata prove each other.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.skew import by_size
from tidemark.operators import datasets
from tidemark.plans import export
from tidemark.session import settle

KIND = "tensor_subset"
SCHEMA_VERSION = 1
VALUE_BYTES = 4
# Limits of one acquisition unless told otherwise.
MAX_SAMPLES = 64
MAX_BYTES = 64 << 20

SOURCE = "sample long, frame int, ordinal long, values array<float>"
RECEIPT = (
    "request long, sample long, range_start long, range_end long, received_bytes long, frames long, sha256 string"
)
METADATA = (
    "schema_version long, kind string, source map<string,string>, tensor_shape array<long>, sample_seed long, "
    "samples long, time_stop long, transfer struct<requests: long, received_bytes: long>, source_sha256 string"
)


def draw_samples(frames: DataFrame, samples: int, seed: int) -> DataFrame:
    """``(sample, ordinal)``: rows drawn without looking at their values, numbered by sample."""
    drawn = datasets.seeded_sample(frames.select("sample").distinct(), "sample", samples, seed)
    place = F.row_number().over(Window.orderBy("sample"))  # over ``samples`` rows
    return drawn.select(F.col("sample").cast("long").alias("sample"), (place - 1).cast("long").alias("ordinal"))


def select_ranges(frames: DataFrame, drawn: DataFrame, time_stop: int) -> DataFrame:
    """The time prefix of every drawn sample; the prefix is a filter of the scan."""
    prefix = frames.filter(F.col("frame") < time_stop)
    typed = prefix.select(
        F.col("sample").cast("long").alias("sample"),
        F.col("frame").cast("int").alias("frame"),
        F.col("values").cast("array<float>").alias("values"),
    )
    return typed.join(by_size(drawn), "sample").select("sample", "frame", "ordinal", "values")


def range_receipts(source: DataFrame, shape: Sequence[int], time_stop: int) -> DataFrame:
    """One receipt per sample of ``source``, recomputed from its values.

    Values are hashed frame by frame where they are read; only digests are grouped.
    """
    _, times, cells = shape
    values = F.concat_ws(",", F.transform("values", lambda v: v.cast("string")))
    narrow = source.select("ordinal", "sample", "frame", F.size("values").alias("n"), F.sha2(values, 256).alias("h"))
    ordered = F.array_sort(F.collect_list(F.struct("frame", "h")))  # ``time_stop`` digests
    sizes = narrow.groupBy("ordinal", "sample").agg(
        (F.sum("n") * VALUE_BYTES).cast("long").alias("received_bytes"),
        F.count("*").alias("frames"),
        F.sha2(F.array_join(F.transform(ordered, lambda x: x["h"]), ""), 256).alias("sha256"),
    )
    start = F.col("sample") * F.lit(times * cells * VALUE_BYTES)
    return sizes.select(
        F.col("ordinal").alias("request"),
        "sample",
        start.alias("range_start"),
        (start + F.lit(time_stop * cells * VALUE_BYTES - 1)).alias("range_end"),
        "received_bytes",
        "frames",
        "sha256",
    )


def _whole_digest() -> Column:
    """Digest over the receipts in the order of their requests, one entry for each sample."""
    ordered = F.array_sort(F.collect_list(F.struct("request", "sha256")))
    return F.sha2(F.array_join(F.transform(ordered, lambda r: r["sha256"]), ""), 256)


def subset_tables(
    frames: DataFrame,
    *,
    shape: Sequence[int],
    samples: int,
    sample_seed: int,
    time_stop: int,
    origin: Mapping[str, str],
    max_samples: int = MAX_SAMPLES,
    max_bytes: int = MAX_BYTES,
) -> dict[str, DataFrame]:
    """``source``, ``receipt`` and ``metadata`` of a seeded subset of ``sample, frame, values``.

    ``shape`` is what the whole tensor must have. A subset beyond ``max_bytes`` is refused before
    any value is read. Samples with frames or cells missing are refused when the receipt is checked.
    """
    count, times, cells = shape
    if not 3 <= samples <= min(max_samples, count) or not 2 <= time_stop <= times:
        raise ValueError(f"samples must be in [3, {min(max_samples, count)}] and time_stop in [2, {times}]")
    if (size := samples * time_stop * cells * VALUE_BYTES) > max_bytes:
        raise ValueError(f"The subset has {size} bytes, more than {max_bytes}")
    source = settle(select_ranges(frames, settle(draw_samples(frames, samples, sample_seed)), time_stop))
    receipt = settle(range_receipts(source, shape, time_stop))
    metadata = receipt.agg(
        F.lit(SCHEMA_VERSION).cast("long").alias("schema_version"),
        F.lit(KIND).alias("kind"),
        F.create_map(*[F.lit(x) for pair in sorted(origin.items()) for x in pair]).alias("source"),
        F.array(*[F.lit(n).cast("long") for n in shape]).alias("tensor_shape"),
        F.lit(sample_seed).cast("long").alias("sample_seed"),
        F.lit(samples).cast("long").alias("samples"),
        F.lit(time_stop).cast("long").alias("time_stop"),
        F.struct(F.count("*").alias("requests"), F.sum("received_bytes").alias("received_bytes")).alias("transfer"),
        _whole_digest().alias("source_sha256"),
    )
    return {"source": source, "receipt": receipt, "metadata": metadata}


def write_subset(tables: Mapping[str, DataFrame], path: str) -> None:
    """Publish a subset: values, receipt, metadata, and the manifest last.

    Refuses to replace anything; a subset without a manifest is not there for readers.
    """
    ordered = tables["source"].repartitionByRange("sample", "frame").sortWithinPartitions("sample", "frame")
    ordered.write.mode("errorifexists").parquet(f"{path}/source")
    tables["receipt"].write.mode("errorifexists").parquet(f"{path}/receipt")
    tables["metadata"].write.mode("errorifexists").json(f"{path}/metadata.json")
    export.write_manifest(tables["source"].sparkSession, path)


def _metadata_problems(spark: SparkSession, path: str, found: DataFrame) -> DataFrame:
    """What the metadata says otherwise than the recomputed receipts ``found``."""
    told = spark.read.schema(METADATA).json(f"{path}/metadata.json")
    real = found.agg(
        F.count("*").alias("requests"), F.sum("received_bytes").alias("bytes"), _whole_digest().alias("sha256")
    ).first()
    differs = lambda name, value: ~F.col(name).eqNullSafe(F.lit(real[value]))
    _, times, cells = (F.col("tensor_shape")[i] for i in range(3))
    expected = F.col("samples") * F.col("time_stop") * cells * VALUE_BYTES
    checks = (
        (~F.col("kind").eqNullSafe(F.lit(KIND)), "kind"),
        (~F.col("schema_version").eqNullSafe(F.lit(SCHEMA_VERSION)), "schema version"),
        (differs("source_sha256", "sha256"), "source digest"),
        (differs("transfer.requests", "requests") | differs("transfer.received_bytes", "bytes"), "transfer"),
        (~F.coalesce((F.col("time_stop") <= times) & (F.lit(real["bytes"]) == expected), F.lit(False)), "selection"),
    )
    problems = F.array_compact(F.array(*[F.when(bad, F.lit(name)) for bad, name in checks]))
    return told.select(F.lit("metadata.json").alias("path"), F.explode(problems).alias("problem"))


def verify_subset(spark: SparkSession, path: str) -> DataFrame:
    """``(path, problem)`` of a published subset; no rows means it is intact.

    Files are checked against the manifest, the receipt against ranges recomputed from the values,
    and kind, schema version, totals and source digest of the metadata against both.
    """
    files = export.verify_bundle(spark, path, KIND).select("path", "problem")
    source = spark.read.schema(SOURCE).parquet(f"{path}/source")
    told = spark.read.schema(METADATA).json(f"{path}/metadata.json").first()
    if told is None or not told["tensor_shape"] or len(told["tensor_shape"]) != 3 or not told["time_stop"]:
        damaged = spark.range(1).select(F.lit("metadata.json").alias("path"), F.lit("unreadable").alias("problem"))
        return files.unionByName(damaged)
    found = settle(range_receipts(source, told["tensor_shape"], told["time_stop"]))
    kept = spark.read.schema(RECEIPT).parquet(f"{path}/receipt")
    names = found.columns[1:]
    both = kept.select("request", F.struct(*names).alias("kept")).join(
        found.select("request", F.struct(*names).alias("found")), "request", "full"
    )
    differs = lambda *of: F.coalesce(
        *[F.when(~F.col(f"kept.{c}").eqNullSafe(F.col(f"found.{c}")), F.lit(True)) for c in of], F.lit(False)
    )
    problem = (
        F.when(F.col("kept").isNull(), "missing range")
        .when(F.col("found").isNull(), "range without data")
        .when(differs("sample", "range_start", "range_end"), "range differs")
        .when(differs("received_bytes", "frames"), "bytes differ")
        .when(differs("sha256"), "digest differs")
    )
    ranges = both.select(F.concat(F.lit("receipt/"), "request").alias("path"), problem.alias("problem")).filter(
        F.col("problem").isNotNull()
    )
    return files.unionByName(ranges).unionByName(_metadata_problems(spark, path, found))
