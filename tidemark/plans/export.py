"""Training datasets and acquisitions from end to end: select, group, split, fit, publish, verify."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.exprs import canonical
from tidemark.functions.skew import by_size
from tidemark.operators import datasets, integrity
from tidemark.session import settle
from tidemark.sources import files

MANIFEST_ROW = "path string, sha256 string"


def trajectory_keys(runs: DataFrame, frames: DataFrame) -> DataFrame:
    """Family key and initial-field digest of every run.

    The family is the kind of initial condition, with its seed only if it is random; never
    viscosity or grid. The initial field is hashed as float32.
    """
    first = frames.filter(F.col("frame") == 0).select(
        F.col("run_id").alias("id"),
        F.sha2(
            F.concat_ws(",", F.transform("values", lambda v: v.cast("float").cast("string"))), 256
        ).alias("initial_field_sha256"),
    )
    key = canonical(
        initial_condition="initial_condition",
        seed=F.when(F.col("initial_condition") == "random", F.col("seed")),
    )
    return runs.withColumn("family_key", key).join(first, "id")


def plan_dataset(runs: DataFrame, frames: DataFrame, seed: int) -> dict[str, DataFrame]:
    """All tables of a dataset export.

    ``runs``: the columns of :func:`tidemark.operators.datasets.eligibility` with
    ``initial_condition, seed``; ``frames``: ``run_id, frame, time, values``.
    ``rejected`` lists every run that was left out and why; callers that want all or nothing
    check that it is empty.
    """
    tagged = datasets.eligibility(runs).withColumn(
        "contract_sha256", datasets.contract_digest(F.col("times"), F.col("x"), F.col("viscosity"))
    )
    eligible = settle(tagged.filter(F.col("reject_reason").isNull()).drop("reject_reason"))
    odd = datasets.contract_outliers(eligible).select(
        "id", F.lit("different time, grid or viscosity").alias("reject_reason")
    )
    cells = by_size(eligible.select(F.col("id").alias("run_id"), F.size("x").alias("_cells")))
    bad = datasets.payload_problems(frames.join(cells, "run_id"), F.col("_cells"))
    damaged = bad.groupBy(F.col("run_id").alias("id")).agg(F.min("problem").alias("reject_reason"))
    rejected = (
        tagged.filter(F.col("reject_reason").isNotNull())
        .select("id", "reject_reason")
        .unionByName(odd)
        .unionByName(damaged)
    )
    usable = eligible.join(odd.unionByName(damaged), "id", "left_anti")
    keyed = trajectory_keys(usable, frames)
    trajectories = settle(datasets.families_and_splits(keyed, seed))
    owners = by_size(trajectories.select(F.col("id").alias("run_id"), "split"))
    stored = frames.join(owners, "run_id").select(
        "run_id",
        "frame",
        "time",
        "split",
        F.col("values").cast("array<float>").alias("values"),
    )
    return {
        "trajectories": trajectories,
        "frames": stored,
        "normalization": datasets.training_normalization(stored),
        "audit": datasets.split_audit(trajectories),
        "rejected": rejected,
    }


def dataset_metadata(tables: dict[str, DataFrame], seed: int) -> DataFrame:
    """The one-row description of a dataset."""
    audit = tables["audit"].select(
        F.struct("families", "trajectories", *[f"{s}_trajectories" for s in datasets.SPLITS])
    )
    return tables["normalization"].select(
        F.lit(1).alias("schema_version"),
        F.lit("burgers1d").alias("equation"),
        F.lit("periodic").alias("boundary"),
        F.lit("float32").alias("dtype"),
        F.lit("raw_physical").alias("stored_values"),
        F.lit(seed).alias("split_seed"),
        F.struct("mean", "std", "fit_split", "count", "constant_training_data").alias(
            "normalization"
        ),
        audit.scalar().alias("splits"),
    )


def write_dataset(tables: dict[str, DataFrame], seed: int, path: str) -> None:
    """Publish a dataset: fields by split, trajectories, metadata, and the manifest last.

    Refuses to replace anything. A dataset without a manifest is not there for readers.
    """
    spark = tables["frames"].sparkSession
    (
        tables["frames"]
        .repartitionByRange("split", "run_id", "frame")
        .sortWithinPartitions("run_id", "frame")
        .write.mode("errorifexists")
        .partitionBy("split")
        .parquet(f"{path}/frames")
    )
    tables["trajectories"].write.mode("errorifexists").parquet(f"{path}/trajectories")
    dataset_metadata(tables, seed).write.mode("errorifexists").json(f"{path}/metadata.json")
    write_manifest(spark, path)


def bundle_files(spark: SparkSession, path: str) -> DataFrame:
    """Digest of every data file of a bundle; bytes are read and hashed in chunks where they are."""
    root = path.rstrip("/").rsplit("/", 1)[-1]
    inner = F.substring_index("path", f"/{root}/", -1)
    named = files.list_files(spark, path).withColumn("_inner", inner)
    named = named.filter(~F.col("_inner").startswith("manifest/") & ~F.col("_inner").rlike(r"(^|/)[_.]"))
    return files.file_digests(named).select(F.col("_inner").alias("path"), "sha256")


def write_manifest(spark: SparkSession, path: str) -> None:
    bundle_files(spark, path).write.mode("errorifexists").parquet(f"{path}/manifest")


# Samples that an acquisition takes unless told otherwise.
MAX_SAMPLES = 64

# Bundles that hold their required artifacts and nothing else.
EXACT_KINDS = ("acquisition", "tensor_subset")


def verify_bundle(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Problems of a published dataset, model or acquisition; no rows means it is intact.

    Every listed file is hashed again, unlisted files are reported, and the artifacts that
    this kind of bundle must have have to be listed, as a file or as a folder of parts.
    """
    name = F.lit(path.rstrip("/").rsplit("/", 1)[-1]).alias("run_id")
    manifest = spark.read.schema(MANIFEST_ROW).parquet(f"{path}/manifest").select(name, "*")
    problems = integrity.artifact_problems(manifest, bundle_files(spark, path).select(name, "*"))
    # a required artifact may be stored as a folder of part files
    tops = manifest.select("run_id", F.explode(_prefixes()).alias("path")).distinct()
    bundle = spark.range(1).select(name, F.lit(kind).alias("kind"))
    problems = problems.unionByName(integrity.required_missing(tops, bundle))
    if kind not in EXACT_KINDS:
        return problems
    # Nothing but the required artifacts, or parts of them, may be listed.
    required = integrity.REQUIRED_ARTIFACTS[kind]
    own = F.lit(False)
    for artifact in required:
        own = own | (F.col("path") == artifact) | F.col("path").startswith(f"{artifact}/")
    extra = manifest.filter(~own).select("run_id", "path", F.lit("not allowed").alias("problem"))
    return problems.unionByName(extra)


def _prefixes():
    parts = F.split("path", "/")
    return F.transform(
        F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/")
    )


def acquire_tensor(
    frames: DataFrame,
    *,
    samples: int,
    sample_seed: int,
    time_stop: int,
    provenance: dict[str, str],
    max_samples: int = MAX_SAMPLES,
) -> DataFrame:
    """A seeded subset of an external tensor with its origin on every row.

    Rows are drawn without looking at their values; the time prefix keeps whole frames.
    """
    if not 3 <= samples <= max_samples or time_stop < 2:
        raise ValueError(f"samples must be in [3, {max_samples}] and time_stop at least 2")
    rows = datasets.seeded_sample(frames.select("sample").distinct(), "sample", samples, sample_seed)
    place = F.row_number().over(Window.orderBy("sample"))  # over ``samples`` rows
    drawn = by_size(rows.withColumn("ordinal", (place - 1).cast("long")))
    chosen = datasets.select_tensor(frames, time_stop=time_stop).drop("ordinal").join(drawn, "sample")
    return chosen.withColumns({k: F.lit(v) for k, v in sorted(provenance.items())})
