"""Leakage-safe training datasets: eligibility, families, splits, normalisation, imports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.exprs import (
    all_finite,
    all_float32,
    is_close,
    is_finite,
    is_uniform_coordinate,
    is_web_url,
    let,
    mean_of,
    reasons,
)
from tidemark.functions.ordered import with_dense_neighbors
from tidemark.functions.skew import lookup
from tidemark.operators.components import connected_components
from tidemark.session import settle

# Splits, the smallest number of families, the value budget of an import.
SPLITS = ("train", "validation", "test")
MIN_FAMILIES = 3
MAX_IMPORT_VALUES = 16_000_000

# Buckets of the two-pass rank over hashed keys; hashes fill them evenly.
RANK_BUCKETS = 4096


# -- eligibility ------------------------------------------------------------------


def eligibility(runs: DataFrame) -> DataFrame:
    """Why a run cannot be exported; NULL when it can.

    ``runs``: ``id, status, equation, needs_review, boundary, domain_length, viscosity,
    times, x, frames, problems`` with coordinates as arrays.
    """
    x = F.col("x")
    spacing = F.get(x, F.lit(1)) - F.get(x, F.lit(0))
    first_failed = F.coalesce(
        F.when(F.coalesce(F.col("problems"), F.lit(0)) > 0, "failed verification"),
        F.when(
            ~((F.col("status") == "completed") & (F.col("equation") == "burgers1d")),
            "not a completed burgers1d run",
        ),
        F.when(F.coalesce(F.col("needs_review"), F.lit(False)), "needs review"),
        F.when(~F.col("boundary").eqNullSafe(F.lit("periodic")), "not periodic"),
        F.when(~is_uniform_coordinate("times", 2), "bad time coordinate"),
        F.when(~is_uniform_coordinate("x", 4), "bad x coordinate"),
        F.when(~(is_finite("viscosity") & (F.col("viscosity") >= 0)), "bad viscosity"),
        F.when(
            ~is_close(spacing * F.size(x), F.col("domain_length"), 1e-9, 1e-12),
            "repeated endpoint",
        ),
        F.when(F.col("frames") != F.size("times"), "frames do not match times"),
    )
    return runs.withColumn("reject_reason", first_failed)


def contract_digest(times: Column, x: Column, viscosity: Column) -> Column:
    text = lambda a: F.concat_ws(",", F.transform(a, lambda v: v.cast("string")))
    return F.sha2(F.concat_ws("|", text(times), text(x), viscosity.cast("string")), 256)


def contract_outliers(runs: DataFrame, digest: str = "contract_sha256") -> DataFrame:
    """Runs whose time, grid or viscosity differs from the most common contract."""
    counts = runs.groupBy(digest).agg(F.count("*").alias("n"))
    # Ties go to the larger digest.
    mode = counts.agg(F.max_by(digest, F.struct("n", F.col(digest))))
    return runs.filter(F.col(digest) != mode.scalar())


def coordinate_problems(coords: DataFrame, minimum: dict[str, int]) -> DataFrame:
    """Axes that are not finite, increasing and evenly spaced with enough entries.

    ``coords``: ``run_id, axis, idx, value`` with ``idx`` 0..n-1.
    """
    steps = with_dense_neighbors(
        coords, ["run_id", "axis"], "idx", prev={"_before": "value"}
    ).withColumn("_step", F.col("value") - F.col("_before"))
    checked = steps.groupBy("run_id", "axis").agg(
        F.count("*").alias("entries"),
        F.bool_and(is_finite("value")).alias("finite"),
        F.min("_step").alias("least"),
        F.max("_step").alias("most"),
        F.min_by("_step", F.when(F.col("_step").isNotNull(), F.col("idx"))).alias("first_step"),
    )
    need = F.lit(2)
    for axis, n in minimum.items():
        need = F.when(F.col("axis") == axis, n).otherwise(need)
    even = is_close("least", "first_step", 1e-4, 1e-10) & is_close(
        "most", "first_step", 1e-4, 1e-10
    )
    return checked.select(
        "run_id",
        "axis",
        F.when(F.col("entries") < need, "too short")
        .when(~F.col("finite"), "not finite")
        .when(F.col("least") <= 0, "not increasing")
        .when(~even, "not uniform")
        .alias("problem"),
    ).filter(F.col("problem").isNotNull())


def payload_problems(frames: DataFrame, cells: Column) -> DataFrame:
    """Frames with a wrong size, non-finite values or values outside float32."""
    return frames.select(
        "run_id",
        "frame",
        F.when(F.size("values") != cells, "incompatible shape")
        .when(~all_finite("values"), "non-finite values")
        .when(~all_float32("values"), "not representable as float32")
        .alias("problem"),
    ).filter(F.col("problem").isNotNull())


def provenance_problems(imports: DataFrame) -> DataFrame:
    """Adds ``reasons`` for a missing URL, version or license."""
    present = lambda c: F.length(F.trim(c)) > 0
    return imports.withColumn(
        "reasons",
        reasons(
            (is_web_url("source_url"), "source_url"),
            (present("source_version"), "source_version"),
            (present("license_name"), "license_name"),
        ),
    )


# -- families and splits ----------------------------------------------------------


def family_table(trajectories: DataFrame) -> DataFrame:
    """``(family_key, family_id)`` for trajectories linked by a family key or initial field.

    The links are contracted to the family keys first: an initial field seen under several
    keys joins those keys. Components are then found on keys, never on trajectories.
    ``family_id`` is a digest of the component's set of family keys, built from mergeable
    aggregates so that a component of any size needs no list.
    """
    pairs = settle(trajectories.select("family_key", "initial_field_sha256").distinct())
    by_field = pairs.groupBy("initial_field_sha256").agg(
        F.min("family_key").alias("v"), F.max("family_key").alias("_top")
    )
    shared = by_field.filter(F.col("v") != F.col("_top")).drop("_top")
    edges = lookup(pairs, shared, ["initial_field_sha256"], how="inner").select(
        F.col("family_key").alias("u"), "v"
    )
    linked = connected_components(edges).withColumnRenamed("node", "family_key")
    keys = (
        pairs.select("family_key")
        .distinct()
        .join(linked, "family_key", "left")
        .withColumn("root", F.coalesce("root", "family_key"))
    )
    digest = F.sha2("family_key", 256)
    piece = lambda i: F.conv(F.substring(digest, 1 + 15 * i, 15), 16, 10).cast("long")
    sets = keys.groupBy("root").agg(
        F.count("*").alias("n"), *[F.bit_xor(piece(i)).alias(f"x{i}") for i in range(4)]
    )
    named = sets.select(
        "root", F.sha2(F.concat_ws(":", "n", "x0", "x1", "x2", "x3"), 256).alias("family_id")
    )
    return settle(lookup(keys, named, ["root"]).select("family_key", "family_id"))


def families(trajectories: DataFrame) -> DataFrame:
    """Adds ``family_id`` to every trajectory."""
    return lookup(trajectories, family_table(trajectories), ["family_key"])


def hashed_rank(df: DataFrame, key: str, name: str = "rank") -> DataFrame:
    """1-based rank by a SHA-256 hex column over the whole table, without one partition.

    Hashes are uniform, so their first three digits make ``RANK_BUCKETS`` equal buckets:
    rank inside the bucket plus the rows of all smaller buckets.
    """
    placed = df.withColumn("_bucket", F.substring(key, 1, 3))
    counts = placed.groupBy("_bucket").agg(F.count("*").alias("n"))
    # Never more than RANK_BUCKETS entries in this one row.
    offsets = counts.agg(F.array_sort(F.collect_list(F.struct("_bucket", "n"))).alias("b")).select(
        F.explode(
            F.transform(
                "b",
                lambda s, i: F.struct(
                    s["_bucket"].alias("_bucket"),
                    F.aggregate(
                        F.slice(F.col("b"), 1, i), F.lit(0).cast("long"), lambda a, x: a + x["n"]
                    ).alias("_before"),
                ),
            )
        ).alias("o")
    ).select("o.*")
    inner = Window.partitionBy("_bucket").orderBy(key)
    return (
        placed.join(F.broadcast(offsets), "_bucket")
        .withColumn(name, F.col("_before") + F.row_number().over(inner))
        .drop("_bucket", "_before")
    )


def split_families(family_ids: DataFrame, seed: int) -> DataFrame:
    """``(family_id, split)``: a fifth each for validation and test, the rest for training.

    Families are ordered by ``sha256(seed:family_id)``. With fewer than three families every
    split is NULL, which :func:`split_audit` reports.
    """
    if type(seed) is not int or seed < 0:
        raise ValueError(f"Cannot order families by seed {seed!r}: it has to be a whole number from 0")
    distinct = family_ids.select("family_id").distinct()
    keyed = distinct.withColumn("_key", F.sha2(F.concat_ws(":", F.lit(seed), "family_id"), 256))
    ranked = hashed_rank(keyed, "_key", "_rank")
    size = distinct.agg(F.count("*")).scalar()
    holdout = F.greatest(F.lit(1), F.expr("_families div 5"))
    return (
        ranked.withColumn("_families", size)
        .withColumn(
            "split",
            F.when(F.col("_families") < MIN_FAMILIES, F.lit(None).cast("string"))
            .when(F.col("_rank") <= holdout, "validation")
            .when(F.col("_rank") <= 2 * holdout, "test")
            .otherwise("train"),
        )
        .select("family_id", "split")
    )


def assign_splits(trajectories: DataFrame, splits: DataFrame) -> DataFrame:
    """Gives every trajectory the split of its family."""
    return lookup(trajectories, splits, ["family_id"])


def families_and_splits(trajectories: DataFrame, seed: int) -> DataFrame:
    """Family and split of every trajectory: both are settled on keys and joined once."""
    table = family_table(trajectories)
    placed = lookup(table, split_families(table, seed), ["family_id"])
    return lookup(trajectories, placed, ["family_key"])


def split_audit(assigned: DataFrame) -> DataFrame:
    """Counts per split and the number of families that appear in two splits."""
    per_family = assigned.groupBy("family_id").agg(
        F.min("split").alias("a"),
        F.max("split").alias("b"),
        F.count("*").alias("n"),
        F.count_if(F.col("split").isNull()).alias("unassigned"),
        *[F.count_if(F.col("split") == s).alias(s) for s in SPLITS],
    )
    return per_family.agg(
        F.count("*").alias("families"),
        F.sum("n").alias("trajectories"),
        *[F.sum(s).alias(f"{s}_trajectories") for s in SPLITS],
        F.count_if(F.col("a") != F.col("b")).alias("leaking_families"),
        F.sum("unassigned").alias("unassigned"),
    ).withColumn(
        "passed",
        (F.col("leaking_families") == 0)
        & (F.col("unassigned") == 0)
        & (F.col("train_trajectories") > 0)
        & (F.col("validation_trajectories") > 0)
        & (F.col("test_trajectories") > 0),
    )


# -- normalisation ----------------------------------------------------------------


def training_normalization(frames: DataFrame) -> DataFrame:
    """Mean and population deviation of the training values, as one row.

    ``frames``: ``split, values``. Every frame contributes its own mean and centred square sum,
    so no cell is exploded; the spread of the means of equally long frames is merged by Spark's
    own moment aggregate, and the lengths, of which there are few, by their shares of all values.
    """
    v = F.col("_v")
    train = frames.filter(F.col("split") == "train").select(
        F.col("values").cast("array<float>").cast("array<double>").alias("_v")
    )
    centred = lambda m: F.aggregate(
        v, F.lit(0.0), lambda a, x: a + (x - m) * (x - m)
    )
    parts = train.select(
        F.size(v).alias("n"), mean_of(v).alias("m"), let(mean_of(v), centred).alias("m2")
    )
    lengths = parts.groupBy("n").agg(
        F.sum("n").alias("total"), F.avg("m").alias("mean"), F.sum("m2").alias("m2"), F.var_pop("m").alias("spread")
    )
    gathered = lengths.agg(
        F.sum("total").alias("count"),
        F.sum("m2").alias("_m2"),
        F.array_sort(F.collect_list(F.struct("n", "total", "mean", "spread"))).alias("_lengths"),
    )
    share = lambda g: g["total"] / F.col("count")
    summed = lambda term: F.aggregate("_lengths", F.lit(0.0), lambda a, g: a + share(g) * term(g))
    out = gathered.withColumn("mean", F.when(F.col("count") > 0, summed(lambda g: g["mean"]))).withColumn(
        "_std",
        F.sqrt(
            F.col("_m2") / F.col("count")
            + summed(lambda g: g["spread"] + F.pow(g["mean"] - F.col("mean"), 2))
        ),
    )
    return out.select(
        "count",
        "mean",
        F.when(F.col("_std") > 0, F.col("_std")).otherwise(1.0).alias("std"),
        (F.col("_std") == 0).alias("constant_training_data"),
        F.lit("train").alias("fit_split"),
    )


def normalization_audit(frames: DataFrame, stored: DataFrame) -> DataFrame:
    """Whether a stored normaliser equals the training statistics."""
    fresh = training_normalization(frames).select(
        F.struct(F.col("count").alias("n"), F.col("mean").alias("m"), F.col("std").alias("s"))
    )
    return stored.withColumn("_f", fresh.scalar()).select(
        "mean",
        "std",
        (
            (F.col("count") == F.col("_f.n"))
            & is_close("mean", "_f.m", 1e-6, 1e-8)
            & is_close("std", "_f.s", 1e-6, 1e-8)
        ).alias("passed"),
    )


def normalized_pairs(frames: DataFrame, normalization: DataFrame) -> DataFrame:
    """Consecutive saved frames of one trajectory, normalised: inputs and targets."""
    pairs = with_dense_neighbors(
        frames, ["run_id"], "frame", next={"target": "values"}
    ).filter(F.col("target").isNotNull())
    fit = normalization.select(F.struct("mean", "std")).scalar()
    norm = lambda a: F.transform(a, lambda v: (v - F.col("_f.mean")) / F.col("_f.std"))
    return pairs.withColumn("_f", fit).select(
        *[c for c in frames.columns if c != "values"],
        norm("values").alias("input"),
        norm("target").alias("target"),
    )


# -- imports ----------------------------------------------------------------------


def seeded_sample(df: DataFrame, key: str, count: int, seed: int) -> DataFrame:
    """``count`` rows without replacement, a function of seed and key alone."""
    order = F.sha2(F.concat_ws(":", F.lit(seed), F.col(key)), 256)
    return df.withColumn("_o", order).orderBy("_o", key).limit(count).drop("_o")


def ordinals(samples: Sequence[int]) -> Column:
    """Position of ``sample`` in a supplied list, NULL when it is not listed."""
    wanted = F.array(*[F.lit(int(s)) for s in samples])
    position = F.array_position(wanted, F.col("sample").cast("int"))
    return F.when(position > 0, position - 1)


def select_tensor(
    frames: DataFrame,
    *,
    samples: Sequence[int] | None = None,
    time_stop: int | None = None,
) -> DataFrame:
    """Rows of an external tensor in supplied order, cut to a time prefix.

    ``frames``: ``sample, frame, values``. Both conditions are plain filters on the stored
    columns, so they reach the scan before any array is read.
    """
    if samples is not None:
        if len(samples) < 3 or len(set(samples)) != len(samples):
            raise ValueError("samples must be at least three distinct rows")
    if time_stop is not None and time_stop < 2:
        raise ValueError("time_stop must be at least 2")
    out = frames
    if time_stop is not None:
        out = out.filter(F.col("frame") < time_stop)
    if samples is None:
        return out.withColumn("ordinal", F.col("sample").cast("long"))
    return out.filter(F.col("sample").isin([int(s) for s in samples])).withColumn(
        "ordinal", ordinals(samples).cast("long")
    )


def tensor_budget(selected: DataFrame, cells: int, max_values: int = MAX_IMPORT_VALUES) -> DataFrame:
    """Size of a selection and whether it fits, from narrow columns only."""
    if max_values < 1:
        raise ValueError("max_values must be positive")
    values = F.count("*") * F.lit(cells)
    return selected.agg(
        F.count_distinct("sample").alias("samples"),
        F.count("*").alias("frames"),
        values.alias("selected_values"),
        (values <= max_values).alias("fits"),
    )


def import_trajectories(selected: DataFrame, source_sha256: str) -> DataFrame:
    """One row per imported trajectory: its family is its initial field."""
    initial = F.sha2(
        F.concat_ws(",", F.transform("values", lambda v: v.cast("float").cast("string"))), 256
    )
    return selected.filter(F.col("frame") == 0).select(
        F.concat(F.lit(source_sha256[:16] + "-"), "sample").alias("trajectory_id"),
        F.col("sample").alias("source_index"),
        "ordinal",
        initial.alias("family_key"),
        initial.alias("initial_field_sha256"),
    )


def bind_remote_rows(local: DataFrame, receipt: DataFrame) -> DataFrame:
    """Gives each local row the remote row named at its ordinal in an acquisition receipt."""
    return local.join(receipt.select("ordinal", "remote_source_index"), "ordinal", "left")


def declaration_mismatches(
    declared: DataFrame, receipt: DataFrame, key: str, columns: Sequence[str]
) -> DataFrame:
    """Fields on which an import declaration and its acquisition receipt disagree."""
    r = receipt.select(key, *[F.col(c).alias(f"_r_{c}") for c in columns])
    wrong = F.array_compact(
        F.array(
            *[F.when(~F.col(c).eqNullSafe(F.col(f"_r_{c}")), F.lit(c)) for c in columns]
        )
    )
    return declared.join(r, key).select(key, wrong.alias("mismatches")).filter(F.size("mismatches") > 0)


def cohort_overlap(new: DataFrame, previous: DataFrame, column: str) -> DataFrame:
    """Rows of a new cohort that an earlier cohort already contains; must be empty."""
    return new.join(previous.select(column).distinct(), column, "left_semi")
