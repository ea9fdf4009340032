"""Per-run summaries of diagnostic series and their review flags."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.exprs import is_finite
from tidemark.functions.ordered import with_neighbors
from tidemark.functions.skew import by_size

# Review tolerances.
ENERGY_RTOL = 1e-8
INVARIANT_TOLERANCE = 1e-10
DIVERGENCE_TOLERANCE = 1e-10
RESIDUAL_TOLERANCE = 1e-8

# Diagnostic series that a summary understands, beside ``energy``.
OPTIONAL_SERIES = ("mass", "circulation", "max_abs_divergence", "enstrophy")


def energy_tolerance(first_energy: str | Column) -> Column:
    e0 = F.col(first_energy) if isinstance(first_energy, str) else first_energy
    return F.lit(ENERGY_RTOL) * F.greatest(e0, F.lit(1.0))


def energy_increases(diagnostics: DataFrame) -> DataFrame:
    """Every saved frame whose energy rose by more than the run's tolerance."""
    return (
        with_neighbors(
            diagnostics,
            ["run_id"],
            "frame",
            prev={"previous_energy": "energy"},
            first={"first_energy": "energy"},
        )
        .withColumn("rise", F.col("energy") - F.col("previous_energy"))
        .filter(F.col("rise") > energy_tolerance("first_energy"))
        .drop("previous_energy", "first_energy")
    )


def drift_from_first(diagnostics: DataFrame, column: str) -> DataFrame:
    """Signed distance of every frame from the run's first frame."""
    return with_neighbors(
        diagnostics, ["run_id"], "frame", first={"_first": column}
    ).withColumn("drift", F.col(column) - F.col("_first")).drop("_first")


def _max_drift(column: str) -> Column:
    """max |q[k] - q[0]| from extremes, so no row needs its run's first value."""
    first = F.min_by(column, "frame")
    return F.greatest(F.max(column) - first, first - F.min(column))


def reynolds(amplitude: Column, length: Column, viscosity: Column) -> Column:
    """Configured amplitude times length over viscosity; NULL when inviscid."""
    return F.when(viscosity > 0, amplitude * length / F.nullif(viscosity, F.lit(0.0)))


def review_flag(
    energy_increase: Column,
    *,
    max_divergence: Column | None = None,
    mass_drift: Column | None = None,
    circulation_drift: Column | None = None,
) -> Column:
    """True when any sampled diagnostic left its tolerance; absent metrics count as zero."""
    flag = F.coalesce(energy_increase, F.lit(False))
    for value, bound in (
        (max_divergence, DIVERGENCE_TOLERANCE),
        (mass_drift, INVARIANT_TOLERANCE),
        (circulation_drift, INVARIANT_TOLERANCE),
    ):
        if value is not None:
            flag = flag | (F.coalesce(value, F.lit(0.0)) > bound)
    return flag


def summarize_runs(
    diagnostics: DataFrame, *, dt: str | None = None, series: Sequence[str] | None = None
) -> DataFrame:
    """One row of metrics per run from wide diagnostics ``(run_id, frame, time, energy, ...)``.

    First and last values, extremes and drifts come from one hash aggregate. Only the energy
    increase needs neighbouring frames; it is located per block of frames and then folded
    into the same aggregate. A run with a non-finite diagnostic is flagged for review.
    """
    present = [
        s
        for s in OPTIONAL_SERIES
        if s in diagnostics.columns and (series is None or s in series)
    ]
    keep = ["run_id", "frame", "time", "energy", *present, *([dt] if dt else [])]
    rows = with_neighbors(
        diagnostics.select(*keep),
        ["run_id"],
        "frame",
        prev={"_prev": "energy"},
        first={"_first": "energy"},
    )
    rose = (F.col("energy") - F.col("_prev")) > energy_tolerance("_first")
    finite = is_finite("energy")
    for name in present:
        finite = finite & is_finite(name)
    aggregates = [
        F.min_by("energy", "frame").alias("initial_energy"),
        F.max_by("energy", "frame").alias("final_energy"),
        F.max("energy").alias("max_energy"),
        F.count_if(rose).alias("energy_increase_count"),
        F.min(F.when(rose, F.col("frame"))).alias("first_energy_increase_frame"),
        F.min_by(F.when(rose, F.col("time")), F.when(rose, F.col("frame"))).alias(
            "first_energy_increase_time"
        ),
        F.max_by("time", "frame").alias("final_time"),
        F.count("*").alias("saved_frames"),
        F.bool_and(F.coalesce(finite, F.lit(False))).alias("finite"),
    ]
    if dt:
        aggregates.append(F.max(dt).alias("_dt"))
    if "mass" in present:
        aggregates.append(_max_drift("mass").alias("mass_drift"))
    if "circulation" in present:
        aggregates.append(_max_drift("circulation").alias("circulation_drift"))
    if "max_abs_divergence" in present:
        aggregates.append(F.max("max_abs_divergence").alias("max_divergence"))
    if "enstrophy" in present:
        aggregates += [
            F.min_by("enstrophy", "frame").alias("initial_enstrophy"),
            F.max_by("enstrophy", "frame").alias("final_enstrophy"),
        ]
    out = rows.groupBy("run_id").agg(*aggregates)
    out = out.withColumns(
        {
            "energy_change": F.col("final_energy") - F.col("initial_energy"),
            "energy_increase_observed": F.col("energy_increase_count") > 0,
            "energy_increase_tolerance": energy_tolerance("initial_energy"),
        }
    )
    if dt:
        out = out.withColumn(
            "first_energy_increase_step",
            F.bround(F.col("first_energy_increase_time") / F.col("_dt")).cast("long"),
        ).drop("_dt")
    have = out.columns
    return out.withColumn(
        "needs_review",
        review_flag(
            F.col("energy_increase_observed"),
            max_divergence=F.col("max_divergence") if "max_divergence" in have else None,
            mass_drift=F.col("mass_drift") if "mass_drift" in have else None,
            circulation_drift=F.col("circulation_drift") if "circulation_drift" in have else None,
        ),
    )


def summarize_steady(diagnostics: DataFrame) -> DataFrame:
    """Summary of steady (Darcy) runs from ``(run_id, residual_l2, pressure_l2_error)``."""
    return diagnostics.select(
        "run_id",
        "residual_l2",
        "pressure_l2_error",
        F.lit(1).cast("long").alias("saved_frames"),
        F.lit(0.0).alias("final_time"),
        (is_finite("residual_l2") & is_finite("pressure_l2_error")).alias("finite"),
        (F.col("residual_l2") > RESIDUAL_TOLERANCE).alias("needs_review"),
        F.lit(RESIDUAL_TOLERANCE).alias("residual_tolerance"),
    )


def widen_diagnostics(long: DataFrame, names: Sequence[str]) -> DataFrame:
    """``(run_id, frame, time, name, value)`` to one column per named series."""
    return long.groupBy("run_id", "frame", "time").pivot("name", list(names)).agg(F.max("value"))


def final_frames(frames: DataFrame) -> DataFrame:
    """The last saved frame of every run and field.

    The positions are found from the narrow columns first and then filter the scan, so field
    arrays are not shuffled unless there are too many runs to broadcast their positions.
    """
    last = by_size(frames.groupBy("run_id", "field").agg(F.max("frame").alias("frame")))
    return frames.join(last, ["run_id", "field", "frame"], "left_semi")


def catalog_counts(catalog: DataFrame) -> DataFrame:
    """Run counts by equation and status with completed, flagged and failed tiles."""
    return catalog.groupBy("equation", "status").agg(
        F.count("*").alias("runs"),
        F.count_if(F.col("status") == "completed").alias("completed"),
        F.count_if(F.coalesce(F.col("needs_review"), F.lit(False))).alias("flagged"),
        F.count_if(F.col("status") == "failed").alias("failed"),
    )
