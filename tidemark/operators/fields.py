"""Per-frame diagnostics, screens, stencils and partial reads of field arrays."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tidemark.functions import grids
from tidemark.functions.exprs import let, mean_of, sum_sq
from tidemark.functions.ordered import with_dense_neighbors

# Fixed value: largest accepted dt * rate of the stability screen.
STABILITY_LIMIT = 0.5


def burgers_diagnostics(frames: DataFrame, length: Column) -> DataFrame:
    """mean velocity, mass and energy of every frame; no shuffle."""
    mean = mean_of("values")
    return frames.select(
        "run_id",
        "frame",
        "time",
        mean.alias("mean_velocity"),
        (mean * length).alias("mass"),
        grids.half_mean_square("values").alias("energy"),
    )


@F.pandas_udf(DoubleType())
def spectral_divergence(
    u: pd.Series, v: pd.Series, n: pd.Series, length: pd.Series
) -> pd.Series:
    """max |du/dx + dv/dy| of periodic row-major n x n fields, by FFT."""
    out = np.empty(len(u))
    for at, (a, b, size, domain) in enumerate(zip(u, v, n, length)):
        size = int(size)
        k = np.fft.fftfreq(size) * size * (2 * np.pi / domain)
        ah = np.fft.fft2(np.asarray(a, dtype=np.float64).reshape(size, size))
        bh = np.fft.fft2(np.asarray(b, dtype=np.float64).reshape(size, size))
        out[at] = np.abs(np.fft.ifft2(1j * k[None, :] * ah + 1j * k[:, None] * bh).real).max()
    return pd.Series(out)


def navier_stokes_diagnostics(frames: DataFrame, length: Column) -> DataFrame:
    """Vorticity mean, circulation, energy, enstrophy and divergence of every frame.

    ``frames``: ``run_id, frame, time, nx, u, v, vorticity``. Only the spectral divergence
    leaves the JVM.
    """
    mean = mean_of("vorticity")
    return frames.select(
        "run_id",
        "frame",
        "time",
        mean.alias("mean_vorticity"),
        (mean * length * length).alias("circulation"),
        grids.half_mean_square("u", "v").alias("energy"),
        grids.half_mean_square("vorticity").alias("enstrophy"),
        spectral_divergence("u", "v", "nx", length).alias("max_abs_divergence"),
    )


def darcy_diagnostics(plates: DataFrame) -> DataFrame:
    """Residual RMS and grid L2 error of ``run_id, n, length, pressure, permeability, forcing, exact``."""
    n = F.col("n")
    h = F.col("length") / (n - 1)
    residual = grids.darcy_residual(
        F.col("pressure"), F.col("permeability"), F.col("forcing"), n, h
    )
    error = F.zip_with("pressure", "exact", lambda p, q: p - q)
    return plates.select(
        "run_id",
        n,
        let(residual, grids.rms).alias("residual_l2"),
        (h * F.sqrt(sum_sq(error))).alias("pressure_l2_error"),
    )


def stability_screen(
    frames: DataFrame, rate: Column, dt: Column
) -> DataFrame:
    """Tag frames whose time step exceeds the advection/diffusion bound.

    Saved frames are screened; stages between saved frames are not visible here.
    """
    out = frames.withColumn("rate", rate)
    bad = F.isnan("rate") | (F.abs("rate") == float("inf")) | (F.col("rate") < 0)
    return out.select(
        "run_id",
        "frame",
        "rate",
        F.when(bad, "non-finite rate")
        .when(dt * F.col("rate") > STABILITY_LIMIT, "bound exceeded")
        .alias("problem"),
        F.when(~bad & (F.col("rate") > 0), STABILITY_LIMIT / F.col("rate")).alias("suggested_dt"),
    )


def with_rhs(frames: DataFrame, dx: Column, viscosity: Column) -> DataFrame:
    """Adds ``rhs``, the periodic Burgers right-hand side of every frame."""
    return frames.withColumn("rhs", grids.burgers_rhs("values", dx, viscosity))


def saved_frame_residuals(
    frames: DataFrame, dt: Column, dx: Column, viscosity: Column
) -> DataFrame:
    """PDE residual RMS of every frame that has both neighbours in time."""
    around = with_dense_neighbors(
        frames.select("run_id", "frame", "values"),
        ["run_id"],
        "frame",
        prev={"before": "values"},
        next={"after": "values"},
    ).filter(F.col("before").isNotNull() & F.col("after").isNotNull())
    residual = grids.burgers_residual(
        F.col("before"), F.col("values"), F.col("after"), dt, dx, viscosity
    )
    return around.select("run_id", "frame", let(residual, grids.rms).alias("residual_rms"))


def frame_gaps(frames: DataFrame) -> DataFrame:
    """Runs whose saved frames are not 0..n-1, with the number missing."""
    return (
        frames.groupBy("run_id")
        .agg(F.count_distinct("frame").alias("saved"), F.max("frame").alias("last"))
        .withColumn("missing", F.col("last") + 1 - F.col("saved"))
        .filter(F.col("missing") > 0)
    )


def read_tile(
    frames: DataFrame, *, run_id, frame: int, rows: int | None = None, cols: int | None = None
) -> DataFrame:
    """The leading tile of one frame. The run and frame filters reach the Parquet scan."""
    nx = F.col("nx")
    wanted = (F.col("run_id") == run_id) & (F.col("frame") == frame)
    keep = lambda v, i: (
        (F.pmod(i, nx) < (F.lit(cols) if cols else nx))
        & (F.floor(i / nx) < (F.lit(rows) if rows else F.col("ny")))
    )
    return frames.filter(wanted).withColumn("values", F.filter("values", keep))


def long_cells(frames: DataFrame) -> DataFrame:
    """One row per cell, for joins that need them; prefer the array forms."""
    return frames.select(
        "run_id",
        "field",
        "frame",
        "time",
        "nx",
        F.posexplode("values").alias("at", "value"),
    ).select(
        "run_id",
        "field",
        "frame",
        "time",
        F.expr("CAST(at div nx AS INT)").alias("iy"),
        F.expr("CAST(at % nx AS INT)").alias("ix"),
        "value",
    )
