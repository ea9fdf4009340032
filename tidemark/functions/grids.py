"""Array expressions on gridded fields: closed forms, moments and stencils.

A field is one row-major array per saved frame, so none of these needs a shuffle or an
exploded cell table.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.exprs import as_double, col, let, max_abs, mean_of, neighbor, sum_sq


def _cells(count: Column) -> Column:
    return F.sequence(F.lit(0), count.cast("int") - 1)


# -- closed forms -----------------------------------------------------------------


def sine_field(n: Column, amplitude: Column) -> Column:
    """amplitude * sin(2 pi x / L) on a periodic grid without endpoint."""
    return F.transform(_cells(n), lambda i: amplitude * F.sin(F.lit(2 * math.pi) * (i / n)))


def taylor_green_vorticity(
    n: Column, amplitude: Column, length: Column, viscosity: Column, time: Column
) -> Column:
    """2 A k sin(kx) sin(ky) exp(-2 nu k^2 t) with k = 2 pi / L, row-major."""
    k = F.lit(2 * math.pi) / length
    scale = 2 * amplitude * k * F.exp(-2 * viscosity * k * k * time)
    step = F.lit(2 * math.pi) / n
    # The field is a product of one wave per axis.
    bound = F.struct(
        n.cast("int").alias("n"),
        scale.alias("scale"),
        F.transform(_cells(n), lambda i: F.sin(step * i)).alias("wave"),
    )
    return let(
        bound,
        lambda b: F.transform(
            _cells(b["n"] * b["n"]),
            lambda i: b["scale"]
            * F.get(b["wave"], F.pmod(i, b["n"]))
            * F.get(b["wave"], F.floor(i / b["n"]).cast("int")),
        ),
    )


def _axis(n: Column, wave) -> Column:
    """``wave`` of the phase pi * i / (n - 1) at every index of one axis."""
    return F.transform(_cells(n), lambda i: wave(F.lit(math.pi) * i / (n - 1)))


def _plate_axes(n: Column) -> Column:
    """Sines with exact zeros at both ends, plain sines, and cosines along one axis."""
    n = n.cast("int")
    return F.struct(
        n.alias("n"),
        F.transform(
            _axis(n, F.sin), lambda s, i: F.when((i == 0) | (i == n - 1), 0.0).otherwise(s)
        ).alias("exact"),
        _axis(n, F.sin).alias("sin"),
        _axis(n, F.cos).alias("cos"),
    )


def _ix(b: Column, i: Column) -> Column:
    return F.pmod(i, b["n"])


def _iy(b: Column, i: Column) -> Column:
    return F.floor(i / b["n"]).cast("int")


def plate_pressure(n: Column) -> Column:
    """sin(pi x/L) sin(pi y/L) with exact zeros on the border."""
    return let(
        _plate_axes(n),
        lambda b: F.transform(
            _cells(b["n"] * b["n"]),
            lambda i: F.get(b["exact"], _ix(b, i)) * F.get(b["exact"], _iy(b, i)),
        ),
    )


def plate_permeability(pressure: Column, contrast: Column) -> Column:
    return F.transform(pressure, lambda p: 1 + contrast * p)


def plate_forcing(n: Column, length: Column, contrast: Column) -> Column:
    """-div(a grad p) of the closed-form pressure and permeability."""
    k2 = (F.lit(math.pi) / length) * (F.lit(math.pi) / length)

    def cell(b, i):
        ix, iy = _ix(b, i), _iy(b, i)
        p = F.get(b["exact"], ix) * F.get(b["exact"], iy)
        sx, sy = F.get(b["sin"], ix), F.get(b["sin"], iy)
        cx, cy = F.get(b["cos"], ix), F.get(b["cos"], iy)
        mixed = cx * cx * sy * sy + sx * sx * cy * cy
        return 2 * k2 * (1 + contrast * p) * p - contrast * k2 * mixed

    return let(
        _plate_axes(n), lambda b: F.transform(_cells(b["n"] * b["n"]), lambda i: cell(b, i))
    )


# -- moments ----------------------------------------------------------------------


def half_mean_square(*components: str | Column) -> Column:
    """0.5 * mean(sum of squared components); null for an empty grid."""
    first, *rest = components
    out = sum_sq(first)
    for c in rest:
        out = out + sum_sq(c)
    return F.try_divide(0.5 * out, F.size(col(first)))


def rms(values: str | Column) -> Column:
    return F.sqrt(F.try_divide(sum_sq(values), F.size(col(values))))


def mean_preserving_update(state: str | Column, increment: str | Column) -> Column:
    """Add an increment after removing its spatial mean."""
    return let(
        mean_of(increment),
        lambda mean: F.zip_with(col(state), col(increment), lambda u, d: u + (d - mean)),
    )


# -- stencils ---------------------------------------------------------------------


def burgers_rhs(values: str | Column, dx: Column, viscosity: Column) -> Column:
    """Conservative central flux plus diffusion on a periodic grid."""

    def cell(v, u, i):
        east, west = neighbor(v, i, 1), neighbor(v, i, -1)
        flux = (0.5 * east * east - 0.5 * west * west) / (2 * dx)
        return -flux + viscosity * (east - 2 * u + west) / (dx * dx)

    return let(col(values), lambda v: F.transform(v, lambda u, i: cell(v, u, i)))


def burgers_residual(
    before: Column, now: Column, after: Column, dt: Column, dx: Column, viscosity: Column
) -> Column:
    """u_t + u u_x - nu u_xx at a saved frame, from its neighbours in time and space."""

    def cell(b, u, i):
        east, west = neighbor(b["now"], i, 1), neighbor(b["now"], i, -1)
        ut = (F.get(b["after"], i) - F.get(b["before"], i)) / (2 * dt)
        return ut + u * (east - west) / (2 * dx) - viscosity * (east - 2 * u + west) / (dx * dx)

    bound = F.struct(before.alias("before"), now.alias("now"), after.alias("after"))
    return let(bound, lambda b: F.transform(b["now"], lambda u, i: cell(b, u, i)))


def darcy_residual(
    pressure: Column, permeability: Column, forcing: Column, n: Column, spacing: Column
) -> Column:
    """-div(a grad p) - f on interior cells with harmonic faces; border pressure is zero."""

    def cell(b, p, i):
        width = b["n"]
        a = F.get(b["a"], i)
        ix, iy = F.pmod(i, width), F.floor(i / width)
        inside = (ix > 0) & (ix < width - 1) & (iy > 0) & (iy < width - 1)

        def flux(j):
            other = F.get(b["a"], j)
            return 2 * a * other / (a + other) * (p - F.get(b["p"], j))

        out = flux(i + 1) + flux(i - 1) + flux(i + width) + flux(i - width)
        return F.when(inside, out / b["h2"] - F.get(b["f"], i))

    bound = F.struct(
        pressure.alias("p"),
        permeability.alias("a"),
        forcing.alias("f"),
        n.cast("int").alias("n"),
        (spacing * spacing).alias("h2"),
    )
    return let(
        bound, lambda b: F.array_compact(F.transform(b["p"], lambda p, i: cell(b, p, i)))
    )


def stability_rate_1d(values: str | Column, dx: Column, viscosity: Column) -> Column:
    return max_abs(values) / dx + 2 * viscosity / (dx * dx)


def kept_modes(n: Column) -> Column:
    """Largest mode strictly below n/3."""
    return F.ceil(n / 3) - 1


def stability_rate_2d(
    u: str | Column, v: str | Column, n: Column, length: Column, viscosity: Column
) -> Column:
    """(max|u| + max|v|) max_k + nu max_k2 over the modes kept by the two-thirds rule."""
    top = F.lit(2 * math.pi) / length * kept_modes(n)
    return (max_abs(u) + max_abs(v)) * top + viscosity * 2 * top * top


def subsample_error(reference: str | Column, solution: str | Column) -> Column:
    """RMS distance between a solution and every k-th cell of a finer reference."""
    bound = F.struct(
        col(reference).alias("fine"),
        col(solution).alias("coarse"),
        F.floor(F.size(col(reference)) / F.size(col(solution))).cast("int").alias("step"),
    )
    gap = let(
        bound,
        lambda b: F.transform(b["coarse"], lambda v, i: v - F.get(b["fine"], i * b["step"])),
    )
    return let(gap, rms)


def doubles(values: str | Column) -> Column:
    return as_double(values)
