"""Scalar, array, hash and text expressions (no UDFs)."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Numeric limits and tolerances used by the checks.
FLOAT32_MAX = 3.4028234663852886e38
COORDINATE_RTOL = 1e-4
COORDINATE_ATOL = 1e-10
# Identifier, array-name, digest and prefix patterns.
SAFE_ID = r"^[A-Za-z0-9][A-Za-z0-9_-]{0,127}$"
SAFE_ARRAY_NAME = r"^[A-Za-z][A-Za-z0-9_]*$"
SHA256_HEX = r"^[0-9a-f]{64}$"


def col(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it in ``body``.

    Spark evaluates whatever a lambda mentions once per element. A whole-array expression
    inside a lambda would therefore be rebuilt for every cell; bound here it is a variable.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


# -- float tests ------------------------------------------------------------------


def is_finite(value: str | Column) -> Column:
    """True for numbers that are neither NaN nor infinite; NULL stays NULL."""
    v = col(value)
    return ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))


def is_close(a, b, rtol: float = 1e-5, atol: float = 1e-8) -> Column:
    return F.abs(col(a) - col(b)) <= F.lit(atol) + F.lit(rtol) * F.abs(col(b))


def finite_or_null(value: str | Column) -> Column:
    v = col(value)
    return F.when(is_finite(v), v)


def all_finite(values: str | Column) -> Column:
    return F.forall(col(values), lambda v: v.isNotNull() & is_finite(v))


def all_float32(values: str | Column) -> Column:
    return F.forall(
        col(values), lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) <= F.lit(FLOAT32_MAX))
    )


# -- arrays -----------------------------------------------------------------------


def total(values: str | Column) -> Column:
    return F.aggregate(col(values), F.lit(0.0), lambda acc, v: acc + v)


def mean_of(values: str | Column) -> Column:
    """The mean; null for no values."""
    return F.try_divide(total(values), F.size(col(values)))


def max_abs(values: str | Column) -> Column:
    return F.aggregate(col(values), F.lit(0.0), lambda acc, v: F.greatest(acc, F.abs(v)))


def sum_sq(values: str | Column) -> Column:
    return F.aggregate(col(values), F.lit(0.0), lambda acc, v: acc + v * v)


def as_double(values: str | Column) -> Column:
    return col(values).cast("array<double>")


def neighbor(values: str | Column, i: Column, offset: int) -> Column:
    """Periodic neighbour of element ``i`` (0-based) of an array."""
    v = col(values)
    return F.get(v, F.pmod(i + F.lit(offset), F.size(v)))


def diffs(values: str | Column) -> Column:
    """Differences of consecutive elements; empty for arrays shorter than two."""
    v = col(values)
    n = F.size(v)
    return F.when(n < 2, F.array().cast("array<double>")).otherwise(
        F.zip_with(
            F.slice(v, 2, F.greatest(n - 1, F.lit(1))),
            F.slice(v, 1, F.greatest(n - 1, F.lit(1))),
            lambda b, a: b - a,
        )
    )


def is_uniform_coordinate(values: str | Column, minimum: int) -> Column:
    """Finite, strictly increasing and evenly spaced with at least ``minimum`` entries."""
    v = col(values)
    spaced = let(
        diffs(v),
        lambda d: F.forall(
            d,
            lambda x: (x > 0)
            & is_close(x, F.get(d, F.lit(0)), COORDINATE_RTOL, COORDINATE_ATOL),
        ),
    )
    return (F.size(v) >= minimum) & all_finite(v) & spaced


# -- hashes and canonical text ----------------------------------------------------


def canonical(**parts) -> Column:
    """Compact JSON text with sorted keys; NULLs are written, doubles use Spark's rendering."""
    fields = [col(parts[name]).alias(name) for name in sorted(parts)]
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def content_id(text: Column, digits: int = 32, prefix: str = "") -> Column:
    digest = F.substring(F.sha2(text, 256), 1, digits)
    return F.concat(F.lit(prefix), digest) if prefix else digest


# -- text, paths, URLs ------------------------------------------------------------


def is_safe_id(value: str | Column) -> Column:
    return F.coalesce(col(value).rlike(SAFE_ID), F.lit(False))


def is_safe_path(value: str | Column) -> Column:
    """A relative path without parent steps, backslashes or drive letters."""
    v = col(value)
    bad = (
        v.startswith("/")
        | F.exists(F.split(v, "/"), lambda p: p == "..")
        | v.contains("\\")
        | v.contains(":")
    )
    return F.coalesce(~bad, F.lit(False))


def is_digest(value: str | Column) -> Column:
    return F.coalesce(col(value).rlike(SHA256_HEX), F.lit(False))


def object_key(*parts: str | Column) -> Column:
    """Join key parts with single slashes, dropping empty ones."""
    trimmed = [F.regexp_replace(p if isinstance(p, Column) else F.lit(p), "^/+|/+$", "") for p in parts]
    return F.array_join(F.filter(F.array(*trimmed), lambda p: p != ""), "/")


def is_web_url(value: str | Column) -> Column:
    """Scheme http or https with a host."""
    v = col(value)
    return F.coalesce(
        F.lower(F.regexp_extract(v, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)).isin("http", "https")
        & (F.length(F.regexp_extract(v, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)", 1)) > 0),
        F.lit(False),
    )


# Characters that must not appear raw inside an HTML script block.
HTML_ESCAPES: Sequence[tuple[str, str]] = (
    ("&", "\\u0026"),
    ("<", "\\u003c"),
    (">", "\\u003e"),
    ("\u2028", "\\u2028"),
    ("\u2029", "\\u2029"),
)


def html_safe_json(text: str | Column) -> Column:
    """JSON text that can be embedded in HTML."""
    out = col(text)
    for raw, escaped in HTML_ESCAPES:
        out = F.replace(out, F.lit(raw), F.lit(escaped))
    return out


# -- time -------------------------------------------------------------------------


def iso_text(moment: str | Column) -> Column:
    """UTC timestamp as ISO-8601 text with microseconds."""
    return F.date_format(col(moment), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")


def from_iso_text(text: str | Column) -> Column:
    return F.to_timestamp(col(text))


def epoch_seconds(moment: str | Column) -> Column:
    """Seconds since the epoch with their fraction, as queue tables store times."""
    return F.unix_micros(col(moment)) / F.lit(1e6)


def reasons(*checks: tuple[Column, str]) -> Column:
    """Array of the names of failed checks (condition NULL counts as failed)."""
    return F.array_compact(
        F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for ok, name in checks])
    )
