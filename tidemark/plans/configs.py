"""Run configurations: defaults, validation, size estimates, identity and comparison.

A raw configuration is ``MAP<STRING, STRING>`` whose values are JSON scalars as text, as
``from_json(text, 'map<string,string>')`` yields them. Rows are tagged with the reasons for
which they are invalid; nothing is thrown and nothing is dropped.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.exprs import canonical, content_id, is_finite, reasons

# Equations, accepted keys, defaults, bounds and size cap of configurations.
TIME_DEPENDENT = ("burgers1d", "navier_stokes2d")
STEADY = "darcy2d"
TIME_DEPENDENT_KEYS = (
    "equation",
    "viscosity",
    "grid_size",
    "dt",
    "steps",
    "save_every",
    "seed",
    "domain_length",
    "amplitude",
    "initial_condition",
)
STEADY_KEYS = ("equation", "grid_size", "domain_length", "contrast")
MAX_OUTPUT_BYTES = 256 * 1024 * 1024
MAX_STEADY_GRID = 513
CODE_FIELDS = ("dependencies", "git_commit", "hardware", "python", "source_sha256")
SCHEMA_VERSION = 1

_NUMBER = r"^-?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?$"
_INTEGER = r"^-?[0-9]+$"
_INF = float("inf")


def _real(raw: Column, key: str, default: float) -> Column:
    text = F.coalesce(raw[key], F.lit(repr(default)))
    return F.when(text.rlike(_NUMBER), text.try_cast("double"))


def _integer(raw: Column, key: str, default: int) -> Column:
    text = F.coalesce(raw[key], F.lit(str(default)))
    return F.when(text.rlike(_INTEGER), text.try_cast("long"))


def frame_count(steps: Column, save_every: Column) -> Column:
    """First frame, every ``save_every`` steps, and always the last step."""
    every = F.nullif(save_every, F.lit(0))
    rest = F.pmod(steps, every)
    return (1 + (steps - rest) / every + F.when(rest > 0, 1).otherwise(0)).cast("long")


def saved_steps(steps: Column, save_every: Column) -> Column:
    """The step numbers that are saved, ascending."""
    return F.array_distinct(
        F.concat(F.sequence(F.lit(0).cast("long"), steps, save_every), F.array(steps))
    )


def output_bytes(equation: Column, grid_size: Column, frames: Column) -> Column:
    """Estimated bytes of saved float64 fields, as a double so that no size overflows."""
    n, f = grid_size.cast("double"), frames.cast("double")
    return F.when(equation == "burgers1d", 8 * (f * (n + 4) + n)).otherwise(
        8 * (f * (3 * n * n + 6) + 2 * n)
    )


def normalize_configs(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Fill defaults and tag problems: adds ``config`` (struct) and ``reasons`` (array).

    ``config`` is NULL when there is any reason.
    """
    m = F.col(raw)
    equation = F.coalesce(m["equation"], F.lit("burgers1d"))
    steady = equation == STEADY
    known = F.when(steady, F.array(*map(F.lit, STEADY_KEYS))).otherwise(
        F.array(*map(F.lit, TIME_DEPENDENT_KEYS))
    )
    usual_ic = F.when(equation == "burgers1d", F.lit("sine")).otherwise(F.lit("taylor_green"))
    staged = df.withColumns(
        {
            "_eq": equation,
            "_unknown": F.size(F.array_except(F.map_keys(m), known)),
            "_nu": _real(m, "viscosity", 0.05),
            "_n": F.when(steady, _integer(m, "grid_size", 33)).otherwise(
                _integer(m, "grid_size", 32)
            ),
            "_dt": _real(m, "dt", 0.001),
            "_steps": _integer(m, "steps", 100),
            "_every": _integer(m, "save_every", 10),
            "_seed": _integer(m, "seed", 0),
            "_len": F.when(steady, _real(m, "domain_length", 1.0)).otherwise(
                _real(m, "domain_length", 2 * math.pi)
            ),
            "_amp": _real(m, "amplitude", 1.0),
            "_ic": F.coalesce(m["initial_condition"], usual_ic),
            "_usual": usual_ic,
            "_con": _real(m, "contrast", 0.5),
        }
    )
    c = F.col
    spacing = c("_len") / F.nullif(F.when(steady, c("_n") - 1).otherwise(c("_n")), F.lit(0))
    wave = F.lit(2 * math.pi) / F.nullif(c("_len"), F.lit(0.0))
    # Sizes are only meaningful for positive counts; other rows already carry a reason.
    frames = frame_count(
        F.when(c("_steps") >= 1, c("_steps")), F.when(c("_every") >= 1, c("_every"))
    )
    size = output_bytes(c("_eq"), c("_n"), frames)
    bounded = lambda v: (v > 0) & (v < F.lit(_INF))
    moving = reasons(
        (c("_unknown") == 0, "unknown_keys"),
        (c("_eq").isin(*TIME_DEPENDENT), "equation"),
        (c("_ic").isin("random") | (c("_ic") == c("_usual")), "initial_condition"),
        (is_finite("_nu") & (c("_nu") >= 0), "viscosity"),
        (c("_n") >= 8, "grid_size"),
        (is_finite("_dt") & (c("_dt") > 0), "dt"),
        (c("_steps") >= 1, "steps"),
        (c("_every") >= 1, "save_every"),
        (c("_seed") >= 0, "seed"),
        (is_finite("_len") & (c("_len") > 0), "domain_length"),
        (is_finite("_amp") & (c("_amp") >= 0), "amplitude"),
        (F.coalesce(is_finite(c("_dt") * c("_steps")), F.lit(True)), "duration"),
        (
            F.coalesce(bounded(spacing * spacing) & bounded(wave * wave), F.lit(True)),
            "spacing",
        ),
        (F.coalesce(is_finite(c("_amp") * c("_amp")), F.lit(True)), "amplitude_range"),
        (F.coalesce(size <= MAX_OUTPUT_BYTES, F.lit(True)), "output_size"),
    )
    still = reasons(
        (c("_unknown") == 0, "unknown_keys"),
        (c("_n").between(5, MAX_STEADY_GRID), "grid_size"),
        (is_finite("_len") & (c("_len") > 0), "domain_length"),
        (is_finite("_con") & (F.abs(c("_con")) < 0.9), "contrast"),
        (F.coalesce(spacing.between(1e-140, 1e140), F.lit(True)), "spacing"),
    )
    problems = F.when(c("_eq") == STEADY, still).otherwise(moving)
    unless_steady = lambda v: F.when(c("_eq") != STEADY, v)
    config = F.struct(
        c("_eq").alias("equation"),
        unless_steady(c("_nu")).alias("viscosity"),
        c("_n").alias("grid_size"),
        c("_len").alias("domain_length"),
        unless_steady(c("_dt")).alias("dt"),
        unless_steady(c("_steps")).alias("steps"),
        unless_steady(c("_every")).alias("save_every"),
        unless_steady(c("_seed")).alias("seed"),
        unless_steady(c("_amp")).alias("amplitude"),
        unless_steady(c("_ic")).alias("initial_condition"),
        F.when(c("_eq") == STEADY, c("_con")).alias("contrast"),
    )
    return (
        staged.withColumn("reasons", problems)
        .withColumn("config", F.when(F.size("reasons") == 0, config))
        .withColumn(
            "output_bytes",
            F.when((F.size("reasons") == 0) & (c("_eq") != STEADY), size.cast("long")),
        )
        .drop(*[name for name in staged.columns if name.startswith("_")])
    )


def change_problems(config: Column) -> Column:
    """Reasons for which a normalised configuration is no longer valid after its resolution changed.

    The rules of :func:`normalize_configs` that look at grid, step, steps and saved steps; everything
    else of a normalised configuration is valid already. NULL stands for a number that overflowed.
    """
    n, length = config["grid_size"], config["domain_length"]
    steady = config["equation"] == STEADY
    dt, steps, every = config["dt"], config["steps"], config["save_every"]
    still = reasons(
        (n.between(5, MAX_STEADY_GRID), "grid_size"),
        ((length / F.nullif(n - 1, F.lit(0))).between(1e-140, 1e140), "spacing"),
    )
    size = output_bytes(config["equation"], n, frame_count(steps, every))
    moving = reasons(
        (n >= 8, "grid_size"),
        (is_finite(dt) & (dt > 0), "dt"),
        (steps >= 1, "steps"),
        (every >= 1, "save_every"),
        (F.coalesce(is_finite(dt * steps), F.lit(True)), "duration"),
        (F.coalesce(size <= MAX_OUTPUT_BYTES, F.lit(True)), "output_size"),
    )
    return F.when(steady, still).otherwise(moving)


def config_json(config: str = "config") -> Column:
    """Sorted-key compact JSON of a normalised configuration; absent keys are left out."""
    return F.to_json(
        F.struct(*[F.col(f"{config}.{k}").alias(k) for k in sorted({*TIME_DEPENDENT_KEYS, *STEADY_KEYS})])
    )


def config_key(config: str = "config") -> Column:
    """Identity of a configuration."""
    return F.sha2(config_json(config), 256)


def experiment_id(
    config_text: Column, provenance: Column, parent_id: Column, attempt: Column
) -> Column:
    """Content identity of a run: configuration, parent, attempt and code, never times.

    ``provenance`` is a map; only the code fields take part, so a dirty flag does not matter.
    """
    code = F.struct(*[provenance[name].alias(name) for name in CODE_FIELDS])
    return content_id(
        canonical(
            schema_version=F.lit(SCHEMA_VERSION),
            config=config_text,
            parent_id=parent_id,
            attempt=attempt,
            code=code,
        )
    )


def same_runtime(left: Column, right: Column, ignored: str = "git_dirty") -> Column:
    """Whether two provenance maps agree when the dirty flag is left out."""
    text = lambda m: F.array_sort(
        F.transform(
            F.map_entries(F.map_filter(m, lambda k, v: k != ignored)),
            lambda e: F.concat_ws("=", e["key"], F.coalesce(e["value"], F.lit("null"))),
        )
    )
    return F.sha2(F.to_json(text(left)), 256).eqNullSafe(F.sha2(F.to_json(text(right)), 256))


def changed_parameters(before: Column, after: Column) -> Column:
    """``{key: {before, after}}`` for the keys of ``after`` whose value differs."""
    both = F.map_zip_with(
        before, after, lambda k, b, a: F.struct(b.alias("before"), a.alias("after"))
    )
    return F.map_filter(
        both, lambda k, v: v["after"].isNotNull() & ~v["before"].eqNullSafe(v["after"])
    )


def duplicate_ids(df: DataFrame, column: str = "id") -> DataFrame:
    """Identifiers that occur more than once, with their counts."""
    return df.groupBy(column).agg(F.count("*").alias("copies")).filter(F.col("copies") > 1)


def compare_keys(planned: DataFrame, returned: DataFrame, key: str = "config_key") -> DataFrame:
    """Keys on one side only: ``missing`` was planned, ``unexpected`` was not."""
    p = planned.select(key).distinct().withColumn("_p", F.lit(True))
    r = returned.select(key).distinct().withColumn("_r", F.lit(True))
    return (
        p.join(r, key, "full")
        .filter(F.col("_p").isNull() | F.col("_r").isNull())
        .select(
            key, F.when(F.col("_r").isNull(), "missing").otherwise("unexpected").alias("problem")
        )
    )


def unequal_repeats(first: DataFrame, second: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows of two executions that are absent on one side or differ in any column."""
    a = first.select(key, F.struct(*columns).alias("_first"))
    b = second.select(key, F.struct(*columns).alias("_second"))
    return (
        a.join(b, key, "full")
        .filter(~F.col("_first").eqNullSafe(F.col("_second")))
        .select(
            key,
            F.when(F.col("_first").isNull(), "only_second")
            .when(F.col("_second").isNull(), "only_first")
            .otherwise("different")
            .alias("problem"),
        )
    )
