"""Bounded previews of runs for browsing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.exprs import finite_or_null, html_safe_json
from tidemark.functions.skew import by_size
from tidemark.sources.catalog import first_runs

# Preview limits and the field shown for each equation.
MAX_SAMPLES = 201
MAX_CELLS_1D = 256
MAX_CELLS_2D = 64
MAX_PAYLOAD_BYTES = 32 * 1024 * 1024
PREVIEW_FIELDS = {"burgers1d": "velocity", "navier_stokes2d": "vorticity", "darcy2d": "pressure"}


def sample_positions(count: Column, most: int = MAX_SAMPLES) -> Column:
    """At most ``most`` (two or more) evenly spaced positions of 0..count-1, both ends kept."""
    every = F.sequence(F.lit(0).cast("long"), count.cast("long") - 1)
    steps = F.sequence(F.lit(0), F.lit(most - 1))
    spread = F.array_distinct(
        F.transform(steps, lambda i: F.floor(i * (count - 1) / F.lit(most - 1)).cast("long"))
    )
    return F.when(count <= most, every).otherwise(spread)


def is_sampled(position: Column, count: Column, most: int = MAX_SAMPLES) -> Column:
    """Whether a position is one of :func:`sample_positions`, decided without a join.

    With m = most-1 steps over n-1 positions, p is hit when some i in 0..m has
    floor(i*(n-1)/m) = p; the first candidate is i = ceil(m*p/(n-1)).
    """
    last = count - 1
    i = F.ceil(position * (most - 1) / F.nullif(last, F.lit(0)))
    hit = F.floor(i * last / F.lit(most - 1)) == position
    return (count <= most) | F.coalesce(hit, F.lit(True))


def series_preview(series: DataFrame, value: str = "energy", *, most: int = MAX_SAMPLES) -> DataFrame:
    """Sampled ``(time, value)`` of each run's diagnostic series; at most ``most`` entries per run."""
    counts = by_size(series.groupBy("run_id").agg(F.count("*").alias("source_samples")))
    shown = series.join(counts, "run_id").filter(
        is_sampled(F.col("frame"), F.col("source_samples"), most)
    )
    entry = F.struct(
        "frame", finite_or_null("time").alias("time"), finite_or_null(value).alias("value")
    )
    return (
        shown.groupBy("run_id", "source_samples")
        .agg(F.array_sort(F.collect_list(entry)).alias("samples"))
        .withColumn("display_samples", F.size("samples"))
    )


def stride(size: Column, limit: int) -> Column:
    return F.greatest(F.lit(1), F.ceil(size / F.lit(limit)).cast("int"))


def field_preview(
    frames: DataFrame, cells_1d: int = MAX_CELLS_1D, cells_2d: int = MAX_CELLS_2D
) -> DataFrame:
    """Every stride-th cell of each row's field, without averaging."""
    one_d = F.col("ny") == 1
    sx = F.when(one_d, stride(F.col("nx"), cells_1d)).otherwise(
        stride(F.col("nx"), cells_2d)
    )
    sy = F.when(one_d, F.lit(1)).otherwise(stride(F.col("ny"), cells_2d))
    kept = F.filter(
        "values",
        lambda v, i: (F.pmod(F.pmod(i, F.col("nx")), F.col("_sx")) == 0)
        & (F.pmod(F.floor(i / F.col("nx")), F.col("_sy")) == 0),
    )
    return (
        frames.withColumns({"_sx": sx, "_sy": sy})
        .withColumn("preview", F.transform(kept, finite_or_null))
        .withColumns(
            {
                "strides": F.array("_sy", "_sx"),
                "display_shape": F.array(
                    F.ceil(F.col("ny") / F.col("_sy")).cast("int"),
                    F.ceil(F.col("nx") / F.col("_sx")).cast("int"),
                ),
            }
        )
        .drop("_sx", "_sy")
    )


def preview_field_of(equation: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, field in PREVIEW_FIELDS.items():
        out = F.when(equation == name, field).otherwise(out)
    return out


def catalog_snapshot(
    catalog: DataFrame,
    problems: DataFrame,
    digests: DataFrame,
    series: DataFrame,
    finals: DataFrame,
    count: int = 50,
    max_payload_bytes: int = MAX_PAYLOAD_BYTES,
) -> DataFrame:
    """JSON payload of each of the first ``count`` runs.

    One corrupt selected run stops the export: every payload row then carries the error and
    no payload. Payloads over ``max_payload_bytes`` are flagged the same way.
    """
    chosen = first_runs(catalog, count)
    keys = F.broadcast(chosen.select("id"))  # at most 200 ids
    bad = problems.join(keys, problems["run_id"] == F.col("id"), "left_semi")
    corrupt = bad.agg(F.count("*") > 0).scalar()
    energy = series_preview(
        series.join(keys, series["run_id"] == F.col("id"), "left_semi")
    ).withColumnRenamed("run_id", "id")
    # One field per run: the one that its equation is shown by.
    shown = F.broadcast(
        chosen.select(
            F.col("id").alias("run_id"),
            preview_field_of(F.col("equation")).alias("field"),
            (F.col("equation") == "darcy2d").alias("steady"),
        )
    )
    field = (
        field_preview(finals.join(shown, ["run_id", "field"]))
        .withColumn("source_shape", F.array("ny", "nx"))
        .select(
            F.col("run_id").alias("id"),
            F.struct(
                "field", "frame", "time", "steady", "source_shape", "strides", "display_shape", "preview"
            ).alias("field"),
        )
    )
    payload = F.to_json(
        F.struct(
            F.struct(*catalog.columns).alias("record"),
            "manifest_sha256",
            "record_sha256",
            F.struct("source_samples", "display_samples", "samples").alias("energy"),
            "field",
        )
    )
    rows = (
        chosen.join(digests, "id", "left")
        .join(energy, "id", "left")
        .join(field, "id", "left")
        .select("id", corrupt.alias("_corrupt"), html_safe_json(payload).alias("payload"))
    )
    too_big = F.octet_length("payload") > max_payload_bytes
    return rows.select(
        "id",
        F.when(F.col("_corrupt"), "a selected run failed verification")
        .when(too_big, "payload exceeds the export limit")
        .alias("error"),
        F.when(~F.col("_corrupt") & ~too_big, F.col("payload")).alias("payload"),
    )
