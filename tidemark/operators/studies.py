"""Benchmark trials, resource samples and transfer receipts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.ordered import exact_medians, with_neighbors

# Byte offsets are wide apart; blocks of one GiB hold many ranges each.
OFFSET_WIDTH = 1 << 30

MEASURES = (
    "wall_seconds",
    "verified_reuse_seconds",
    "stored_bytes",
    "runs_per_hour",
    "attempts_per_hour",
)


def throughput(trials: DataFrame) -> DataFrame:
    """Successful runs and all attempts per hour of every trial."""
    per_hour = F.lit(3600.0) / F.col("wall_seconds")
    return trials.withColumns(
        {
            "runs_per_hour": per_hour * F.col("completed_experiments"),
            "attempts_per_hour": per_hour
            * (F.col("completed_experiments") + F.col("failure_count")),
        }
    )


def summarize_trials(
    trials: DataFrame, keys: Sequence[str] = ("grid_size", "mode", "workers")
) -> DataFrame:
    """Medians, ranges, throughput and speedup per group of trials.

    Peak memory is the largest over the trials and NULL when any trial lacks it. Speedup is
    the one-worker median of the same group (without workers) over the own median.
    """
    keys = list(keys)
    rated = throughput(trials)
    plain = [
        F.count("*").alias("trials"),
        F.min("wall_seconds").alias("wall_seconds_min"),
        F.max("wall_seconds").alias("wall_seconds_max"),
        F.min("verified_reuse_seconds").alias("verified_reuse_seconds_min"),
        F.max("verified_reuse_seconds").alias("verified_reuse_seconds_max"),
        F.min("stored_bytes").alias("stored_bytes_min"),
        F.max("stored_bytes").alias("stored_bytes_max"),
        F.sum("completed_experiments").alias("completed_experiments"),
        F.sum("failure_count").alias("failure_count"),
        F.sum("sampling_errors").alias("sampling_errors"),
        F.when(F.bool_and(F.col("peak_rss").isNotNull()), F.max("peak_rss")).alias("peak_rss_max"),
    ]
    return with_speedup(exact_medians(rated, keys, MEASURES, also=plain), keys)


def with_speedup(summary: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Adds the speedup against one worker with otherwise equal keys."""
    same = [k for k in keys if k != "workers"]
    base = summary.filter(F.col("workers") == 1).select(
        *same, F.col("wall_seconds_median").alias("_base")
    )
    return summary.join(base, same, "left").withColumn(
        "speedup_vs_one_worker", F.col("_base") / F.col("wall_seconds_median")
    ).drop("_base")


def study_totals(trials: DataFrame) -> DataFrame:
    """Totals per grid and for the whole study in one pass; ``grid_size`` NULL is the study."""
    return (
        trials.rollup("grid_size")
        .agg(
            F.grouping("grid_size").cast("int").alias("is_total"),
            F.count("*").alias("trials"),
            F.sum("completed_experiments").alias("successful_runs"),
            F.sum("failure_count").alias("failure_count"),
            F.sum(F.col("completed_experiments") + F.col("failure_count")).alias("fresh_runs"),
            F.sum("stored_bytes").alias("stored_bytes"),
        )
    )


def unequal_results(results: DataFrame) -> DataFrame:
    """Configurations whose digest, id or flag differs between trials.

    Grouped by configuration: equal results collapse before the shuffle, so there is no
    comparison of pairs.
    """
    outcome = F.struct("run_id", "values_sha256", "needs_review")
    return (
        results.groupBy("config_key")
        .agg(
            F.min(outcome).alias("_a"),
            F.max(outcome).alias("_b"),
            F.count("*").alias("trials"),
        )
        .filter(~F.col("_a").eqNullSafe(F.col("_b")))
        .select("config_key", "trials")
    )


def sample_aggregates(samples: DataFrame) -> DataFrame:
    """Memory of every sample: parent, children and their sum, with unreadable parts as NULL.

    ``samples``: ``trial_id, sample, process_id, is_parent, rss``. The sum counts readable
    processes only and is NULL when none was readable. No children is a measured zero;
    children that were all unreadable are NULL.
    """
    parent, readable = F.col("is_parent"), F.col("rss").isNotNull()
    child = ~parent
    per = samples.groupBy("trial_id", "sample").agg(
        F.sum(F.when(parent, F.col("rss"))).alias("parent_rss"),
        F.sum(F.when(child, F.col("rss"))).alias("_children"),
        F.sum("rss").alias("aggregate_rss"),
        F.count_if(child).alias("children"),
        F.count_if(~readable).alias("errors"),
    )
    return per.withColumn(
        "children_rss",
        F.when(F.col("children") == 0, F.lit(0).cast("long")).otherwise(F.col("_children")),
    ).drop("_children")


def sample_peaks(aggregates: DataFrame) -> DataFrame:
    """Peaks per trial. Each peak is of one sample; they need not add up."""
    return aggregates.groupBy("trial_id").agg(
        F.max("aggregate_rss").alias("peak_aggregate_rss"),
        F.max("parent_rss").alias("peak_parent_rss"),
        F.max("children_rss").alias("peak_children_rss"),
        F.max("children").alias("max_children"),
        F.count("*").alias("samples"),
        F.count_if(F.col("errors") > 0).alias("partial_samples"),
        F.sum("errors").alias("sampling_errors"),
    )


def audit_transfers(ranges: DataFrame, max_bytes: int, max_requests: int) -> DataFrame:
    """Bytes, requests, remaining budget and overlapping ranges per transfer.

    ``ranges``: ``transfer_id, start, end`` (inclusive) with ascending request starts.
    """
    after = with_neighbors(
        ranges.withColumn("_at", F.col("start")),
        ["transfer_id"],
        "_at",
        prev={"_before": "end"},
        width=OFFSET_WIDTH,
    )
    return after.groupBy("transfer_id").agg(
        F.sum(F.col("end") - F.col("start") + 1).alias("bytes_received"),
        F.count("*").alias("requests"),
        F.count_if(F.col("start") <= F.col("_before")).alias("overlapping_ranges"),
        (max_bytes - F.sum(F.col("end") - F.col("start") + 1)).alias("bytes_left"),
        (max_requests - F.count("*")).alias("requests_left"),
    )


def duplicate_ranges(ranges: DataFrame) -> DataFrame:
    """Identical byte ranges that were requested more than once."""
    return (
        ranges.groupBy("transfer_id", "start", "end")
        .agg(F.count("*").alias("copies"))
        .filter(F.col("copies") > 1)
    )
