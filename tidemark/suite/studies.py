"""Queries on benchmark trials, resource samples and transfers."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import studies
from tidemark.sources import driver_tables as dt
from tidemark.suite import query

TRIAL_SQL = """, rated AS (SELECT *, 3600.0::DOUBLE / wall_seconds * completed_experiments AS runs_per_hour,
  3600.0::DOUBLE / wall_seconds * (completed_experiments + failure_count) AS attempts_per_hour FROM trials),
summary AS (SELECT grid_size, mode, workers, count(*) AS trials, min(wall_seconds) AS wall_seconds_min, max(wall_seconds) AS wall_seconds_max,
  quantile_cont(wall_seconds, 0.5) AS wall_seconds_median, quantile_cont(verified_reuse_seconds, 0.5) AS verified_reuse_seconds_median,
  quantile_cont(CAST(stored_bytes AS DOUBLE), 0.5) AS stored_bytes_median, quantile_cont(runs_per_hour, 0.5) AS runs_per_hour_median,
  quantile_cont(attempts_per_hour, 0.5) AS attempts_per_hour_median, min(verified_reuse_seconds) AS verified_reuse_seconds_min,
  max(verified_reuse_seconds) AS verified_reuse_seconds_max, min(stored_bytes) AS stored_bytes_min, max(stored_bytes) AS stored_bytes_max,
  CAST(sum(completed_experiments) AS BIGINT) AS completed_experiments, CAST(sum(failure_count) AS BIGINT) AS failure_count,
  CAST(sum(sampling_errors) AS BIGINT) AS sampling_errors, CASE WHEN count(*) = count(peak_rss) THEN max(peak_rss) END AS peak_rss_max
  FROM rated GROUP BY grid_size, mode, workers)"""

ROUNDED = (
    "wall_seconds_median",
    "verified_reuse_seconds_median",
    "stored_bytes_median",
    "runs_per_hour_median",
    "attempts_per_hour_median",
)
PLAIN = (
    "trials",
    "wall_seconds_min",
    "wall_seconds_max",
    "verified_reuse_seconds_min",
    "verified_reuse_seconds_max",
    "stored_bytes_min",
    "stored_bytes_max",
    "completed_experiments",
    "failure_count",
    "sampling_errors",
    "peak_rss_max",
)


@query(
    "trial_summary",
    dt.with_views("trials")
    + TRIAL_SQL
    + " SELECT s.grid_size, s.mode, s.workers, "
    + ", ".join(f"s.{c}" for c in PLAIN)
    + ", "
    + ", ".join(f"round(s.{c}, 6) AS {c}" for c in ROUNDED)
    + """, round(b.wall_seconds_median / s.wall_seconds_median, 9) AS speedup_vs_one_worker
FROM summary s LEFT JOIN summary b ON s.grid_size = b.grid_size AND s.mode = b.mode AND b.workers = 1""",
)
def trial_summary(spark, sf_dir):
    out = studies.summarize_trials(dt.trials(spark, sf_dir))
    return out.select(
        "grid_size",
        "mode",
        "workers",
        *PLAIN,
        *[F.round(c, 6).alias(c) for c in ROUNDED],
        F.round("speedup_vs_one_worker", 9).alias("speedup_vs_one_worker"),
    )


@query(
    "trial_throughput",
    dt.with_views("trials")
    + TRIAL_SQL
    + """ SELECT grid_size, round(max(runs_per_hour), 6) AS best_runs_per_hour, round(max(attempts_per_hour), 6) AS best_attempts_per_hour
FROM rated GROUP BY grid_size""",
)
def trial_throughput(spark, sf_dir):
    return (
        studies.throughput(dt.trials(spark, sf_dir))
        .groupBy("grid_size")
        .agg(
            F.round(F.max("runs_per_hour"), 6).alias("best_runs_per_hour"),
            F.round(F.max("attempts_per_hour"), 6).alias("best_attempts_per_hour"),
        )
    )


@query(
    "study_totals",
    dt.with_views("trials")
    + """ SELECT grid_size, grouping(grid_size) AS is_total, count(*) AS trials, CAST(sum(completed_experiments) AS BIGINT) AS successful_runs,
  CAST(sum(failure_count) AS BIGINT) AS failure_count, CAST(sum(completed_experiments + failure_count) AS BIGINT) AS fresh_runs,
  CAST(sum(stored_bytes) AS BIGINT) AS stored_bytes FROM trials GROUP BY ROLLUP (grid_size)""",
)
def study_totals(spark, sf_dir):
    return studies.study_totals(dt.trials(spark, sf_dir))


@query(
    "unequal_results",
    """SELECT l_partkey AS config_key, count(*) AS trials FROM lineitem GROUP BY l_partkey
HAVING count(DISTINCT CASE WHEN l_orderkey % 997 = 0 THEN 'x' ELSE 'same' END) > 1""",
)
def unequal_results(spark, sf_dir):
    results = dt.table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("config_key"),
        F.col("l_partkey").alias("run_id"),
        F.sha2(F.when(F.col("l_orderkey") % 997 == 0, "x").otherwise("same"), 256).alias(
            "values_sha256"
        ),
        F.lit(False).alias("needs_review"),
    )
    return studies.unequal_results(results)


SAMPLE_SQL = """, per AS (SELECT trial_id, sample, sum(rss) FILTER (is_parent) AS parent_rss, sum(rss) AS aggregate_rss,
  CASE WHEN count(*) FILTER (NOT is_parent) = 0 THEN 0 ELSE sum(rss) FILTER (NOT is_parent) END AS children_rss,
  count(*) FILTER (NOT is_parent) AS children, count(*) FILTER (rss IS NULL) AS errors FROM samples GROUP BY trial_id, sample)"""


@query(
    "sample_aggregates",
    dt.with_views("samples")
    + SAMPLE_SQL
    + """ SELECT trial_id, sample, CAST(parent_rss AS BIGINT) AS parent_rss, CAST(aggregate_rss AS BIGINT) AS aggregate_rss,
  CAST(children_rss AS BIGINT) AS children_rss, children, errors FROM per""",
)
def sample_aggregates(spark, sf_dir):
    return studies.sample_aggregates(dt.samples(spark, sf_dir))


@query(
    "sample_peaks",
    dt.with_views("samples")
    + SAMPLE_SQL
    + """ SELECT trial_id, CAST(max(aggregate_rss) AS BIGINT) AS peak_aggregate_rss, CAST(max(parent_rss) AS BIGINT) AS peak_parent_rss,
  CAST(max(children_rss) AS BIGINT) AS peak_children_rss, max(children) AS max_children, count(*) AS samples,
  count(*) FILTER (errors > 0) AS partial_samples, CAST(sum(errors) AS BIGINT) AS sampling_errors FROM per GROUP BY trial_id""",
)
def sample_peaks(spark, sf_dir):
    return studies.sample_peaks(studies.sample_aggregates(dt.samples(spark, sf_dir)))


@query(
    "transfer_audit",
    dt.with_views("ranges")
    + """, seen AS (SELECT *, lag("end") OVER (PARTITION BY transfer_id ORDER BY "start") AS before FROM ranges)
SELECT transfer_id, CAST(sum("end" - "start" + 1) AS BIGINT) AS bytes_received, count(*) AS requests, count(*) FILTER ("start" <= before) AS overlapping_ranges,
  CAST(1000000 - sum("end" - "start" + 1) AS BIGINT) AS bytes_left, 512 - count(*) AS requests_left FROM seen GROUP BY transfer_id""",
)
def transfer_audit(spark, sf_dir):
    return studies.audit_transfers(dt.transfer_ranges(spark, sf_dir), 1_000_000, 512)


@query(
    "duplicate_ranges",
    """SELECT l_suppkey AS transfer_id, l_partkey * 100 AS start, l_partkey * 100 + 99 AS "end", count(*) AS copies
FROM lineitem GROUP BY l_suppkey, l_partkey HAVING count(*) > 1""",
)
def duplicate_ranges(spark, sf_dir):
    ranges = dt.table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("transfer_id"),
        (F.col("l_partkey") * 100).alias("start"),
        (F.col("l_partkey") * 100 + 99).alias("end"),
    )
    return studies.duplicate_ranges(ranges)
