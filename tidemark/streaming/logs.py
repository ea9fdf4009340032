"""Event logs, catalog tails, submissions and resource samples as streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.operators.studies import sample_aggregates
from tidemark.sources.catalog import path_exists
from tidemark.streaming import latest, run_to_table


def append_events(events: DataFrame, path: str) -> None:
    """Append event rows to a JSON log."""
    events.write.mode("append").json(path)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.EVENT_LOG).json(path)


def tail_events(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(schemas.EVENT_LOG).json(path)


def latest_status(events: DataFrame, time: str = "time", stage: str = "stage") -> DataFrame:
    """Latest status and number of events per stage; works on tables and streams."""
    return events.groupBy(stage).agg(
        F.max_by("status", time).alias("status"),
        F.max(time).alias("last_time"),
        F.count("*").alias("events"),
    )


def tail_catalog(spark: SparkSession, path: str, schema) -> DataFrame:
    """New catalog files as they are committed, without rescanning old ones."""
    return spark.readStream.schema(schema).parquet(path)


def new_submissions(batch: DataFrame, table: str, batch_id: int) -> DataFrame:
    """Jobs of a micro-batch that were never submitted before.

    Repeats inside the batch are dropped by id, repeats of earlier batches by anti-join with
    what they wrote. The batch's own folder is not looked at, so a replay gives the same rows.
    """
    first = batch.groupBy("job_id").agg(F.min(F.struct("at", "sequence")).alias("_f"))
    rows = first.select("job_id", "_f.sequence", "_f.at")
    if not path_exists(batch.sparkSession, f"{table}/batch_id=*"):
        return rows
    known = batch.sparkSession.read.parquet(table).filter(F.col("batch_id") < batch_id)
    return rows.join(known.select("job_id"), "job_id", "left_anti")


def distinct_submissions(events: DataFrame, time: str, delay: str) -> DataFrame:
    """The first submission of every job within the watermark delay."""
    return events.withWatermark(time, delay).dropDuplicatesWithinWatermark(["job_id"])


def follow_samples(samples: DataFrame) -> DataFrame:
    """Running per-sample memory of a stream, as the newest row of every sample."""
    table = run_to_table(sample_aggregates(samples), "samples", mode="update")
    return latest(table, ["trial_id", "sample"])


def windowed_counts(
    events: DataFrame, time: str, width: str, delay: str, *keys: str, slide: str | None = None
) -> DataFrame:
    """Rows per window and key; rows later than the watermark are dropped by Spark."""
    window: Column = F.window(time, width, slide) if slide else F.window(time, width)
    return (
        events.withWatermark(time, delay)
        .groupBy(window.alias("w"), *keys)
        .agg(F.count("*").alias("rows"))
        .select(F.col("w.start").alias("window_start"), *keys, "rows")
    )
