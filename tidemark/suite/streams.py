"""Streaming queries; each processes what is available and is compared with plain SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import streaming
from tidemark.functions import exprs
from tidemark.operators import fields, studies
from tidemark.session import store
from tidemark.sources import driver_tables as dt
from tidemark.sources import mirror
from tidemark.streaming import logs, stateful
from tidemark.suite import jobs as job_suite
from tidemark.suite import query
from tidemark.suite.studies import SAMPLE_SQL

SLICES = 3


@query(
    "stream_job_states",
    dt.with_views("job_events", recursive=True)
    + job_suite.JOB_SQL
    + """ SELECT job_id, status, claim_count, renewals, lease_expirations, lost_acknowledgements, refused_claims, duplicate_submissions, lease_until FROM states""",
)
def stream_job_states(spark, sf_dir):
    """Job leases followed over several micro-batches of the event table."""
    events = store(job_suite.job_events(spark, sf_dir))  # every slice reads it
    path = streaming.scratch(spark, "job-events")
    base = streaming.scratch(spark, "job-outcomes")
    top = dt.table(spark, sf_dir, "events").agg(F.max("event_id")).first()[0]
    # Every slice is written, then followed by a query that resumes where the last one ended.
    for i in range(SLICES):
        low, high = top * i // SLICES, top * (i + 1) // SLICES
        part = events.filter(
            (F.col("sequence") > low if i else F.lit(True)) & (F.col("sequence") <= high)
        )
        part.repartition("job_id").write.mode("append").parquet(path)
        stream = spark.readStream.schema(events.schema).parquet(path)
        outcomes = stateful.job_outcomes(stream, job_suite.LEASE)
        streaming.drain(streaming.write_batches(outcomes, f"{base}/table", f"{base}/checkpoint"))
    return stateful.outcome_states(streaming.read_batches(spark, f"{base}/table"))


@query(
    "stream_lease_expirations",
    dt.with_views("job_events", recursive=True)
    + job_suite.JOB_SQL
    + """ SELECT job_id, lease_until, claim_count, status FROM states
WHERE status = 'running' AND lease_until <= (SELECT max(moment) FROM job_events)""",
)
def stream_lease_expirations(spark, sf_dir):
    """Leases that ran out although their job has no further event."""
    events = job_suite.job_events(spark, sf_dir)
    path = streaming.scratch(spark, "job-events")
    rows = events.withColumn("moment", F.timestamp_micros("at"))
    rows.repartition("job_id").write.parquet(path)
    stream = spark.readStream.schema(rows.schema).parquet(path)
    out = streaming.run_to_table(stateful.watched_outcomes(stream, job_suite.LEASE, "moment"), "leases")
    return out.filter(F.col("outcome") == "lease_expired").select("job_id", "lease_until", "claim_count", "status")


@query(
    "stream_frame_arrivals",
    """WITH f AS (SELECT vec_id // 25 AS run_id, vec_id, 20 + (vec_id // 25) % 8 AS expected FROM embeddings),
g AS (SELECT run_id, expected, count(*) FILTER (vec_id % 59 <> 0) AS good, count(*) FILTER (vec_id % 59 = 0) AS bad FROM f GROUP BY run_id, expected)
SELECT run_id, CASE WHEN good >= expected THEN 1 ELSE 0 END AS complete, greatest(good - expected, 0) AS excess, bad AS nonfinite FROM g
WHERE good >= expected OR bad > 0""",
)
def stream_frame_arrivals(spark, sf_dir):
    run = F.expr("vec_id div 25")
    stream = streaming.stream_table(spark, sf_dir, "embeddings").select(
        run.alias("run_id"),
        (F.col("vec_id") % 25).cast("int").alias("frame"),
        F.when(
            F.col("vec_id") % 59 == 0,
            F.transform("embedding", lambda v, i: F.when(i == 3, float("nan")).otherwise(v)),
        )
        .otherwise(F.col("embedding"))
        .cast("array<double>")
        .alias("values"),
        (20 + run % 8).alias("expected"),
    )
    out = streaming.run_to_table(stateful.frame_arrivals(stream), "arrivals")
    return out.groupBy("run_id").agg(
        F.count_if(F.col("outcome") == "complete").alias("complete"),
        F.count_if(F.col("outcome") == "excess").alias("excess"),
        F.count_if(F.col("outcome") == "nonfinite").alias("nonfinite"),
    )


@query(
    "stream_frame_diagnostics",
    dt.with_views("frames")
    + """ SELECT run_id, frame, round(list_sum(vals) / 64, 9) AS mean_velocity,
  round(0.5 * list_sum(list_transform(vals, lambda v: v * v)) / 64, 9) AS energy FROM frames""",
)
def stream_frame_diagnostics(spark, sf_dir):
    frames = dt.frames_of(streaming.stream_table(spark, sf_dir, "embeddings"))
    table = streaming.run_to_table(
        fields.burgers_diagnostics(frames, F.lit(64.0)), "diagnostics"
    )
    return table.select(
        "run_id",
        "frame",
        F.round("mean_velocity", 9).alias("mean_velocity"),
        F.round("energy", 9).alias("energy"),
    )


@query(
    "stream_submissions",
    """SELECT user_id AS job_id, min(event_id) AS sequence FROM events WHERE event_type = 'signup' GROUP BY user_id""",
)
def stream_submissions(spark, sf_dir):
    events = dt.job_events_of(streaming.stream_table(spark, sf_dir, "events"))
    base = streaming.scratch(spark, "submissions")
    submitted = events.filter(F.col("kind") == "submitted").select("job_id", "sequence", "at")
    table = f"{base}/table"
    streaming.drain(
        streaming.write_batches(
            submitted,
            table,
            f"{base}/checkpoint",
            prepare=lambda rows, batch_id: logs.new_submissions(rows, table, batch_id),
        )
    )
    return streaming.read_batches(spark, table).select("job_id", "sequence")


@query(
    "stream_first_submissions",
    """SELECT user_id AS job_id, min(event_id) AS sequence FROM events WHERE event_type = 'signup' GROUP BY user_id""",
)
def stream_first_submissions(spark, sf_dir):
    """First submissions over several batches, each of which looks only at its own jobs."""
    submitted = dt.job_events(spark, sf_dir).filter("kind = 'submitted'").select("job_id", "sequence", "at")
    path, base = streaming.scratch(spark, "submitted"), streaming.scratch(spark, "first-submissions")
    top = dt.table(spark, sf_dir, "events").agg(F.max("event_id")).first()[0]
    for i in range(SLICES):
        low, high = top * i // SLICES, top * (i + 1) // SLICES
        lower = F.col("sequence") > low if i else F.lit(True)
        submitted.filter(lower & (F.col("sequence") <= high)).write.mode("append").parquet(path)
        stream = spark.readStream.schema(submitted.schema).parquet(path)
        found = stateful.first_submissions(stream)
        streaming.drain(streaming.write_batches(found, f"{base}/table", f"{base}/checkpoint"))
    return streaming.read_batches(spark, f"{base}/table").select("job_id", "sequence")


@query(
    "stream_distinct_submissions",
    """SELECT DISTINCT user_id AS job_id FROM events WHERE event_type = 'signup'""",
)
def stream_distinct_submissions(spark, sf_dir):
    events = streaming.stream_table(spark, sf_dir, "events").filter("event_type = 'signup'")
    rows = events.select(F.col("user_id").alias("job_id"), F.col("ts").cast("timestamp").alias("at"))
    out = streaming.run_to_table(logs.distinct_submissions(rows, "at", "60 days"), "distinct")
    return out.select("job_id")


@query(
    "stream_catalog_tail",
    dt.with_views("runs") + " SELECT status, equation, count(*) AS runs FROM runs GROUP BY status, equation",
)
def stream_catalog_tail(spark, sf_dir):
    runs = dt.runs(spark, sf_dir).select("id", "status", "equation")
    base = streaming.scratch(spark, "catalog-tail")
    runs.filter(F.col("status") == "completed").write.mode("append").parquet(f"{base}/catalog")
    tail = lambda: streaming.drain(
        streaming.write_batches(
            logs.tail_catalog(spark, f"{base}/catalog", runs.schema),
            f"{base}/seen",
            f"{base}/checkpoint",
        )
    )
    tail()
    runs.filter(F.col("status") != "completed").write.mode("append").parquet(f"{base}/catalog")
    tail()  # continues after the last committed file
    seen = streaming.read_batches(spark, f"{base}/seen")
    return seen.groupBy("status", "equation").agg(F.count("*").alias("runs"))


@query(
    "stream_stage_status",
    """SELECT event_type AS stage, arg_max('s' || user_id, ts) AS status, count(*) AS events FROM events GROUP BY event_type""",
)
def stream_stage_status(spark, sf_dir):
    log = streaming.stream_table(spark, sf_dir, "events").select(
        F.col("event_type").alias("stage"),
        F.concat(F.lit("s"), "user_id").alias("status"),
        F.col("ts").alias("time"),
    )
    table = streaming.run_to_table(logs.latest_status(log), "stages", mode="update")
    return streaming.latest(table, ["stage"]).select("stage", "status", "events")


@query(
    "stream_sample_peaks",
    dt.with_views("samples")
    + SAMPLE_SQL
    + """ SELECT trial_id, CAST(max(aggregate_rss) AS BIGINT) AS peak_aggregate_rss, CAST(max(parent_rss) AS BIGINT) AS peak_parent_rss,
  CAST(max(children_rss) AS BIGINT) AS peak_children_rss, max(children) AS max_children, count(*) AS samples,
  count(*) FILTER (errors > 0) AS partial_samples, CAST(sum(errors) AS BIGINT) AS sampling_errors FROM per GROUP BY trial_id""",
)
def stream_sample_peaks(spark, sf_dir):
    stream = dt.samples_of(streaming.stream_table(spark, sf_dir, "events"))
    return studies.sample_peaks(logs.follow_samples(stream))


@query(
    "stream_compacted_samples",
    dt.with_views("samples")
    + SAMPLE_SQL
    + """ SELECT trial_id, sample, CAST(aggregate_rss AS BIGINT) AS aggregate_rss, children, errors FROM per""",
)
def stream_compacted_samples(spark, sf_dir):
    """Running sample memory over several batches, read from a snapshot and what follows it."""
    samples = dt.samples_of(dt.table(spark, sf_dir, "events")).withColumn("_slice", F.col("process_id") % SLICES)
    path, base = streaming.scratch(spark, "samples"), streaming.scratch(spark, "sample-table")
    keys = ["trial_id", "sample"]
    for i in range(SLICES):
        samples.filter(F.col("_slice") == i).drop("_slice").write.mode("append").parquet(path)
        stream = spark.readStream.schema(samples.drop("_slice").schema).parquet(path)
        table = studies.sample_aggregates(stream)
        streaming.drain(streaming.write_batches(table, f"{base}/table", f"{base}/checkpoint", mode="update"))
        streaming.compact(spark, f"{base}/table", keys, after=2)
    out = streaming.latest_table(spark, f"{base}/table", keys)
    return out.select(
        *keys,
        F.col("aggregate_rss").cast("long").alias("aggregate_rss"),
        F.col("children").cast("long").alias("children"),
        F.col("errors").cast("long").alias("errors"),
    )


@query(
    "stream_batch_callbacks",
    dt.with_views("frames")
    + """ SELECT run_id, count(*) AS frames, round(sum(list_sum(vals)), 6) AS total FROM frames GROUP BY run_id""",
)
def stream_batch_callbacks(spark, sf_dir):
    """A callback for every micro-batch of saved frames that keeps sums for each run."""
    source = dt.frames(spark, sf_dir)
    path, base = streaming.scratch(spark, "saved-frames"), streaming.scratch(spark, "callbacks")
    for half in (0, 1):
        source.filter(F.col("frame") % 2 == half).write.mode("append").parquet(path)

        def keep(rows, batch_id):
            sums = rows.groupBy("run_id").agg(F.count("*").alias("frames"), F.sum(exprs.total("values")).alias("total"))
            sums.write.mode("overwrite").parquet(f"{base}/sums/batch_id={batch_id}")

        stream = spark.readStream.schema(source.schema).parquet(path)
        streaming.drain(streaming.for_each_batch(stream, keep, f"{base}/checkpoint"))
    sums = streaming.read_batches(spark, f"{base}/sums")
    return sums.groupBy("run_id").agg(F.sum("frames").alias("frames"), F.round(F.sum("total"), 6).alias("total"))


@query(
    "stream_window_counts",
    """SELECT event_type, CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS window_start, count(*) AS rows FROM events GROUP BY 1, 2""",
)
def stream_window_counts(spark, sf_dir):
    events = streaming.stream_table(spark, sf_dir, "events").select(
        F.col("ts").cast("timestamp").alias("ts"), "event_type"
    )
    counts = logs.windowed_counts(events, "ts", "1 hour", "30 days", "event_type")
    table = streaming.run_to_table(counts, "windows", mode="update")
    return streaming.latest(table, ["window_start", "event_type"]).select(
        "event_type", F.unix_seconds("window_start").alias("window_start"), "rows"
    )


# -- mirror plans -----------------------------------------------------------------


@query(
    "mirror_plan",
    dt.with_views("manifest", "artifacts")
    + """, l AS (SELECT 'team/experiments/run-' || run_id || '/' || path AS key, sha256 FROM artifacts),
r AS (SELECT 'team/experiments/run-' || run_id || '/' || path AS key, sha256 FROM manifest)
SELECT coalesce(l.key, r.key) AS key, CASE WHEN l.key IS NULL THEN 'extra' WHEN r.key IS NULL THEN 'upload' WHEN l.sha256 = r.sha256 THEN 'reuse' ELSE 'conflict' END AS action
FROM l FULL JOIN r ON l.key = r.key""",
)
def mirror_plan(spark, sf_dir):
    key = F.concat(F.lit("team/experiments/run-"), "run_id", F.lit("/"), "path").alias("key")
    local = dt.artifacts(spark, sf_dir).select(key, "sha256")
    remote = dt.manifest_entries(spark, sf_dir).select(key, "sha256")
    return mirror.mirror_plan(local, remote)


@query(
    "mirror_ready_runs",
    dt.with_views("manifest", "artifacts")
    + """, p AS (SELECT a.run_id, a.path AS key, CASE WHEN m.path IS NULL THEN 'upload' WHEN a.sha256 = m.sha256 THEN 'reuse' ELSE 'conflict' END AS action
  FROM artifacts a LEFT JOIN manifest m ON a.run_id = m.run_id AND a.path = m.path)
SELECT run_id, key, action FROM p WHERE run_id NOT IN (SELECT run_id FROM p WHERE action = 'conflict')""",
)
def mirror_ready_runs(spark, sf_dir):
    local = dt.artifacts(spark, sf_dir).select("run_id", F.col("path").alias("key"), "sha256")
    remote = dt.manifest_entries(spark, sf_dir).select(F.col("path").alias("key"), "sha256")
    plan = mirror.mirror_plan(local, remote).filter(F.col("action") != "extra")
    return mirror.ready_runs(local.select("run_id", "key").join(plan, "key"))


@query(
    "mirror_restorable",
    dt.with_views("manifest", "artifacts")
    + """, bad AS (SELECT DISTINCT coalesce(m.run_id, a.run_id) AS run_id FROM manifest m FULL JOIN artifacts a ON m.run_id = a.run_id AND m.path = a.path
  WHERE m.sha256 IS DISTINCT FROM a.sha256)
SELECT o_orderkey AS run_id, CASE WHEN o_orderkey % 5 = 0 THEN 'download' WHEN o_orderkey IN (SELECT run_id FROM bad) THEN 'refuse: failed verification'
  WHEN o_orderkey % 7 = 0 THEN 'refuse: different manifest' ELSE 'resumed' END AS action FROM orders""",
)
def mirror_restorable(spark, sf_dir):
    from tidemark.operators.integrity import artifact_problems

    o = dt.table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    digest = F.sha2(F.col("o_custkey").cast("string"), 256)
    remote = o.select(k.alias("run_id"), digest.alias("manifest_sha256"))
    local = o.filter(k % 5 != 0).select(
        k.alias("run_id"),
        F.when(k % 7 == 0, F.lit("other")).otherwise(digest).alias("manifest_sha256"),
    )
    problems = artifact_problems(dt.manifest_entries(spark, sf_dir), dt.artifacts(spark, sf_dir))
    return mirror.restorable(remote, local, problems)
