"""Queries on job states folded from queue events."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.exprs import epoch_seconds, from_iso_text, iso_text
from tidemark.functions.ordered import carry_forward
from tidemark.operators import jobs
from tidemark.sources import driver_tables as dt
from tidemark.suite import query

LEASE = 6 * 3600 * 1_000_000
NOW = 1_706_700_000_000_000

TOKEN_SQL = """, ev AS (SELECT job_id, sequence, kind, moment, CASE WHEN kind = 'claimed' THEN CAST(sequence AS VARCHAR)
    WHEN kind = 'submitted' THEN NULL WHEN stale THEN 'stale'
    ELSE CAST(last_value(CASE WHEN kind = 'claimed' THEN sequence END IGNORE NULLS) OVER (PARTITION BY job_id ORDER BY sequence
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS VARCHAR) END AS token FROM job_events),"""

# Few tokens that come again, some NULL, and one job with a third of all events.
HARD_SQL = """, ev AS (SELECT CASE WHEN sequence % 3 = 0 THEN -1 ELSE job_id END AS job_id, sequence, kind, moment,
    CASE WHEN sequence % 7 = 0 OR kind = 'submitted' THEN NULL WHEN stale THEN 'stale' ELSE CAST(sequence // 40 % 4 AS VARCHAR) END AS token
  FROM job_events),"""

FOLD_SQL = f"""
ordered AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY sequence) AS n FROM ev),
fold AS (SELECT DISTINCT job_id, CAST(0 AS BIGINT) AS n, CAST(NULL AS VARCHAR) AS status, CAST(NULL AS VARCHAR) AS token, CAST(NULL AS BIGINT) AS lease_until,
    0 AS claim_count, 0 AS renewals, 0 AS lease_expirations, 0 AS lost_acknowledgements, 0 AS refused_claims, 0 AS duplicate_submissions FROM ev
  UNION ALL
  SELECT job_id, n, CASE WHEN kind = 'submitted' AND status IS NULL THEN 'queued' WHEN claim THEN 'running' WHEN held AND kind <> 'renewed' THEN kind ELSE status END,
    CASE WHEN claim THEN new_token WHEN held AND kind <> 'renewed' THEN NULL ELSE token END,
    CASE WHEN claim OR (held AND kind = 'renewed') THEN moment + {LEASE} WHEN held THEN NULL ELSE lease_until END,
    claim_count + claim::INT, renewals + (held AND kind = 'renewed')::INT, lease_expirations + (claim AND coalesce(status = 'running', FALSE))::INT,
    lost_acknowledgements + (kind IN ('renewed', 'completed', 'failed') AND NOT held)::INT, refused_claims + (kind = 'claimed' AND NOT claim)::INT,
    duplicate_submissions + (kind = 'submitted' AND status IS NOT NULL)::INT
  FROM (SELECT f.*, o.n AS next_n, o.kind, o.moment, o.token AS new_token,
      o.kind = 'claimed' AND coalesce(f.status = 'queued' OR (f.status = 'running' AND f.lease_until <= o.moment), FALSE) AS claim,
      o.kind IN ('renewed', 'completed', 'failed') AND coalesce(f.status = 'running' AND f.lease_until > o.moment AND f.token = o.token, FALSE) AS held
    FROM fold f JOIN ordered o ON f.job_id = o.job_id AND o.n = f.n + 1) AS step(job_id, old_n, status, token, lease_until, claim_count, renewals, lease_expirations,
      lost_acknowledgements, refused_claims, duplicate_submissions, n, kind, moment, new_token, claim, held)),
states AS (SELECT job_id, arg_max(status, n) AS status, max(claim_count) AS claim_count, max(renewals) AS renewals, max(lease_expirations) AS lease_expirations,
    max(lost_acknowledgements) AS lost_acknowledgements, max(refused_claims) AS refused_claims, max(duplicate_submissions) AS duplicate_submissions,
    max(lease_until) FILTER (last) AS lease_until FROM (SELECT *, n = max(n) OVER (PARTITION BY job_id) AS last FROM fold) GROUP BY job_id)"""


JOB_SQL = TOKEN_SQL + FOLD_SQL


def tokens(events):
    """An acknowledgement presents the latest claim before it, unless it is stale."""
    with_claim = carry_forward(
        events,
        ["job_id"],
        "sequence",
        F.when(F.col("kind") == "claimed", F.col("sequence")),
        "_claim",
        width=1 << 20,
    )
    token = (
        F.when(F.col("kind") == "claimed", F.col("sequence").cast("string"))
        .when(F.col("kind") == "submitted", F.lit(None))
        .when(F.col("stale"), F.lit("stale"))
        .otherwise(F.col("_claim").cast("string"))
    )
    return with_claim.select("job_id", "sequence", "kind", "at", token.alias("token"))


def job_events(spark, sf_dir):
    return tokens(dt.job_events(spark, sf_dir))


@query(
    "job_states",
    dt.with_views("job_events", recursive=True) + JOB_SQL + f" SELECT {', '.join(jobs.SUMMARY)} FROM states",
)
def job_states(spark, sf_dir):
    return jobs.job_states(job_events(spark, sf_dir), LEASE)


@query(
    "job_states_by_pointers",
    dt.with_views("job_events", recursive=True) + JOB_SQL + f" SELECT {', '.join(jobs.SUMMARY)} FROM states",
)
def job_states_by_pointers(spark, sf_dir):
    """The same states, counted from the events that took effect."""
    events = job_events(spark, sf_dir)
    return jobs.job_states(events.repartition("sequence"), LEASE)


@query(
    "job_states_hard_tokens",
    dt.with_views("job_events", recursive=True) + HARD_SQL + FOLD_SQL + f" SELECT {', '.join(jobs.SUMMARY)} FROM states",
)
def job_states_hard_tokens(spark, sf_dir):
    """Repeated, NULL and stale tokens, events before submission, a job with a third of all."""
    events = dt.job_events(spark, sf_dir)
    number = F.col("sequence")
    token = (
        F.when((number % 7 == 0) | (F.col("kind") == "submitted"), F.lit(None))
        .when(F.col("stale"), "stale")
        .otherwise((F.floor(number / 40) % 4).cast("string"))
    )
    job = F.when(number % 3 == 0, F.lit(-1)).otherwise(F.col("job_id"))
    hard = events.select(job.alias("job_id"), "sequence", "kind", "at", token.alias("token"))
    return jobs.job_states(hard, LEASE)


@query(
    "job_results",
    dt.with_views("job_events", recursive=True)
    + JOB_SQL
    + """, done AS (SELECT f.job_id, o.sequence, o.kind FROM fold f JOIN fold p ON p.job_id = f.job_id AND p.n = f.n - 1
    JOIN ordered o ON o.job_id = f.job_id AND o.n = f.n WHERE f.status IN ('completed', 'failed') AND p.status = 'running')
SELECT s.job_id, s.status, CASE WHEN kind = 'completed' THEN 'run-' || sequence END AS result_id,
  CASE WHEN kind = 'failed' THEN '{"type":"E' || sequence % 5 || '"}' END AS error, CASE WHEN kind = 'completed' THEN sequence % 4 = 0 END AS resumed
FROM states s LEFT JOIN done d ON s.job_id = d.job_id""",
)
def job_results(spark, sf_dir):
    """What the acknowledgement that finished a job said; late and stale ones say nothing."""
    events = job_events(spark, sf_dir)
    number, kind = F.col("sequence"), F.col("kind")
    told = events.withColumns(
        {
            "result_id": F.when(kind == "completed", F.concat(F.lit("run-"), number)),
            "error": F.when(kind == "failed", F.concat(F.lit('{"type":"E'), number % 5, F.lit('"}'))),
            "resumed": F.when(kind == "completed", number % 4 == 0),
        }
    )
    return jobs.job_states(told, LEASE).select("job_id", "status", *jobs.RESULTS)


@query(
    "job_state_counts",
    dt.with_views("job_events", recursive=True)
    + JOB_SQL
    + f""" SELECT s.status, count(j.job_id) AS jobs, count(*) FILTER (j.status = 'running' AND j.lease_until <= {NOW}) AS expired_leases
FROM (SELECT unnest(['queued', 'running', 'completed', 'failed']) AS status) s LEFT JOIN states j ON s.status = j.status GROUP BY s.status""",
)
def job_state_counts(spark, sf_dir):
    return jobs.state_counts(jobs.job_states(job_events(spark, sf_dir), LEASE), F.lit(NOW))


@query(
    "claimable_jobs",
    dt.with_views("runs")
    + " SELECT run_id AS job_id, created_at FROM runs WHERE status = 'queued' ORDER BY created_at, run_id LIMIT 20",
)
def claimable_jobs(spark, sf_dir):
    queue = dt.runs(spark, sf_dir).select(F.col("run_id").alias("job_id"), "status", "created_at")
    return jobs.claimable(queue, 20).select("job_id", "created_at")


@query(
    "event_times",
    """SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f+00:00') AS iso, epoch_us(ts) / 1e6::DOUBLE AS seconds, TRUE AS round_trip FROM events""",
)
def event_times(spark, sf_dir):
    moment = F.col("ts").cast("timestamp")
    iso = iso_text(moment)
    return dt.table(spark, sf_dir, "events").select(
        "event_id",
        iso.alias("iso"),
        epoch_seconds(moment).alias("seconds"),
        (from_iso_text(iso) == moment).alias("round_trip"),
    )
