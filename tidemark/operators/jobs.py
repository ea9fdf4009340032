"""Job state from ordered queue events.

``events``: ``job_id, sequence, kind, at, token``. ``kind`` is submitted, claimed, renewed,
completed or failed; ``at`` is in the unit of ``lease``; a claim's token is its own, an
acknowledgement presents the token of the claim it belongs to. Sequence order is time order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.ordered import carry_forward, first_at_or_after
from tidemark.session import settle

# Job states in reporting order.
STATES = ("queued", "running", "completed", "failed")

SUMMARY = (
    "job_id",
    "status",
    "claim_count",
    "renewals",
    "lease_expirations",
    "lost_acknowledgements",
    "refused_claims",
    "duplicate_submissions",
    "lease_until",
)

# What the acknowledgement that finished a job says of its outcome, where events carry it.
RESULTS = ("result_id", "error", "resumed")

# Width in sequence numbers of the blocks in which acknowledgements are looked up.
BLOCK = 1 << 16


def job_states(events: DataFrame, lease: int) -> DataFrame:
    """One row per job: its state and what happened to its claims and acknowledgements.

    A claim takes effect on a queued job or after the lease of the one before is over; a claim
    within the lease is refused, also if it repeats the token. An acknowledgement takes effect
    within the lease if it presents the token of the claim that holds it; a NULL token never
    does. Events before the first submission change nothing. A job may have any number of
    events: none is ever brought together. Where events have ``result_id, error, resumed``, a finished
    job has those of the acknowledgement that finished it.
    """
    return _summarize(events, accepted_events(events, lease), lease)


def accepted_events(events: DataFrame, lease: int) -> DataFrame:
    """``(job_id, sequence)`` of the claims and acknowledgements that took effect.

    Which event takes effect after an accepted claim or renewal ``e`` does not depend on
    anything earlier: it is the next acknowledgement with the same token, which is not NULL, if
    that comes before ``e.at + lease``, otherwise the first claim at or after that time. These pointers are
    found without bringing a job together, and the path from each job's first claim is then
    marked by pointer doubling, in a logarithmic number of rounds.
    """
    first = (
        events.filter(F.col("kind") == "submitted")
        .groupBy("job_id")
        .agg(F.min("sequence").alias("_from"))
    )
    live = (
        events.join(first, "job_id")
        .filter((F.col("sequence") > F.col("_from")) & (F.col("kind") != "submitted"))
        .select("job_id", "sequence", "kind", "at", "token")
    )
    ack = F.col("kind").isin("renewed", "completed", "failed")
    # From back to front, the last acknowledgement before a row is the next one after it.
    linked = carry_forward(
        live.filter("token IS NOT NULL").withColumn("_back", -F.col("sequence")),
        ["job_id", "token"],
        "_back",
        F.when(ack, F.struct("sequence", "at")),
        "_next",
        width=BLOCK,
    ).unionByName(live.filter("token IS NULL"), allowMissingColumns=True)
    probes = linked.filter(F.col("kind").isin("claimed", "renewed")).select(
        "job_id",
        "sequence",
        F.col("_next.sequence").alias("_ack"),
        F.col("_next.at").alias("_ack_at"),
        (F.col("at") + lease).alias("at"),
    )
    claims = live.filter(F.col("kind") == "claimed").select("job_id", "at", "sequence")
    timed = first_at_or_after(probes, claims, "job_id", "at", "sequence", "_claim", width=lease)
    jump = settle(
        timed.select(
            "job_id",
            "sequence",
            F.when(F.col("_ack_at") < F.col("at"), F.col("_ack"))
            .otherwise(F.col("_claim"))
            .alias("to"),
        ).filter(F.col("to").isNotNull())
    )
    reach = settle(claims.groupBy("job_id").agg(F.min("sequence").alias("sequence")))
    while True:
        step = reach.join(jump, ["job_id", "sequence"]).select(
            "job_id", F.col("to").alias("sequence")
        )
        fresh = settle(step.join(reach, ["job_id", "sequence"], "left_anti").distinct())
        if fresh.isEmpty():
            return reach
        reach = settle(reach.unionByName(fresh))
        further = jump.select("job_id", F.col("sequence").alias("to"), F.col("to").alias("_next"))
        jump = settle(
            jump.join(further, ["job_id", "to"]).select(
                "job_id", "sequence", F.col("_next").alias("to")
            )
        )


def _summarize(events: DataFrame, accepted: DataFrame, lease: int) -> DataFrame:
    """Job rows from all events and the set of accepted ones."""
    marked = events.join(
        accepted.withColumn("_ok", F.lit(True)), ["job_id", "sequence"], "left"
    ).withColumn("_ok", F.coalesce("_ok", F.lit(False)))
    ok, kind = F.col("_ok"), F.col("kind")
    ack = kind.isin("renewed", "completed", "failed")
    last = F.when(ok, F.col("sequence"))
    results = [c for c in RESULTS if c in events.columns]
    out = marked.groupBy("job_id").agg(
        *[F.max_by(c, last).alias(c) for c in results],
        F.max_by("kind", last).alias("_kind"),
        F.max_by("at", last).alias("_at"),
        F.count_if(ok & (kind == "claimed")).alias("claim_count"),
        F.count_if(ok & (kind == "renewed")).alias("renewals"),
        F.count_if(ack & ~ok).alias("lost_acknowledgements"),
        F.count_if((kind == "claimed") & ~ok).alias("refused_claims"),
        F.count_if(kind == "submitted").alias("_submitted"),
    )
    finished = F.col("_kind").isin("completed", "failed")
    return out.select(
        "job_id",
        F.when(finished, F.col("_kind"))
        .when(F.col("_kind").isNotNull(), "running")
        .when(F.col("_submitted") > 0, "queued")
        .alias("status"),
        "claim_count",
        "renewals",
        # every claim after the first took over an expired lease
        F.greatest(F.col("claim_count") - 1, F.lit(0)).cast("long").alias("lease_expirations"),
        "lost_acknowledgements",
        "refused_claims",
        F.greatest(F.col("_submitted") - 1, F.lit(0)).cast("long").alias("duplicate_submissions"),
        F.when(~finished, F.col("_at") + lease).alias("lease_until"),
        *[F.when(finished, F.col(c)).alias(c) for c in results],
    )


def state_counts(jobs: DataFrame, now: Column) -> DataFrame:
    """Jobs per state, zero states included, with the running ones whose lease is over."""
    spark = jobs.sparkSession
    states = spark.createDataFrame([(s,) for s in STATES], "status string")
    counts = jobs.groupBy("status").agg(
        F.count("*").alias("jobs"),
        F.count_if((F.col("status") == "running") & (F.col("lease_until") <= now)).alias(
            "expired_leases"
        ),
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return states.join(counts, "status", "left").select(
        "status", zero("jobs"), zero("expired_leases")
    )


def claimable(jobs: DataFrame, count: int, created: str = "created_at") -> DataFrame:
    """The oldest queued jobs, ties by id."""
    return jobs.filter(F.col("status") == "queued").orderBy(created, "job_id").limit(count)
