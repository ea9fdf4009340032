"""Keyed state: frame arrival and job leases."""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator
from itertools import groupby
from operator import itemgetter

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.functions.exprs import all_finite

# The driver starts a worker for every stream that imports nothing shipped with addPyFile, so the
# processors of this module travel by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

ARRIVALS = "run_id long, frame int, outcome string, accepted long"
OUTCOMES = (
    "job_id long, sequence long, kind string, outcome string, status string, "
    "claim_count long, lease_until long, lease_expired boolean"
)


class FrameArrival(StatefulProcessor):
    """Counts the finite frames of one run; emits completion, excess and non-finite frames."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.accepted = handle.getValueState("accepted", "count long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        count = self.accepted.get()[0] if self.accepted.exists() else 0
        out = []
        for pdf in rows:
            for frame, expected, finite in zip(pdf["frame"], pdf["expected"], pdf["finite"]):
                if not finite:
                    out.append((frame, "nonfinite", count))
                elif count >= expected:
                    out.append((frame, "excess", count))
                else:
                    count += 1
                    if count == expected:
                        out.append((frame, "complete", count))
        self.accepted.update((count,))
        if out:
            yield pd.DataFrame(
                [(key[0], *row) for row in out],
                columns=["run_id", "frame", "outcome", "accepted"],
            )

    def close(self) -> None:
        pass


def frame_arrivals(frames: DataFrame) -> DataFrame:
    """Follow frames of runs with a known number of saved frames.

    ``frames``: stream of ``run_id, frame, values, expected``. Values are tested where they
    are read; only flags reach the state.
    """
    narrow = frames.select(
        "run_id", "frame", "expected", all_finite("values").alias("finite")
    )
    return narrow.groupBy("run_id").transformWithStateInPandas(
        statefulProcessor=FrameArrival(),
        outputStructType=ARRIVALS,
        outputMode="Append",
        timeMode="None",
    )


SUBMISSIONS = "job_id long, sequence long, at long"


class FirstSubmission(StatefulProcessor):
    """Remembers that a job was submitted; emits its first submission once."""

    def __init__(self, keep_ms: int | None):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "sequence long", self.keep_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first = min((row for pdf in rows for row in zip(pdf["at"], pdf["sequence"])), default=None)
        if first is not None and not self.seen.exists():
            self.seen.update((int(first[1]),))
            yield pd.DataFrame({"job_id": [key[0]], "sequence": [first[1]], "at": [first[0]]})

    def close(self) -> None:
        pass


def first_submissions(submitted: DataFrame, keep_ms: int | None = None) -> DataFrame:
    """The first submission of every job of a stream of ``job_id, sequence, at``.

    A batch looks its own jobs up in the state store, so it reads as much as it brings, however
    long the stream is. Jobs are remembered for ``keep_ms`` of processing time, or for good.
    """
    return submitted.groupBy("job_id").transformWithStateInPandas(
        statefulProcessor=FirstSubmission(keep_ms),
        outputStructType=SUBMISSIONS,
        outputMode="Append",
        timeMode="None" if keep_ms is None else "ProcessingTime",
    )


# Groups that jobs are dealt to, fixed for the life of a stream.
BUCKETS = 1024
LEASE_STATE = "status string, token string, lease_until long, claim_count long"
FREE = (None, None, None, 0)


def _follow_lease(job_id: int, state: tuple, events: Iterable[tuple], lease: int, out: list[tuple]) -> tuple:
    """State of a job after ``events``; what became of each is added to ``out``."""
    status, token, until, claims = state
    for sequence, kind, at, presented in events:
        live = status == "running" and until > at
        expired = False
        if kind == "submitted":
            outcome = "duplicate" if status else "accepted"
            status = status or "queued"
        elif kind == "claimed":
            if status == "queued" or (status == "running" and not live):
                expired = status == "running"
                status, token, until = "running", presented, int(at) + lease
                claims += 1
                outcome = "accepted"
            else:
                outcome = "refused"
        elif live and isinstance(presented, str) and token == presented:
            outcome = "accepted"
            if kind == "renewed":
                until = int(at) + lease
            else:
                status, token, until = kind, None, None
        else:
            outcome = "lost_claim"
        out.append((job_id, sequence, kind, outcome, status, claims, until, expired))
    return status, token, until, claims


def _outcomes(out: list[tuple]) -> pd.DataFrame:
    names = ("job_id", "sequence", "kind", "outcome", "status", "claim_count", "lease_until", "lease_expired")
    table = dict(zip(names, map(list, zip(*out))))
    table["lease_until"] = pd.array(table["lease_until"], dtype="Int64")
    return pd.DataFrame(table)


def _in_order(rows: Iterator[pd.DataFrame]) -> pd.DataFrame:
    # A micro-batch is bounded by the source's trigger limit.
    return pd.concat(list(rows)).sort_values(["job_id", "sequence"], kind="stable")


def _events(batch: pd.DataFrame) -> Iterator[tuple]:
    return zip(*[batch[c].tolist() for c in ("sequence", "kind", "at", "token")])


class JobLease(StatefulProcessor):
    """Lease and token of one job; emits what became of every event."""

    def __init__(self, lease: int):
        self.lease = lease

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.job = handle.getValueState("job", LEASE_STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        out = []
        self.job.update(_follow_lease(key[0], self.job.get() or FREE, _events(_in_order(rows)), self.lease, out))
        yield _outcomes(out)

    def close(self) -> None:
        pass


class JobLeases(StatefulProcessor):
    """Leases and tokens of the jobs of one bucket, each with a state of its own."""

    def __init__(self, lease: int):
        self.lease = lease

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.jobs = handle.getMapState("jobs", "job_id long", LEASE_STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = _in_order(rows)
        out = []
        for job_id, events in groupby(zip(batch["job_id"].tolist(), _events(batch)), key=itemgetter(0)):
            state = self.jobs.getValue((job_id,)) or FREE
            self.jobs.updateValue((job_id,), _follow_lease(job_id, state, map(itemgetter(1), events), self.lease, out))
        yield _outcomes(out)

    def close(self) -> None:
        pass


class LeaseWatch(JobLease):
    """A job's lease with a timer, so that one that nobody touches again is reported, too."""

    def __init__(self, lease: int, per_ms: int):
        super().__init__(lease)
        self.per_ms = per_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.handle = handle

    def _due(self) -> int | None:
        """Milliseconds at which the current lease is over."""
        if not self.job.exists():
            return None
        status, _, until, _ = self.job.get()
        return -(-int(until) // self.per_ms) if status == "running" and until is not None else None

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        before = self._due()
        yield from super().handleInputRows(key, rows, timerValues)
        due = self._due()
        if due != before:
            if before is not None:
                self.handle.deleteTimer(before)
            if due is not None:
                self.handle.registerTimer(due)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        due = self._due()
        if due is None or due > expiredTimerInfo.getExpiryTimeInMs():
            return  # the lease was given back or renewed
        status, _, until, claims = self.job.get()
        row = pd.DataFrame(
            {
                "job_id": [key[0]],
                "sequence": pd.array([None], dtype="Int64"),
                "kind": ["expired"],
                "outcome": ["lease_expired"],
                "status": [status],
                "claim_count": [claims],
                "lease_until": pd.array([until], dtype="Int64"),
                "lease_expired": [False],
            }
        )
        yield row


def watched_outcomes(events: DataFrame, lease: int, moment: str, *, delay: str = "0 seconds", per_ms: int = 1000) -> DataFrame:
    """Outcomes as :func:`job_outcomes` gives them, and a row for every lease that ran out.

    ``moment`` is the timestamp of an event; once the stream's time, ``delay`` behind the latest,
    has passed the end of a running job's lease, a row of kind ``expired`` with outcome
    ``lease_expired`` and no sequence number follows, without any further event of that job. The job
    stays running until the next claim takes it over, which is counted as before. Events later
    than ``delay`` are dropped by Spark. ``per_ms`` is the number of units of ``lease`` in a millisecond.
    """
    return (
        events.withWatermark(moment, delay)
        .groupBy("job_id")
        .transformWithStateInPandas(
            statefulProcessor=LeaseWatch(lease, per_ms),
            outputStructType=OUTCOMES,
            outputMode="Append",
            timeMode="EventTime",
        )
    )


def job_outcomes(events: DataFrame, lease: int) -> DataFrame:
    """Outcome of every queue event: accepted, duplicate, refused or lost_claim.

    Late or stale acknowledgements are reported as ``lost_claim``, never dropped. Events of a
    job must arrive in sequence order from one micro-batch to the next. Jobs are dealt to
    ``BUCKETS`` groups: what a group costs is paid for many jobs at once, and a batch still
    looks up the states of its own jobs only.
    """
    columns = [F.col(c) for c in ("job_id", "sequence", "kind", "at", "token")]
    dealt = events.select(F.pmod(F.xxhash64("job_id"), F.lit(BUCKETS)).alias("bucket"), *columns)
    return dealt.groupBy("bucket").transformWithStateInPandas(
        statefulProcessor=JobLeases(lease),
        outputStructType=OUTCOMES,
        outputMode="Append",
        timeMode="None",
    )


def outcome_states(outcomes: DataFrame) -> DataFrame:
    """Job rows from the outcome table, as the batch fold gives them."""
    kind, result = F.col("kind"), F.col("outcome")
    ok = result == "accepted"
    return outcomes.groupBy("job_id").agg(
        F.max_by("status", "sequence").alias("status"),
        F.max("claim_count").alias("claim_count"),
        F.count_if(ok & (kind == "renewed")).alias("renewals"),
        F.count_if("lease_expired").alias("lease_expirations"),
        F.count_if(result == "lost_claim").alias("lost_acknowledgements"),
        F.count_if(result == "refused").alias("refused_claims"),
        F.count_if(result == "duplicate").alias("duplicate_submissions"),
        F.max_by("lease_until", "sequence").alias("lease_until"),
    )
