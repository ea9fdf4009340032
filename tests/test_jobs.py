import random

import pytest
from pyspark.sql import functions as F

from tidemark import streaming
from tidemark.operators import jobs
from tidemark.streaming import stateful

EVENTS = "job_id long, sequence long, kind string, at long, token string"


def _state(spark, rows, lease):
    df = spark.createDataFrame(rows, EVENTS)
    return {r["job_id"]: r for r in jobs.job_states(df, lease).collect()}


def fold(rows, lease):
    """The rules one event after the other."""
    out = {}
    for job, _, kind, at, token in sorted(rows, key=lambda r: r[1]):
        s = out.setdefault(job, dict.fromkeys(jobs.SUMMARY[2:8], 0) | {"status": None, "token": None, "lease_until": None})
        live = s["status"] == "running" and s["lease_until"] > at
        if kind == "submitted":
            s["duplicate_submissions"] += s["status"] is not None
            s["status"] = s["status"] or "queued"
        elif kind == "claimed":
            if s["status"] == "queued" or (s["status"] == "running" and not live):
                s["lease_expirations"] += s["status"] == "running"
                s["claim_count"] += 1
                s.update(status="running", token=token, lease_until=at + lease)
            else:
                s["refused_claims"] += 1
        elif live and token is not None and token == s["token"]:
            if kind == "renewed":
                s["renewals"] += 1
                s["lease_until"] = at + lease
            else:
                s.update(status=kind, token=None, lease_until=None)
        else:
            s["lost_acknowledgements"] += 1
    return {job: tuple({"job_id": job, **s}[c] for c in jobs.SUMMARY) for job, s in out.items()}


TIMELINE = [
    (1, 1, "submitted", 90, None),
    (1, 2, "claimed", 100, "a"),
    (1, 3, "renewed", 105, "a"),
    (1, 4, "claimed", 114, "x"),
    (1, 5, "claimed", 115, "b"),
    (1, 6, "renewed", 116, "a"),
    (1, 7, "completed", 116, "a"),
    (1, 8, "completed", 116, "b"),
    (1, 9, "submitted", 120, None),
]


def test_golden_timeline(spark):
    r = _state(spark, TIMELINE, 10)[1]
    assert (r["status"], r["claim_count"], r["renewals"], r["lease_expirations"]) == ("completed", 2, 1, 1)
    assert (r["lost_acknowledgements"], r["refused_claims"], r["duplicate_submissions"]) == (2, 1, 1)
    assert r["lease_until"] is None


def test_expired_lease_rejects_its_owner(spark):
    rows = [(1, 1, "submitted", 99, None), (1, 2, "claimed", 100, "a"), (1, 3, "renewed", 101, "a"), (1, 4, "failed", 101, "a")]
    r = _state(spark, rows, 1)[1]
    assert (r["status"], r["lost_acknowledgements"], r["lease_until"]) == ("running", 2, 101)


def _random_events(seed, jobs_=6, count=400):
    rnd = random.Random(seed)
    rows, at, last = [], 0, {}
    for sequence in range(count):
        at += rnd.randint(0, 4)
        job = rnd.choice([0, 0, 0, rnd.randrange(jobs_)])
        kind = rnd.choice(["submitted", "claimed", "claimed", "renewed", "renewed", "renewed"] + (["completed", "failed"] if rnd.random() < 0.1 else []))
        token = None
        if kind == "claimed":
            token = last[job] = f"t{sequence}"
        elif kind != "submitted":
            token = last.get(job) if rnd.random() < 0.8 else f"t{rnd.randrange(count)}"
        rows.append((job, sequence, kind, at, token))
    return rows


@pytest.mark.parametrize("seed", range(4))
def test_pointers_equal_the_fold(spark, seed):
    rows = _random_events(seed)
    if seed % 2:  # few tokens that come again, some NULL
        rows = [(*r[:4], None if r[1] % 5 == 0 else r[4] and f"t{r[1] // 9 % 3}") for r in rows]
    got = {job: tuple(row[c] for c in jobs.SUMMARY) for job, row in _state(spark, rows, 9).items()}
    assert got == fold(rows, 9)


def test_repeated_claims_and_null_tokens(spark):
    again = [(1, 1, "submitted", 0, None), (1, 2, "claimed", 1, "a"), (1, 3, "claimed", 2, "a"), (1, 4, "completed", 3, "a")]
    r = _state(spark, again, 10)[1]
    assert (r["status"], r["claim_count"], r["refused_claims"], r["lease_expirations"]) == ("completed", 1, 1, 0)
    null = [(1, 1, "submitted", 0, None), (1, 2, "claimed", 1, None), (1, 3, "completed", 2, None)]
    r = _state(spark, null, 10)[1]
    assert (r["status"], r["lost_acknowledgements"], r["lease_until"]) == ("running", 1, 11)


def test_state_counts_include_zero_states(spark):
    df = spark.createDataFrame([("running", 5), ("running", 50)], "status string, lease_until long")
    got = {r["status"]: (r["jobs"], r["expired_leases"]) for r in jobs.state_counts(df, F.lit(10)).collect()}
    assert got == {"queued": (0, 0), "running": (2, 1), "completed": (0, 0), "failed": (0, 0)}


def test_oldest_queued_first(spark):
    df = spark.createDataFrame([("b", "queued", 1), ("a", "queued", 1), ("c", "running", 0), ("d", "queued", 0)], "job_id string, status string, created_at int")
    assert [r["job_id"] for r in jobs.claimable(df, 2).collect()] == ["d", "a"]


def test_stream_equals_batch_and_resumes(spark, tmp_path):
    rows = _random_events(11)
    events = spark.createDataFrame(rows, EVENTS)
    path, table, mark = (str(tmp_path / n) for n in ("events", "table", "mark"))

    def run():
        stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(path)
        streaming.drain(streaming.write_batches(stateful.job_outcomes(stream, 9), table, mark))

    for low, high in ((0, 150), (150, 151), (151, 400)):
        events.filter(f"sequence >= {low} AND sequence < {high}").coalesce(1).write.mode("append").parquet(path)
        run()  # a new query continues from the checkpoint
    run()
    got = stateful.outcome_states(streaming.read_batches(spark, table))
    cols = list(jobs.SUMMARY)
    want = jobs.job_states(events, 9).select(*cols)
    assert sorted(map(tuple, got.select(*cols).collect())) == sorted(map(tuple, want.collect()))
    assert streaming.read_batches(spark, table).count() == len(rows)


def test_many_jobs_share_a_group_and_keep_their_own_state(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stateful, "BUCKETS", 4)
    rows = [(job, 1000 * half + 10 * job + n, kind, at, token) for half in (0, 1) for job in range(60) for n, (kind, at, token) in enumerate(
        [("claimed", 1, "x"), ("submitted", 2, None), ("claimed", 3, "a"), ("renewed", 5 + job % 3, "a"), ("claimed", 6, "b")]
        if half == 0 else [("renewed", 10 + job % 7, "a"), ("claimed", 30, None), ("completed", 31, "a" if job % 2 else None)]
    )]
    events = spark.createDataFrame(rows, EVENTS)
    path, table, mark = (str(tmp_path / n) for n in ("events", "table", "mark"))
    for half in (0, 1):
        events.filter(f"sequence DIV 1000 = {half}").repartition(3).write.mode("append").parquet(path)
        query = streaming.write_batches(stateful.job_outcomes(spark.readStream.schema(EVENTS).parquet(path), 9), table, mark)
        streaming.drain(query)
        assert query.lastProgress.stateOperators[0].numRowsUpdated == 60  # a state for each job, not for each group
    got = stateful.outcome_states(streaming.read_batches(spark, table)).select(*jobs.SUMMARY)
    want = jobs.job_states(events, 9).select(*jobs.SUMMARY)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
