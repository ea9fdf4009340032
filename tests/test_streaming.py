from pyspark.sql import functions as F

from tidemark import schemas, streaming
from tidemark.streaming import logs, stateful
from tidemark.suite import streams


def _write(df, path):
    df.coalesce(1).write.mode("append").parquet(path)


def test_frames_complete_only_when_counts_match(spark, tmp_path):
    schema = "run_id long, frame int, values array<double>, expected int"
    path, table, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    first = [(1, 0, [0.0], 3), (1, 1, [float("nan")], 3), (2, 0, [1.0], 1)]
    later = [(1, 1, [1.0], 3), (1, 2, [1.0], 3), (1, 3, [1.0], 3), (3, 0, [1.0], 2)]
    for rows in (first, later):
        _write(spark.createDataFrame(rows, schema), path)
        stream = spark.readStream.schema(schema).parquet(path)
        streaming.drain(streaming.write_batches(stateful.frame_arrivals(stream), table, mark))
    got = {(r["run_id"], r["frame"], r["outcome"]) for r in streaming.read_batches(spark, table).collect()}
    assert got == {(1, 1, "nonfinite"), (2, 0, "complete"), (1, 2, "complete"), (1, 3, "excess")}


def _several_files(spark, folder):
    rows = [(v, [float(v)] * 8, v % 3) for v in range(100)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    table.repartition(3).write.parquet(str(folder / "embeddings.parquet"))
    return table


def test_a_table_of_several_files_is_streamed_whole(spark, tmp_path):
    table = _several_files(spark, tmp_path)
    (tmp_path / "other").mkdir()
    table.toPandas().to_parquet(tmp_path / "other" / "embeddings.parquet")
    for folder in (tmp_path, tmp_path / "other"):
        found = streaming.run_to_table(streaming.stream_table(spark, str(folder), "embeddings"), "whole")
        assert sorted(r["vec_id"] for r in found.collect()) == list(range(100))
    arrivals = streams.stream_frame_arrivals(spark, str(tmp_path)).collect()
    nonfinite = {r["run_id"]: r["nonfinite"] for r in arrivals}
    assert nonfinite[0] == 1 and nonfinite[2] == 1  # vectors 0 and 59


def test_diagnostics_of_a_table_of_several_files(spark, tmp_path):
    _several_files(spark, tmp_path)
    frames = streams.stream_frame_diagnostics(spark, str(tmp_path)).collect()
    assert {r["run_id"] * 25 + r["frame"]: r["energy"] for r in frames} == {v: v * v / 2 for v in range(100)}


def test_diagnostics_of_empty_vectors_are_null(spark, tmp_path):
    rows = [(0, [2.0] * 64, 1), (1, [], 1), (2, None, 1)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    table.write.parquet(str(tmp_path / "embeddings.parquet"))
    frames = streams.stream_frame_diagnostics(spark, str(tmp_path)).collect()
    got = {r["frame"]: (r["mean_velocity"], r["energy"]) for r in frames}
    assert got == {0: (2.0, 2.0), 1: (None, None), 2: (None, None)}


def test_submissions_are_inserted_once(spark, tmp_path):
    schema = "job_id long, sequence long, at long"
    path, table, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    for rows in ([(1, 1, 1), (1, 2, 2), (2, 3, 3)], [(2, 4, 4), (3, 5, 5)]):
        _write(spark.createDataFrame(rows, schema), path)
        stream = spark.readStream.schema(schema).parquet(path)
        streaming.drain(
            streaming.write_batches(stream, table, mark, prepare=lambda b, i: logs.new_submissions(b, table, i))
        )
    got = sorted((r["job_id"], r["sequence"]) for r in streaming.read_batches(spark, table).collect())
    assert got == [(1, 1), (2, 3), (3, 5)]
    # a replayed batch writes the same rows again
    again = logs.new_submissions(spark.createDataFrame([(2, 4, 4), (3, 5, 5)], schema), table, 1)
    assert [r["job_id"] for r in again.collect()] == [3]


def test_event_log_round_trip_and_latest_status(spark, tmp_path):
    path = str(tmp_path / "events")
    rows = [("2026-01-01T00:00:00", "solve", "started", None), ("2026-01-01T00:00:05", "solve", "completed", "{}"), ("2026-01-01T00:00:01", "export", "started", None)]
    logs.append_events(spark.createDataFrame(rows[:2], schemas.EVENT_LOG), path)
    logs.append_events(spark.createDataFrame(rows[2:], schemas.EVENT_LOG), path)
    want = {("solve", "completed", 2), ("export", "started", 1)}
    batch = logs.latest_status(logs.read_events(spark, path)).collect()
    assert {(r["stage"], r["status"], r["events"]) for r in batch} == want
    table = streaming.run_to_table(logs.latest_status(logs.tail_events(spark, path)), "log", mode="update")
    got = streaming.latest(table, ["stage"]).collect()
    assert {(r["stage"], r["status"], r["events"]) for r in got} == want


def test_callback_sees_every_frame_once(spark, tmp_path):
    path, mark = str(tmp_path / "in"), str(tmp_path / "mark")
    _write(spark.range(5), path)
    seen = []
    stream = lambda: spark.readStream.schema("id long").parquet(path)
    note = lambda rows, batch_id: seen.append((batch_id, rows.count()))
    streaming.drain(streaming.for_each_batch(stream(), note, mark))
    _write(spark.range(2), path)
    streaming.drain(streaming.for_each_batch(stream(), note, mark))
    assert seen == [(0, 5), (1, 2)]


def test_settings_are_restored(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    with streaming.state_settings(spark):
        assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == streaming.ROCKSDB
    assert spark.conf.get("spark.sql.shuffle.partitions") == before


def test_sliding_windows(spark, tmp_path):
    path = str(tmp_path / "in")
    rows = spark.createDataFrame([("2026-01-01 00:00:30", "a"), ("2026-01-01 00:01:30", "a")], "t string, k string")
    _write(rows.select(F.to_timestamp("t").alias("t"), "k"), path)
    stream = spark.readStream.schema("t timestamp, k string").parquet(path)
    counts = logs.windowed_counts(stream, "t", "2 minutes", "1 hour", "k", slide="1 minute")
    table = streaming.run_to_table(counts, "w", mode="update")
    assert sorted(r["rows"] for r in table.collect()) == [1, 1, 2]


def test_a_lease_runs_out_without_an_event(spark, tmp_path):
    schema = "job_id long, sequence long, kind string, at long, token string, moment timestamp"
    events, base = str(tmp_path / "events"), str(tmp_path / "out")

    def feed(*rows):
        df = spark.createDataFrame([(*r, None) for r in rows], schema)
        df.withColumn("moment", F.timestamp_micros("at")).coalesce(1).write.mode("append").parquet(events)
        stream = spark.readStream.schema(schema).parquet(events)
        out = stateful.watched_outcomes(stream, 10_000, "moment")
        streaming.drain(streaming.write_batches(out, f"{base}/table", f"{base}/checkpoint", partitions=2))
        table = streaming.read_batches(spark, f"{base}/table").filter("outcome = 'lease_expired'")
        return sorted((r["job_id"], r["lease_until"], r["claim_count"]) for r in table.collect())

    start = 1_000_000
    assert feed((1, 1, "submitted", start, None), (1, 2, "claimed", start, "a"), (2, 3, "submitted", start, None)) == []
    # another job moves the time on: the first lease is over, the renewed one is not
    assert feed((2, 4, "claimed", start + 9_000, "b"), (2, 5, "renewed", start + 15_000, "b")) == [(1, start + 10_000, 1)]
    assert feed((3, 6, "submitted", start + 24_000, None)) == [(1, start + 10_000, 1)]
    # the claim that takes over is counted as an expiry, as without a timer, and has its own lease
    late = [(1, start + 10_000, 1), (1, start + 36_000, 2), (2, start + 25_000, 1)]
    assert feed((1, 7, "claimed", start + 26_000, "c"), (3, 8, "submitted", start + 90_000, None)) == late
    states = stateful.outcome_states(streaming.read_batches(spark, f"{base}/table"))
    got = {r["job_id"]: (r["status"], r["claim_count"], r["lease_expirations"]) for r in states.collect()}
    assert got == {1: ("running", 2, 1), 2: ("running", 1, 0), 3: ("queued", 0, 0)}


def test_a_batch_reads_no_more_as_the_stream_grows(spark, tmp_path):
    path, keys = str(tmp_path / "table"), ["k"]
    write = lambda b, rows: spark.createDataFrame(rows, "k long, v long").write.parquet(f"{path}/batch_id={b}")
    read = []
    for b in range(9):
        write(b, [(b, b), (0, 100 + b)])
        streaming.compact(spark, path, keys, after=3)
        table = streaming.latest_table(spark, path, keys)
        assert {(r["k"], r["v"]) for r in table.collect()} == {(0, 100 + b), *((k, k) for k in range(1, b + 1))}
        read.append(len({f.rsplit("/", 2)[1] for f in table.inputFiles()}))
    assert max(read) <= 3  # a snapshot and at most two batches after it
    # a snapshot that was not completed does not count
    (tmp_path / "table_snapshots" / "upto=99").mkdir()
    assert streaming.latest_table(spark, path, keys).count() == 9


def test_first_submissions_are_emitted_once(spark, tmp_path):
    schema = "job_id long, sequence long, at long"
    path, base = str(tmp_path / "in"), str(tmp_path / "out")
    for rows in ([(1, 5, 50), (1, 4, 40), (2, 6, 60)], [(1, 7, 70), (3, 9, 90), (3, 8, 80)], [(2, 10, 100)]):
        _write(spark.createDataFrame(rows, schema), path)
        stream = spark.readStream.schema(schema).parquet(path)
        out = stateful.first_submissions(stream)
        streaming.drain(streaming.write_batches(out, f"{base}/t", f"{base}/c", partitions=2))
    got = sorted((r["job_id"], r["sequence"]) for r in streaming.read_batches(spark, f"{base}/t").collect())
    assert got == [(1, 4), (2, 6), (3, 8)]
