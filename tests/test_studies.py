import math

from pyspark.sql import functions as F

from tidemark.operators import studies

TRIALS = "grid_size int, mode string, workers int, wall_seconds double, verified_reuse_seconds double, completed_experiments long, failure_count long, stored_bytes long, peak_rss long, sampling_errors long"


def test_golden_trials(spark):
    rows = [
        (64, "buffered", 1, 9.0, 1.0, 8, 0, 10, 100, 0),
        (64, "buffered", 1, 11.0, 2.0, 8, 0, 12, 120, 1),
        (64, "buffered", 2, 4.0, 1.0, 8, 0, 10, 200, 0),
        (64, "buffered", 2, 6.0, 3.0, 8, 0, 14, 220, 0),
        (64, "streamed", 1, 20.0, 1.0, 8, 0, 10, 100, 0),
        (64, "streamed", 2, 4.0, 1.0, 8, 0, 10, None, 0),
    ]
    got = {(r["mode"], r["workers"]): r for r in studies.summarize_trials(spark.createDataFrame(rows, TRIALS)).collect()}
    b2, s2 = got[("buffered", 2)], got[("streamed", 2)]
    assert b2["speedup_vs_one_worker"] == 2 and b2["peak_rss_max"] == 220 and b2["completed_experiments"] == 16
    assert math.isclose(b2["runs_per_hour_median"], (8 / 4 + 8 / 6) * 1800)
    assert s2["speedup_vs_one_worker"] == 5 and s2["peak_rss_max"] is None
    assert b2["stored_bytes_median"] == 12 and got[("buffered", 1)]["verified_reuse_seconds_median"] == 1.5


def test_golden_samples(spark):
    rows = [
        ("a", 1, 0, True, 100), ("a", 1, 1, False, 30), ("a", 1, 2, False, 40),
        ("a", 2, 0, True, 200), ("a", 2, 1, False, 10),
        ("b", 1, 0, True, 100), ("b", 1, 1, False, None), ("b", 1, 2, False, 20),
        ("c", 1, 0, True, None), ("c", 1, 1, False, None),
        ("d", 1, 0, True, None),
    ]
    df = spark.createDataFrame(rows, "trial_id string, sample int, process_id int, is_parent boolean, rss long")
    got = {r["trial_id"]: r for r in studies.sample_peaks(studies.sample_aggregates(df)).collect()}
    a, b, c, d = (got[k] for k in "abcd")
    assert (a["peak_aggregate_rss"], a["peak_parent_rss"], a["peak_children_rss"], a["max_children"]) == (210, 200, 70, 2)
    assert b["peak_aggregate_rss"] == 120 and b["partial_samples"] == 1
    assert c["peak_aggregate_rss"] is None and c["peak_children_rss"] is None
    assert d["peak_aggregate_rss"] is None and d["peak_children_rss"] == 0


def test_transfers(spark):
    rows = [("t", 0, 99), ("t", 100, 199), ("t", 150, 160), ("u", 0, 7), ("u", 0, 7)]
    df = spark.createDataFrame(rows, "transfer_id string, start long, end long")
    got = {r["transfer_id"]: r for r in studies.audit_transfers(df.filter("transfer_id = 't'"), 1000, 10).collect()}
    t = got["t"]
    assert (t["bytes_received"], t["requests"], t["overlapping_ranges"], t["bytes_left"], t["requests_left"]) == (211, 3, 1, 789, 7)
    assert [tuple(r) for r in studies.duplicate_ranges(df).collect()] == [("u", 0, 7, 2)]


def test_unequal_results(spark):
    rows = [("c1", "r", "h", False), ("c1", "r", "h", False), ("c2", "r", "h", False), ("c2", "r", "g", False), ("c3", "r", None, None), ("c3", "r", None, None)]
    df = spark.createDataFrame(rows, "config_key string, run_id string, values_sha256 string, needs_review boolean")
    assert [r["config_key"] for r in studies.unequal_results(df).collect()] == ["c2"]


def test_totals(spark):
    rows = [(64, "m", 1, 1.0, 1.0, 5, 1, 10, None, 0), (128, "m", 1, 1.0, 1.0, 7, 0, 20, None, 0)]
    got = {r["grid_size"]: r for r in studies.study_totals(spark.createDataFrame(rows, TRIALS)).collect()}
    assert got[None]["is_total"] == 1 and got[None]["fresh_runs"] == 13 and got[64]["stored_bytes"] == 10


def test_throughput_counts_successes(spark):
    rows = [(64, "m", 1, 1800.0, 1.0, 3, 1, 10, None, 0)]
    r = studies.throughput(spark.createDataFrame(rows, TRIALS)).select(F.col("runs_per_hour"), F.col("attempts_per_hour")).first()
    assert tuple(r) == (6.0, 8.0)
