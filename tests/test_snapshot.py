import json

from tidemark.operators import preview


def _snapshot(spark, problems, count=2):
    catalog = spark.createDataFrame([("a", "burgers1d", "<x>"), ("b", "burgers1d", "y"), ("c", "burgers1d", "z")], "id string, equation string, note string")
    bad = spark.createDataFrame(problems, "run_id string, problem string")
    digests = spark.createDataFrame([(i, i + "m", i + "r") for i in "abc"], "id string, manifest_sha256 string, record_sha256 string")
    series = spark.createDataFrame([("a", f, f * 0.5, 1.0 + f) for f in range(3)], "run_id string, frame int, time double, energy double")
    finals = spark.createDataFrame([("a", "velocity", 2, 1.0, 1, 512, [float(i) for i in range(512)]), ("a", "pressure", 2, 1.0, 1, 2, [9.0, 9.0])], "run_id string, field string, frame int, time double, ny int, nx int, values array<double>")
    return {r["id"]: r for r in preview.catalog_snapshot(catalog, bad, digests, series, finals, count).collect()}


def test_payloads(spark):
    got = _snapshot(spark, [("c", "missing")])  # a problem of a run that is not shown
    assert set(got) == {"a", "b"} and all(r["error"] is None for r in got.values())
    assert "<" not in got["a"]["payload"]
    a = json.loads(got["a"]["payload"])
    assert a["record"]["note"] == "<x>" and (a["manifest_sha256"], a["record_sha256"]) == ("am", "ar")
    assert [s["value"] for s in a["energy"]["samples"]] == [1.0, 2.0, 3.0]
    assert (a["field"]["field"], a["field"]["steady"], a["field"]["source_shape"]) == ("velocity", False, [1, 512])
    assert a["field"]["preview"] == [float(i) for i in range(0, 512, 2)]


def test_one_corrupt_selected_run_stops_the_export(spark):
    got = _snapshot(spark, [("b", "hash mismatch")])
    assert all(r["payload"] is None and "verification" in r["error"] for r in got.values())


def test_registered_snapshot_stops_at_a_corrupt_run(spark):
    from tidemark.suite import fields

    stopped = fields.catalog_snapshot(spark, "/root/testdata/sf0.001").collect()
    assert len(stopped) == 50 and all(r["error"] and r["payload"] is None for r in stopped)
    intact = fields.catalog_snapshot_intact(spark, "/root/testdata/sf0.001").collect()
    assert intact and all(r["error"] is None and json.loads(r["payload"]) for r in intact)
