import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import evaluate as e

FRAMES = "run_id long, frame int, values array<double>"


def _reference(spark):
    return spark.createDataFrame([(1, k, [v] * 8) for k, v in enumerate((2.0, 2.25, 2.5))], FRAMES)


def test_hand_computed_drifts(spark):
    out = e.evaluate(_reference(spark), lambda s: s + 0.5)
    drift = {r["quantity"]: r for r in out["drifts"].collect()}
    assert drift["one_step_mean_change"]["rms"] == 0.5 == drift["one_step_mean_change"]["max_abs"]
    assert drift["rollout_mean_drift"]["rms"] == math.sqrt((0.25 + 1) / 2)
    assert drift["reference_mean_drift"]["max_abs"] == 0.5
    per = {(r["quantity"], r["frame"]): r["rms"] for r in out["drifts_per_time"].collect()}
    assert per[("rollout_mean_drift", 1)] == 0.5 and per[("rollout_mean_drift", 2)] == 1.0
    assert per[("reference_mean_drift", 1)] == 0.25 and per[("reference_mean_drift", 2)] == 0.5
    fields = {r["kind"]: r for r in out["fields"].collect()}
    assert fields["one_step"]["mean_velocity_rmse"] == 0.25 == fields["one_step"]["rmse"]
    assert fields["persistence_one_step"]["max_abs_error"] == 0.25
    assert fields["persistence_rollout"]["max_abs_error"] == 0.5


def test_metrics_equal_numpy(spark):
    rng = np.random.default_rng(4)
    truth = rng.normal(size=(3, 6, 5))
    rows = [(t, f, truth[t, f].tolist()) for t in range(3) for f in range(6)]
    out = e.evaluate(spark.createDataFrame(rows, FRAMES), e.decay_step)
    one = 0.9 * truth[:, :-1]
    error = one - truth[:, 1:]
    got = next(r for r in out["fields"].collect() if r["kind"] == "one_step")
    assert np.isclose(got["rmse"], np.sqrt(np.mean(error**2)))
    assert np.isclose(got["relative_l2"], np.linalg.norm(error) / np.linalg.norm(truth[:, 1:]))
    assert np.isclose(got["energy_rmse"], np.sqrt(np.mean((0.5 * np.mean(one**2 - truth[:, 1:] ** 2, axis=-1)) ** 2)))
    per = {r["frame"]: r["rmse"] for r in out["per_time"].collect() if r["kind"] == "one_step"}
    assert np.allclose([per[f] for f in range(1, 6)], np.sqrt(np.mean(error**2, axis=(0, 2))))


def test_normalised_scoring(spark):
    seen = e.score_one_step(_reference(spark), lambda s: s * 0, mean=2.0, std=4.0).collect()
    assert {tuple(r["values"]) for r in seen} == {(2.0,) * 8}


def test_long_rollout_leaves_in_batches(spark):
    df = spark.createDataFrame([(1, k, [1.0]) for k in range(200)], FRAMES)
    got = e.score_rollout(df, lambda s: s + 1).orderBy("frame").collect()
    assert [r["values"][0] for r in got] == [2.0 + k for k in range(199)]


def test_non_finite_predictions(spark):
    ref = _reference(spark)
    out = e.evaluate(ref, lambda s: s * float("nan"))
    row = next(r for r in out["fields"].collect() if r["kind"] == "rollout")
    assert row["finite"] is False and row["rmse"] is None and row["relative_l2"] is None
    drift = next(r for r in out["drifts"].collect() if r["quantity"] == "rollout_mean_drift")
    assert drift["finite"] is False and drift["rms"] is None


def test_zero_reference_has_no_relative_error(spark):
    df = spark.createDataFrame([(1, k, [0.0] * 4) for k in range(2)], FRAMES)
    row = e.evaluate(df, lambda s: s + 1)["fields"].filter("kind = 'one_step'").first()
    assert row["relative_l2"] is None and row["rmse"] == 1.0


def test_predictions_are_written_once(spark, tmp_path):
    path = str(tmp_path / "p")
    out = e.evaluate(_reference(spark), e.persistence_step)["predictions"]
    e.write_predictions(out, path)
    back = spark.read.parquet(path)
    assert back.count() == 4 and dict(back.dtypes)["values"] == "array<float>"
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS|already exists"):
        e.write_predictions(out, path)


def test_best_checkpoint_takes_the_earliest_tie(spark):
    rows = [("m", 0, 0.5), ("m", 1, 0.2), ("m", 2, 0.2), ("k", 0, 0.1), ("k", 1, 0.3)]
    df = spark.createDataFrame(rows, "model_id string, epoch int, validation_loss double")
    assert {r["model_id"]: r["best_epoch"] for r in e.best_checkpoints(df).collect()} == {"m": 1, "k": 0}


def test_paired_table(spark):
    df = spark.createDataFrame([(0, "baseline", 2.0), (0, "mean_preserving", 0.5)], "seed int, variant string, rmse double")
    assert e.paired_table(df, ["rmse"]).select(F.col("delta_rmse")).first()[0] == -1.5


def test_one_non_finite_prediction_voids_the_series(spark):
    rows = [("a", 1, True, 4.0), ("a", 2, False, 1.0), ("b", 1, True, 4.0), ("b", 2, True, 16.0)]
    scores = spark.createDataFrame(rows, "kind string, frame int, finite boolean, error_sq double").selectExpr("*", "4 AS cells")
    got = {(r["kind"], r["frame"]): r["rmse"] for r in e.per_time_rmse(scores).collect()}
    assert got == {("a", 1): None, ("a", 2): None, ("b", 1): 1.0, ("b", 2): 2.0}
    drifts = spark.createDataFrame([("q", 1, 1.0), ("q", 2, float("nan")), ("p", 1, 3.0)], "quantity string, frame int, drift double")
    table = {(r["quantity"], r["frame"]): r["rms"] for r in e.drift_metrics(drifts, ("quantity", "frame")).collect()}
    assert table == {("q", 1): None, ("q", 2): None, ("p", 1): 3.0}
