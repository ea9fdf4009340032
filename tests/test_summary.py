from pyspark.sql import functions as F

from tidemark.operators import summary

SCHEMA = "run_id string, frame int, time double, energy double, mass double"


def test_increase_and_drift(spark):
    rows = [
        ("calm", 0, 0.0, 0.5, 1.0),
        ("calm", 1, 0.1, 0.45, 1.0),
        ("calm", 2, 0.2, 0.4, 1.0 + 5e-11),
        ("rising", 0, 0.0, 2.0, 1.0),
        ("rising", 1, 0.1, 2.0 + 1e-8, 1.0),  # within tolerance
        ("rising", 2, 0.2, 2.1, 0.5),
        ("rising", 3, 0.3, 2.2, 1.0),
    ]
    diag = spark.createDataFrame(rows, SCHEMA).withColumn("dt", F.lit(0.05))
    got = {r["run_id"]: r for r in summary.summarize_runs(diag, dt="dt").collect()}
    calm, rising = got["calm"], got["rising"]
    assert (calm["initial_energy"], calm["final_energy"], calm["saved_frames"]) == (0.5, 0.4, 3)
    assert not calm["energy_increase_observed"] and not calm["needs_review"]
    assert calm["first_energy_increase_step"] is None
    assert rising["energy_increase_count"] == 2 and rising["needs_review"]
    assert (rising["first_energy_increase_frame"], rising["first_energy_increase_time"]) == (2, 0.2)
    assert rising["first_energy_increase_step"] == 4
    assert rising["mass_drift"] == 0.5


def test_non_finite_diagnostics_are_reported(spark):
    rows = [("a", 0, 0.0, 1.0, 1.0), ("a", 1, 0.1, float("nan"), 1.0), ("b", 0, 0.0, 1.0, 1.0)]
    got = {r["run_id"]: r["finite"] for r in summary.summarize_runs(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {"a": False, "b": True}


def test_absent_metrics_count_as_zero(spark):
    diag = spark.createDataFrame([("a", 0, 0.0, 1.0), ("a", 1, 0.1, 0.9)], "run_id string, frame int, time double, energy double")
    row = summary.summarize_runs(diag).first()
    assert row["needs_review"] is False and "mass_drift" not in row.asDict()


def test_reynolds_is_null_when_inviscid(spark):
    df = spark.createDataFrame([(1.0, 2.0, 0.5), (1.0, 2.0, 0.0)], "a double, l double, n double")
    got = [r[0] for r in df.select(summary.reynolds(F.col("a"), F.col("l"), F.col("n"))).collect()]
    assert got == [4.0, None]


def test_steady_review(spark):
    df = spark.createDataFrame([("a", 1e-12, 0.1), ("b", 1e-7, 0.1)], "run_id string, residual_l2 double, pressure_l2_error double")
    got = {r["run_id"]: r["needs_review"] for r in summary.summarize_steady(df).collect()}
    assert got == {"a": False, "b": True}


def test_long_runs_cross_blocks(spark):
    n = 9000
    diag = spark.range(n).select(
        F.lit("r").alias("run_id"),
        F.col("id").cast("int").alias("frame"),
        (F.col("id") * 0.1).alias("time"),
        F.when(F.col("id") == 4096, 2.0).otherwise(1.0).alias("energy"),
    )
    row = summary.summarize_runs(diag).first()
    assert row["first_energy_increase_frame"] == 4096 and row["energy_increase_count"] == 1
