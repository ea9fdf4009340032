import math
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import datasets as d

T = "trajectory_id int, family_key string, initial_field_sha256 string"


def test_families_are_transitive(spark):
    rows = [(0, "a", "1"), (1, "b", "1"), (2, "b", "2"), (3, "c", "2"), (4, "d", "4"), (5, "e", "5"), (6, "d", "6")]
    got = {r["trajectory_id"]: r["family_id"] for r in d.families(spark.createDataFrame(rows, T)).collect()}
    groups = {}
    for k, v in got.items():
        groups.setdefault(v, set()).add(k)
    assert sorted(map(sorted, groups.values())) == [[0, 1, 2, 3], [4, 6], [5]]


def test_split_sizes_and_determinism(spark):
    fam = spark.createDataFrame([(f"f{i}",) for i in range(23)], "family_id string")
    first = {r["family_id"]: r["split"] for r in d.split_families(fam, 3).collect()}
    again = {r["family_id"]: r["split"] for r in d.split_families(fam.repartition(7), 3).collect()}
    assert first == again
    counts = {s: list(first.values()).count(s) for s in d.SPLITS}
    assert counts == {"train": 15, "validation": 4, "test": 4}
    assert first != {r["family_id"]: r["split"] for r in d.split_families(fam, 4).collect()}
    with pytest.raises(ValueError):
        d.split_families(fam, -1)


def test_too_few_families_fail_the_audit(spark):
    rows = [(i, "sine", "x") for i in range(3)]
    assigned = d.families_and_splits(spark.createDataFrame(rows, T), 0)
    audit = d.split_audit(assigned).first()
    assert not audit["passed"] and audit["unassigned"] == 3


def test_audit_finds_leaks(spark):
    rows = [("a", "train"), ("a", "test"), ("b", "validation"), ("c", "test")]
    audit = d.split_audit(spark.createDataFrame(rows, "family_id string, split string")).first()
    assert audit["leaking_families"] == 1 and not audit["passed"]


def test_normalization_uses_training_values_only(spark):
    rng = np.random.default_rng(1)
    train, other = rng.normal(3, 2, (4, 16)).astype("f4"), rng.normal(-50, 9, (2, 16))
    rows = [("train", t.tolist()) for t in train] + [("test", o.tolist()) for o in other]
    df = spark.createDataFrame(rows, "split string, values array<double>")
    n = d.training_normalization(df).first()
    v = train.astype("f8").ravel().tolist()
    assert n["count"] == 64 and math.isclose(n["mean"], statistics.fmean(v), rel_tol=1e-12)
    assert math.isclose(n["std"], statistics.pstdev(v), rel_tol=1e-12) and not n["constant_training_data"]
    flat = spark.createDataFrame([("train", [2.0, 2.0])], "split string, values array<double>")
    row = d.training_normalization(flat).first()
    assert (row["std"], row["constant_training_data"]) == (1.0, True)


def test_pairs_stay_inside_a_trajectory(spark):
    rows = [("a", f, [float(f)]) for f in range(3)] + [("b", f, [10.0 + f]) for f in range(2)]
    df = spark.createDataFrame(rows, "run_id string, frame int, values array<double>")
    norm = spark.createDataFrame([(1.0, 2.0)], "mean double, std double")
    got = sorted((r["run_id"], r["frame"], r["input"], r["target"]) for r in d.normalized_pairs(df, norm).collect())
    assert got == [("a", 0, [-0.5], [0.0]), ("a", 1, [0.0], [0.5]), ("b", 0, [4.5], [5.0])]


def test_eligibility_reasons(spark):
    x = [0.0, 0.25, 0.5, 0.75]
    base = dict(id="r", status="completed", equation="burgers1d", needs_review=False, boundary="periodic", domain_length=1.0, viscosity=0.1, times=[0.0, 0.1, 0.2], x=x, frames=3, problems=0)
    cases = [
        ({}, None),
        ({"problems": 1}, "failed verification"),
        ({"status": "failed"}, "not a completed burgers1d run"),
        ({"needs_review": True}, "needs review"),
        ({"boundary": "open"}, "not periodic"),
        ({"times": [0.0, 0.1, 0.3]}, "bad time coordinate"),
        ({"x": [0.0, 0.25, 0.5]}, "bad x coordinate"),
        ({"viscosity": -1.0}, "bad viscosity"),
        ({"x": [0.0, 1 / 3, 2 / 3, 1.0]}, "repeated endpoint"),
        ({"frames": 4}, "frames do not match times"),
    ]
    rows = [{**base, **change, "n": i} for i, (change, _) in enumerate(cases)]
    schema = "n int, id string, status string, equation string, needs_review boolean, boundary string, domain_length double, viscosity double, times array<double>, x array<double>, frames int, problems int"
    names = [f.split()[0] for f in schema.split(", ")]
    df = spark.createDataFrame([tuple(r[c] for c in names) for r in rows], schema)
    got = [r["reject_reason"] for r in d.eligibility(df).orderBy("n").collect()]
    assert got == [reason for _, reason in cases]


def test_contract_outliers(spark):
    df = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "2")], "id string, contract_sha256 string")
    assert [r["id"] for r in d.contract_outliers(df).collect()] == ["c"]


def test_coordinate_problems(spark):
    axes = {("ok", "x"): [0, 1, 2, 3], ("short", "x"): [0, 1, 2], ("back", "x"): [0, 1, 0.5, 3], ("uneven", "x"): [0, 1, 2, 3.5], ("nan", "x"): [0, 1, float("nan"), 3], ("t", "time"): [0, 1]}
    rows = [(r, a, i, float(v)) for (r, a), vs in axes.items() for i, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "run_id string, axis string, idx int, value double")
    got = {r["run_id"]: r["problem"] for r in d.coordinate_problems(df, {"x": 4, "time": 2}).collect()}
    assert got == {"short": "too short", "back": "not increasing", "uneven": "not uniform", "nan": "not finite"}


def test_import_selection_and_budget(spark):
    rows = [(s, f, [float(s if s > 1 else 0)] * 8) for s in range(6) for f in range(5)]
    df = spark.createDataFrame(rows, "sample int, frame int, values array<float>")
    chosen = d.select_tensor(df, samples=[4, 0, 1], time_stop=3)
    got = {(r["sample"], r["ordinal"]) for r in chosen.collect()}
    assert got == {(4, 0), (0, 1), (1, 2)} and chosen.count() == 9
    budget = d.tensor_budget(chosen, 8, 71).first()
    assert (budget["samples"], budget["selected_values"], budget["fits"]) == (3, 72, False)
    made = d.import_trajectories(chosen, "f" * 64).collect()
    keys = {r["source_index"]: r["family_key"] for r in made}
    assert keys[0] == keys[1] != keys[4] and all(r["trajectory_id"].startswith("f" * 16 + "-") for r in made)
    for bad in ([1, 2], [1, 1, 2]):
        with pytest.raises(ValueError):
            d.select_tensor(df, samples=bad)
    with pytest.raises(ValueError):
        d.tensor_budget(chosen, 8, 0)
    assert d.tensor_budget(chosen, 8, 10**15).first()["fits"]


def test_selection_filters_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "tensor")
    spark.createDataFrame([(s, 0, [0.0]) for s in range(5)], "sample int, frame int, values array<float>").write.parquet(path)
    plan = d.select_tensor(spark.read.parquet(path), samples=[0, 1, 2], time_stop=2)._jdf.queryExecution().executedPlan().toString()
    assert "LessThan(frame,2)" in plan and "In(sample" in plan


def test_provenance(spark):
    rows = [("https://a.org/x", "1", "MIT"), ("ftp://a.org", " ", None), ("https://", "1", "MIT")]
    df = spark.createDataFrame(rows, "source_url string, source_version string, license_name string")
    got = [r["reasons"] for r in d.provenance_problems(df).collect()]
    assert got == [[], ["source_url", "source_version", "license_name"], ["source_url"]]


def test_seeded_sample_ignores_layout(spark):
    df = spark.range(500)
    a = sorted(r["id"] for r in d.seeded_sample(df, "id", 24, 7).collect())
    b = sorted(r["id"] for r in d.seeded_sample(df.repartition(9), "id", 24, 7).collect())
    assert a == b and len(set(a)) == 24


def test_normalization_weighs_frames_by_their_length(spark):
    rows = [("train", [2.0]), ("train", [4.0, 4.0, 2.0]), ("train", [0.0, 6.0, 3.0])]
    got = d.training_normalization(spark.createDataFrame(rows, "split string, values array<double>")).first()
    values = np.array([2.0, 4.0, 4.0, 2.0, 0.0, 6.0, 3.0])
    assert got["count"] == 7 and got["mean"] == pytest.approx(values.mean())
    assert got["std"] == pytest.approx(values.std())
