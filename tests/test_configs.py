import math

import pytest
from pyspark.sql import functions as F

from tidemark.plans import configs, sweeps

RAW = "id int, raw map<string,string>"


def _normalize(spark, *raws):
    df = spark.createDataFrame(list(enumerate(raws)), RAW)
    return [r for r in configs.normalize_configs(df).orderBy("id").collect()]


def test_defaults(spark):
    burgers, flow, plate = _normalize(spark, {}, {"equation": "navier_stokes2d"}, {"equation": "darcy2d"})
    c = burgers["config"]
    assert (c["equation"], c["viscosity"], c["grid_size"], c["dt"]) == ("burgers1d", 0.05, 32, 0.001)
    assert (c["steps"], c["save_every"], c["seed"], c["amplitude"]) == (100, 10, 0, 1.0)
    assert c["domain_length"] == 2 * math.pi and c["initial_condition"] == "sine"
    assert burgers["output_bytes"] == 8 * (11 * 36 + 32)
    assert flow["config"]["initial_condition"] == "taylor_green"
    assert flow["output_bytes"] == 8 * (11 * (3 * 32 * 32 + 6) + 64)
    p = plate["config"]
    assert (p["grid_size"], p["domain_length"], p["contrast"], p["viscosity"]) == (33, 1.0, 0.5, None)


@pytest.mark.parametrize(
    "raw, reason",
    [
        ({"viscosity": "-1"}, "viscosity"),
        ({"viscosity": "true"}, "viscosity"),
        ({"viscosity": "NaN"}, "viscosity"),
        ({"viscosity": "1e999"}, "viscosity"),
        ({"grid_size": "7"}, "grid_size"),
        ({"grid_size": "32.0"}, "grid_size"),
        ({"dt": "0"}, "dt"),
        ({"steps": "0"}, "steps"),
        ({"steps": "99999999999999999999"}, "steps"),
        ({"save_every": "0"}, "save_every"),
        ({"seed": "-1"}, "seed"),
        ({"domain_length": "0"}, "domain_length"),
        ({"domain_length": "1e-300"}, "spacing"),
        ({"amplitude": "1e200"}, "amplitude_range"),
        ({"dt": "1e308", "steps": "100"}, "duration"),
        ({"initial_condition": "taylor_green"}, "initial_condition"),
        ({"equation": "heat"}, "equation"),
        ({"viscocity": "0.1"}, "unknown_keys"),
        ({"grid_size": "9000000000"}, "output_size"),
        ({"equation": "darcy2d", "grid_size": "4"}, "grid_size"),
        ({"equation": "darcy2d", "grid_size": "514"}, "grid_size"),
        ({"equation": "darcy2d", "contrast": "0.9"}, "contrast"),
        ({"equation": "darcy2d", "viscosity": "0.1"}, "unknown_keys"),
        ({"equation": "darcy2d", "domain_length": "1e-150"}, "spacing"),
    ],
)
def test_refusals(spark, raw, reason):
    (row,) = _normalize(spark, raw)
    assert reason in row["reasons"] and row["config"] is None


def test_frame_count_and_steps(spark):
    df = spark.createDataFrame([(10, 5), (11, 5), (3, 10), (1, 1)], "s long, e long")
    got = df.select(configs.frame_count(F.col("s"), F.col("e")), configs.saved_steps(F.col("s"), F.col("e"))).collect()
    assert [tuple(r) for r in got] == [(3, [0, 5, 10]), (4, [0, 5, 10, 11]), (2, [0, 3]), (2, [0, 1])]


SPEC = "spec_id int, base map<string,string>, parameters map<string,array<string>>"


def _plan(spark, *specs):
    df = spark.createDataFrame([(i, *s) for i, s in enumerate(specs)], SPEC)
    return df, sweeps.plan_sweeps(df)


def test_grid_sizes(spark):
    two = {"seed": ["0", "1"], "viscosity": ["0.05", "0.1"]}
    _, plan = _plan(
        spark,
        ({}, {**two, "grid_size": ["32", "64"]}),
        ({}, {"viscosity": ["0.05", "0.05", "0.1"], "seed": ["0", "1"]}),
        ({}, {"viscosity": ["0.05", "-0.1"], "seed": ["0", "1"]}),
        ({}, {}),
    )
    sizes = {r["spec_id"]: r["count"] for r in plan.groupBy("spec_id").count().collect()}
    assert sizes == {0: 8, 1: 4, 3: 1}


def test_order_of_combinations(spark):
    df, _ = _plan(spark, ({"seed": "9", "steps": "7"}, {"b": ["1", "2"], "a": ["x", "y"], "seed": ["5"]}))
    rows = sweeps.expand_sweeps(df).orderBy("ordinal").collect()
    assert [(r["raw"]["a"], r["raw"]["b"]) for r in rows] == [("x", "1"), ("x", "2"), ("y", "1"), ("y", "2")]
    assert all(r["raw"]["seed"] == "5" and r["raw"]["steps"] == "7" for r in rows)


def test_refused_sweeps(spark):
    df, plan = _plan(
        spark,
        ({}, {"seed": []}),
        ({}, {"seed": [str(i) for i in range(10_001)]}),
        ({}, {"seed": [str(i) for i in range(10_000)]}),
    )
    got = {r["spec_id"]: r["reasons"] for r in sweeps.sweep_problems(df).collect()}
    assert got == {0: ["empty_parameter"], 1: ["too_many_combinations"]}
    assert {r["spec_id"]: r["count"] for r in plan.groupBy("spec_id").count().collect()} == {2: 10_000}


def test_identity_ignores_the_dirty_flag(spark):
    base = {"git_commit": "c", "python": "3", "git_dirty": "true"}
    rows = [(0, base, "p", 0), (1, {**base, "git_dirty": "false"}, "p", 0), (2, {**base, "python": "4"}, "p", 0), (3, base, None, 0), (4, base, "p", 1)]
    df = spark.createDataFrame(rows, "i int, prov map<string,string>, parent string, attempt int")
    ids = [r[0] for r in df.orderBy("i").select(configs.experiment_id(F.lit("{}"), F.col("prov"), F.col("parent"), F.col("attempt"))).collect()]
    assert ids[0] == ids[1] and len(set(ids)) == 4 and all(len(i) == 32 for i in ids)
    same = spark.createDataFrame([(base, {**base, "git_dirty": "x"}), (base, {"python": "3"})], "a map<string,string>, b map<string,string>")
    assert [r[0] for r in same.select(configs.same_runtime(F.col("a"), F.col("b"))).collect()] == [True, False]


def test_study_budget(spark):
    _, plan = _plan(spark, ({}, {"seed": ["0", "1", "2", "3"]}))
    studies = spark.createDataFrame(
        [(0, [1, 2], ["buffered"], 3, 5, "small"), (0, [2], ["fast"], 9, -1, "small")],
        "study_id int, workers array<int>, modes array<string>, repeats int, seed long, scale string",
    )
    ok, bad = sorted(
        sweeps.plan_studies(studies, plan.withColumnRenamed("spec_id", "study_id")).collect(),
        key=lambda r: len(r["reasons"]),
    )
    assert ok["reasons"] == [] and (ok["cases"], ok["fresh_runs"], ok["integration_steps"]) == (6, 24, 2400)
    assert bad["reasons"] == ["workers", "modes", "repeats", "seed"]
    cases = sweeps.order_cases(sweeps.plan_studies(studies, plan.withColumnRenamed("spec_id", "study_id"))).collect()
    assert sorted(r["position"] for r in cases) == list(range(6))
    assert len({(r["repeat"], r["workers"], r["mode"]) for r in cases}) == 6


def test_key_comparisons(spark):
    a = spark.createDataFrame([("x",), ("y",)], "config_key string")
    b = spark.createDataFrame([("y",), ("z",)], "config_key string")
    got = {tuple(r) for r in configs.compare_keys(a, b).collect()}
    assert got == {("x", "missing"), ("z", "unexpected")}
    m = spark.createDataFrame([({"dt": "1", "n": "8"}, {"dt": "0.5", "n": "8"})], "a map<string,string>, b map<string,string>")
    diff = m.select(configs.changed_parameters(F.col("a"), F.col("b")).alias("d")).first()["d"]
    assert {k: (v["before"], v["after"]) for k, v in diff.items()} == {"dt": ("1", "0.5")}
