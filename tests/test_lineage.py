import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import lineage as l


def test_lineage_has_placeholders(spark):
    df = spark.createDataFrame([("a", None, "completed"), ("b", "a", "failed"), ("c", "gone", "completed")], "id string, parent_id string, status string").withColumns({"equation": F.lit("e"), "solver": F.lit("s")})
    assert {(r["source"], r["target"]) for r in l.lineage_edges(df).collect()} == {("a", "b"), ("gone", "c")}
    nodes = {r["id"]: r["missing"] for r in l.lineage_nodes(df).collect()}
    assert nodes == {"a": False, "b": False, "c": False, "gone": True}


ENT = "type string, properties string, links array<struct<type:string,target:string>>"


def test_entity_rules(spark):
    rows = [
        ("Hypothesis", '{"statement":"x"}', None),
        ("Hypothesis", "{}", None),
        ("Finding", '{"statement":"x"}', None),
        ("Finding", '{"statement":"x"}', [("cites", "run-1")]),
        ("Opinion", "{}", None),
        ("Dataset", "{}", [("likes", "x")]),
        ("Dataset", "{}", [("cites", "")]),
        ("Dataset", "[1]", None),
    ]
    df = spark.createDataFrame(rows, ENT).withColumn("n", F.monotonically_increasing_id())
    got = [r["reasons"] for r in l.check_entities(df).orderBy("n").collect()]
    assert got == [[], ["statement required"], ["finding must cite evidence"], [], ["unknown type"], ["unsupported link"], ["unsupported link"], ["invalid properties"]]


def test_registration_is_idempotent(spark):
    df = spark.createDataFrame([("Hypothesis", '{"statement":"x"}', None)] * 2, ENT)
    none = spark.createDataFrame([], "id string")
    first = l.register_entities(df, none)
    assert first.count() == 1 and l.register_entities(df, first).count() == 0
    assert first.first()["id"].startswith("hypothesis-") and len(first.first()["id"]) == len("hypothesis-") + 24


def _records(spark, rows):
    return spark.createDataFrame(rows, "id string, status string, parent_id string, needs_review boolean, error string").withColumns(
        {
            "equation": F.lit("burgers1d"),
            "solver": F.lit("fd"),
            "created_at": F.lit("2026"),
            "config_json": F.lit("{}"),
            "boundary": F.lit(None).cast("string"),
            "initial_condition": F.lit("sine"),
            "grid_size": F.lit(8),
            "seed": F.lit(1),
            "source_sha256": F.lit("s"),
            "final_energy": F.lit(1.0),
        }
    )


def test_graph(spark):
    recs = _records(spark, [("r1", "completed", None, True, None), ("r2", "failed", "r1", None, "boom"), ("r3", "completed", "lost", False, None)])
    cite = l.check_entities(spark.createDataFrame([("Finding", '{"statement":"s"}', [("cites", "nowhere")])], ENT))
    graph = l.build_graph(recs, cite, ["final_energy"])
    kinds = {r["type"]: r["count"] for r in graph["nodes"].groupBy("type").count().collect()}
    assert kinds == {"Experiment": 3, "Equation": 1, "Solver": 1, "BoundaryCondition": 1, "InitialCondition": 1, "Dataset": 2, "Metric": 3, "Anomaly": 2, "Finding": 1, "Unresolved": 2}
    links = {r["type"]: r["count"] for r in graph["edges"].groupBy("type").count().collect()}
    assert links == {"solves": 3, "uses": 3, "has_boundary": 3, "starts_from": 3, "produces": 2, "measures": 3, "observed_in": 2, "parent_of": 2, "cites": 1}


def test_asserted_nodes_override(spark):
    a = spark.createDataFrame([("x", "Experiment", "{}")], "id string, type string, properties string")
    b = spark.createDataFrame([("x", "Finding", '{"s":1}')], "id string, type string, properties string")
    assert l.merge_nodes(a, b).first()["type"] == "Finding"


def test_refinement_example(spark):
    df = spark.createDataFrame([("r", "burgers1d", 8, 0.001, 4, 2), ("d", "darcy2d", 9, None, None, None)], "id string, equation string, grid_size int, dt double, steps int, save_every int")
    got = {r["id"]: r for r in l.refine(df).collect()}
    assert (got["r"]["new_dt"], got["r"]["new_steps"], got["r"]["new_save_every"], got["r"]["cost"]) == (0.0005, 8, 4, 8)
    assert got["d"]["new_grid_size"] == 17 and got["d"]["cost"] == 1


def _greedy(rows, max_runs, budget):
    rows = sorted(rows, key=lambda r: (r[1] != "failed", not r[2], r[0]))
    picked, skipped, used = [], [], 0
    for rid, _status, _flag, cost, invalid, child in rows:
        if len(picked) == max_runs:
            break
        if invalid:
            skipped.append((rid, invalid))
        elif child:
            continue
        elif used + cost > budget:
            skipped.append((rid, "total step budget"))
        else:
            picked.append((len(picked), rid, cost, used + cost))
            used += cost
    return picked, skipped


CAND = "id string, status string, needs_review boolean, cost long, invalid string, has_child boolean"


@pytest.mark.parametrize("max_runs,budget", [(3, 20), (5, 40), (32, 10), (1, 7), (8, 100000)])
def test_greedy_choice_equals_a_loop(spark, max_runs, budget):
    rnd = random.Random(max_runs)
    rows = [
        (f"r{i:03d}", rnd.choice(["failed", "completed"]), rnd.choice([True, False]), rnd.randint(1, 30), rnd.choice([None, None, None, "dt"]), rnd.random() < 0.2)
        for i in range(120)
    ]
    out = l.select_proposals(spark.createDataFrame(rows, CAND), max_runs=max_runs, max_total_steps=budget)
    picked, skipped = _greedy(rows, max_runs, budget)
    assert [tuple(r) for r in out["proposals"].orderBy("position").collect()] == picked
    assert sorted(tuple(r) for r in out["skipped"].collect()) == sorted(skipped)


def test_budget_limits(spark):
    df = spark.createDataFrame([], CAND)
    for kwargs in ({"max_runs": 0}, {"max_runs": 33}, {"max_total_steps": 0}, {"max_total_steps": 100_001}):
        with pytest.raises(ValueError):
            l.select_proposals(df, **kwargs)
    assert l.select_proposals(df)["proposals"].count() == 0


def test_checksums(spark):
    df = spark.createDataFrame([("a", "x"), ("b", "y")], "id string, text string").withColumn("sha256", F.sha2(F.lit("x"), 256))
    assert [r["id"] for r in l.entity_checksums(df).collect()] == ["b"]


def test_different_initial_conditions_are_different_nodes(spark):
    rows = [(f"r{k}", "completed", "burgers1d", "fd", 16, "sine", 1, a, length) for k, (a, length) in enumerate([(1.0, 1.0), (2.0, 1.0), (1.0, 2.0), (1.0, 1.0)])]
    schema = "id string, status string, equation string, solver string, grid_size long, initial_condition string, seed long, amplitude double, domain_length double"
    records = spark.createDataFrame(rows, schema).selectExpr(
        "*", "'periodic' AS boundary", "'s' AS source_sha256", "'{}' AS config_json", "'{\"git\":1}' AS provenance_json",
        "'{}' AS metrics_json", "'t' AS created_at", "CAST(NULL AS STRING) AS error", "false AS needs_review",
    )
    nodes = l.derived_nodes(records, [])
    assert nodes.filter("type = 'InitialCondition'").count() == 3
    assert nodes.filter("type = 'Experiment' AND properties LIKE '%git%'").count() == 4
