import hashlib
import json

import pytest
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.operators import integrity
from tidemark.sources import catalog as c


def _lake(tmp_path, docs):
    root = tmp_path / "lake"
    for doc in docs:
        d = root / "experiments" / doc["id"]
        d.mkdir(parents=True)
        (d / "record.json").write_text(json.dumps(doc))
        (d / "fields.bin").write_bytes(doc["id"].encode() * 3)
        files = {p.name: hashlib.sha256(p.read_bytes()).hexdigest() for p in d.iterdir()}
        (d / "manifest.json").write_text(
            json.dumps({"version": 1, "algorithm": "sha256", "artifacts": files})
        )
    return str(root)


def _doc(run, nu, metrics, **more):
    return {
        "id": run,
        "status": "completed",
        "equation": "burgers1d",
        "solver": "fd",
        "created_at": "2026-01-01T00:00:00+00:00",
        "parent_id": None,
        "config": {"viscosity": nu, "grid_size": 128, "dt": 0.001, "steps": 10, "seed": 1},
        "provenance": {"git_commit": "abc", "dependencies": {"numpy": "2"}},
        "metrics": metrics,
        **more,
    }


DOCS = [
    _doc("run-1", 0.02, {"initial_energy": 0.5, "final_energy": 0.4, "mass_drift": 1e-14, "needs_review": False}),
    _doc("run-2", 0.1, {"initial_energy": 2.0, "final_energy": 1, "max_divergence": 0, "seed": 5.0, "sharp": 3}),
]


def test_golden_queries(spark, tmp_path):
    root = _lake(tmp_path, [*DOCS, _doc(".staging-x", 1, {})])
    table = c.union_catalogs(c.empty_catalog(spark), c.flatten_records(c.scan_records(spark, root)))
    got = c.select_runs(table, "SELECT id, final_energy FROM experiments WHERE viscosity < 0.05").collect()
    assert [tuple(r) for r in got] == [("run-1", 0.4)]
    assert c.select_runs(table, "SELECT count(*) FROM experiments").first()[0] == 2
    row = c.show_run(table, "run-2").first()
    assert row["mass_drift"] is None and row["sharp"] == 3.0
    assert row["seed"] == 1 and row["metric_seed"] == 5.0
    assert c.show_run(table, "run-1").first()["needs_review"] is False
    assert json.loads(row["provenance_json"])["git_commit"] == "abc"


def test_failed_only_catalog_has_null_flags(spark, tmp_path):
    root = _lake(tmp_path, [_doc("bad", 1.0, {}, status="failed", error={"type": "ValueError", "message": "x"})])
    row = c.flatten_records(c.scan_records(spark, root)).first()
    assert row["needs_review"] is None and "ValueError" in row["error"]


def test_empty_catalog_answers(spark, tmp_path):
    assert c.scan_records(spark, str(tmp_path)).count() == 0
    table = c.scan_catalog(spark, str(tmp_path / "none"))
    assert len(table.columns) == len(schemas.CATALOG.names) == 22
    assert c.select_runs(table, "SELECT count(*) FROM experiments WHERE needs_review").first()[0] == 0


@pytest.mark.parametrize(
    "sql",
    [
        "DELETE FROM experiments",
        "CREATE TABLE t AS SELECT * FROM experiments",
        "SELECT 1; SELECT 2",
        "SET spark.sql.ansi.enabled=false",
        "INSERT INTO experiments SELECT * FROM experiments",
        "SELECT * FROM parquet.`/tmp/x`",
        "SELECT * FROM other",
        "SELECT (SELECT max(x) FROM secret) FROM experiments",
        "SELECT * FROM experiments WHERE id IN (SELECT id FROM secret)",
        "SELECT reflect('java.lang.System', 'getenv', 'HOME') FROM experiments",
        "WITH a AS (SELECT * FROM secret) SELECT * FROM a",
        "EXPLAIN SELECT 1",
        "DROP TABLE experiments",
        "SELECT TRANSFORM(id) USING 'cat' FROM experiments",
        "CACHE TABLE experiments",
        "SELECT * FROM explode(TABLE(secret))",
        "SELECT * FROM explode(TABLE(SELECT x FROM secret))",
        "SELECT * FROM IDENTIFIER('secret')",
        "SELECT IDENTIFIER('reflect')('java.lang.System', 'getenv', 'HOME') FROM experiments",
        "EXECUTE IMMEDIATE 'SELECT 1'",
        "BEGIN SELECT 1; END",
        "SELECT * FROM experiments e, LATERAL (SELECT * FROM secret)",
        "SELECT id FROM experiments ORDER BY (SELECT max(x) FROM secret)",
        "SELECT CASE WHEN EXISTS (SELECT 1 FROM secret) THEN 1 END FROM experiments",
        "INSERT OVERWRITE DIRECTORY '/tmp/x' SELECT * FROM experiments",
        "DESCRIBE experiments",
        "not sql",
    ],
)
def test_refused_sql(spark, sql):
    with pytest.raises(c.RefusedQuery):
        c.select_runs(c.empty_catalog(spark), sql)


@pytest.mark.parametrize(
    "sql",
    [
        "SELECT equation, count(*) FROM experiments GROUP BY equation HAVING count(*) > 1 ORDER BY 1 LIMIT 3",
        "WITH a AS (SELECT id FROM experiments) SELECT * FROM a JOIN experiments USING (id)",
        "SELECT *, row_number() OVER (PARTITION BY equation ORDER BY id) FROM experiments",
        "SELECT id FROM experiments UNION SELECT parent_id FROM experiments",
        "SELECT e.id, m.n FROM experiments e, LATERAL (SELECT count(*) AS n FROM experiments x WHERE x.parent_id = e.id) m",
        "SELECT equation, rank() OVER (PARTITION BY equation ORDER BY viscosity) FROM experiments",
        "SELECT equation, status, count(*) FROM experiments GROUP BY ROLLUP (equation, status)",
        "SELECT approx_count_distinct(id), percentile(dt, 0.5) FROM experiments",
        "SELECT DISTINCT status FROM experiments WHERE EXISTS (SELECT 1 FROM experiments)",
        "SELECT e.id, x FROM experiments e LATERAL VIEW explode(array(1, 2)) t AS x",
        "SELECT * FROM (VALUES (1), (2)) AS v(n)",
        "SELECT equation, status, count(*) FROM experiments GROUP BY GROUPING SETS ((equation), (status), ())",
    ],
)
def test_allowed_sql(spark, sql):
    assert c.select_runs(c.empty_catalog(spark), sql).collect() is not None


def test_sql_filters_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "cat")
    table = c.empty_catalog(spark)
    spark.createDataFrame([("a", 0.5, "x")], "id string, viscosity double, extra string").write.parquet(path)
    scan = c.scan_catalog(spark, path)
    assert set(table.columns) < set(scan.columns)
    out = c.select_runs(scan, "SELECT id FROM experiments WHERE viscosity < 0.05")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "LessThan(viscosity,0.05)" in plan and "extra" not in plan.split("ReadSchema")[1]


def test_publication_is_idempotent_and_checked(spark, tmp_path):
    root = str(tmp_path / "pub")
    base = c.empty_catalog(spark)
    rows = c.union_catalogs(base, spark.createDataFrame([("r1", "completed", "burgers1d"), ("r2", "completed", "burgers1d"), ("bad id", "completed", "burgers1d")], "id string, status string, equation string"))
    frames = spark.createDataFrame(
        [("r1", "velocity", f, [1.0, 2.0]) for f in range(3)]
        + [("r2", "velocity", 0, [1.0]), ("r2", "velocity", 1, [1.0, 2.0])],
        "run_id string, field string, frame int, values array<double>",
    )
    done = {r["id"] for r in c.publish_runs(rows, frames, root).collect()}
    assert done == {"r1"}  # r2 is ragged, the third id is unsafe
    c.publish_runs(rows, frames, root)
    assert c.published_catalog(spark, root).count() == 1
    assert c.published_frames(spark, root).count() == 3
    # an attempt that died before its commit stays invisible
    rows.withColumn("batch", F.lit("dead")).write.mode("append").partitionBy("batch", "status").parquet(f"{root}/catalog")
    assert c.published_catalog(spark, root).count() == 1


def test_report_is_exclusive(spark, tmp_path):
    path = str(tmp_path / "report")
    c.write_report(spark.range(1), path)
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS|already exists"):
        c.write_report(spark.range(1), path)


def test_browse_and_listing(spark):
    df = spark.createDataFrame([("a", "burgers1d", "completed", True), ("B", "darcy2d", "failed", None)], "id string, equation string, status string, needs_review boolean")
    assert c.browse(df).count() == 2
    assert [r["id"] for r in c.browse(df, flagged=False).collect()] == ["B"]
    assert [r["id"] for r in c.browse(df, text="DARCY").collect()] == ["B"]
    assert tuple(c.listing_summary(df, 1).first()) == (1, 2, True, 1)
    with pytest.raises(ValueError):
        c.first_runs(df, 201)


def test_verification_of_files(spark, tmp_path):
    root = _lake(tmp_path, DOCS)
    one = tmp_path / "lake" / "experiments" / "run-1"
    check = lambda: {
        (r["path"], r["problem"])
        for r in integrity.artifact_problems(
            c.manifest_rows(c.scan_manifests(spark, root)), c.scan_artifacts(spark, root)
        ).collect()
    }
    assert check() == set()
    (one / "record.json").write_text("{}")
    (one / "fields.bin").unlink()
    (one / "extra.txt").write_text("x")
    assert check() == {
        ("record.json", "hash mismatch"),
        ("fields.bin", "missing"),
        ("extra.txt", "unexpected"),
    }
    (one / "manifest.json").write_text('{"version": 1}')
    bad = integrity.manifest_problems(c.scan_manifests(spark, root)).collect()
    assert [(r["run_id"], r["problem"]) for r in bad] == [("run-1", "invalid manifest")]
    sizes = integrity.stored_sizes(c.scan_artifacts(spark, root, content=False))
    assert sizes.filter("run_id = 'run-2'").first()["artifact_files"] == 2


def test_unsafe_and_unreadable(spark):
    m = spark.createDataFrame([("r", "../x", "a"), ("r", "/abs", "a"), ("r", "c:x", "a"), ("r", "ok", "a"), ("r", "gone", "a")], "run_id string, path string, sha256 string")
    a = spark.createDataFrame([("r", "ok", "a", True), ("r", "gone", None, False)], "run_id string, path string, sha256 string, is_link boolean")
    got = {(r["path"], r["problem"]) for r in integrity.artifact_problems(m, a).collect()}
    assert got == {("../x", "unsafe path"), ("/abs", "unsafe path"), ("c:x", "unsafe path"), ("ok", "symbolic link"), ("gone", "unreadable")}


def test_reuse(spark):
    want = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    have = spark.createDataFrame([("a", "failed"), ("b", "completed")], "id string, status string")
    bad = spark.createDataFrame([("b", "missing")], "id string, problem string")
    got = {r["id"]: r["action"] for r in c.reuse_plan(want, have, bad).collect()}
    assert got == {"a": "reuse", "b": "corrupt", "c": "run"}


def test_metrics_keep_their_types(spark, tmp_path):
    docs = [
        _doc("run-1", 0.1, {"flag": True, "sampling": "saved_frames", "rate": 2, "mixed": 1, "ID": 7, "config_json": "c"}),
        _doc("run-2", 0.1, {"flag": False, "sampling": "all", "rate": 2.5, "mixed": "n/a", "Rate": 1}),
    ]
    # "Rate" sorts first and takes the name; Spark does not tell "rate" from it.
    table = c.flatten_records(c.scan_records(spark, _lake(tmp_path, docs)))
    kinds = dict(table.dtypes)
    assert (kinds["flag"], kinds["sampling"], kinds["metric_rate"], kinds["mixed"]) == ("boolean", "string", "double", "string")
    row = table.filter("id = 'run-1'").first()
    assert (row["flag"], row["sampling"], row["metric_rate"], row["mixed"]) == (True, "saved_frames", 2.0, "1")
    # Names that differ from taken ones in case only get the prefix too.
    assert row["metric_ID"] == 7.0 and row["metric_config_json"] == "c"
    assert len({n.lower() for n in table.columns}) == len(table.columns)


def test_catalog_files_of_other_types_are_widened(spark, tmp_path):
    path = str(tmp_path / "catalog")
    rows = [("a", 1), ("b", 2)]
    spark.createDataFrame(rows, "id string, extra long").write.parquet(f"{path}/batch=1")
    spark.createDataFrame([("c", 2.5)], "id string, extra double").write.parquet(f"{path}/batch=2")
    spark.createDataFrame([("d", "x", True)], "id string, note string, flag boolean").write.parquet(f"{path}/batch=3")
    got = {r["id"]: (r["extra"], r["note"], r["flag"]) for r in c.scan_catalog(spark, path).collect()}
    assert got == {"a": (1.0, None, None), "b": (2.0, None, None), "c": (2.5, None, None), "d": (None, "x", True)}


def test_the_first_commit_of_an_id_stays(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "lake")
    row = lambda solver: c.union_catalogs(c.empty_catalog(spark), spark.createDataFrame([("run-1", "completed", "burgers1d", solver)], "id string, status string, equation string, solver string"))
    held = {}
    real = c.committed_runs
    monkeypatch.setattr(c, "committed_runs", lambda s, r: held.setdefault("before", real(s, r).limit(0)))
    # Both attempts start before either commits, with batch names in either order.
    for names in (("f" * 32, "0" * 32), ("0" * 32, "f" * 32)):
        target = f"{root}-{names[0][0]}"
        for name, solver in zip(names, ("first", "second")):
            monkeypatch.setattr(c.uuid, "uuid4", lambda name=name: type("U", (), {"hex": name}))
            c.publish_runs(row(solver), None, target)
        with monkeypatch.context() as restored:
            restored.setattr(c, "committed_runs", real)
            assert [r["solver"] for r in c.published_catalog(spark, target).collect()] == ["first"]


def test_different_rows_of_one_run_are_refused(spark, tmp_path):
    root = str(tmp_path / "lake")
    rows = lambda *solvers: c.union_catalogs(
        c.empty_catalog(spark),
        spark.createDataFrame([("run-1", "completed", s) for s in solvers], "id string, status string, solver string"),
    )
    with pytest.raises(ValueError, match="run-1"):
        c.publish_runs(rows("a", "b"), None, root)
    assert c.committed_runs(spark, root).count() == 0
    c.publish_runs(rows("a", "a"), None, root)
    assert [r["solver"] for r in c.published_catalog(spark, root).collect()] == ["a"]
