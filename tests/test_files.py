import hashlib

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tidemark.operators import integrity, lineage
from tidemark.plans import acquisition, configs
from tidemark.sources import catalog as c
from tidemark.sources import files
from tidemark.suite import lake


def test_files_of_several_types_in_one_folder(spark, tmp_path):
    path = str(tmp_path / "catalog")
    write = lambda rows, schema: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    write([("a", 1, 1, 1)], "id string, x int, y int, z int")
    write([("b", 2, 2**40, 2)], "id string, x int, y bigint, z bigint")
    write([("c", 0.5, 0.5)], "id string, y double, z double")
    write([("d", "text", (1, 2))], "id string, z string, only struct<p:int,q:int>")
    write([("e", "plain")], "id string, only string")
    pq.write_table(pa.table({"id": ["f"], "y": pa.array([7], pa.int16()), "new": [True]}), f"{path}/other.parquet")
    got = c.scan_catalog(spark, path)
    kinds = dict(got.dtypes)
    assert (kinds["x"], kinds["y"], kinds["z"], kinds["only"]) == ("int", "double", "string", "string")
    rows = {r["id"]: (r["x"], r["y"], r["z"], r["only"], r["new"]) for r in got.collect()}
    assert rows == {
        "a": (1, 1.0, "1", None, None), "b": (2, float(2**40), "2", None, None), "c": (None, 0.5, "0.5", None, None),
        "d": (None, None, "text", '{"p":1,"q":2}', None), "e": (None, None, None, "plain", None),
        "f": (None, 7.0, None, None, True),
    }


def test_integers_stay_integers(spark, tmp_path):
    path = str(tmp_path / "catalog")
    big = 2**60 + 1
    spark.createDataFrame([("a", 1)], "id string, x int").write.parquet(f"{path}/batch=1")
    spark.createDataFrame([("b", big)], "id string, x bigint").write.parquet(f"{path}/batch=2")
    got = c.scan_catalog(spark, path)
    assert {(r["id"], r["x"], r["batch"]) for r in got.collect()} == {("a", 1, 1), ("b", big, 2)}


def test_a_file_without_a_footer_is_an_error(spark, tmp_path):
    bad = tmp_path / "x.parquet"
    bad.write_bytes(b"nothing")
    found = files.footer_schemas(files.list_files(spark, str(tmp_path))).first()
    assert found["schema"] is None and found["error"]


def test_many_folders_are_listed_in_few_tasks(spark, tmp_path):
    for n in range(200):
        (tmp_path / f"run-{n}" / "fields").mkdir(parents=True)
        (tmp_path / f"run-{n}" / "fields" / "a").write_bytes(b"x" * n)
    (tmp_path / "top").write_bytes(b"abc")
    listed = files.list_files(spark, str(tmp_path))
    assert listed.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism
    got = {r["path"].removeprefix(f"{tmp_path}/"): r["length"] for r in listed.collect()}
    assert got == {f"run-{n}/fields/a": n for n in range(200)} | {"top": 3}


def test_documents_read_in_tasks_equal_those_of_the_json_reader(spark, tmp_path):
    texts = {
        "plain": '{"a": 1,\n "b": {"c": "x"}}', "list": '[{"a": 2}, {"a": 3, "b": {}}]', "none": "[]", "cut": '{"a": 4, "b',
        "wrong": '{"a": "x", "b": {"c": "y"}}', "empty": "", "blank": " \n", "number": "5", "known": '{"a": 6, "z": [1]}',
    }
    for name, text in texts.items():
        (tmp_path / f"{name}.json").write_text(text)
    schema = "a bigint, b struct<c: string>"
    rows = lambda df: sorted(df.collect(), key=repr)
    want = rows(c.read_json(spark, str(tmp_path), schema))
    assert len(want) > 6
    assert rows(c.read_documents(files.list_files(spark, str(tmp_path)), schema)) == want


def test_documents_and_absent_files(spark, tmp_path):
    for n in range(20):
        (tmp_path / f"{n:02}").write_bytes(bytes([n]) * n)
    listed = files.list_files(spark, str(tmp_path)).withColumn("sized", F.lit(1)).coalesce(1)
    listed = spark.createDataFrame([*listed.collect(), (f"{tmp_path}/gone", 0, 1)], listed.schema)
    got = {r["path"].rsplit("/", 1)[1]: (r["content"], r["error"]) for r in files.read_files(listed).collect()}
    want = {f"{n:02}": (bytearray([n] * n), None) for n in range(20)}
    assert got == want | {"gone": (None, files.ABSENT)}


def test_an_empty_manifest_is_a_problem_of_its_run(spark, tmp_path):
    for name, text in (("run-1", ""), ("run-2", '{"version": 1, "algorithm": "sha256", "artifacts": {"a": "0"}}'), (".staging-run-3", "")):
        (tmp_path / "experiments" / name).mkdir(parents=True)
        (tmp_path / "experiments" / name / "manifest.json").write_text(text)
    (tmp_path / "experiments" / "run-4").mkdir()
    found = {r["run_id"]: r["valid"] for r in c.scan_manifests(spark, str(tmp_path)).collect()}
    assert found == {"run-1": False, "run-2": True}


def test_sweep_documents_are_written_by_many_tasks(spark, tmp_path, monkeypatch):
    parts = spark.range(1, 40).selectExpr("id AS p_partkey", "CAST(id % 50 AS INT) AS p_size")
    parts.coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    seen, write = [], files.write_files
    monkeypatch.setattr(files, "write_files", lambda rows, root: (seen.append(rows.rdd.getNumPartitions()), write(rows, root))[1])
    got = {r["seed"]: (r["viscosity"], r["values"], r["last"]) for r in lake.sweep_documents(spark, str(tmp_path)).collect()}
    assert seen == [spark.sparkContext.defaultParallelism]
    assert got == {k: (k % 50 / 50.0, 2 + k % 3, float(k + 1 + k % 3)) for k in range(1, 40)}


def test_digests_in_chunks_and_unreadable_files(spark, tmp_path):
    data = {"empty": b"", "small": b"abc", "large": bytes(range(256)) * 1000}
    for name, content in data.items():
        (tmp_path / name).write_bytes(content)
    listed = files.list_files(spark, str(tmp_path)).withColumn("sized", F.lit(1))
    listed = spark.createDataFrame(listed.collect(), listed.schema)
    assert files.remove_files(listed.filter(F.col("path").endswith("small"))) == 1
    got = {r["path"].rsplit("/", 1)[1]: (r["length"], r["sha256"]) for r in files.file_digests(listed, 777).collect()}
    want = {n: (len(b), hashlib.sha256(b).hexdigest()) for n, b in data.items()} | {"small": (3, None)}
    assert got == want


def test_written_files(spark, tmp_path):
    rows = spark.createDataFrame([("a/b.txt", "x"), ("c", None), ("a/d", "é" * 3)], "path string, content string")
    got = {(r["path"], r["length"]) for r in files.write_files(rows, str(tmp_path)).collect()}
    assert got == {("a/b.txt", 1), ("c", 0), ("a/d", 6)}
    assert (tmp_path / "a" / "d").read_text() == "ééé" and sorted(p.name for p in (tmp_path / "a").iterdir()) == ["b.txt", "d"]


def _evidence(spark):
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    runs = ["r1", "r2", "r3", "r4", "r5"]
    records = spark.createDataFrame([(r,) for r in runs if r != "r5"], "id string")
    manifests = spark.createDataFrame([("r1", True), ("r2", True), ("r3", False), ("r5", True)], "run_id string, valid boolean")
    listed = [(r, "record.json", sha(r)) for r in runs]
    actual = [(r, "record.json", sha(r + "x" * (r == "r2"))) for r in runs]
    make = lambda rows: spark.createDataFrame(rows, "run_id string, path string, sha256 string")
    return {"records": records, "manifests": manifests, "listed": make(listed), "actual": make(actual)}


def test_only_verified_records_are_evidence(spark):
    given = _evidence(spark)
    problems = lineage.evidence_problems(**given)
    assert {(r["run_id"], r["problem"]) for r in problems.collect()} == {
        ("r2", "hash mismatch"), ("r3", "invalid manifest"), ("r4", "no manifest"), ("r5", "no record")
    }
    kept = lineage.verified_records(given["records"], problems)
    assert [r["id"] for r in kept.collect()] == ["r1"]
    with pytest.raises(lineage.UnverifiedEvidence):
        lineage.verified_records(given["records"], problems, strict=True)
    nothing = problems.filter("false")
    assert lineage.verified_records(given["records"], nothing, strict=True).count() == 4


def test_refined_configurations(spark):
    raw = [
        ("still", {"equation": "darcy2d", "grid_size": "9"}),
        ("edge", {"equation": "darcy2d", "grid_size": "400"}),
        ("moving", {"equation": "burgers1d", "dt": "0.01", "steps": "7", "save_every": "2"}),
    ]
    runs = spark.createDataFrame(raw, "id string, raw map<string,string>")
    got = {r["id"]: r for r in lineage.refine_configs(configs.normalize_configs(runs).select("id", "config")).collect()}
    assert got["still"]["changes"] == '{"grid_size":{"before":9,"after":17}}' and got["still"]["cost"] == 1
    assert got["edge"]["invalid"] == "grid_size" and got["edge"]["config_key"] is None and got["edge"]["changes"] is None
    assert got["moving"]["changes"] == (
        '{"dt":{"before":0.01,"after":0.005},"save_every":{"before":2,"after":4},"steps":{"before":7,"after":14}}'
    )
    # as if the refined configurations were normalised themselves
    raw = [(r["id"], {k: str(v) for k, v in r["candidate"].asDict().items() if v is not None}) for r in got.values() if r["candidate"]]
    again = configs.normalize_configs(spark.createDataFrame(raw, "id string, raw map<string,string>"))
    for row in again.select("id", configs.config_key().alias("key"), "reasons").collect():
        assert row["reasons"] == [] and row["key"] == got[row["id"]]["config_key"]
    # the identity is that of the same configuration written down by hand
    hand = [("x", {"equation": "burgers1d", "dt": "5e-3", "steps": "14", "save_every": "4"})]
    same = configs.normalize_configs(spark.createDataFrame(hand, "id string, raw map<string,string>"))
    assert same.select(configs.config_key()).first()[0] == got["moving"]["config_key"]


def test_an_acquisition_proves_itself(spark, tmp_path):
    rows = [(s, f, [float(s), float(f)]) for s in range(8) for f in range(5)]
    frames = spark.createDataFrame(rows, "sample int, frame int, values array<float>")
    options = {"shape": (8, 5, 2), "samples": 3, "sample_seed": 1, "time_stop": 4, "origin": {"source_url": "https://a.org"}}
    tables = acquisition.subset_tables(frames, **options)
    path = str(tmp_path / "subset")
    acquisition.write_subset(tables, path)
    assert acquisition.verify_subset(spark, path).count() == 0
    receipt = tables["receipt"].orderBy("request").collect()
    assert [(r["range_start"], r["range_end"]) for r in receipt] == [(r["sample"] * 40, r["sample"] * 40 + 31) for r in receipt]
    assert [r["request"] for r in receipt] == [0, 1, 2] and receipt[0]["received_bytes"] == 32
    with pytest.raises(Exception, match="already exists"):
        acquisition.write_subset(tables, path)
    for bad in ({"samples": 2}, {"time_stop": 6}, {"max_bytes": 95}):
        with pytest.raises(ValueError):
            acquisition.subset_tables(frames, **options | bad)
    name = next(p for p in (tmp_path / "subset" / "receipt").iterdir() if p.name.startswith("part-"))
    name.write_bytes(name.read_bytes() + b"x")
    assert {r["problem"] for r in integrity_problems(spark, path)} == {"hash mismatch"}


def integrity_problems(spark, path):
    from tidemark.plans import export

    return export.verify_bundle(spark, path, acquisition.KIND).collect()


def test_required_artifacts_of_a_subset():
    assert integrity.REQUIRED_ARTIFACTS[acquisition.KIND] == ("metadata.json", "receipt", "source")
