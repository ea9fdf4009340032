import json

import pytest
from pyspark.sql import functions as F

from tidemark.plans import export
from tidemark.sources import catalog

RUN = "id string, status string, equation string, needs_review boolean, boundary string, domain_length double, viscosity double, times array<double>, x array<double>, frames int, problems int, initial_condition string, seed int"


def _tables(spark, seed=0, sine=False):
    n, times = 16, [0.0, 0.1, 0.2, 0.3, 0.4]
    x = [i / n for i in range(n)]
    rows = [
        (f"r{i}", "completed", "burgers1d", False, "periodic", 1.0, 0.1, times, x, 5, 0, "sine" if sine else "random", i)
        for i in range(6)
    ]
    rows.append(("flagged", "completed", "burgers1d", True, "periodic", 1.0, 0.1, times, x, 5, 0, "random", 9))
    rows.append(("other", "completed", "burgers1d", False, "periodic", 1.0, 0.5, times, x, 5, 0, "random", 9))
    rows.append(("nan", "completed", "burgers1d", False, "periodic", 1.0, 0.1, times, x, 5, 0, "random", 8))
    frames = [
        (r[0], f, times[f], [float("nan") if r[0] == "nan" and f == 2 else (k + f) * 0.1 + j for j in range(n)])
        for k, r in enumerate(rows)
        for f in range(5)
    ]
    return export.plan_dataset(
        spark.createDataFrame(rows, RUN),
        spark.createDataFrame(frames, "run_id string, frame int, time double, values array<double>"),
        seed,
    )


def test_export_publish_verify_tamper(spark, tmp_path):
    tables = _tables(spark)
    rejected = {r["id"]: r["reject_reason"] for r in tables["rejected"].collect()}
    assert rejected == {"flagged": "needs review", "other": "different time, grid or viscosity", "nan": "non-finite values"}
    splits = {r["id"]: r["split"] for r in tables["trajectories"].collect()}
    assert len(splits) == 6 and sorted(splits.values()) == ["test"] + ["train"] * 4 + ["validation"]
    assert tables["audit"].first()["passed"]
    path = str(tmp_path / "dataset")
    export.write_dataset(tables, 0, path)
    check = lambda: {r["problem"] for r in export.verify_bundle(spark, path, "dataset").collect()}
    assert check() == set()
    stored = spark.read.parquet(f"{path}/frames")
    assert stored.count() == 30 and dict(stored.dtypes)["values"] == "array<float>"
    meta = spark.read.json(f"{path}/metadata.json").first()
    assert meta["normalization"]["count"] == 4 * 5 * 16 and meta["split_seed"] == 0
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS|already exists"):
        export.write_dataset(tables, 0, path)
    part = next(p for p in (tmp_path / "dataset" / "trajectories").iterdir() if p.suffix == ".parquet")
    (part.parent / f".{part.name}.crc").unlink()  # the local file system's own checksum
    part.write_bytes(part.read_bytes() + b"x")
    (tmp_path / "dataset" / "extra.bin").write_bytes(b"1")
    assert check() == {"hash mismatch", "unexpected"}


def test_one_family_cannot_be_split(spark):
    tables = _tables(spark, sine=True)
    audit = tables["audit"].first()
    # the sine runs are one family; the other two runs were rejected
    assert audit["families"] < 3 and not audit["passed"]


def test_missing_required_artifact(spark, tmp_path):
    path = str(tmp_path / "model")
    (tmp_path / "model").mkdir()
    (tmp_path / "model" / "report.json").write_text("{}")
    export.write_manifest(spark, path)
    got = {(r["path"], r["problem"]) for r in export.verify_bundle(spark, path, "model").collect()}
    assert got == {("checkpoint.pt", "not listed")}


def test_acquisition(spark):
    df = spark.createDataFrame([(s, f, [float(s)]) for s in range(10) for f in range(4)], "sample int, frame int, values array<float>")
    out = export.acquire_tensor(df, samples=4, sample_seed=3, time_stop=2, provenance={"source_url": "https://a.org"})
    rows = out.collect()
    picked = sorted({r["sample"] for r in rows})
    assert len(picked) == 4 and len(rows) == 8 and rows[0]["source_url"] == "https://a.org"
    assert {(r["sample"], r["ordinal"]) for r in rows} == {(s, i) for i, s in enumerate(picked)}
    with pytest.raises(ValueError):
        export.acquire_tensor(df, samples=2, sample_seed=0, time_stop=2, provenance={})


def test_sweep_documents_are_read(spark, tmp_path):
    (tmp_path / "sweep.json").write_text(json.dumps({"base": {"dt": 0.001}, "parameters": {"seed": [0, 1]}}))
    spec = catalog.read_json(spark, str(tmp_path / "sweep.json"), "base map<string,string>, parameters map<string,array<string>>").first()
    assert spec["base"] == {"dt": "0.001"} and spec["parameters"] == {"seed": ["0", "1"]}


def test_family_key_ignores_the_seed_of_deterministic_runs(spark):
    runs = spark.createDataFrame([("a", "sine", 1), ("b", "sine", 2), ("c", "random", 1)], "id string, initial_condition string, seed int")
    frames = spark.createDataFrame([(i, 0, [1.0]) for i in "abc"], "run_id string, frame int, values array<double>")
    keys = {r["id"]: r["family_key"] for r in export.trajectory_keys(runs, frames).collect()}
    assert keys["a"] == keys["b"] != keys["c"]
    same = export.trajectory_keys(runs, frames).agg(F.count_distinct("initial_field_sha256")).first()[0]
    assert same == 1


def test_an_acquisition_lists_nothing_else(spark, tmp_path):
    path = str(tmp_path / "acquisition")
    (tmp_path / "acquisition").mkdir()
    for name in ("metadata.json", "source.hdf5", "notes.txt"):
        (tmp_path / "acquisition" / name).write_text("{}")
    export.write_manifest(spark, path)
    got = {(r["path"], r["problem"]) for r in export.verify_bundle(spark, path, "acquisition").collect()}
    assert got == {("notes.txt", "not allowed")}
