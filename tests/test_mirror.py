import hashlib
import json

from pyspark.sql import functions as F

from tidemark.operators import integrity
from tidemark.sources import mirror


def _setup(spark, tmp_path):
    root = tmp_path / "lake"
    rows, manifests = [], []
    for run in ("r1", "r2"):
        files = {"record.json": b"{}" + run.encode(), "fields/u.bin": run.encode() * 9}
        for path, data in files.items():
            target = root / run / path
            target.parent.mkdir(parents=True, exist_ok=True)
            target.write_bytes(data)
        text = json.dumps({p: hashlib.sha256(b).hexdigest() for p, b in files.items()})
        digest = hashlib.sha256(text.encode()).hexdigest()
        manifests.append((run, text, digest))
        rows += [(run, p, hashlib.sha256(b).hexdigest(), digest) for p, b in files.items()]
    listed = spark.createDataFrame(rows, "run_id string, path string, sha256 string, manifest_sha256 string")
    markers = spark.createDataFrame(manifests, "run_id string, manifest string, manifest_sha256 string")
    keyed = mirror.with_keys(listed, "team").withColumn("source_key", F.concat_ws("/", "run_id", "path"))
    return root, keyed, mirror.with_keys(markers.withColumn("path", F.lit("x")), "team")


def test_upload_is_idempotent_and_marker_last(spark, tmp_path):
    root, keyed, markers = _setup(spark, tmp_path)
    remote = tmp_path / "remote"
    source = lambda: mirror.FolderStore(str(root))
    target = lambda: mirror.FolderStore(str(remote))

    def upload():
        done = mirror.complete_runs(mirror.copy_objects(keyed, source, target)).collect()
        frame = spark.createDataFrame(done, "run_id string, uploaded long, reused long")
        wrote = mirror.write_markers(markers.join(frame, "run_id", "left_semi"), target).collect()
        return {r[0]: (r[1], r[2]) for r in done}, {r["run_id"]: r["outcome"] for r in wrote}

    # a damaged source blocks only its own run, and no marker appears for it
    (root / "r2" / "record.json").write_bytes(b"changed")
    counts, wrote = upload()
    assert counts == {"r1": (2, 0)} and wrote == {"r1": "committed"}
    assert (remote / "team/experiments/r1/manifest.json").exists()
    assert not (remote / "team/experiments/r2/manifest.json").exists()
    (root / "r2" / "record.json").write_bytes(b"{}r2")
    counts, wrote = upload()
    assert counts == {"r1": (0, 2), "r2": (1, 1)} and wrote == {"r1": "resumed", "r2": "committed"}


def test_conflicting_bytes_are_refused(spark, tmp_path):
    root, keyed, markers = _setup(spark, tmp_path)
    remote = tmp_path / "remote"
    store = mirror.FolderStore(str(remote))
    target = lambda: mirror.FolderStore(str(remote))
    key = keyed.filter("run_id = 'r1' AND path = 'record.json'").first()["key"]
    store.put_immutable(key, b"other")
    out = mirror.copy_objects(keyed, lambda: mirror.FolderStore(str(root)), target)
    got = {(r["run_id"], r["path"]): r["outcome"] for r in out.collect()}
    assert got[("r1", "record.json")] == "conflict" and store.read_optional(key) == b"other"
    assert [r["run_id"] for r in mirror.complete_runs(out).collect()] == ["r2"]
    store.put_immutable("team/experiments/r1/manifest.json", b"old")
    wrote = {r["run_id"]: r["outcome"] for r in mirror.write_markers(markers, target).collect()}
    assert wrote == {"r1": "different manifest", "r2": "committed"}


def test_restore(spark, tmp_path):
    root, keyed, _ = _setup(spark, tmp_path)
    remote, back = tmp_path / "remote", tmp_path / "back"
    store = lambda: mirror.FolderStore(str(remote))
    mirror.copy_objects(keyed, lambda: mirror.FolderStore(str(root)), store).collect()
    wanted = keyed.select("run_id", "path", F.col("key").alias("source_key"), F.col("source_key").alias("key"), "sha256")
    damaged = remote.joinpath(*keyed.filter("run_id = 'r2'").first()["key"].split("/"))
    damaged.write_bytes(b"damaged")
    out = mirror.copy_objects(wanted, store, lambda: mirror.FolderStore(str(back)))
    assert [r["run_id"] for r in mirror.complete_runs(out).collect()] == ["r1"]
    assert (back / "r1/fields/u.bin").read_bytes() == b"r1" * 9


def test_restorable(spark):
    remote = spark.createDataFrame([(r, "m") for r in "abcd"], "run_id string, manifest_sha256 string")
    local = spark.createDataFrame([("b", "m"), ("c", "x"), ("d", "m")], "run_id string, manifest_sha256 string")
    bad = spark.createDataFrame([("d", "missing")], "run_id string, problem string")
    got = {r["run_id"]: r["action"] for r in mirror.restorable(remote, local, bad).collect()}
    assert got == {"a": "download", "b": "resumed", "c": "refuse: different manifest", "d": "refuse: failed verification"}


def test_fingerprints_depend_on_values_and_order_only(spark):
    rows = [("r", "u", f, str(f)) for f in range(3000)] + [("r", "v", 0, "x")]
    df = spark.createDataFrame(rows, "run_id string, field string, frame int, text string")
    of = lambda d: integrity.run_fingerprints(integrity.frame_digests(d, F.col("text"))).first()[1]
    assert of(df) == of(df.repartition(9, "text"))
    swapped = df.withColumn("text", F.when(F.col("frame") == 5, "6").when(F.col("frame") == 6, "5").otherwise(F.col("text")))
    assert of(df) != of(swapped)


def test_a_store_takes_paths_and_uris(tmp_path):
    for root in (str(tmp_path), f"file://{tmp_path}"):
        store = mirror.FolderStore(root)
        assert store.read_optional("none") is None
        store.put_immutable("a/b", b"x")
        assert store.put_immutable("a/b", b"x") is False and store.read_optional("a/b") == b"x"
    assert sorted(p.name for p in (tmp_path / "a").iterdir()) == ["b"]


def test_a_store_without_links_reads_what_it_wrote(tmp_path):
    from pyarrow import fs

    store = mirror.FolderStore(str(tmp_path))
    store.store = fs.SubTreeFileSystem("/", fs.LocalFileSystem())  # of another type
    store.put_immutable("k", b"1")
    assert store.put_immutable("k", b"1") is False
    try:
        store.put_immutable("k", b"2")
    except FileExistsError:
        return
    raise AssertionError("other bytes were taken")
