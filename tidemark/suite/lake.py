"""Queries over files: run documents, manifests, artifacts, logs and reports in shared storage.

Each writes what it scans from the given tables first, through the package's own sinks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from tidemark import streaming
from tidemark.operators import integrity
from tidemark.plans import acquisition
from tidemark.session import store, widen
from tidemark.sources import catalog as sources
from tidemark.sources import driver_tables as dt
from tidemark.sources import files
from tidemark.streaming import logs
from tidemark.suite import query

# -- catalog files of several schemas in one folder ---------------------------------


@query(
    "mixed_schema_catalog",
    """SELECT 'run-' || o_orderkey AS id, CASE WHEN o_orderkey % 5 < 2 THEN o_custkey END AS level,
  CASE WHEN o_orderkey % 5 < 3 THEN o_custkey / (CASE WHEN o_orderkey % 5 = 2 THEN 4.0 ELSE 1.0 END)::DOUBLE END AS rate,
  CASE o_orderkey % 5 WHEN 2 THEN (o_custkey + 0.5)::VARCHAR WHEN 3 THEN 'c' || o_custkey WHEN 4 THEN NULL
    ELSE o_custkey::VARCHAR END AS note,
  CASE WHEN o_orderkey % 5 = 4 THEN '{"n":' || o_custkey || '}' WHEN o_orderkey % 5 = 3 THEN 'none' END AS detail
FROM orders""",
)
def mixed_schema_catalog(spark, sf_dir):
    """Catalog files appended to one folder with a column as int, bigint, double, text and struct."""
    o = dt.table(spark, sf_dir, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    path = streaming.scratch(spark, "mixed-catalog")
    run = F.concat(F.lit("run-"), k).alias("id")
    columns = (
        {"level": c.cast("int"), "rate": c.cast("int"), "note": c.cast("int")},
        {"level": c.cast("bigint"), "rate": c.cast("bigint"), "note": c.cast("bigint")},
        {"rate": c / 4.0, "note": c + F.lit(0.5).cast("double")},
        {"note": F.concat(F.lit("c"), c), "detail": F.lit("none")},
        {"detail": F.struct(c.alias("n"))},
    )
    for part, more in enumerate(columns):
        rows = o.filter(k % 5 == part).select(run, *[value.alias(name) for name, value in more.items()])
        rows.write.mode("append").parquet(path)
    return sources.scan_catalog(spark, path).select("id", "level", "rate", "note", "detail")


# -- a lake of run folders ------------------------------------------------------------

def _run():
    return F.concat(F.lit("run-"), F.col("run_id"))


def _folder():
    """Every seventh run is still being staged."""
    return F.when(F.col("run_id") % 7 == 3, F.concat(F.lit(".staging-"), _run())).otherwise(_run())


def document_lake(spark: SparkSession, sf_dir: str) -> str:
    """Run folders of twenty documents each: record, manifest and an artifact for each document."""
    root = streaming.scratch(spark, "lake")
    d = dt.table(spark, sf_dir, "documents").withColumn("run_id", F.expr("doc_id div 20"))
    place = lambda name: F.concat(F.lit("experiments/"), _folder(), F.lit("/"), name).alias("path")
    artifacts = d.select(place(F.concat(F.lit("fields/doc-"), "doc_id")), F.col("text").alias("content"))
    # a record names its run; some name another one and some are cut off
    document = F.to_json(
        F.struct(
            F.when(F.col("run_id") % 13 == 6, F.lit("run-x")).otherwise(_run()).alias("id"),
            F.lit("completed").alias("status"),
            F.lit("burgers1d").alias("equation"),
            F.struct((F.col("run_id") % 9).alias("seed"), (F.col("documents") * 8).alias("grid_size")).alias("config"),
            F.struct(
                F.col("characters").alias("characters"), (F.col("run_id") % 2 == 0).alias("needs_review")
            ).alias("metrics"),
        )
    )
    runs = d.groupBy("run_id").agg(F.count("*").alias("documents"), F.sum("n_chars").alias("characters"))
    content = F.when(F.col("run_id") % 11 == 5, F.substring(document, 1, 20)).otherwise(document)
    records = runs.select("run_id", content.alias("content"))
    entries = dt.manifest_entries(spark, sf_dir).unionByName(
        records.select(
            "run_id",
            F.lit("record.json").alias("path"),
            F.sha2(F.when(F.col("run_id") % 9 == 4, F.lit("altered")).otherwise(F.col("content")), 256).alias("sha256"),
        )
    )
    listed = F.map_from_entries(F.collect_list(F.struct("path", "sha256")))  # some forty files a run
    version = F.when(F.col("run_id") % 10 == 8, 2).otherwise(1)
    manifest = F.struct(version.alias("version"), F.lit("sha256").alias("algorithm"), "artifacts")
    manifests = entries.groupBy("run_id").agg(listed.alias("artifacts"))
    rows = (
        artifacts.unionByName(records.select(place(F.lit("record.json")), "content"))
        .unionByName(manifests.select(place(F.lit("manifest.json")), F.to_json(manifest).alias("content")))
        .select("path", F.col("content").cast("binary").alias("content"))
    )
    files.write_files(rows, root).agg(F.sum("length")).collect()
    return root


LAKE_SQL = (
    dt.with_views("manifest", "artifacts")
    + """, runs AS (SELECT DISTINCT run_id FROM artifacts WHERE run_id % 7 <> 3),
listed AS (SELECT m.*, run_id % 9 = 4 AND path = 'record.json' AS altered FROM (
    SELECT run_id, path, sha256 FROM manifest UNION ALL SELECT run_id, 'record.json', NULL FROM runs) m
  WHERE run_id IN (SELECT run_id FROM runs) AND run_id % 10 <> 8),
stored AS (SELECT run_id, path, sha256 FROM artifacts WHERE run_id IN (SELECT run_id FROM runs)
  UNION ALL SELECT run_id, 'record.json', NULL FROM runs)"""
)


@query(
    "lake_records",
    dt.with_views("artifacts")
    + """ SELECT 'run-' || k AS id, 'completed' AS status, k % 9 AS seed, n * 8 AS grid_size,
  characters::DOUBLE AS characters, k % 2 = 0 AS needs_review FROM (
  SELECT doc_id // 20 AS k, count(*) AS n, sum(n_chars) AS characters FROM documents GROUP BY 1)
WHERE k % 7 <> 3 AND k % 11 <> 5 AND k % 13 <> 6""",
)
def lake_records(spark, sf_dir):
    """Catalog rows of run documents in their folders, staging and damaged ones left out."""
    root = document_lake(spark, sf_dir)
    flat = sources.flatten_records(sources.scan_records(spark, root))
    return flat.select("id", "status", "seed", "grid_size", "characters", "needs_review")


@query(
    "lake_record_problems",
    """SELECT DISTINCT 'run-' || k AS run_id, CASE WHEN k % 11 = 5 THEN 'malformed record' ELSE 'id of another run' END AS problem
FROM (SELECT doc_id // 20 AS k FROM documents) WHERE k % 7 <> 3 AND (k % 11 = 5 OR k % 13 = 6)""",
)
def lake_record_problems(spark, sf_dir):
    return sources.record_problems(spark, document_lake(spark, sf_dir))


@query(
    "lake_manifests",
    LAKE_SQL
    + """ SELECT 'run-' || r.run_id AS run_id, r.run_id % 10 <> 8 AS valid, count(l.path) AS listed
FROM runs r LEFT JOIN listed l USING (run_id) GROUP BY r.run_id""",
)
def lake_manifests(spark, sf_dir):
    manifests = sources.scan_manifests(spark, document_lake(spark, sf_dir))
    entries = sources.manifest_rows(manifests).groupBy("run_id").agg(F.count("*").alias("n"))
    return manifests.join(entries, "run_id", "left").select(
        "run_id", "valid", F.coalesce("n", F.lit(0)).cast("long").alias("listed")
    )


def lake_problems(spark: SparkSession, root: str, lost: DataFrame | None = None) -> DataFrame:
    """Problems of all runs of a lake; ``lost`` artifacts vanish after they were listed."""
    manifests = store(sources.scan_manifests(spark, root))
    usable = manifests.filter("valid").select("run_id")
    listed = store(sources.list_artifacts(spark, root).join(usable, "run_id", "left_semi"))
    if lost is not None:
        files.remove_files(listed.join(lost, ["run_id", "path"], "left_semi").select(F.col("file").alias("path")))
    actual = sources.artifact_digests(listed)
    found = integrity.artifact_problems(sources.manifest_rows(manifests), actual)
    return found.unionByName(integrity.manifest_problems(manifests))


@query(
    "lake_artifact_problems",
    LAKE_SQL
    + """, p AS (SELECT coalesce(l.run_id, s.run_id) AS run_id, coalesce(l.path, s.path) AS path,
    CASE WHEN l.path IS NULL THEN 'unexpected' WHEN starts_with(l.path, '../') THEN 'unsafe path'
      WHEN s.path IS NULL THEN 'missing'
      WHEN try_cast(regexp_extract(s.path, '[0-9]+$') AS BIGINT) % 37 = 0 THEN 'unreadable'
      WHEN altered OR l.sha256 <> s.sha256 THEN 'hash mismatch' END AS problem
  FROM listed l FULL JOIN (SELECT * FROM stored WHERE run_id % 10 <> 8) s ON l.run_id = s.run_id AND l.path = s.path)
SELECT 'run-' || run_id AS run_id, path, problem FROM p WHERE problem IS NOT NULL
UNION ALL SELECT 'run-' || run_id, NULL, 'invalid manifest' FROM runs WHERE run_id % 10 = 8""",
)
def lake_artifact_problems(spark, sf_dir):
    """Artifacts of a lake against its manifests; some vanish between listing and reading."""
    root = document_lake(spark, sf_dir)
    doc = F.col("doc_id")
    lost = dt.table(spark, sf_dir, "documents").filter(doc % 37 == 0).select(
        F.concat(F.lit("run-"), F.expr("doc_id div 20")).alias("run_id"),
        F.concat(F.lit("fields/doc-"), doc).alias("path"),
    )
    return lake_problems(spark, root, lost)


# -- reports, logs and specifications -------------------------------------------------


@query(
    "report_round_trip",
    dt.with_views("artifacts")
    + """ SELECT run_id, CAST(sum(length) AS BIGINT) AS stored_bytes, count(*) AS artifact_files,
  true AS refused FROM artifacts GROUP BY run_id""",
)
def report_round_trip(spark, sf_dir):
    """A report written once, refused a second time and read back."""
    path = streaming.scratch(spark, "report")
    report = integrity.stored_sizes(dt.artifacts(spark, sf_dir))
    sources.write_report(report, path)
    try:
        sources.write_report(report.limit(1), path)
        refused = False
    except AnalysisException:
        refused = True
    return sources.read_report(spark, path, report.schema).withColumn("refused", F.lit(refused))


@query(
    "event_log_status",
    """SELECT event_type AS stage, arg_max('s' || user_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || event_id) AS status,
  max(strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || event_id) AS last_time, count(*) AS events FROM events GROUP BY event_type""",
)
def event_log_status(spark, sf_dir):
    """Stage events appended to a JSON log in two parts and read with a fixed schema."""
    path = streaming.scratch(spark, "event-log")
    e = dt.table(spark, sf_dir, "events")
    moment = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    rows = e.select(
        F.concat(moment, F.col("event_id")).alias("time"),
        F.col("event_type").alias("stage"),
        F.concat(F.lit("s"), "user_id").alias("status"),
        F.col("value").cast("string").alias("detail"),
        (F.col("user_id") % 2 == 0).alias("_first"),
    )
    logs.append_events(rows.filter("_first").drop("_first"), path)
    logs.append_events(rows.filter("NOT _first").drop("_first"), path)
    return logs.latest_status(logs.read_events(spark, path))


SWEEP = "equation string, base struct<viscosity: double, seed: bigint>, parameters map<string, array<double>>"


@query(
    "sweep_documents",
    """SELECT 'burgers1d' AS equation, p_size / 50.0::DOUBLE AS viscosity, p_partkey AS seed, 2 + p_partkey % 3 AS values,
  CAST(p_partkey + (2 + p_partkey % 3) - 1 AS DOUBLE) AS last FROM part""",
)
def sweep_documents(spark, sf_dir):
    """One multi-line sweep document for each part, read with its schema."""
    root = streaming.scratch(spark, "sweeps")
    k = F.col("p_partkey")
    steps = F.transform(F.sequence(k, k + 1 + k % 3), lambda x: x.cast("double"))
    spec = F.struct(
        F.lit("burgers1d").alias("equation"),
        F.struct((F.col("p_size") / 50.0).alias("viscosity"), k.alias("seed")).alias("base"),
        F.create_map(F.lit("amplitude"), steps).alias("parameters"),
    )
    text = F.to_json(spec, {"pretty": "true"})  # over several lines
    rows = dt.table(spark, sf_dir, "part").select(
        F.concat(F.lit("specs/"), k % 16, F.lit("/"), k, F.lit(".json")).alias("path"),
        text.cast("binary").alias("content"),
    )
    # a part is a short row, but its file is not cheap to write
    files.write_files(widen(rows), root).agg(F.sum("length")).collect()
    found = sources.read_documents(files.list_files(spark, f"{root}/specs"), SWEEP)
    amplitude = F.col("parameters")["amplitude"]
    return found.select(
        "equation",
        "base.viscosity",
        "base.seed",
        F.size(amplitude).cast("long").alias("values"),
        F.element_at(amplitude, -1).alias("last"),
    )


# -- acquisitions -----------------------------------------------------------------------

SUBSET = {"samples": 6, "sample_seed": 9, "time_stop": 12}
TIMES, CELLS = 25, 64


def subset(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    e = dt.table(spark, sf_dir, "embeddings")
    frames = e.select(
        F.expr("vec_id div 25").alias("sample"),
        (F.col("vec_id") % TIMES).cast("int").alias("frame"),
        F.col("embedding").alias("values"),
    )
    shape = (e.agg(F.max(F.expr("vec_id div 25"))).first()[0] + 1, TIMES, CELLS)
    return acquisition.subset_tables(frames, shape=shape, origin={"source_url": "https://example.org/t"}, **SUBSET)


SUBSET_SQL = """WITH s AS (SELECT sample, row_number() OVER (ORDER BY sample) - 1 AS request FROM (
  SELECT sample FROM (SELECT DISTINCT vec_id // 25 AS sample FROM embeddings) ORDER BY sha256('9:' || sample), sample LIMIT 6)),
f AS (SELECT s.request, s.sample, count(*) AS frames, CAST(sum(len(embedding)) * 4 AS BIGINT) AS received_bytes
  FROM embeddings e JOIN s ON e.vec_id // 25 = s.sample WHERE e.vec_id % 25 < 12 GROUP BY s.request, s.sample)"""


@query(
    "acquisition_receipt",
    SUBSET_SQL
    + """ SELECT request, sample, sample * 25 * 64 * 4 AS range_start, sample * 25 * 64 * 4 + 12 * 64 * 4 - 1 AS range_end,
  received_bytes, frames, 64 AS digits, CAST(0 AS BIGINT) AS problems FROM f""",
)
def acquisition_receipt(spark, sf_dir):
    """Receipts of a published subset, and how many problems its verification finds."""
    path = streaming.scratch(spark, "subset")
    acquisition.write_subset(subset(spark, sf_dir), path)
    problems = acquisition.verify_subset(spark, path).agg(F.count("*")).scalar()
    kept = spark.read.schema(acquisition.RECEIPT).parquet(f"{path}/receipt")
    return kept.withColumns({"digits": F.length("sha256"), "problems": problems}).drop("sha256")


def _altered(tables: dict[str, DataFrame]) -> dict[str, dict[str, DataFrame]]:
    """Subsets with one thing changed before the manifest was written."""
    source, receipt, metadata = tables["source"], tables["receipt"], tables["metadata"]
    request = F.col("request")
    moved = F.transform("values", lambda v: (v + 1).cast("float"))
    hit = (F.col("ordinal") % 2 == 0) & (F.col("frame") == 0)
    changed = lambda table, **columns: table.withColumns(columns)
    other = F.lit("0" * 64)
    extra = receipt.filter(request == 1).withColumn("request", F.lit(1000).cast("long"))
    return {
        "none": {},
        "values": {"source": changed(source, values=F.when(hit, moved).otherwise(F.col("values")))},
        "frames": {"source": source.filter(~((F.col("ordinal") == 2) & (F.col("frame") == 3)))},
        "digests": {"receipt": changed(receipt, sha256=F.when(request % 3 == 0, other).otherwise(F.col("sha256")))},
        "dropped ranges": {"receipt": receipt.filter(request % 5 != 0)},
        "added range": {"receipt": receipt.unionByName(extra)},
        "bounds": {"receipt": changed(receipt, range_end=F.col("range_end") + F.when(request == 1, 1).otherwise(0))},
        "kind": {"metadata": changed(metadata, kind=F.lit("other"))},
        "schema version": {"metadata": changed(metadata, schema_version=F.lit(2).cast("long"))},
        "source digest": {"metadata": changed(metadata, source_sha256=other)},
    }


@query(
    "acquisition_alterations",
    SUBSET_SQL
    + """, r AS (
  SELECT 'values' AS alteration, 'receipt/' || request AS path, 'digest differs' AS problem FROM f WHERE request % 2 = 0
  UNION ALL SELECT 'frames', 'receipt/2', 'bytes differ'
  UNION ALL SELECT 'digests', 'receipt/' || request, 'digest differs' FROM f WHERE request % 3 = 0
  UNION ALL SELECT 'dropped ranges', 'receipt/' || request, 'missing range' FROM f WHERE request % 5 = 0
  UNION ALL SELECT 'added range', 'receipt/1000', 'range without data'
  UNION ALL SELECT 'bounds', 'receipt/1', 'range differs'
  UNION ALL SELECT unnest(['values', 'frames', 'frames', 'frames', 'kind', 'schema version', 'source digest']), 'metadata.json',
    unnest(['source digest', 'source digest', 'transfer', 'selection', 'kind', 'schema version', 'source digest'])
  UNION ALL SELECT 'added file', 'notes.txt', 'unexpected')
SELECT * FROM r""",
)
def acquisition_alterations(spark, sf_dir):
    """What verification says of subsets each of which was altered in one way."""
    tables = subset(spark, sf_dir)
    root = streaming.scratch(spark, "altered")
    cases = _altered(tables) | {"added file": {}}
    out = []
    for number, (name, change) in enumerate(cases.items()):
        path = f"{root}/{number}"
        acquisition.write_subset(tables | change, path)
        if name == "added file":
            note = spark.range(1).select(F.lit("notes.txt").alias("path"), F.lit("x").alias("content"))
            files.write_files(note, path).collect()
        out.append(acquisition.verify_subset(spark, path).select(F.lit(name).alias("alteration"), "path", "problem"))
    return reduce(DataFrame.unionByName, out)
