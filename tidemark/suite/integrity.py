"""Queries on artifacts and manifests."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import exprs
from tidemark.operators import integrity
from tidemark.sources import driver_tables as dt
from tidemark.suite import query

PROBLEM_SQL = """, problems AS (SELECT coalesce(m.run_id, a.run_id) AS run_id, coalesce(m.path, a.path) AS path,
    CASE WHEN m.path IS NULL THEN 'unexpected' WHEN starts_with(m.path, '../') THEN 'unsafe path'
      WHEN a.path IS NULL THEN 'missing' ELSE 'hash mismatch' END AS problem
  FROM manifest m FULL JOIN artifacts a ON m.run_id = a.run_id AND m.path = a.path
  WHERE m.sha256 IS DISTINCT FROM a.sha256)"""


@query(
    "artifact_problems",
    dt.with_views("manifest", "artifacts") + PROBLEM_SQL + " SELECT run_id, path, problem FROM problems",
)
def artifact_problems(spark, sf_dir):
    return integrity.artifact_problems(
        dt.manifest_entries(spark, sf_dir), dt.artifacts(spark, sf_dir)
    )


@query(
    "artifact_summary",
    dt.with_views("manifest", "artifacts")
    + PROBLEM_SQL
    + """ SELECT a.run_id, count(p.problem) AS problems, count(*) FILTER (p.problem = 'unsafe path') AS unsafe_path,
  count(*) FILTER (p.problem = 'missing') AS missing, count(*) FILTER (p.problem = 'symbolic link') AS symbolic_link,
  count(*) FILTER (p.problem = 'hash mismatch') AS hash_mismatch, count(*) FILTER (p.problem = 'unreadable') AS unreadable,
  count(*) FILTER (p.problem = 'unexpected') AS unexpected, count(p.problem) = 0 AS valid
FROM (SELECT DISTINCT run_id FROM artifacts) a LEFT JOIN problems p ON a.run_id = p.run_id GROUP BY a.run_id""",
)
def artifact_summary(spark, sf_dir):
    actual = dt.artifacts(spark, sf_dir)
    problems = integrity.artifact_problems(dt.manifest_entries(spark, sf_dir), actual)
    return integrity.problem_summary(actual, problems)


@query(
    "unexpected_artifacts",
    dt.with_views("manifest", "artifacts")
    + """ SELECT run_id, path FROM artifacts a WHERE NOT EXISTS
  (SELECT 1 FROM manifest m WHERE m.run_id = a.run_id AND m.path = a.path)""",
)
def unexpected_artifacts(spark, sf_dir):
    return integrity.unexpected_artifacts(
        dt.manifest_entries(spark, sf_dir), dt.artifacts(spark, sf_dir)
    )


@query(
    "stored_sizes",
    dt.with_views("artifacts")
    + """ SELECT run_id, CAST(sum(length) AS BIGINT) AS stored_bytes, count(*) AS artifact_files FROM artifacts GROUP BY run_id""",
)
def stored_sizes(spark, sf_dir):
    return integrity.stored_sizes(dt.artifacts(spark, sf_dir))


@query(
    "document_digests",
    """SELECT doc_id, sha256(text) AS sha256, substr(sha256(text), 1, 24) AS short_id FROM documents""",
)
def document_digests(spark, sf_dir):
    return dt.table(spark, sf_dir, "documents").select(
        "doc_id",
        F.sha2("text", 256).alias("sha256"),
        exprs.content_id(F.col("text"), 24).alias("short_id"),
    )


@query(
    "run_fingerprints",
    """WITH d AS (SELECT o_orderkey // 3000 AS run_id, o_orderpriority AS field, o_orderkey % 3000 AS frame,
    sha256(o_orderstatus || ':' || o_custkey) AS h FROM orders),
b1 AS (SELECT run_id, field, frame // 1024 AS pos, sha256(string_agg(h, '' ORDER BY frame)) AS h FROM d GROUP BY run_id, field, frame // 1024),
b2 AS (SELECT run_id, field, sha256(string_agg(h, '' ORDER BY pos)) AS h FROM b1 GROUP BY run_id, field),
b3 AS (SELECT run_id, field, sha256(h) AS h FROM b2)
SELECT run_id, sha256(string_agg(field || ':' || h, '' ORDER BY field)) AS values_sha256 FROM b3 GROUP BY run_id""",
)
def run_fingerprints(spark, sf_dir):
    frames = dt.table(spark, sf_dir, "orders").select(
        F.expr("o_orderkey div 3000").alias("run_id"),
        F.col("o_orderpriority").alias("field"),
        (F.col("o_orderkey") % 3000).alias("frame"),
        F.concat_ws(":", "o_orderstatus", "o_custkey").alias("text"),
    )
    return integrity.run_fingerprints(integrity.frame_digests(frames, F.col("text")))


@query(
    "safe_names",
    """SELECT page_id, regexp_full_match(split_part(url, '/', 4), '[A-Za-z0-9][A-Za-z0-9_-]{0,127}') AS safe_id,
  NOT (starts_with(rel, '/') OR list_contains(string_split(rel, '/'), '..') OR contains(rel, '\\') OR contains(rel, ':')) AS safe_path,
  regexp_full_match(lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://[^/?#]+', 1)), 'https?') AS web_url
FROM (SELECT page_id, url, CASE page_id % 5 WHEN 0 THEN '/abs' WHEN 1 THEN '../up' WHEN 2 THEN url ELSE 'fields/' || page_id END AS rel FROM pages)""",
)
def safe_names(spark, sf_dir):
    p = F.col("page_id")
    rel = (
        F.when(p % 5 == 0, F.lit("/abs"))
        .when(p % 5 == 1, F.lit("../up"))
        .when(p % 5 == 2, F.col("url"))
        .otherwise(F.concat(F.lit("fields/"), p))
    )
    return dt.table(spark, sf_dir, "pages").select(
        "page_id",
        exprs.is_safe_id(F.coalesce(F.get(F.split("url", "/"), F.lit(3)), F.lit(""))).alias("safe_id"),
        exprs.is_safe_path(rel).alias("safe_path"),
        exprs.is_web_url("url").alias("web_url"),
    )


@query(
    "mirror_keys",
    dt.with_views("artifacts")
    + """ SELECT run_id, path, 'team/lake/artifacts/run-' || run_id || '/' || sha256 || '/' || path AS content_key,
  'team/lake/experiments/run-' || run_id || '/manifest.json' AS marker_key FROM artifacts""",
)
def mirror_keys(spark, sf_dir):
    run = F.concat(F.lit("run-"), "run_id")
    return dt.artifacts(spark, sf_dir).select(
        "run_id",
        "path",
        integrity.content_key("/team/lake/", run, F.col("sha256"), F.col("path")).alias("content_key"),
        integrity.marker_key("/team/lake/", run).alias("marker_key"),
    )


@query(
    "bundle_requirements",
    """WITH b AS (SELECT p_partkey AS run_id, CASE p_partkey % 4 WHEN 0 THEN 'experiment' WHEN 1 THEN 'dataset' WHEN 2 THEN 'model' ELSE 'acquisition' END AS kind FROM part),
want AS (SELECT run_id, unnest(CASE kind WHEN 'dataset' THEN ['metadata.json'] WHEN 'model' THEN ['checkpoint.pt', 'report.json']
    WHEN 'acquisition' THEN ['metadata.json', 'source.hdf5'] ELSE [] END) AS path FROM b),
have AS (SELECT p_partkey AS run_id, unnest(CASE WHEN p_size % 3 = 0 THEN ['metadata.json'] WHEN p_size % 3 = 1 THEN ['report.json', 'source.hdf5'] ELSE ['checkpoint.pt', 'report.json', 'metadata.json', 'source.hdf5'] END) AS path FROM part)
SELECT run_id, path, 'not listed' AS problem FROM want w WHERE NOT EXISTS (SELECT 1 FROM have h WHERE h.run_id = w.run_id AND h.path = w.path)""",
)
def bundle_requirements(spark, sf_dir):
    part = dt.table(spark, sf_dir, "part")
    k, size = F.col("p_partkey"), F.col("p_size")
    kind = (
        F.when(k % 4 == 0, "experiment")
        .when(k % 4 == 1, "dataset")
        .when(k % 4 == 2, "model")
        .otherwise("acquisition")
    )
    names = lambda *n: F.array(*map(F.lit, n))
    listed = (
        F.when(size % 3 == 0, names("metadata.json"))
        .when(size % 3 == 1, names("report.json", "source.hdf5"))
        .otherwise(names("checkpoint.pt", "report.json", "metadata.json", "source.hdf5"))
    )
    bundles = part.select(k.alias("run_id"), kind.alias("kind"))
    manifest = part.select(k.alias("run_id"), F.explode(listed).alias("path"))
    return integrity.required_missing(manifest, bundles)
