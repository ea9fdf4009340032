"""Queries on training datasets: families, splits, normalisation and imports."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.exprs import is_uniform_coordinate, total
from tidemark import streaming
from tidemark.operators import datasets
from tidemark.plans import export
from tidemark.sources import driver_tables as dt
from tidemark.suite import query

SEED = 17

FAMILY_SQL = """, pairs AS (SELECT DISTINCT family_key AS c, initial_field_sha256 AS f FROM trajectories),
links AS (SELECT DISTINCT a.c AS u, b.c AS v FROM pairs a JOIN pairs b ON a.f = b.f),
reach AS (SELECT DISTINCT c AS u, c AS v FROM pairs UNION SELECT r.u, l.v FROM reach r JOIN links l ON r.v = l.u),
roots AS (SELECT u AS family_key, min(v) AS root FROM reach GROUP BY u),
hashed AS (SELECT root, sha256(family_key) AS h FROM roots),
sets AS (SELECT root, sha256(count(*) || ':' || bit_xor(CAST('0x' || substr(h, 1, 15) AS BIGINT)) || ':' || bit_xor(CAST('0x' || substr(h, 16, 15) AS BIGINT))
   || ':' || bit_xor(CAST('0x' || substr(h, 31, 15) AS BIGINT)) || ':' || bit_xor(CAST('0x' || substr(h, 46, 15) AS BIGINT))) AS family_id
  FROM hashed GROUP BY root),
family AS (SELECT t.trajectory_id, t.family_key, s.family_id FROM trajectories t JOIN roots r ON t.family_key = r.family_key JOIN sets s ON r.root = s.root),
ranked AS (SELECT family_id, row_number() OVER (ORDER BY sha256('17:' || family_id)) AS rk, count(*) OVER () AS n FROM (SELECT DISTINCT family_id FROM family)),
splits AS (SELECT family_id, CASE WHEN rk <= greatest(1, n // 5) THEN 'validation' WHEN rk <= 2 * greatest(1, n // 5) THEN 'test' ELSE 'train' END AS split FROM ranked)"""


@query(
    "trajectory_families",
    dt.with_views("trajectories", recursive=True)
    + FAMILY_SQL
    + " SELECT trajectory_id, family_key, family_id FROM family",
)
def trajectory_families(spark, sf_dir):
    return datasets.families(dt.trajectories(spark, sf_dir)).select(
        "trajectory_id", "family_key", "family_id"
    )


def assigned(spark, sf_dir):
    return datasets.families_and_splits(dt.trajectories(spark, sf_dir), SEED)


@query(
    "family_splits",
    dt.with_views("trajectories", recursive=True)
    + FAMILY_SQL
    + " SELECT f.trajectory_id, f.family_id, s.split FROM family f JOIN splits s ON f.family_id = s.family_id",
)
def family_splits(spark, sf_dir):
    return assigned(spark, sf_dir).select("trajectory_id", "family_id", "split")


@query(
    "split_audit",
    dt.with_views("trajectories", recursive=True)
    + FAMILY_SQL
    + """ SELECT count(DISTINCT f.family_id) AS families, count(*) AS trajectories, count(*) FILTER (split = 'train') AS train_trajectories,
  count(*) FILTER (split = 'validation') AS validation_trajectories, count(*) FILTER (split = 'test') AS test_trajectories,
  0 AS leaking_families, 0 AS unassigned, TRUE AS passed FROM family f JOIN splits s ON f.family_id = s.family_id""",
)
def split_audit(spark, sf_dir):
    return datasets.split_audit(assigned(spark, sf_dir))


# Trajectories of the frames view: nine families over its runs.
FRAME_SPLIT_SQL = """, fam AS (SELECT DISTINCT run_id, sha256('family:' || run_id % 9) AS family_id FROM frames),
ranked AS (SELECT family_id, row_number() OVER (ORDER BY sha256('17:' || family_id)) AS rk, count(*) OVER () AS n FROM (SELECT DISTINCT family_id FROM fam)),
placed AS (SELECT family_id, CASE WHEN rk <= greatest(1, n // 5) THEN 'validation' WHEN rk <= 2 * greatest(1, n // 5) THEN 'test' ELSE 'train' END AS split FROM ranked),
split_frames AS (SELECT f.*, p.split FROM frames f JOIN fam USING (run_id) JOIN placed p USING (family_id)),
norm AS (SELECT count(*) AS n, avg(v) AS mean, stddev_pop(v) AS std FROM (SELECT unnest(vals) AS v FROM split_frames WHERE split = 'train'))"""


def split_frames(spark, sf_dir):
    frames = dt.frames(spark, sf_dir).withColumn(
        "family_id", F.sha2(F.concat(F.lit("family:"), F.col("run_id") % 9), 256)
    )
    return datasets.assign_splits(frames, datasets.split_families(frames, SEED))


@query(
    "training_normalization",
    dt.with_views("frames")
    + FRAME_SPLIT_SQL
    + """ SELECT n AS count, round(mean, 10) AS mean, round(std, 10) AS std, FALSE AS constant_training_data, 'train' AS fit_split FROM norm""",
)
def training_normalization(spark, sf_dir):
    out = datasets.training_normalization(split_frames(spark, sf_dir))
    return out.withColumn("mean", F.round("mean", 10)).withColumn("std", F.round("std", 10))


@query(
    "normalization_audit",
    dt.with_views("frames")
    + FRAME_SPLIT_SQL
    + """ SELECT round(mean * k, 9) AS mean, round(std, 9) AS std, k = 1 AS passed FROM norm, (SELECT unnest([1, 2]) AS k)""",
)
def normalization_audit(spark, sf_dir):
    frames = split_frames(spark, sf_dir)
    stored = (
        datasets.training_normalization(frames)
        .withColumn("k", F.explode(F.array(F.lit(1), F.lit(2))))
        .withColumn("mean", F.col("mean") * F.col("k"))
    )
    out = datasets.normalization_audit(frames, stored)
    return out.withColumn("mean", F.round("mean", 9)).withColumn("std", F.round("std", 9))


@query(
    "normalized_pairs",
    dt.with_views("frames")
    + FRAME_SPLIT_SQL
    + """, p AS (SELECT run_id, frame, split, vals, lead(vals) OVER (PARTITION BY run_id ORDER BY frame) AS nxt FROM split_frames)
SELECT run_id, frame, split, round((vals[1] - mean) / std, 7) AS first_input, round(list_sum(list_transform(nxt, lambda v: (v - mean) / std)), 6) AS target_sum
FROM p, norm WHERE nxt IS NOT NULL""",
)
def normalized_pairs(spark, sf_dir):
    frames = split_frames(spark, sf_dir).select("run_id", "frame", "split", "values")
    norm = datasets.training_normalization(frames)
    pairs = datasets.normalized_pairs(frames, norm)
    return pairs.select(
        "run_id",
        "frame",
        "split",
        F.round(F.get("input", F.lit(0)), 7).alias("first_input"),
        F.round(total("target"), 6).alias("target_sum"),
    )


def candidates(spark, sf_dir):
    """Export candidates with their coordinates as arrays."""
    runs = dt.runs(spark, sf_dir)
    k = F.col("run_id")
    n = F.col("grid_size").cast("int")
    at = lambda size, step: F.transform(
        F.sequence(F.lit(0), size - 1), lambda i: i * step
    )
    step = 1.0 / F.when(k % 47 == 0, n - 1).otherwise(n)
    times = at((F.col("steps") % 5).cast("int") + 1, F.lit(0.5))
    x = at(n, step)
    return runs.select(
        "id",
        "run_id",
        "status",
        "equation",
        "needs_review",
        F.when(k % 31 == 0, "open").otherwise("periodic").alias("boundary"),
        "domain_length",
        "viscosity",
        times.alias("times"),
        x.alias("x"),
        (F.size(times) + F.when(k % 37 == 0, 1).otherwise(0)).alias("frames"),
        F.when(k % 29 == 0, 2).alias("problems"),
    )


@query(
    "export_eligibility",
    dt.with_views("runs")
    + """ SELECT id, CASE WHEN run_id % 29 = 0 THEN 'failed verification'
  WHEN NOT (status = 'completed' AND equation = 'burgers1d') THEN 'not a completed burgers1d run'
  WHEN needs_review THEN 'needs review' WHEN run_id % 31 = 0 THEN 'not periodic'
  WHEN steps % 5 = 0 THEN 'bad time coordinate' WHEN run_id % 47 = 0 THEN 'repeated endpoint'
  WHEN run_id % 37 = 0 THEN 'frames do not match times' END AS reject_reason FROM runs""",
)
def export_eligibility(spark, sf_dir):
    return datasets.eligibility(candidates(spark, sf_dir)).select("id", "reject_reason")


@query(
    "contract_outliers",
    dt.with_views("runs")
    + """, ok AS (SELECT id, grid_size || '/' || viscosity || '/' || steps % 5 AS contract FROM runs
  WHERE status = 'completed' AND equation = 'burgers1d'),
mode AS (SELECT max(n) AS n FROM (SELECT count(*) AS n FROM ok GROUP BY contract)),
groups AS (SELECT contract, count(*) AS c FROM ok GROUP BY contract)
SELECT g.c AS group_size, count(*) AS runs FROM ok JOIN groups g USING (contract), mode WHERE g.c < mode.n GROUP BY g.c""",
)
def contract_outliers(spark, sf_dir):
    ok = candidates(spark, sf_dir).filter("status = 'completed' AND equation = 'burgers1d'")
    # The repeated-endpoint grids of the view are left alone here: the contract text is the
    # grid size, viscosity and number of times, as in the SQL twin.
    keyed = ok.select(
        "id",
        datasets.contract_digest(
            F.array(F.size("times")), F.array(F.size("x")), F.col("viscosity")
        ).alias("contract_sha256"),
    )
    sizes = keyed.groupBy("contract_sha256").agg(F.count("*").alias("group_size"))
    biggest = sizes.agg(F.max("group_size")).scalar()
    out = datasets.contract_outliers(keyed).join(sizes, "contract_sha256")
    # Equally common contracts are outliers too, but which one wins is a matter of digests.
    return (
        out.filter(F.col("group_size") < biggest)
        .groupBy("group_size")
        .agg(F.count("*").alias("runs"))
    )


@query(
    "coordinate_arrays",
    dt.with_views("runs")
    + """ SELECT id, steps % 5 >= 1 AS time_ok, grid_size >= 4 AS x_ok FROM runs""",
)
def coordinate_arrays(spark, sf_dir):
    return candidates(spark, sf_dir).select(
        "id",
        is_uniform_coordinate("times", 2).alias("time_ok"),
        is_uniform_coordinate("x", 4).alias("x_ok"),
    )


@query(
    "coordinate_problems",
    """WITH c AS (SELECT o_orderkey // 16 AS run_id, o_orderkey % 16 AS idx,
    o_orderkey % 16 + CASE WHEN o_orderkey % 97 = 0 THEN 0.25 WHEN o_orderkey % 401 = 0 THEN -2 ELSE 0 END AS value FROM orders),
s AS (SELECT *, value - lag(value) OVER (PARTITION BY run_id ORDER BY idx) AS step FROM c),
g AS (SELECT run_id, count(*) AS n, min(step) AS low, max(step) AS high, arg_min(step, idx) FILTER (step IS NOT NULL) AS first FROM s GROUP BY run_id)
SELECT run_id, 'x' AS axis, CASE WHEN n < 4 THEN 'too short' WHEN low <= 0 THEN 'not increasing' ELSE 'not uniform' END AS problem FROM g
WHERE n < 4 OR low <= 0 OR abs(low - first) > 1e-10 + 1e-4 * abs(first) OR abs(high - first) > 1e-10 + 1e-4 * abs(first)""",
)
def coordinate_problems(spark, sf_dir):
    k = F.col("o_orderkey")
    shift = F.when(k % 97 == 0, 0.25).when(k % 401 == 0, -2.0).otherwise(0.0)
    coords = dt.table(spark, sf_dir, "orders").select(
        F.expr("o_orderkey div 16").alias("run_id"),
        F.lit("x").alias("axis"),
        (k % 16).alias("idx"),
        (k % 16 + shift).alias("value"),
    )
    return datasets.coordinate_problems(coords, {"x": 4, "time": 2})


@query(
    "payload_problems",
    """SELECT vec_id // 25 AS run_id, vec_id % 25 AS frame, CASE WHEN vec_id % 19 = 0 THEN 'incompatible shape'
  WHEN vec_id % 23 = 0 THEN 'non-finite values' ELSE 'not representable as float32' END AS problem
FROM embeddings WHERE vec_id % 19 = 0 OR vec_id % 23 = 0 OR vec_id % 29 = 0""",
)
def payload_problems(spark, sf_dir):
    k = F.col("vec_id")
    v = F.col("embedding").cast("array<double>")
    # as_double keeps the damaged copies in one expression
    damaged = (
        F.when(k % 19 == 0, F.slice(v, 1, 63))
        .when(k % 23 == 0, F.transform(v, lambda x, i: F.when(i == 5, float("nan")).otherwise(x)))
        .when(k % 29 == 0, F.transform(v, lambda x, i: F.when(i == 7, 1e39).otherwise(x)))
        .otherwise(v)
    )
    frames = dt.table(spark, sf_dir, "embeddings").select(
        F.expr("vec_id div 25").alias("run_id"), (k % 25).alias("frame"), damaged.alias("values")
    )
    return datasets.payload_problems(frames, F.lit(64))


@query(
    "provenance_problems",
    """SELECT page_id, array_to_string(list_filter([CASE WHEN page_id % 4 = 0 THEN 'source_url' END, CASE WHEN page_id % 3 = 0 THEN 'source_version' END,
  CASE WHEN page_id % 5 = 0 THEN 'license_name' END], lambda r: r IS NOT NULL), ',') AS reasons FROM pages""",
)
def provenance_problems(spark, sf_dir):
    k = F.col("page_id")
    imports = dt.table(spark, sf_dir, "pages").select(
        k,
        F.when(k % 4 == 0, F.regexp_replace("url", "^https?", "ftp")).otherwise(F.col("url")).alias("source_url"),
        F.when(k % 3 == 0, "  ").otherwise("v1").alias("source_version"),
        F.when(k % 5 != 0, "CC-BY").alias("license_name"),
    )
    out = datasets.provenance_problems(imports)
    return out.select("page_id", F.concat_ws(",", "reasons").alias("reasons"))


SELECTION = (11, 3, 7, 0, 15)


def tensor(spark, sf_dir):
    return dt.frames(spark, sf_dir).select(F.col("run_id").alias("sample"), "frame", "values")


@query(
    "tensor_selection",
    dt.with_views("frames")
    + """ SELECT run_id AS sample, frame, list_position([11, 3, 7, 0, 15], run_id) - 1 AS ordinal, round(list_sum(vals), 8) AS total
FROM frames WHERE run_id IN (11, 3, 7, 0, 15) AND frame < 10""",
)
def tensor_selection(spark, sf_dir):
    out = datasets.select_tensor(tensor(spark, sf_dir), samples=SELECTION, time_stop=10)
    return out.select("sample", "frame", "ordinal", F.round(total("values"), 8).alias("total"))


@query(
    "tensor_budget",
    """SELECT count(DISTINCT vec_id // 25) AS samples, count(*) AS frames, count(*) * 64 AS selected_values, count(*) * 64 <= 20000 AS fits
FROM embeddings WHERE vec_id % 25 < 20""",
)
def tensor_budget(spark, sf_dir):
    chosen = datasets.select_tensor(tensor(spark, sf_dir), time_stop=20)
    return datasets.tensor_budget(chosen, 64, 20000)


@query(
    "imported_trajectories",
    """SELECT 'abcdef0123456789-' || (vec_id // 25) AS trajectory_id, vec_id // 25 AS source_index, vec_id // 25 AS ordinal, TRUE AS own_family
FROM embeddings WHERE vec_id % 25 = 0""",
)
def imported_trajectories(spark, sf_dir):
    chosen = datasets.select_tensor(tensor(spark, sf_dir))
    out = datasets.import_trajectories(chosen, "abcdef0123456789" * 4)
    return out.select(
        "trajectory_id",
        "source_index",
        "ordinal",
        (F.col("family_key") == F.col("initial_field_sha256")).alias("own_family"),
    )


@query(
    "remote_row_binding",
    """SELECT o.o_orderkey AS ordinal, l.l_partkey AS remote_source_index FROM orders o LEFT JOIN
  (SELECT l_orderkey, max(l_partkey) AS l_partkey FROM lineitem GROUP BY l_orderkey) l ON o.o_orderkey = l.l_orderkey""",
)
def remote_row_binding(spark, sf_dir):
    local = dt.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ordinal"))
    receipt = (
        dt.table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_orderkey").alias("ordinal"))
        .agg(F.max("l_partkey").alias("remote_source_index"))
    )
    return datasets.bind_remote_rows(local, receipt)


@query(
    "declaration_mismatches",
    """SELECT s_suppkey AS import_id, array_to_string(list_filter([CASE WHEN s_suppkey % 3 = 0 THEN 'license_name' END,
  CASE WHEN s_suppkey % 4 = 0 THEN 'viscosity' END], lambda r: r IS NOT NULL), ',') AS mismatches
FROM supplier WHERE s_suppkey % 3 = 0 OR s_suppkey % 4 = 0""",
)
def declaration_mismatches(spark, sf_dir):
    s = dt.table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    receipt = s.select(
        k.alias("import_id"),
        F.col("s_name").alias("source_url"),
        F.lit("CC-BY").alias("license_name"),
        F.col("s_acctbal").alias("viscosity"),
    )
    declared = s.select(
        k.alias("import_id"),
        F.col("s_name").alias("source_url"),
        F.when(k % 3 != 0, "CC-BY").alias("license_name"),
        (F.col("s_acctbal") + F.when(k % 4 == 0, 1.0).otherwise(0.0)).alias("viscosity"),
    )
    out = datasets.declaration_mismatches(
        declared, receipt, "import_id", ["source_url", "license_name", "viscosity"]
    )
    return out.withColumn("mismatches", F.concat_ws(",", "mismatches"))


@query(
    "seeded_sample",
    """SELECT doc_id, source FROM documents ORDER BY sha256('20260929:' || doc_id), doc_id LIMIT 24""",
)
def seeded_sample(spark, sf_dir):
    docs = dt.table(spark, sf_dir, "documents").select("doc_id", "source")
    return datasets.seeded_sample(docs, "doc_id", 24, 20260929)


@query(
    "cohort_overlap",
    """SELECT d.doc_id, sha256(d.text) AS initial_field_sha256 FROM documents d WHERE sha256(d.text) IN
  (SELECT sha256(text) FROM documents WHERE doc_id % 2 = 1 UNION SELECT sha256(text) FROM benchmark) AND d.doc_id % 2 = 0""",
)
def cohort_overlap(spark, sf_dir):
    docs = dt.table(spark, sf_dir, "documents").select(
        "doc_id", F.sha2("text", 256).alias("initial_field_sha256")
    )
    items = dt.table(spark, sf_dir, "benchmark").select(
        F.sha2("text", 256).alias("initial_field_sha256")
    )
    earlier = docs.filter(F.col("doc_id") % 2 == 1).select("initial_field_sha256").union(items)
    new = docs.filter(F.col("doc_id") % 2 == 0)
    return datasets.cohort_overlap(new, earlier, "initial_field_sha256").select(
        "doc_id", "initial_field_sha256"
    )


# -- end to end -------------------------------------------------------------------


def export_tables(spark, sf_dir):
    """Runs over the frames view; some need review, some have another viscosity."""
    frames = dt.frames(spark, sf_dir).select("run_id", "frame", "time", "values")
    steps = lambda n, h: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: i * h)
    k = F.col("id")
    runs = frames.filter("frame = 0").select(F.col("run_id").alias("id")).select(
        "id",
        F.lit("completed").alias("status"),
        F.lit("burgers1d").alias("equation"),
        (k % 7 == 3).alias("needs_review"),
        F.lit("periodic").alias("boundary"),
        F.lit(64.0).alias("domain_length"),
        F.when(k % 10 == 4, 0.2).otherwise(0.1).alias("viscosity"),
        steps(25, 0.01).alias("times"),
        steps(64, 1.0).alias("x"),
        F.lit(25).alias("frames"),
        F.lit(0).alias("problems"),
        F.when(k % 9 == 8, "sine").otherwise("random").alias("initial_condition"),
        (k % 9).alias("seed"),
    )
    return export.plan_dataset(runs, frames, SEED)


EXPORT_SQL = """, r AS (SELECT DISTINCT run_id AS id FROM frames WHERE run_id % 7 <> 3 AND run_id % 10 <> 4),
k AS (SELECT id, CASE WHEN id % 9 = 8 THEN '{"initial_condition":"sine","seed":null}' ELSE '{"initial_condition":"random","seed":' || id % 9 || '}' END AS key FROM r),
fam AS (SELECT id, sha256('1:' || CAST('0x' || substr(sha256(key), 1, 15) AS BIGINT) || ':' || CAST('0x' || substr(sha256(key), 16, 15) AS BIGINT) || ':'
   || CAST('0x' || substr(sha256(key), 31, 15) AS BIGINT) || ':' || CAST('0x' || substr(sha256(key), 46, 15) AS BIGINT)) AS family_id FROM k),
rk AS (SELECT family_id, row_number() OVER (ORDER BY sha256('17:' || family_id)) AS n, count(*) OVER () AS c FROM (SELECT DISTINCT family_id FROM fam)),
sp AS (SELECT fam.id, fam.family_id, CASE WHEN n <= greatest(1, c // 5) THEN 'validation' WHEN n <= 2 * greatest(1, c // 5) THEN 'test' ELSE 'train' END AS split
  FROM fam JOIN rk ON fam.family_id = rk.family_id)"""


@query(
    "dataset_export",
    dt.with_views("frames") + EXPORT_SQL + " SELECT id, family_id, split FROM sp",
)
def dataset_export(spark, sf_dir):
    return export_tables(spark, sf_dir)["trajectories"].select("id", "family_id", "split")


@query(
    "dataset_export_normalization",
    dt.with_views("frames")
    + EXPORT_SQL
    + """ SELECT count(*) AS count, round(avg(v), 10) AS mean, round(stddev_pop(v), 10) AS std
FROM (SELECT unnest(f.vals) AS v FROM frames f JOIN sp ON f.run_id = sp.id WHERE sp.split = 'train')""",
)
def dataset_export_normalization(spark, sf_dir):
    n = export_tables(spark, sf_dir)["normalization"]
    return n.select("count", F.round("mean", 10).alias("mean"), F.round("std", 10).alias("std"))


@query(
    "dataset_export_rejections",
    dt.with_views("frames")
    + """ SELECT DISTINCT run_id AS id, CASE WHEN run_id % 7 = 3 THEN 'needs review' ELSE 'different time, grid or viscosity' END AS reject_reason
FROM frames WHERE run_id % 7 = 3 OR run_id % 10 = 4""",
)
def dataset_export_rejections(spark, sf_dir):
    return export_tables(spark, sf_dir)["rejected"]


@query(
    "dataset_round_trip",
    dt.with_views("frames")
    + EXPORT_SQL
    + """ SELECT sp.split, count(*) AS frames, round(sum(list_sum(f.vals)), 5) AS total, CAST(0 AS BIGINT) AS problems
FROM frames f JOIN sp ON f.run_id = sp.id GROUP BY sp.split""",
)
def dataset_round_trip(spark, sf_dir):
    """Publish a dataset into the shared scratch folder, verify it and read it back."""
    path = streaming.scratch(spark, "dataset")
    export.write_dataset(export_tables(spark, sf_dir), SEED, path)
    problems = export.verify_bundle(spark, path, "dataset").agg(F.count("*")).scalar()
    stored = spark.read.parquet(f"{path}/frames")
    return (
        stored.groupBy("split")
        .agg(
            F.count("*").alias("frames"),
            F.round(F.sum(total(F.col("values").cast("array<double>"))), 5).alias("total"),
        )
        .withColumn("problems", problems)
    )


@query(
    "acquired_subset",
    dt.with_views("frames")
    + """, s AS (SELECT run_id FROM (SELECT DISTINCT run_id FROM frames) ORDER BY sha256('5:' || run_id), run_id LIMIT 6)
SELECT run_id AS sample, frame, row_number() OVER (PARTITION BY frame ORDER BY run_id) - 1 AS ordinal, 'CC-BY' AS license_name
FROM frames WHERE run_id IN (SELECT run_id FROM s) AND frame < 12""",
)
def acquired_subset(spark, sf_dir):
    out = export.acquire_tensor(
        tensor(spark, sf_dir),
        samples=6,
        sample_seed=5,
        time_stop=12,
        provenance={"license_name": "CC-BY"},
    )
    return out.select("sample", "frame", "ordinal", "license_name")
