"""Experiment-shaped views of the TPC-H-like test tables.

Each function has an SQL twin in :data:`VIEWS`, used by the oracle queries. The views are
plain projections (or one pre-aggregation) so that work grows with the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import widen


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cents(column: str):
    return F.round(F.col(column) * 100).cast("long")


# Fixed mapping of order priority to the three equations and their solvers.
def _equation():
    p = F.substring("o_orderpriority", 1, 1)
    return (
        F.when(p.isin("1", "2"), F.lit("burgers1d"))
        .when(p == "5", F.lit("darcy2d"))
        .otherwise(F.lit("navier_stokes2d"))
    )


def _solver(equation):
    return (
        F.when(equation == "burgers1d", F.lit("finite_difference_rk4"))
        .when(equation == "darcy2d", F.lit("darcy_harmonic_sparse"))
        .otherwise(F.lit("pseudospectral_rk4"))
    )


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One flat catalog row per order."""
    return runs_of(table(spark, sf_dir, "orders"))


def runs_of(o: DataFrame) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    eq = _equation()
    done = F.col("o_orderstatus") == "F"
    return o.select(
        F.concat(F.lit("run-"), k).alias("id"),
        k.alias("run_id"),
        F.when(F.col("o_orderstatus") == "F", "completed")
        .when(F.col("o_orderstatus") == "P", "failed")
        .otherwise("queued")
        .alias("status"),
        eq.alias("equation"),
        _solver(eq).alias("solver"),
        F.when(k % 3 == 0, F.lit(None).cast("string"))
        .when(k % 11 == 0, F.concat(F.lit("gone-"), k))
        .otherwise(F.concat(F.lit("run-"), F.expr("o_orderkey div 2")))
        .alias("parent_id"),
        ((1 + c % 20) / 200.0).alias("viscosity"),
        F.when(eq == "darcy2d", 9 + 4 * (c % 8)).otherwise(8 + 8 * (c % 8)).alias("grid_size"),
        ((1 + k % 4) / 1000.0).alias("dt"),
        (1 + k % 200).alias("steps"),
        (1 + k % 7).alias("save_every"),
        (c % 50).alias("seed"),
        (1.0 + (k % 5) / 2.0).alias("amplitude"),
        F.lit(1.0).alias("domain_length"),
        F.when(k % 2 == 0, F.lit("random")).otherwise(F.lit("sine")).alias("initial_condition"),
        F.when(done, cents("o_totalprice") / 100.0).alias("initial_energy"),
        F.when(done, F.expr("CAST(round(o_totalprice * 100) AS BIGINT) div 2") / 100.0).alias(
            "final_energy"
        ),
        F.when(done & (eq == "burgers1d"), (k % 13) / 1e11).alias("mass_drift"),
        F.when(done, F.col("o_totalprice") > 300000).alias("needs_review"),
        F.when(F.col("o_orderstatus") == "P", F.lit("ValueError")).alias("error"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("created_at"),
    )


def diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide diagnostic series: 64 consecutive orders are the saved frames of one run."""
    item = table(spark, sf_dir, "lineitem")
    frame = item.groupBy("l_orderkey").agg(
        F.sum(cents("l_extendedprice")).alias("price"),
        F.sum(F.col("l_quantity").cast("long")).alias("quantity"),
        F.max("l_discount").alias("discount"),
    )
    run = F.expr("l_orderkey div 64")
    pos = (F.col("l_orderkey") % 64).cast("int")
    return frame.select(
        run.alias("run_id"),
        pos.alias("frame"),
        (pos * 0.5).alias("time"),
        F.when(run % 3 == 0, 1000000.0 / (1 + pos))
        .otherwise(F.col("price") / 100.0)
        .alias("energy"),
        F.when(run % 2 == 0, F.lit(1.0)).otherwise(F.col("quantity") / 8.0).alias("mass"),
        F.when(run % 5 < 3, F.lit(1e-12)).otherwise(F.col("discount")).alias("max_abs_divergence"),
        (F.col("quantity") / 4.0).alias("enstrophy"),
    )


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-dimensional fields: 25 consecutive vectors are the saved frames of one run."""
    return frames_of(table(spark, sf_dir, "embeddings"))


def frames_of(e: DataFrame) -> DataFrame:
    return e.select(
        F.expr("vec_id div 25").alias("run_id"),
        F.lit("velocity").alias("field"),
        (F.col("vec_id") % 25).cast("int").alias("frame"),
        ((F.col("vec_id") % 25) * 0.01).alias("time"),
        F.lit(1).alias("ny"),
        F.size("embedding").alias("nx"),
        F.col("embedding").cast("array<double>").alias("values"),
        F.col("label"),
    )


def manifest_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected artifacts: some documents left out, some digests altered, some paths absent."""
    d = table(spark, sf_dir, "documents")
    doc = F.col("doc_id")
    listed = d.filter(doc % 17 != 0).select(
        F.expr("doc_id div 20").alias("run_id"),
        F.when(doc % 43 == 0, F.concat(F.lit("../doc-"), doc))
        .otherwise(F.concat(F.lit("fields/doc-"), doc))
        .alias("path"),
        F.when(doc % 19 == 0, F.sha2(F.concat(F.lit("altered"), F.col("text")), 256))
        .otherwise(F.sha2("text", 256))
        .alias("sha256"),
    )
    absent = d.filter(doc % 23 == 0).select(
        F.expr("doc_id div 20").alias("run_id"),
        F.concat(F.lit("fields/lost-"), doc).alias("path"),
        F.sha2("text", 256).alias("sha256"),
    )
    return listed.unionByName(absent)


def artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Actual artifacts with the digest of their bytes."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.expr("doc_id div 20").alias("run_id"),
        F.concat(F.lit("fields/doc-"), F.col("doc_id")).alias("path"),
        F.octet_length("text").cast("long").alias("length"),
        F.sha2("text", 256).alias("sha256"),
    )


def trajectories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trajectories with a configured family and an initial-field digest that overlap."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("trajectory_id"),
        F.concat_ws(":", "source", "lang", F.expr("n_chars div 50")).alias("family_key"),
        F.sha2("text", 256).alias("initial_field_sha256"),
    )


def job_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queue events of jobs; every seventh acknowledgement carries a stale token."""
    return job_events_of(table(spark, sf_dir, "events"))


def job_events_of(e: DataFrame) -> DataFrame:
    kind = (
        F.when(F.col("event_type") == "signup", "submitted")
        .when(F.col("event_type") == "view", "claimed")
        .when(F.col("event_type") == "click", "renewed")
        .when(F.col("event_type") == "purchase", "completed")
        .otherwise("failed")
    )
    return e.select(
        F.col("user_id").alias("job_id"),
        F.col("event_id").alias("sequence"),
        kind.alias("kind"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("at"),
        (F.col("event_id") % 7 == 0).alias("stale"),
    )


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One benchmark repetition per line item."""
    i = table(spark, sf_dir, "lineitem")
    return widen(i.drop("l_shipdate", "l_tax", "l_discount")).select(
        F.ascii("l_returnflag").alias("grid_size"),
        F.when(F.col("l_linestatus") == "O", "streamed").otherwise("buffered").alias("mode"),
        (1 + F.col("l_linenumber") % 4).alias("workers"),
        (F.col("l_suppkey") % 3).alias("repeat"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("trial_key"),
        (cents("l_extendedprice") / 100.0).alias("wall_seconds"),
        (cents("l_extendedprice") / 400.0).alias("verified_reuse_seconds"),
        F.col("l_quantity").cast("long").alias("completed_experiments"),
        (F.col("l_partkey") % 3).alias("failure_count"),
        (F.col("l_partkey") * 1000 + F.col("l_suppkey")).alias("stored_bytes"),
        F.when(
            (F.col("l_partkey") % 97 != 0) | (F.col("l_linestatus") == "O"), F.col("l_partkey")
        ).alias("peak_rss"),
        (F.col("l_suppkey") % 2).alias("sampling_errors"),
    )


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resource samples: an hour of one event type is one sample of one trial."""
    return samples_of(table(spark, sf_dir, "events"))


def samples_of(e: DataFrame) -> DataFrame:
    return e.select(
        F.col("event_type").alias("trial_id"),
        F.date_format("ts", "yyyy-MM-dd HH").alias("sample"),
        F.col("event_id").alias("process_id"),
        (F.col("user_id") % 5 == 0).alias("is_parent"),
        F.when(F.col("event_id") % 50 != 0, cents("value")).alias("rss"),
    )


def transfer_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte ranges received per transfer; a few overlap their predecessor."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    return o.select(
        F.expr("o_orderkey div 500").alias("transfer_id"),
        k.alias("request"),
        ((k % 500) * 1000).alias("start"),
        ((k % 500) * 1000 + F.when(k % 29 == 0, 1499).otherwise(999 - k % 3)).alias("end"),
    )


# SQL twins, as DuckDB common table expressions.
VIEWS: dict[str, str] = {
    "runs": """runs AS (
  SELECT 'run-' || o_orderkey AS id, o_orderkey AS run_id,
    CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'P' THEN 'failed' ELSE 'queued' END AS status,
    eq AS equation,
    CASE eq WHEN 'burgers1d' THEN 'finite_difference_rk4' WHEN 'darcy2d' THEN 'darcy_harmonic_sparse'
      ELSE 'pseudospectral_rk4' END AS solver,
    CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey % 11 = 0 THEN 'gone-' || o_orderkey
      ELSE 'run-' || (o_orderkey // 2) END AS parent_id,
    (1 + o_custkey % 20) / 200.0::DOUBLE AS viscosity,
    CASE WHEN eq = 'darcy2d' THEN 9 + 4 * (o_custkey % 8) ELSE 8 + 8 * (o_custkey % 8) END AS grid_size,
    (1 + o_orderkey % 4) / 1000.0::DOUBLE AS dt, 1 + o_orderkey % 200 AS steps,
    1 + o_orderkey % 7 AS save_every, o_custkey % 50 AS seed,
    1.0::DOUBLE + (o_orderkey % 5) / 2.0::DOUBLE AS amplitude, 1.0::DOUBLE AS domain_length,
    CASE WHEN o_orderkey % 2 = 0 THEN 'random' ELSE 'sine' END AS initial_condition,
    CASE WHEN o_orderstatus = 'F' THEN CAST(round(o_totalprice * 100) AS BIGINT) / 100.0::DOUBLE END AS initial_energy,
    CASE WHEN o_orderstatus = 'F' THEN (CAST(round(o_totalprice * 100) AS BIGINT) // 2) / 100.0::DOUBLE END AS final_energy,
    CASE WHEN o_orderstatus = 'F' AND eq = 'burgers1d' THEN (o_orderkey % 13) / 1e11::DOUBLE END AS mass_drift,
    CASE WHEN o_orderstatus = 'F' THEN o_totalprice > 300000 END AS needs_review,
    CASE WHEN o_orderstatus = 'P' THEN 'ValueError' END AS error,
    strftime(o_orderdate, '%Y-%m-%d') AS created_at
  FROM (SELECT *, CASE WHEN o_orderpriority[1] IN ('1','2') THEN 'burgers1d'
          WHEN o_orderpriority[1] = '5' THEN 'darcy2d' ELSE 'navier_stokes2d' END AS eq FROM orders))""",
    "diagnostics": """diagnostics AS (
  SELECT run_id, frame, frame * 0.5::DOUBLE AS time,
    CASE WHEN run_id % 3 = 0 THEN 1000000.0::DOUBLE / (1 + frame) ELSE price / 100.0::DOUBLE END AS energy,
    CASE WHEN run_id % 2 = 0 THEN 1.0::DOUBLE ELSE quantity / 8.0::DOUBLE END AS mass,
    CASE WHEN run_id % 5 < 3 THEN 1e-12::DOUBLE ELSE discount END AS max_abs_divergence,
    quantity / 4.0::DOUBLE AS enstrophy
  FROM (SELECT l_orderkey // 64 AS run_id, CAST(l_orderkey % 64 AS INTEGER) AS frame,
      CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS price,
      CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity, max(l_discount) AS discount
    FROM lineitem GROUP BY l_orderkey))""",
    "frames": """frames AS (
  SELECT vec_id // 25 AS run_id, 'velocity' AS field, CAST(vec_id % 25 AS INTEGER) AS frame,
    (vec_id % 25) * 0.01::DOUBLE AS time, 1 AS ny, len(embedding) AS nx,
    embedding::DOUBLE[] AS vals, label FROM embeddings)""",
    "manifest": """manifest AS (
  SELECT doc_id // 20 AS run_id,
    CASE WHEN doc_id % 43 = 0 THEN '../doc-' || doc_id ELSE 'fields/doc-' || doc_id END AS path,
    CASE WHEN doc_id % 19 = 0 THEN sha256('altered' || text) ELSE sha256(text) END AS sha256
  FROM documents WHERE doc_id % 17 <> 0
  UNION ALL
  SELECT doc_id // 20, 'fields/lost-' || doc_id, sha256(text) FROM documents WHERE doc_id % 23 = 0)""",
    "artifacts": """artifacts AS (
  SELECT doc_id // 20 AS run_id, 'fields/doc-' || doc_id AS path,
    CAST(octet_length(encode(text)) AS BIGINT) AS length, sha256(text) AS sha256 FROM documents)""",
    "trajectories": """trajectories AS (
  SELECT doc_id AS trajectory_id, source || ':' || lang || ':' || (n_chars // 50) AS family_key,
    sha256(text) AS initial_field_sha256 FROM documents)""",
    "job_events": """job_events AS (
  SELECT user_id AS job_id, event_id AS sequence,
    CASE event_type WHEN 'signup' THEN 'submitted' WHEN 'view' THEN 'claimed' WHEN 'click' THEN 'renewed'
      WHEN 'purchase' THEN 'completed' ELSE 'failed' END AS kind,
    epoch_us(ts) AS moment, event_id % 7 = 0 AS stale FROM events)""",
    "trials": """trials AS (
  SELECT ascii(l_returnflag) AS grid_size, CASE WHEN l_linestatus = 'O' THEN 'streamed' ELSE 'buffered' END AS mode,
    1 + l_linenumber % 4 AS workers, l_suppkey % 3 AS repeat, l_orderkey * 8 + l_linenumber AS trial_key,
    CAST(round(l_extendedprice * 100) AS BIGINT) / 100.0::DOUBLE AS wall_seconds,
    CAST(round(l_extendedprice * 100) AS BIGINT) / 400.0::DOUBLE AS verified_reuse_seconds,
    CAST(l_quantity AS BIGINT) AS completed_experiments, l_partkey % 3 AS failure_count,
    l_partkey * 1000 + l_suppkey AS stored_bytes,
    CASE WHEN l_partkey % 97 <> 0 OR l_linestatus = 'O' THEN l_partkey END AS peak_rss,
    l_suppkey % 2 AS sampling_errors FROM lineitem)""",
    "samples": """samples AS (
  SELECT event_type AS trial_id, strftime(ts, '%Y-%m-%d %H') AS sample, event_id AS process_id,
    user_id % 5 = 0 AS is_parent,
    CASE WHEN event_id % 50 <> 0 THEN CAST(round(value * 100) AS BIGINT) END AS rss FROM events)""",
    "ranges": """ranges AS (
  SELECT o_orderkey // 500 AS transfer_id, o_orderkey AS request, (o_orderkey % 500) * 1000 AS "start",
    (o_orderkey % 500) * 1000 + CASE WHEN o_orderkey % 29 = 0 THEN 1499 ELSE 999 - o_orderkey % 3 END AS "end"
  FROM orders)""",
}


def with_views(*names: str, recursive: bool = False) -> str:
    """``WITH`` clause that defines the named views."""
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(VIEWS[n] for n in names)
