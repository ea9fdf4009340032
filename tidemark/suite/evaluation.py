"""Queries on predictions, baselines and refinement studies."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from tidemark import streaming
from tidemark.functions.exprs import total
from tidemark.operators import evaluate
from tidemark.sources import driver_tables as dt
from tidemark.suite import query

EVAL_SQL = """, truth AS (SELECT run_id, frame, vals, lag(vals) OVER w AS prev, first_value(vals) OVER w AS first FROM frames
  WINDOW w AS (PARTITION BY run_id ORDER BY frame)),
predicted AS (
  SELECT run_id, frame, 'one_step' AS kind, list_transform(prev, lambda v: 0.9::DOUBLE * v) AS p, vals AS r, prev, first FROM truth WHERE frame > 0
  UNION ALL SELECT run_id, frame, 'rollout', list_transform(first, lambda v: power(0.9::DOUBLE, frame) * v), vals, prev, first FROM truth WHERE frame > 0
  UNION ALL SELECT run_id, frame, 'persistence_one_step', prev, vals, prev, first FROM truth WHERE frame > 0
  UNION ALL SELECT run_id, frame, 'persistence_rollout', first, vals, prev, first FROM truth WHERE frame > 0),
errors AS (SELECT *, list_transform(range(1, 65), lambda i: p[i] - r[i]) AS e FROM predicted),
scored AS (SELECT run_id, frame, kind, list_sum(list_transform(e, lambda v: v * v)) AS error_sq, list_sum(list_transform(r, lambda v: v * v)) AS reference_sq,
    list_max(list_transform(e, lambda v: abs(v))) AS top, power(list_sum(e) / 64, 2) AS mean_sq,
    power(0.5 * (list_sum(list_transform(p, lambda v: v * v)) - list_sum(list_transform(r, lambda v: v * v))) / 64, 2) AS energy_sq,
    list_sum(p) / 64 AS pm, list_sum(r) / 64 AS rm, list_sum(prev) / 64 AS bm, list_sum(first) / 64 AS fm FROM errors)"""


def decay(spark, sf_dir):
    return evaluate.evaluate(dt.frames(spark, sf_dir), evaluate.decay_step)


def rounded(df, digits, *columns):
    for c in columns:
        df = df.withColumn(c, F.round(c, digits))
    return df


@query(
    "evaluation_fields",
    dt.with_views("frames")
    + EVAL_SQL
    + """ SELECT kind, TRUE AS finite, round(sqrt(sum(error_sq) / (count(*) * 64)), 9) AS rmse,
  round(sqrt(sum(error_sq)) / sqrt(sum(reference_sq)), 9) AS relative_l2, round(max(top), 9) AS max_abs_error,
  round(sqrt(avg(mean_sq)), 9) AS mean_velocity_rmse, round(sqrt(avg(energy_sq)), 9) AS energy_rmse FROM scored GROUP BY kind""",
)
def evaluation_fields(spark, sf_dir):
    return rounded(
        decay(spark, sf_dir)["fields"],
        9,
        "rmse",
        "relative_l2",
        "max_abs_error",
        "mean_velocity_rmse",
        "energy_rmse",
    )


@query(
    "evaluation_per_time",
    dt.with_views("frames")
    + EVAL_SQL
    + """ SELECT kind, frame, round(sqrt(sum(error_sq) / (count(*) * 64)), 9) AS rmse FROM scored GROUP BY kind, frame""",
)
def evaluation_per_time(spark, sf_dir):
    return rounded(decay(spark, sf_dir)["per_time"], 9, "rmse")


@query(
    "stored_predictions",
    dt.with_views("frames")
    + EVAL_SQL
    + """ SELECT kind, run_id, count(*) AS frames, round(sum(list_sum(p)), 6) AS total, true AS refused FROM predicted
WHERE kind LIKE 'persistence%' GROUP BY kind, run_id""",
)
def stored_predictions(spark, sf_dir):
    """Baseline predictions written once as arrays by kind, refused a second time, and read back."""
    path = streaming.scratch(spark, "predictions")
    frames = dt.frames(spark, sf_dir)
    both = evaluate.persistence_one_step(frames).unionByName(evaluate.persistence_rollout(frames))
    evaluate.write_predictions(both, path)
    try:
        evaluate.write_predictions(both.limit(1), path)
        refused = False
    except AnalysisException:
        refused = True
    stored = spark.read.parquet(path)
    sums = F.round(F.sum(total(F.col("values").cast("array<double>"))), 6)
    return stored.groupBy("kind", "run_id").agg(
        F.count("*").alias("frames"), sums.alias("total"), F.lit(refused).alias("refused")
    )


DRIFT_SQL = """, drifts AS (SELECT run_id, frame, 'one_step_mean_change' AS quantity, pm - bm AS d FROM scored WHERE kind = 'one_step'
  UNION ALL SELECT run_id, frame, 'rollout_mean_drift', pm - fm FROM scored WHERE kind = 'rollout'
  UNION ALL SELECT run_id, frame, 'reference_mean_drift', rm - fm FROM scored WHERE kind = 'rollout')"""


@query(
    "evaluation_drifts",
    dt.with_views("frames")
    + EVAL_SQL
    + DRIFT_SQL
    + """ SELECT quantity, TRUE AS finite, round(sqrt(avg(d * d)), 9) AS rms, round(max(abs(d)), 9) AS max_abs FROM drifts GROUP BY quantity""",
)
def evaluation_drifts(spark, sf_dir):
    return rounded(decay(spark, sf_dir)["drifts"], 9, "rms", "max_abs")


@query(
    "evaluation_drifts_per_time",
    dt.with_views("frames")
    + EVAL_SQL
    + DRIFT_SQL
    + """ SELECT quantity, frame, TRUE AS finite, round(sqrt(avg(d * d)), 9) AS rms, round(max(abs(d)), 9) AS max_abs FROM drifts GROUP BY quantity, frame""",
)
def evaluation_drifts_per_time(spark, sf_dir):
    return rounded(decay(spark, sf_dir)["drifts_per_time"], 9, "rms", "max_abs")


@query(
    "persistence_baselines",
    dt.with_views("frames")
    + """, t AS (SELECT run_id, frame, lag(vals) OVER w AS a, first_value(vals) OVER w AS b FROM frames WINDOW w AS (PARTITION BY run_id ORDER BY frame))
SELECT run_id, frame, 'persistence_one_step' AS kind, round(list_sum(a), 8) AS total FROM t WHERE frame > 0
UNION ALL SELECT run_id, frame, 'persistence_rollout', round(list_sum(b), 8) FROM t WHERE frame > 0""",
)
def persistence_baselines(spark, sf_dir):
    frames = dt.frames(spark, sf_dir)
    both = evaluate.persistence_one_step(frames).unionByName(evaluate.persistence_rollout(frames))
    return both.select("run_id", "frame", "kind", F.round(total("values"), 8).alias("total"))


@query(
    "step_predictions",
    dt.with_views("frames")
    + EVAL_SQL
    + """ SELECT run_id, frame, kind, round(pm * 64, 8) AS total FROM scored WHERE kind IN ('one_step', 'rollout')""",
)
def step_predictions(spark, sf_dir):
    out = decay(spark, sf_dir)["predictions"]
    return out.select("run_id", "frame", "kind", F.round(total("values"), 8).alias("total"))


def study_errors(spark, sf_dir):
    """Refinement errors: a part is a study with four levels of roughly second order."""
    k = F.col("p_partkey")
    return dt.table(spark, sf_dir, "part").select(
        k.alias("study"),
        F.posexplode(
            F.transform(
                F.sequence(F.lit(0), F.lit(3)),
                lambda i: F.when((k % 50 == 0) & (i == 2), F.lit(0.0)).otherwise(
                    F.col("p_retailprice") / F.pow(F.lit(4.0), i) * (1 + (k % 11) / 40.0 * (i % 2))
                ),
            )
        ).alias("level", "error"),
    )


ORDER_SQL = """WITH e AS (SELECT p_partkey AS study, i AS level, CASE WHEN p_partkey % 50 = 0 AND i = 2 THEN 0.0::DOUBLE
    ELSE p_retailprice / power(4.0::DOUBLE, i) * (1 + (p_partkey % 11) / 40.0::DOUBLE * (i % 2)) END AS error
  FROM part, LATERAL (SELECT unnest([0, 1, 2, 3]) AS i)),
o AS (SELECT study, level, log2(error / nxt) AS observed_order FROM
  (SELECT *, lead(error) OVER (PARTITION BY study ORDER BY level) AS nxt, min(error) OVER (PARTITION BY study) AS low FROM e)
  WHERE nxt IS NOT NULL AND low > 0)"""


@query(
    "convergence_orders",
    ORDER_SQL + " SELECT study, level, round(observed_order, 9) AS observed_order FROM o",
)
def convergence_orders(spark, sf_dir):
    return rounded(evaluate.convergence_orders(study_errors(spark, sf_dir)), 9, "observed_order")


@query(
    "refinement_report",
    ORDER_SQL
    + """ SELECT e.study, 4 AS levels, 2 AS expected_order, round(o.low, 9) AS least_order, round(o.high, 9) AS most_order,
  coalesce(o.low >= 1.7 AND o.high <= 2.3, FALSE) AS passed
FROM (SELECT DISTINCT study FROM e) e LEFT JOIN (SELECT study, min(observed_order) AS low, max(observed_order) AS high FROM o GROUP BY study) o ON e.study = o.study""",
)
def refinement_report(spark, sf_dir):
    out = evaluate.refinement_report(study_errors(spark, sf_dir), F.lit(2))
    return rounded(out, 9, "least_order", "most_order")


@query(
    "validation_report",
    ORDER_SQL
    + """, r AS (SELECT e.study, coalesce(min(o.observed_order) >= 1.7 AND max(o.observed_order) <= 2.3, FALSE) AS passed
  FROM (SELECT DISTINCT study FROM e) e LEFT JOIN o ON e.study = o.study GROUP BY e.study)
SELECT bool_and(passed) AS passed, count(*) AS studies, count(*) FILTER (NOT passed) AS failed_studies,
  (SELECT count(*) FROM lineitem) AS cases, (SELECT CAST(sum(l_partkey) AS BIGINT) FROM lineitem) AS stored_output_bytes,
  (SELECT max(l_suppkey * 1000) FROM lineitem) AS peak_traced_allocation_bytes_max_case FROM r""",
)
def validation_report(spark, sf_dir):
    studies = evaluate.refinement_report(study_errors(spark, sf_dir), F.lit(2))
    cases = dt.table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("stored_bytes"), (F.col("l_suppkey") * 1000).alias("peak_bytes")
    )
    return evaluate.validation_report(studies, cases)


@query(
    "best_checkpoints",
    """SELECT l_partkey AS model_id, arg_min(l_orderkey, (l_discount, l_orderkey)) AS best_epoch, min(l_discount) AS validation_loss, count(*) AS epochs
FROM lineitem GROUP BY l_partkey""",
)
def best_checkpoints(spark, sf_dir):
    losses = dt.table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("model_id"),
        F.col("l_orderkey").alias("epoch"),
        F.col("l_discount").alias("validation_loss"),
    )
    return evaluate.best_checkpoints(losses)


@query(
    "paired_study_table",
    """WITH r AS (SELECT o_custkey AS seed, o_orderkey % 2 AS v, CAST(max(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / 128 AS rmse FROM orders GROUP BY 1, 2)
SELECT seed, max(rmse) FILTER (v = 0) AS baseline_rmse, max(rmse) FILTER (v = 1) AS mean_preserving_rmse,
  max(rmse) FILTER (v = 1) - max(rmse) FILTER (v = 0) AS delta_rmse FROM r GROUP BY seed""",
)
def paired_study_table(spark, sf_dir):
    results = (
        dt.table(spark, sf_dir, "orders")
        .groupBy(
            F.col("o_custkey").alias("seed"),
            F.when(F.col("o_orderkey") % 2 == 0, "baseline")
            .otherwise("mean_preserving")
            .alias("variant"),
        )
        .agg((F.max(dt.cents("o_totalprice")) / 128).alias("rmse"))
    )
    return evaluate.paired_table(results, ["rmse"])
