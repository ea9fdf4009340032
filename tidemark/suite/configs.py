"""Queries on configurations, sweeps and study plans."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tidemark.plans import configs, sweeps
from tidemark.sources import driver_tables as dt
from tidemark.suite import query

TWO_PI = repr(2 * math.pi)


def raw_configs(spark, sf_dir):
    """One raw configuration per part; some carry a value that must be refused."""
    k = F.col("p_partkey")
    text = lambda c: c.cast("string")
    raw = F.map_from_entries(
        F.array_compact(
            F.array(
                F.when(
                    k % 4 != 0,
                    F.struct(
                        F.lit("equation").alias("key"),
                        F.when(k % 4 == 1, "burgers1d")
                        .when(k % 4 == 2, "navier_stokes2d")
                        .otherwise("darcy2d")
                        .alias("value"),
                    ),
                ),
                F.struct(F.lit("grid_size").alias("key"), text(F.col("p_size") * 4).alias("value")),
                F.when(
                    k % 4 != 3,
                    F.struct(
                        F.lit("viscosity").alias("key"),
                        F.when(k % 17 == 0, F.lit("true"))
                        .when(k % 19 == 0, F.lit("-0.5"))
                        .otherwise(F.lit("0.25"))
                        .alias("value"),
                    ),
                ),
                F.when(
                    k % 4 != 3,
                    F.struct(F.lit("steps").alias("key"), text((k % 300) * 50).alias("value")),
                ),
                F.when(
                    k % 3 == 0,
                    F.struct(F.lit("domain_length").alias("key"), F.lit("2.5").alias("value")),
                ),
                F.when(
                    k % 29 == 0,
                    F.struct(F.lit("viscocity").alias("key"), F.lit("0.1").alias("value")),
                ),
                F.when(
                    k % 31 == 0,
                    F.struct(
                        F.lit("initial_condition").alias("key"), F.lit("sine").alias("value")
                    ),
                ),
            )
        )
    )
    return dt.table(spark, sf_dir, "part").select(k.alias("config_id"), raw.alias("raw"))


RAW_SQL = f"""WITH given AS (SELECT p_partkey AS k, 4 * p_size AS n, (p_partkey % 300) * 50 AS steps,
    CASE p_partkey % 4 WHEN 2 THEN 'navier_stokes2d' WHEN 3 THEN 'darcy2d' ELSE 'burgers1d' END AS equation,
    CASE WHEN p_partkey % 3 = 0 THEN 2.5::DOUBLE WHEN p_partkey % 4 = 3 THEN 1.0::DOUBLE ELSE {TWO_PI}::DOUBLE END AS len
  FROM part),
sized AS (SELECT *, 1 + steps // 10 AS frames,
    CASE WHEN equation = 'burgers1d' THEN 8 * ((1 + steps // 10) * (n + 4) + n)
         ELSE 8 * ((1 + steps // 10) * (3 * n * n + 6) + 2 * n) END AS bytes FROM given),
tagged AS (SELECT *, CASE WHEN equation = 'darcy2d' THEN
    list_filter([CASE WHEN k % 29 = 0 OR k % 31 = 0 THEN 'unknown_keys' END,
      CASE WHEN NOT n BETWEEN 5 AND 513 THEN 'grid_size' END], lambda r: r IS NOT NULL)
  ELSE list_filter([CASE WHEN k % 29 = 0 THEN 'unknown_keys' END,
      CASE WHEN k % 31 = 0 AND equation = 'navier_stokes2d' THEN 'initial_condition' END,
      CASE WHEN k % 17 = 0 OR k % 19 = 0 THEN 'viscosity' END,
      CASE WHEN n < 8 THEN 'grid_size' END, CASE WHEN steps < 1 THEN 'steps' END,
      CASE WHEN steps >= 1 AND bytes > 268435456 THEN 'output_size' END], lambda r: r IS NOT NULL) END AS reasons
  FROM sized)"""


@query(
    "config_normalization",
    RAW_SQL
    + """ SELECT k AS config_id, array_to_string(reasons, ',') AS reasons,
  CASE WHEN len(reasons) = 0 THEN equation END AS equation,
  CASE WHEN len(reasons) = 0 THEN n END AS grid_size,
  CASE WHEN len(reasons) = 0 AND equation <> 'darcy2d' THEN 0.25::DOUBLE END AS viscosity,
  CASE WHEN len(reasons) = 0 THEN len END AS domain_length,
  CASE WHEN len(reasons) = 0 AND equation <> 'darcy2d' THEN steps END AS steps,
  CASE WHEN len(reasons) = 0 AND equation <> 'darcy2d' THEN 10 END AS save_every,
  CASE WHEN len(reasons) = 0 AND equation = 'darcy2d' THEN 0.5::DOUBLE END AS contrast,
  CASE WHEN len(reasons) = 0 AND equation <> 'darcy2d' THEN
    CASE WHEN k % 31 = 0 THEN 'sine' WHEN equation = 'burgers1d' THEN 'sine' ELSE 'taylor_green' END END AS initial_condition,
  CASE WHEN len(reasons) = 0 AND equation <> 'darcy2d' THEN bytes END AS output_bytes
FROM tagged""",
)
def config_normalization(spark, sf_dir):
    out = configs.normalize_configs(raw_configs(spark, sf_dir))
    return out.select(
        "config_id",
        F.concat_ws(",", "reasons").alias("reasons"),
        *[
            F.col(f"config.{n}").alias(n)
            for n in (
                "equation",
                "grid_size",
                "viscosity",
                "domain_length",
                "steps",
                "save_every",
                "contrast",
                "initial_condition",
            )
        ],
        "output_bytes",
    )


@query(
    "unknown_config_keys",
    """SELECT p_partkey AS config_id,
  CASE WHEN p_partkey % 29 = 0 AND p_partkey % 31 = 0 AND p_partkey % 4 = 3 THEN 'initial_condition,viscocity'
    WHEN p_partkey % 29 = 0 THEN 'viscocity' ELSE 'initial_condition' END AS unknown
FROM part WHERE p_partkey % 29 = 0 OR (p_partkey % 31 = 0 AND p_partkey % 4 = 3)""",
)
def unknown_config_keys(spark, sf_dir):
    m = F.col("raw")
    known = F.when(m["equation"] == "darcy2d", F.array(*map(F.lit, configs.STEADY_KEYS))).otherwise(
        F.array(*map(F.lit, configs.TIME_DEPENDENT_KEYS))
    )
    return (
        raw_configs(spark, sf_dir)
        .select(
            "config_id",
            F.concat_ws(",", F.array_sort(F.array_except(F.map_keys(m), known))).alias("unknown"),
        )
        .filter(F.col("unknown") != "")
    )


@query(
    "saved_frame_cadence",
    dt.with_views("runs")
    + """ SELECT id, 1 + steps // save_every + CASE WHEN steps % save_every > 0 THEN 1 ELSE 0 END AS frames,
  steps AS last_step, (steps // save_every) * (steps // save_every + 1) // 2 * save_every
    + CASE WHEN steps % save_every > 0 THEN steps ELSE 0 END AS step_sum
FROM runs WHERE equation <> 'darcy2d'""",
)
def saved_frame_cadence(spark, sf_dir):
    steps, every = F.col("steps"), F.col("save_every")
    saved = configs.saved_steps(steps, every)
    return (
        dt.runs(spark, sf_dir)
        .filter(F.col("equation") != "darcy2d")
        .select(
            "id",
            configs.frame_count(steps, every).alias("frames"),
            F.array_max(saved).alias("last_step"),
            F.aggregate(saved, F.lit(0).cast("long"), lambda a, s: a + s).alias("step_sum"),
        )
    )


@query(
    "run_identity",
    dt.with_views("runs")
    + """ SELECT id, substr(sha256('{"attempt":' || (run_id % 3) || ',"code":{"dependencies":null,"git_commit":"c'
   || (run_id % 5) || '","hardware":null,"python":"3.12","source_sha256":"' || sha256(solver)
   || '"},"config":"' || equation || ':' || seed || ':' || steps || '","parent_id":'
   || coalesce('"' || parent_id || '"', 'null') || ',"schema_version":1}'), 1, 32) AS content_id FROM runs""",
)
def run_identity(spark, sf_dir):
    provenance = F.create_map(
        F.lit("git_commit"),
        F.concat(F.lit("c"), F.col("run_id") % 5),
        F.lit("python"),
        F.lit("3.12"),
        F.lit("source_sha256"),
        F.sha2("solver", 256),
        F.lit("git_dirty"),
        F.col("status"),
    )
    return dt.runs(spark, sf_dir).select(
        "id",
        configs.experiment_id(
            F.concat_ws(":", "equation", "seed", "steps"),
            provenance,
            F.col("parent_id"),
            F.col("run_id") % 3,
        ).alias("content_id"),
    )


@query(
    "runtime_identity_changes",
    dt.with_views("runs")
    + """ SELECT c.id, p.id AS parent_id, NOT (c.solver = p.solver AND c.seed % 4 = p.seed % 4) AS changed
FROM runs c JOIN runs p ON c.parent_id = p.id""",
)
def runtime_identity_changes(spark, sf_dir):
    provenance = F.create_map(
        F.lit("solver"),
        F.col("solver"),
        F.lit("machine"),
        (F.col("seed") % 4).cast("string"),
        F.lit("git_dirty"),
        F.col("created_at"),
    )
    runs = dt.runs(spark, sf_dir).select("id", "parent_id", provenance.alias("provenance"))
    parents = runs.select(F.col("id").alias("parent_id"), F.col("provenance").alias("before"))
    return runs.join(parents, "parent_id").select(
        "id",
        "parent_id",
        (~configs.same_runtime(F.col("provenance"), F.col("before"))).alias("changed"),
    )


@query(
    "changed_parameters",
    dt.with_views("runs")
    + """, pairs AS (SELECT c.id, [CASE WHEN c.grid_size <> p.grid_size THEN 'grid_size:' || p.grid_size || '>' || c.grid_size END,
    CASE WHEN c.save_every <> p.save_every THEN 'save_every:' || p.save_every || '>' || c.save_every END,
    CASE WHEN c.seed <> p.seed THEN 'seed:' || p.seed || '>' || c.seed END,
    CASE WHEN c.steps <> p.steps THEN 'steps:' || p.steps || '>' || c.steps END] AS parts
  FROM runs c JOIN runs p ON c.parent_id = p.id)
SELECT id, array_to_string(list_filter(parts, lambda x: x IS NOT NULL), ';') AS changes FROM pairs""",
)
def changed_parameters(spark, sf_dir):
    keys = ("grid_size", "save_every", "seed", "steps")
    as_map = F.create_map(*[x for k in keys for x in (F.lit(k), F.col(k).cast("string"))])
    runs = dt.runs(spark, sf_dir).select("id", "parent_id", as_map.alias("after"))
    parents = runs.select(F.col("id").alias("parent_id"), F.col("after").alias("before"))
    diff = configs.changed_parameters(F.col("before"), F.col("after"))
    text = F.transform(
        F.array_sort(F.map_entries(diff)),
        lambda e: F.concat(e["key"], F.lit(":"), e["value"]["before"], F.lit(">"), e["value"]["after"]),
    )
    return runs.join(parents, "parent_id").select("id", F.concat_ws(";", text).alias("changes"))


def sweep_specs(spark, sf_dir):
    """One sweep per customer; some list a value twice, some a refused one, some none."""
    k = F.col("c_custkey")
    base = F.create_map(
        F.lit("equation"), F.lit("burgers1d"), F.lit("steps"), F.lit("40"), F.lit("seed"), F.lit("99")
    )
    seeds = F.transform(F.sequence(F.lit(0), (k % 3).cast("int")), lambda s: s.cast("string"))
    viscosity = (
        F.when(k % 13 == 0, F.array(F.lit("0.5"), F.lit("-1")))
        .when(k % 7 == 0, F.array().cast("array<string>"))
        .otherwise(F.array(F.lit("0.25"), F.lit("0.25"), F.lit("0.5")))
    )
    grids = F.array((8 + k % 5).cast("string"), F.lit("32"))
    return dt.table(spark, sf_dir, "customer").select(
        k.alias("spec_id"),
        base.alias("base"),
        F.map_from_arrays(
            F.array(F.lit("viscosity"), F.lit("seed"), F.lit("grid_size")),
            F.array(viscosity, seeds, grids),
        ).alias("parameters"),
    )


@query(
    "sweep_expansion",
    """WITH combos AS (SELECT c_custkey AS spec_id, g.v AS grid_size, g.i AS gi, s.v AS seed, n.v AS viscosity, n.i AS ni,
    c_custkey % 3 + 1 AS seeds
  FROM customer, LATERAL (SELECT unnest([8 + c_custkey % 5, 32]) AS v, unnest([0, 1]) AS i) g,
    LATERAL (SELECT unnest(range(0, c_custkey % 3 + 1)) AS v) s,
    LATERAL (SELECT unnest([0.25::DOUBLE, 0.25::DOUBLE, 0.5::DOUBLE]) AS v, unnest([0, 1, 2]) AS i) n
  WHERE c_custkey % 13 <> 0 AND c_custkey % 7 <> 0)
SELECT spec_id, grid_size, seed, viscosity, 40 AS steps, min(gi * seeds * 3 + seed * 3 + ni) AS ordinal
FROM combos GROUP BY spec_id, grid_size, seed, viscosity""",
)
def sweep_expansion(spark, sf_dir):
    return sweeps.plan_sweeps(sweep_specs(spark, sf_dir)).select(
        "spec_id", "config.grid_size", "config.seed", "config.viscosity", "config.steps", "ordinal"
    )


@query(
    "sweep_problems",
    """SELECT c_custkey AS spec_id, 'empty_parameter' AS reasons FROM customer
WHERE c_custkey % 7 = 0 AND c_custkey % 13 <> 0""",
)
def sweep_problems(spark, sf_dir):
    return sweeps.sweep_problems(sweep_specs(spark, sf_dir)).select(
        "spec_id", F.concat_ws(",", "reasons").alias("reasons")
    )


def studies(spark, sf_dir):
    """One benchmark study per customer over that customer's sweep."""
    k = F.col("c_custkey")
    study = dt.table(spark, sf_dir, "customer").select(
        k.alias("study_id"),
        F.when(k % 11 == 0, F.array(F.lit(2), F.lit(4)))
        .otherwise(F.array(F.lit(1), F.lit(2), F.lit(4)))
        .alias("workers"),
        F.when(k % 5 == 0, F.array(F.lit("streamed")))
        .otherwise(F.array(F.lit("buffered"), F.lit("streamed")))
        .alias("modes"),
        (1 + k % 9).alias("repeats"),
        (k * 17).alias("seed"),
        F.when(k % 2 == 0, "small").otherwise("large").alias("scale"),
    )
    planned = sweeps.plan_sweeps(sweep_specs(spark, sf_dir)).withColumnRenamed("spec_id", "study_id")
    return sweeps.plan_studies(study, planned)


STUDY_SQL = """WITH study AS (SELECT c_custkey AS study_id,
    CASE WHEN c_custkey % 11 = 0 THEN [2, 4] ELSE [1, 2, 4] END AS workers,
    CASE WHEN c_custkey % 5 = 0 THEN ['streamed'] ELSE ['buffered', 'streamed'] END AS modes,
    1 + c_custkey % 9 AS repeats, c_custkey * 17 AS seed, c_custkey % 2 = 0 AS small,
    (c_custkey % 3 + 1) * 4 AS configs,
    (c_custkey % 3 + 1) * 2 * (8 * (5 * (8 + c_custkey % 5 + 4) + 8 + c_custkey % 5) + 8 * (5 * 36 + 32)) AS bytes_per_trial
  FROM customer WHERE c_custkey % 13 <> 0 AND c_custkey % 7 <> 0),
totals AS (SELECT *, len(workers) * len(modes) * repeats AS cases FROM study),
planned AS (SELECT study_id, workers, modes, repeats, seed, configs, cases, cases * configs AS fresh_runs,
    cases * configs * 40 AS integration_steps, cases * bytes_per_trial AS estimated_bytes,
    array_to_string(list_filter([CASE WHEN NOT list_contains(workers, 1) THEN 'workers' END,
      CASE WHEN repeats > 7 THEN 'repeats' END, CASE WHEN cases > 48 THEN 'case_count' END,
      CASE WHEN cases * configs > CASE WHEN small THEN 256 ELSE 4096 END THEN 'fresh_runs' END],
      lambda r: r IS NOT NULL), ',') AS reasons
  FROM totals)"""


@query(
    "study_plan",
    STUDY_SQL
    + """ SELECT study_id, configs, cases, fresh_runs, integration_steps, estimated_bytes, reasons FROM planned""",
)
def study_plan(spark, sf_dir):
    return studies(spark, sf_dir).select(
        "study_id",
        "configs",
        "cases",
        "fresh_runs",
        "integration_steps",
        "estimated_bytes",
        F.concat_ws(",", "reasons").alias("reasons"),
    )


@query(
    "study_case_order",
    STUDY_SQL
    + """, cases AS (SELECT study_id, r.v AS repeat, w.v AS workers, m.v AS mode,
    sha256(seed || ':' || r.v || ':' || w.v || ':' || m.v) AS key
  FROM planned, LATERAL (SELECT unnest(range(0, repeats)) AS v) r, LATERAL (SELECT unnest(workers) AS v) w,
    LATERAL (SELECT unnest(modes) AS v) m WHERE reasons = ''),
placed AS (SELECT *, row_number() OVER (PARTITION BY study_id ORDER BY key) - 1 AS position FROM cases)
SELECT study_id, position, repeat, workers, mode,
  printf('trial-%03d-%s-w%d-r%d', position, mode, workers, repeat) AS case_id FROM placed""",
)
def study_case_order(spark, sf_dir):
    return sweeps.order_cases(studies(spark, sf_dir))


@query(
    "paired_run_order",
    """SELECT c_custkey AS seed, p.i AS position, (p.i = 1) = (c_custkey % 2 = 0) AS conserve_mean,
  CASE WHEN (p.i = 1) = (c_custkey % 2 = 0) THEN 'mean_preserving' ELSE 'baseline' END AS variant
FROM customer, LATERAL (SELECT unnest([0, 1]) AS i) p""",
)
def paired_run_order(spark, sf_dir):
    seeds = dt.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("seed"))
    return sweeps.paired_runs(seeds)


@query(
    "duplicate_ids",
    """SELECT CAST(l_orderkey * 8 + l_linenumber AS VARCHAR) AS id, count(*) AS copies FROM lineitem
GROUP BY l_orderkey * 8 + l_linenumber HAVING count(*) > 1""",
)
def duplicate_ids(spark, sf_dir):
    ids = dt.table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).cast("string").alias("id")
    )
    return configs.duplicate_ids(ids)


@query(
    "planned_vs_returned",
    """SELECT coalesce(p.k, r.k) AS config_key, CASE WHEN r.k IS NULL THEN 'missing' ELSE 'unexpected' END AS problem
FROM (SELECT DISTINCT o_orderkey AS k FROM orders) p
FULL JOIN (SELECT DISTINCT l_orderkey + CASE WHEN l_orderkey % 101 = 0 THEN 1000000 ELSE 0 END AS k FROM lineitem) r
  ON p.k = r.k WHERE p.k IS NULL OR r.k IS NULL""",
)
def planned_vs_returned(spark, sf_dir):
    planned = dt.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("config_key"))
    k = F.col("l_orderkey")
    returned = dt.table(spark, sf_dir, "lineitem").select(
        (k + F.when(k % 101 == 0, 1000000).otherwise(0)).alias("config_key")
    )
    return configs.compare_keys(planned, returned)


@query(
    "repeat_equality",
    """SELECT coalesce(a.k, b.k) AS run_id, CASE WHEN a.k IS NULL THEN 'only_second' WHEN b.k IS NULL THEN 'only_first'
  ELSE 'different' END AS problem
FROM (SELECT o_orderkey AS k, o_orderstatus AS s, o_totalprice AS p FROM orders WHERE o_orderkey % 37 <> 0) a
FULL JOIN (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 41 = 0 THEN NULL ELSE o_orderstatus END AS s, o_totalprice AS p
  FROM orders WHERE o_orderkey % 43 <> 0) b ON a.k = b.k
WHERE a.k IS NULL OR b.k IS NULL OR (a.s, a.p) IS DISTINCT FROM (b.s, b.p)""",
)
def repeat_equality(spark, sf_dir):
    o = dt.table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    base = o.select(k.alias("run_id"), F.col("o_orderstatus").alias("status"), "o_totalprice")
    first = base.filter(F.col("run_id") % 37 != 0)
    second = base.filter(F.col("run_id") % 43 != 0).withColumn(
        "status", F.when(F.col("run_id") % 41 != 0, F.col("status"))
    )
    return configs.unequal_repeats(first, second, "run_id", ["status", "o_totalprice"])
