"""Queries on run summaries and the catalog."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import schemas, streaming
from tidemark.operators import integrity, summary
from tidemark.sources import catalog as sources
from tidemark.sources import driver_tables as dt
from tidemark.suite import query

SUMMARY_COLUMNS = """run_id, initial_energy, final_energy, max_energy,
  energy_change, energy_increase_observed, energy_increase_count, first_energy_increase_frame,
  first_energy_increase_time, first_energy_increase_step, final_time, saved_frames,
  mass_drift, max_divergence, initial_enstrophy, final_enstrophy, needs_review"""

SUMMARY_CTE = """,
stepped AS (SELECT *, energy - lag(energy) OVER w AS rise, first_value(energy) OVER w AS e0,
    first_value(mass) OVER w AS m0 FROM diagnostics WINDOW w AS (PARTITION BY run_id ORDER BY frame)),
folded AS (
  SELECT run_id, arg_min(energy, frame) AS initial_energy, arg_max(energy, frame) AS final_energy,
    max(energy) AS max_energy, arg_max(energy, frame) - arg_min(energy, frame) AS energy_change,
    count(*) FILTER (rise > 1e-8 * greatest(e0, 1)) > 0 AS energy_increase_observed,
    count(*) FILTER (rise > 1e-8 * greatest(e0, 1)) AS energy_increase_count,
    min(frame) FILTER (rise > 1e-8 * greatest(e0, 1)) AS first_energy_increase_frame,
    min(time) FILTER (rise > 1e-8 * greatest(e0, 1)) AS first_energy_increase_time,
    CAST(round_even(min(time) FILTER (rise > 1e-8 * greatest(e0, 1)) / 0.25, 0) AS BIGINT) AS first_energy_increase_step,
    arg_max(time, frame) AS final_time, count(*) AS saved_frames, max(abs(mass - m0)) AS mass_drift,
    max(max_abs_divergence) AS max_divergence, arg_min(enstrophy, frame) AS initial_enstrophy,
    arg_max(enstrophy, frame) AS final_enstrophy
  FROM stepped GROUP BY run_id),
summaries AS (SELECT *, energy_increase_observed OR max_divergence > 1e-10 OR mass_drift > 1e-10 AS needs_review
  FROM folded)"""


def summaries(spark, sf_dir):
    diag = dt.diagnostics(spark, sf_dir).withColumn("dt", F.lit(0.25))
    return summary.summarize_runs(diag, dt="dt")


@query("run_summary", dt.with_views("diagnostics") + SUMMARY_CTE + f" SELECT {SUMMARY_COLUMNS} FROM summaries")
def run_summary(spark, sf_dir):
    return summaries(spark, sf_dir).select(*[c.strip() for c in SUMMARY_COLUMNS.split(",")])


@query(
    "catalog_counts",
    dt.with_views("runs", "diagnostics")
    + SUMMARY_CTE
    + """ SELECT r.equation, r.status, count(*) AS runs, count(*) FILTER (r.status = 'completed') AS completed,
  count(*) FILTER (s.needs_review) AS flagged, count(*) FILTER (r.status = 'failed') AS failed
FROM runs r LEFT JOIN summaries s ON r.run_id = s.run_id GROUP BY r.equation, r.status""",
)
def catalog_counts(spark, sf_dir):
    flags = summaries(spark, sf_dir).select("run_id", "needs_review")
    runs = dt.runs(spark, sf_dir).select("run_id", "equation", "status")
    return summary.catalog_counts(runs.join(flags, "run_id", "left"))


@query(
    "energy_increase_frames",
    dt.with_views("diagnostics")
    + """, stepped AS (SELECT *, energy - lag(energy) OVER w AS rise, first_value(energy) OVER w AS e0
  FROM diagnostics WINDOW w AS (PARTITION BY run_id ORDER BY frame))
SELECT run_id, frame, time, round(rise, 6) AS rise FROM stepped WHERE rise > 1e-8 * greatest(e0, 1)""",
)
def energy_increase_frames(spark, sf_dir):
    rows = summary.energy_increases(dt.diagnostics(spark, sf_dir))
    return rows.select("run_id", "frame", "time", F.round("rise", 6).alias("rise"))


@query(
    "mass_drift_frames",
    dt.with_views("diagnostics")
    + """ SELECT run_id, frame, mass - first_value(mass) OVER (PARTITION BY run_id ORDER BY frame) AS drift FROM diagnostics""",
)
def mass_drift_frames(spark, sf_dir):
    return summary.drift_from_first(dt.diagnostics(spark, sf_dir), "mass").select(
        "run_id", "frame", "drift"
    )


@query(
    "wide_diagnostics",
    dt.with_views("diagnostics")
    + """ SELECT run_id, frame, time, energy, mass, max_abs_divergence FROM diagnostics""",
)
def wide_diagnostics(spark, sf_dir):
    names = ["energy", "mass", "max_abs_divergence"]
    long = dt.diagnostics(spark, sf_dir).select(
        "run_id",
        "frame",
        "time",
        F.inline(
            F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("value")) for n in names])
        ),
    )
    return summary.widen_diagnostics(long, names)


@query(
    "steady_summary",
    """SELECT p_partkey AS run_id, p_size / 1e9::DOUBLE AS residual_l2, p_size / 100.0::DOUBLE AS pressure_l2_error,
  1 AS saved_frames, 0.0::DOUBLE AS final_time, TRUE AS finite, p_size / 1e9::DOUBLE > 1e-8 AS needs_review,
  1e-8::DOUBLE AS residual_tolerance FROM part""",
)
def steady_summary(spark, sf_dir):
    return summary.summarize_steady(
        dt.table(spark, sf_dir, "part").select(
            F.col("p_partkey").alias("run_id"),
            (F.col("p_size") / 1e9).alias("residual_l2"),
            (F.col("p_size") / 100.0).alias("pressure_l2_error"),
        )
    )


@query(
    "reynolds_number",
    dt.with_views("runs")
    + """ SELECT id, CASE WHEN run_id % 7 = 0 THEN NULL ELSE round(amplitude * domain_length / viscosity, 9) END AS reynolds FROM runs""",
)
def reynolds_number(spark, sf_dir):
    nu = F.when(F.col("run_id") % 7 == 0, F.lit(0.0)).otherwise(F.col("viscosity"))
    value = summary.reynolds(F.col("amplitude"), F.col("domain_length"), nu)
    return dt.runs(spark, sf_dir).select("id", F.round(value, 9).alias("reynolds"))


def catalog(spark, sf_dir):
    """The flat catalog: base columns first, one open metric column after them."""
    runs = dt.runs(spark, sf_dir)
    return sources.union_catalogs(
        sources.empty_catalog(spark),
        runs.select(
            *[c for c in schemas.IDENTITY_COLUMNS],
            *[c for c in schemas.CONFIG_COLUMNS],
            "initial_energy",
            "final_energy",
            "mass_drift",
            "needs_review",
            F.when(F.col("equation") == "darcy2d", F.col("initial_energy") / 4).alias("residual_l2"),
        ),
    )


CATALOG_SQL = """, experiments AS (SELECT id, status, equation, solver, created_at, parent_id, error, viscosity, grid_size, dt,
    steps, seed, initial_energy, final_energy, mass_drift, needs_review,
    CASE WHEN equation = 'darcy2d' THEN initial_energy / 4 END AS residual_l2 FROM runs)"""


@query(
    "catalog_open_columns",
    dt.with_views("runs")
    + CATALOG_SQL
    + """ SELECT equation, count(*) AS runs, count(mass_drift) AS with_mass_drift, count(residual_l2) AS with_residual,
  CAST(0 AS BIGINT) AS with_divergence FROM experiments GROUP BY equation""",
)
def catalog_open_columns(spark, sf_dir):
    return (
        catalog(spark, sf_dir)
        .groupBy("equation")
        .agg(
            F.count("*").alias("runs"),
            F.count("mass_drift").alias("with_mass_drift"),
            F.count("residual_l2").alias("with_residual"),
            F.count("max_divergence").alias("with_divergence"),
        )
    )


@query(
    "flattened_records",
    dt.with_views("runs")
    + """ SELECT id, status, equation, viscosity, grid_size, steps, initial_energy, needs_review,
  mass_drift, CAST(seed AS DOUBLE) / 2 AS metric_seed, CASE WHEN status = 'completed' THEN steps / 4.0::DOUBLE END AS sharpness
FROM runs""",
)
def flattened_records(spark, sf_dir):
    text = lambda c: F.col(c).cast("string")
    runs = dt.runs(spark, sf_dir)
    metrics = F.map_filter(
        F.create_map(
            F.lit("initial_energy"),
            text("initial_energy"),
            F.lit("mass_drift"),
            text("mass_drift"),
            F.lit("needs_review"),
            text("needs_review"),
            F.lit("seed"),
            (F.col("seed") / 2).cast("string"),
            F.lit("sharpness"),
            F.when(F.col("status") == "completed", (F.col("steps") / 4).cast("string")),
        ),
        lambda k, v: v.isNotNull(),
    )
    config = F.struct("equation", "viscosity", "grid_size", "dt", "steps", "seed")
    records = runs.select(
        "id",
        "status",
        "equation",
        "solver",
        "created_at",
        "parent_id",
        F.when(
            F.col("error").isNotNull(),
            F.struct(F.col("error").alias("type"), F.lit("unstable").alias("message")),
        ).alias("error"),
        config.alias("config"),
        F.create_map(F.lit("python"), F.lit("3.12")).alias("provenance"),
        metrics.alias("metrics"),
    )
    return sources.flatten_records(records).select(
        "id",
        "status",
        "equation",
        "viscosity",
        "grid_size",
        "steps",
        "initial_energy",
        "needs_review",
        "mass_drift",
        "metric_seed",
        "sharpness",
    )


@query(
    "catalog_browser",
    dt.with_views("runs")
    + """ SELECT id, equation, status, parent_id FROM runs WHERE equation = 'burgers1d' AND needs_review
  AND contains(lower(concat_ws(' ', id, parent_id, solver, created_at)), '1997')""",
)
def catalog_browser(spark, sf_dir):
    narrow = dt.runs(spark, sf_dir).select(
        "id", "parent_id", "solver", "created_at", "equation", "status", "needs_review"
    )
    # The oracle names the four text columns; no other column can contain "1997".
    return sources.list_runs(
        sources.browse(narrow, equation="burgers1d", flagged=True, text="1997")
    )


@query(
    "page_text_filter",
    """SELECT page_id, url FROM pages WHERE contains(lower(url), 'ref=x') OR contains(lower(html), 'ref=x')""",
)
def page_text_filter(spark, sf_dir):
    pages = dt.table(spark, sf_dir, "pages")
    return sources.browse(pages, text="REF=x").select("page_id", "url")


@query(
    "first_runs",
    dt.with_views("runs") + """ SELECT id, equation, status, parent_id FROM runs ORDER BY id LIMIT 50""",
)
def first_runs(spark, sf_dir):
    return sources.list_runs(sources.first_runs(dt.runs(spark, sf_dir), 50))


@query(
    "listing_summary",
    """SELECT least(count(*), 50) AS displayed, count(*) AS total, count(*) > 50 AS truncated, 50 AS max_experiments FROM orders""",
)
def listing_summary(spark, sf_dir):
    return sources.listing_summary(dt.runs(spark, sf_dir), 50)


@query(
    "catalog_sql",
    dt.with_views("runs")
    + CATALOG_SQL
    + """ SELECT equation, status, count(*) AS runs, count(*) FILTER (needs_review) AS flagged, max(final_energy) AS top_energy
FROM experiments WHERE viscosity < 0.05 GROUP BY equation, status""",
)
def catalog_sql(spark, sf_dir):
    return sources.select_runs(
        catalog(spark, sf_dir),
        """SELECT equation, status, count(*) AS runs, count_if(needs_review) AS flagged,
             max(final_energy) AS top_energy
           FROM experiments WHERE viscosity < 0.05 GROUP BY equation, status""",
    )


@query(
    "catalog_sql_cte_subquery",
    dt.with_views("runs")
    + CATALOG_SQL
    + """, costly AS (SELECT equation, max(steps) AS top FROM experiments GROUP BY equation)
SELECT e.id, e.equation FROM experiments e JOIN costly c ON e.equation = c.equation AND e.steps = c.top
WHERE e.parent_id IN (SELECT id FROM experiments WHERE status = 'failed')""",
)
def catalog_sql_cte_subquery(spark, sf_dir):
    return sources.select_runs(
        catalog(spark, sf_dir),
        """WITH costly AS (SELECT equation, max(steps) AS top FROM experiments GROUP BY equation)
           SELECT e.id, e.equation FROM experiments e
           JOIN costly c ON e.equation = c.equation AND e.steps = c.top
           WHERE e.parent_id IN (SELECT id FROM experiments WHERE status = 'failed')""",
    )


@query(
    "catalog_sql_grouping_sets",
    dt.with_views("runs")
    + CATALOG_SQL
    + """ SELECT equation, status, grouping(equation) + 2 * grouping(status) AS level, count(*) AS runs,
  count(DISTINCT seed) AS seeds FROM experiments GROUP BY CUBE (equation, status)""",
)
def catalog_sql_grouping_sets(spark, sf_dir):
    return sources.select_runs(
        catalog(spark, sf_dir),
        """SELECT equation, status, CAST(grouping(equation) + 2 * grouping(status) AS BIGINT) AS level,
             count(*) AS runs, count(DISTINCT seed) AS seeds
           FROM experiments GROUP BY CUBE (equation, status)""",
    )


@query(
    "catalog_sql_ranking",
    dt.with_views("runs")
    + CATALOG_SQL
    + """ SELECT id, seed, rank() OVER w AS place, dense_rank() OVER w AS dense_place,
  CAST(sum(steps) OVER (w ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS BIGINT) AS pair_steps
FROM experiments WHERE status = 'completed' WINDOW w AS (PARTITION BY seed, equation ORDER BY steps, id)""",
)
def catalog_sql_ranking(spark, sf_dir):
    return sources.select_runs(
        catalog(spark, sf_dir),
        """SELECT id, seed, rank() OVER w AS place, dense_rank() OVER w AS dense_place,
             sum(steps) OVER (PARTITION BY seed, equation ORDER BY steps, id
                              ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS pair_steps
           FROM experiments WHERE status = 'completed'
           WINDOW w AS (PARTITION BY seed, equation ORDER BY steps, id)""",
    )


@query(
    "verified_reuse",
    dt.with_views("runs", "manifest", "artifacts")
    + """, wanted AS (SELECT CASE WHEN l_orderkey % 3 = 0 THEN 'new-' || l_orderkey ELSE 'run-' || l_orderkey END AS id
  FROM lineitem GROUP BY l_orderkey),
problems AS (SELECT 'run-' || coalesce(m.run_id, a.run_id) AS id, count(*) AS n FROM manifest m
  FULL JOIN artifacts a ON m.run_id = a.run_id AND m.path = a.path
  WHERE m.sha256 IS DISTINCT FROM a.sha256 GROUP BY 1)
SELECT w.id, r.status AS found_status, coalesce(p.n, 0) AS problem_count,
  CASE WHEN r.id IS NULL THEN 'run' WHEN p.n > 0 THEN 'corrupt' ELSE 'reuse' END AS action
FROM wanted w LEFT JOIN runs r ON w.id = r.id LEFT JOIN problems p ON w.id = p.id""",
)
def verified_reuse(spark, sf_dir):
    k = F.col("l_orderkey")
    expected = (
        dt.table(spark, sf_dir, "lineitem")
        .select(
            F.concat(F.when(k % 3 == 0, F.lit("new-")).otherwise(F.lit("run-")), k).alias("id")
        )
        .distinct()
    )
    return sources.reuse_plan(expected, dt.runs(spark, sf_dir), artifact_problem_ids(spark, sf_dir))


def artifact_problem_ids(spark, sf_dir):
    problems = integrity.artifact_problems(
        dt.manifest_entries(spark, sf_dir), dt.artifacts(spark, sf_dir)
    )
    return problems.select(F.concat(F.lit("run-"), "run_id").alias("id"), "problem")


@query(
    "parents_ready",
    dt.with_views("runs", "manifest", "artifacts")
    + """, problems AS (SELECT DISTINCT 'run-' || coalesce(m.run_id, a.run_id) AS id FROM manifest m
  FULL JOIN artifacts a ON m.run_id = a.run_id AND m.path = a.path WHERE m.sha256 IS DISTINCT FROM a.sha256)
SELECT r.id, r.parent_id FROM runs r WHERE r.parent_id IS NULL
  OR (r.parent_id IN (SELECT id FROM runs) AND r.parent_id NOT IN (SELECT id FROM problems))""",
)
def parents_ready(spark, sf_dir):
    runs = dt.runs(spark, sf_dir).select("id", "parent_id")
    return sources.parents_ready(runs, runs, artifact_problem_ids(spark, sf_dir))


@query(
    "publication_round_trip",
    dt.with_views("runs")
    + """ SELECT equation, status, count(*) AS runs, CAST(sum(steps) AS BIGINT) AS steps FROM runs GROUP BY equation, status""",
)
def publication_round_trip(spark, sf_dir):
    """Publish the runs in two overlapping batches and read the committed catalog."""
    root = streaming.scratch(spark, "lake")
    runs = catalog(spark, sf_dir)
    sources.publish_runs(runs.filter(F.col("steps") <= 150), None, root)
    sources.publish_runs(runs.filter(F.col("steps") > 50), None, root)
    return (
        sources.published_catalog(spark, root)
        .groupBy("equation", "status")
        .agg(F.count("*").alias("runs"), F.sum("steps").alias("steps"))
    )
