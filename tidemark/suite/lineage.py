"""Queries on lineage, the evidence graph and proposals."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.exprs import canonical
from tidemark.operators import lineage
from tidemark.plans import configs
from tidemark.session import widen
from tidemark.sources import driver_tables as dt
from tidemark.suite import query

METRICS = ("initial_energy", "final_energy", "mass_drift", "needs_review")


@query(
    "lineage_edges",
    dt.with_views("runs")
    + " SELECT parent_id AS source, id AS target, 'parent_of' AS type FROM runs WHERE parent_id IS NOT NULL",
)
def lineage_edges(spark, sf_dir):
    return lineage.lineage_edges(dt.runs(spark, sf_dir))


@query(
    "lineage_nodes",
    dt.with_views("runs")
    + """ SELECT id, status, equation, solver, FALSE AS missing FROM runs
UNION ALL SELECT DISTINCT parent_id, NULL, NULL, NULL, TRUE FROM runs WHERE parent_id IS NOT NULL AND parent_id NOT IN (SELECT id FROM runs)""",
)
def lineage_nodes(spark, sf_dir):
    return lineage.lineage_nodes(dt.runs(spark, sf_dir))


@query(
    "parent_child_metrics",
    dt.with_views("runs")
    + """, m AS (SELECT id, parent_id, unnest(['initial_energy', 'final_energy']) AS metric, unnest([initial_energy, final_energy]) AS v FROM runs)
SELECT c.id, c.parent_id, c.metric, p.v AS before, c.v AS after, round(c.v - p.v, 4) AS change
FROM m c JOIN m p ON c.parent_id = p.id AND c.metric = p.metric WHERE c.v IS NOT NULL AND p.v IS NOT NULL""",
)
def parent_child_metrics(spark, sf_dir):
    out = lineage.parent_child_metrics(dt.runs(spark, sf_dir), ["initial_energy", "final_energy"])
    return out.withColumn("change", F.round("change", 4))


def records(spark, sf_dir):
    return widen(dt.runs(spark, sf_dir)).select(
        "*",
        F.lit("periodic").alias("boundary"),
        F.sha2("solver", 256).alias("source_sha256"),
        canonical(seed="seed", steps="steps").alias("config_json"),
    )


GRAPH_SQL = """, rec AS (SELECT *, sha256(solver) AS source_sha256 FROM runs),
measured AS (SELECT id, unnest(['initial_energy', 'final_energy', 'mass_drift', 'needs_review']) AS name,
  unnest([initial_energy IS NOT NULL, final_energy IS NOT NULL, mass_drift IS NOT NULL, needs_review IS NOT NULL]) AS present FROM rec),
counts AS (
  SELECT 'Experiment' AS type, count(*) AS nodes, CAST(0 AS BIGINT) AS edges, NULL AS link FROM rec
  UNION ALL SELECT 'Equation', count(DISTINCT equation), count(*), 'solves' FROM rec
  UNION ALL SELECT 'Solver', count(DISTINCT solver), count(*), 'uses' FROM rec
  UNION ALL SELECT 'BoundaryCondition', 1, count(*), 'has_boundary' FROM rec
  UNION ALL SELECT 'InitialCondition', count(DISTINCT (equation, grid_size, initial_condition, seed, amplitude, domain_length, source_sha256)), count(*), 'starts_from' FROM rec
  UNION ALL SELECT 'Dataset', count(*), count(*), 'produces' FROM rec WHERE status = 'completed'
  UNION ALL SELECT 'Metric', count(*), count(*), 'measures' FROM measured WHERE present
  UNION ALL SELECT 'Anomaly', count(*), count(*), 'observed_in' FROM rec WHERE status = 'failed' OR needs_review
  UNION ALL SELECT 'Unresolved', count(DISTINCT parent_id), 0, NULL FROM rec WHERE parent_id IS NOT NULL AND parent_id NOT IN (SELECT id FROM rec)
  UNION ALL SELECT NULL, 0, count(*), 'parent_of' FROM rec WHERE parent_id IS NOT NULL)"""


@query(
    "evidence_graph_nodes",
    dt.with_views("runs")
    + GRAPH_SQL
    + " SELECT type, nodes FROM counts WHERE type IS NOT NULL",
)
def evidence_graph_nodes(spark, sf_dir):
    graph = lineage.build_graph(records(spark, sf_dir), None, METRICS)
    return graph["nodes"].groupBy("type").agg(F.count_distinct("id").alias("nodes"))


@query(
    "evidence_graph_edges",
    dt.with_views("runs")
    + GRAPH_SQL
    + " SELECT link AS type, edges FROM counts WHERE link IS NOT NULL",
)
def evidence_graph_edges(spark, sf_dir):
    graph = lineage.build_graph(records(spark, sf_dir), None, METRICS)
    return graph["edges"].groupBy("type").agg(F.count("*").alias("edges"))


@query(
    "equation_node_ids",
    dt.with_views("runs")
    + """ SELECT DISTINCT 'equation-' || substr(sha256('{"name":"' || equation || '"}'), 1, 24) AS id, 'Equation' AS type,
  '{"name":"' || equation || '"}' AS properties FROM runs""",
)
def equation_node_ids(spark, sf_dir):
    return lineage.derived_nodes(records(spark, sf_dir), METRICS).filter(F.col("type") == "Equation")


# -- verified evidence ------------------------------------------------------------

PLAIN_METRICS = ("needs_review", "steps")


def evidence(spark, sf_dir):
    """Run records, manifests, listed and stored artifacts; some of each are damaged or absent."""
    runs = records(spark, sf_dir)
    k = F.col("run_id")
    name = F.concat(F.lit("run-"), k).alias("run_id")
    digest = F.sha2(F.concat("id", F.lit(":"), "config_json"), 256)
    fields = F.sha2("id", 256)
    row = lambda path, sha: F.struct(F.lit(path).alias("path"), sha.alias("sha256"))
    listed = F.array(
        row("record.json", F.when(k % 17 == 0, F.lit("0" * 64)).otherwise(digest)), row("fields/u.bin", fields)
    )
    stored = F.array_compact(
        F.array(
            row("record.json", digest),
            F.when(k % 13 != 0, row("fields/u.bin", fields)),
            F.when(k % 29 == 0, row("scratch.tmp", fields)),
        )
    )
    return {
        "records": runs.filter(k % 37 != 0),
        "manifests": runs.filter(k % 23 != 0).select(name, (k % 31 != 0).alias("valid")),
        "listed": runs.select(name, F.inline(listed)),
        "actual": runs.select(name, F.inline(stored)),
    }


def verified(spark, sf_dir):
    given = evidence(spark, sf_dir)
    return lineage.verified_records(given["records"], lineage.evidence_problems(**given))


@query(
    "evidence_problems",
    dt.with_views("runs")
    + """, p AS (SELECT id AS run_id, unnest([{'path': NULL, 'problem': CASE WHEN run_id % 23 = 0 THEN 'no manifest' END},
    {'path': NULL, 'problem': CASE WHEN run_id % 23 <> 0 AND run_id % 31 = 0 THEN 'invalid manifest' END},
    {'path': NULL, 'problem': CASE WHEN run_id % 23 <> 0 AND run_id % 37 = 0 THEN 'no record' END},
    {'path': 'record.json', 'problem': CASE WHEN run_id % 23 <> 0 AND run_id % 31 <> 0 AND run_id % 17 = 0 THEN 'hash mismatch' END},
    {'path': 'fields/u.bin', 'problem': CASE WHEN run_id % 23 <> 0 AND run_id % 31 <> 0 AND run_id % 13 = 0 THEN 'missing' END},
    {'path': 'scratch.tmp', 'problem': CASE WHEN run_id % 23 <> 0 AND run_id % 31 <> 0 AND run_id % 29 = 0 THEN 'unexpected' END}]) AS x, run_id AS k FROM runs)
SELECT run_id, x.path AS path, x.problem AS problem FROM p
WHERE x.problem IS NOT NULL AND NOT (k % 37 = 0 AND x.problem = 'no manifest')""",
)
def evidence_problems(spark, sf_dir):
    return lineage.evidence_problems(**evidence(spark, sf_dir))


VERIFIED_SQL = """, rec AS (SELECT *, sha256(solver) AS source_sha256 FROM runs WHERE run_id % 23 <> 0 AND run_id % 31 <> 0
    AND run_id % 37 <> 0 AND run_id % 17 <> 0 AND run_id % 13 <> 0 AND run_id % 29 <> 0),
implied AS (
  SELECT id, 'Equation' AS kind, 'solves' AS link, FALSE AS inward, json_object('name', equation)::VARCHAR AS properties FROM rec
  UNION ALL SELECT id, 'Solver', 'uses', FALSE, json_object('name', solver)::VARCHAR FROM rec
  UNION ALL SELECT id, 'BoundaryCondition', 'has_boundary', FALSE, '{"name":"periodic"}' FROM rec
  UNION ALL SELECT id, 'InitialCondition', 'starts_from', FALSE, json_object('amplitude', amplitude, 'domain_length', domain_length,
    'equation', equation, 'generator_source_sha256', source_sha256, 'grid_size', grid_size, 'initial_condition', initial_condition, 'seed', seed)::VARCHAR FROM rec
  UNION ALL SELECT id, 'Dataset', 'produces', FALSE, json_object('experiment_id', id, 'format', 'parquet', 'path', 'experiments/' || id || '/fields')::VARCHAR
    FROM rec WHERE status = 'completed'
  UNION ALL SELECT id, 'Anomaly', 'observed_in', TRUE, json_object('error', error, 'experiment_id', id, 'interpretation', 'Numerical evidence requiring review',
    'kind', CASE status WHEN 'failed' THEN 'computational_failure' ELSE 'sampled_diagnostic_flag' END, 'metrics', NULL)::VARCHAR
    FROM rec WHERE status = 'failed' OR needs_review
  UNION ALL SELECT id, 'Metric', 'measures', TRUE, json_object('experiment_id', id, 'name', 'needs_review', 'value', needs_review::VARCHAR)::VARCHAR
    FROM rec WHERE needs_review IS NOT NULL
  UNION ALL SELECT id, 'Metric', 'measures', TRUE, json_object('experiment_id', id, 'name', 'steps', 'value', steps::VARCHAR)::VARCHAR FROM rec),
placed AS (SELECT *, lower(kind) || '-' || substr(sha256(properties), 1, 24) AS node FROM implied)"""


@query(
    "verified_graph_nodes",
    dt.with_views("runs")
    + VERIFIED_SQL
    + """ SELECT id, 'Experiment' AS type, json_object('config', json_object('seed', seed, 'steps', steps)::VARCHAR, 'created_at', created_at,
  'provenance', NULL, 'status', status)::VARCHAR AS properties FROM rec
UNION ALL SELECT DISTINCT node, kind, properties FROM placed
UNION ALL SELECT DISTINCT parent_id, 'Unresolved', '{}' FROM rec WHERE parent_id IS NOT NULL AND parent_id NOT IN (SELECT id FROM rec)""",
)
def verified_graph_nodes(spark, sf_dir):
    """Nodes of the graph that starts from verified runs alone, row by row."""
    return lineage.build_graph(verified(spark, sf_dir), None, PLAIN_METRICS)["nodes"]


@query(
    "verified_graph_edges",
    dt.with_views("runs")
    + VERIFIED_SQL
    + """ SELECT parent_id AS source, 'parent_of' AS type, id AS target FROM rec WHERE parent_id IS NOT NULL
UNION ALL SELECT CASE WHEN inward THEN node ELSE id END, link, CASE WHEN inward THEN id ELSE node END FROM placed""",
)
def verified_graph_edges(spark, sf_dir):
    return lineage.build_graph(verified(spark, sf_dir), None, PLAIN_METRICS)["edges"]


@query(
    "merged_nodes",
    """SELECT 'n-' || o_orderkey AS id, CASE WHEN o_orderkey % 4 = 0 THEN 'Finding' ELSE 'Experiment' END AS type,
  CASE WHEN o_orderkey % 4 = 0 THEN 'asserted' ELSE o_orderstatus END AS properties FROM orders""",
)
def merged_nodes(spark, sf_dir):
    o = dt.table(spark, sf_dir, "orders")
    key = F.concat(F.lit("n-"), "o_orderkey").alias("id")
    derived = o.select(key, F.lit("Experiment").alias("type"), F.col("o_orderstatus").alias("properties"))
    asserted = o.filter(F.col("o_orderkey") % 4 == 0).select(
        key, F.lit("Finding").alias("type"), F.lit("asserted").alias("properties")
    )
    return lineage.merge_nodes(derived, asserted)


@query(
    "unresolved_nodes",
    dt.with_views("runs")
    + """ SELECT DISTINCT parent_id AS id, 'Unresolved' AS type, '{}' AS properties FROM runs
WHERE parent_id IS NOT NULL AND parent_id NOT IN (SELECT id FROM runs)""",
)
def unresolved_nodes(spark, sf_dir):
    runs = dt.runs(spark, sf_dir)
    return lineage.unresolved_nodes(runs.select("id"), lineage.lineage_edges(runs))


def entities(spark, sf_dir):
    """One assertion per document: hypotheses, findings and unsupported kinds."""
    d = dt.table(spark, sf_dir, "documents")
    k = F.col("doc_id")
    kind = F.when(k % 7 == 0, "Opinion").when(k % 2 == 0, "Finding").otherwise("Hypothesis")
    statement = F.when(k % 11 != 0, F.concat(F.lit("from "), "source", F.lit(" "), k % 100))
    link = lambda t, target: F.struct(t.alias("type"), target.alias("target"))
    links = F.when(
        k % 5 != 0,
        F.array(
            link(
                F.when(k % 13 == 0, "likes").otherwise("cites"),
                F.concat(F.lit("run-"), k % 100),
            )
        ),
    )
    return d.select(
        k.alias("doc_id"), kind.alias("type"), canonical(statement=statement).alias("properties"), links.alias("links")
    )


ENTITY_SQL = """WITH e AS (SELECT doc_id, source, CASE WHEN doc_id % 7 = 0 THEN 'Opinion' WHEN doc_id % 2 = 0 THEN 'Finding' ELSE 'Hypothesis' END AS type FROM documents),
tagged AS (SELECT *, array_to_string(list_filter([CASE WHEN doc_id % 7 = 0 THEN 'unknown type' END,
  CASE WHEN doc_id % 5 <> 0 AND doc_id % 13 = 0 THEN 'unsupported link' END,
  CASE WHEN type <> 'Opinion' AND doc_id % 11 = 0 THEN 'statement required' END,
  CASE WHEN type = 'Finding' AND (doc_id % 5 = 0 OR doc_id % 13 = 0) THEN 'finding must cite evidence' END], lambda r: r IS NOT NULL), ',') AS reasons FROM e)"""


@query("entity_checks", ENTITY_SQL + " SELECT doc_id, type, reasons FROM tagged")
def entity_checks(spark, sf_dir):
    out = lineage.check_entities(entities(spark, sf_dir))
    return out.select("doc_id", "type", F.concat_ws(",", "reasons").alias("reasons"))


@query(
    "entity_registration",
    ENTITY_SQL
    + """, shaped AS (SELECT DISTINCT type, json_object('statement', 'from ' || source || ' ' || doc_id % 100)::VARCHAR AS properties,
    CASE WHEN doc_id % 5 = 0 THEN '[]' ELSE '[{"type":"cites","target":"run-' || doc_id % 100 || '"}]' END AS links, doc_id % 4 = 1 AS known
  FROM tagged WHERE reasons = '')
SELECT DISTINCT lower(type) || '-' || substr(sha256('{"links":' || links || ',"properties":' || to_json(properties) || '}'), 1, 24) AS id, type, properties, links
FROM shaped s WHERE NOT EXISTS (SELECT 1 FROM shaped k WHERE k.known AND k.type = s.type AND k.properties = s.properties AND k.links = s.links)""",
)
def entity_registration(spark, sf_dir):
    given = entities(spark, sf_dir)
    existing = lineage.check_entities(given.filter(F.col("doc_id") % 4 == 1)).filter(
        F.size("reasons") == 0
    )
    new = lineage.register_entities(given, existing)
    return new.select("id", "type", "properties", F.to_json("links").alias("links"))


@query(
    "entity_checksums",
    "SELECT doc_id AS id, 'checksum mismatch' AS problem FROM documents WHERE doc_id % 9 = 0",
)
def entity_checksums(spark, sf_dir):
    stored = dt.table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"),
        F.col("text"),
        F.sha2(
            F.concat("text", F.when(F.col("doc_id") % 9 == 0, F.lit("!")).otherwise(F.lit(""))), 256
        ).alias("sha256"),
    )
    return lineage.entity_checksums(stored)


@query(
    "model_links",
    """SELECT 'model-' || o_orderkey AS source, 'trained_on' AS type, 'dataset-' || o_custkey AS target FROM orders WHERE o_custkey % 5 <> 0
UNION ALL SELECT 'checkpoint-' || o_orderkey, 'belongs_to', 'model-' || o_orderkey FROM orders WHERE o_orderkey % 3 = 0""",
)
def model_links(spark, sf_dir):
    o = dt.table(spark, sf_dir, "orders")
    digest = lambda c: F.sha2(F.col(c).cast("string"), 256)
    models = o.select(
        F.concat(F.lit("model-"), "o_orderkey").alias("model_id"),
        digest("o_custkey").alias("dataset_sha256"),
        digest("o_orderkey").alias("checkpoint_sha256"),
    )
    customers = dt.table(spark, sf_dir, "customer").filter(F.col("c_custkey") % 5 != 0)
    datasets = customers.select(
        F.concat(F.lit("dataset-"), "c_custkey").alias("dataset_id"),
        digest("c_custkey").alias("dataset_sha256"),
    )
    checkpoints = o.filter(F.col("o_orderkey") % 3 == 0).select(
        F.concat(F.lit("checkpoint-"), "o_orderkey").alias("checkpoint_id"),
        digest("o_orderkey").alias("checkpoint_sha256"),
    )
    return lineage.model_links(models, datasets, checkpoints)


@query(
    "evidence_priority",
    dt.with_views("runs")
    + """ SELECT id, status, needs_review FROM runs ORDER BY status <> 'failed', NOT coalesce(needs_review, FALSE), id LIMIT 100""",
)
def evidence_priority(spark, sf_dir):
    runs = dt.runs(spark, sf_dir).select("id", "status", "needs_review")
    return lineage.evidence_priority(runs, 100)


@query(
    "refinement_candidates",
    dt.with_views("runs")
    + """ SELECT id, CASE WHEN equation = 'darcy2d' THEN 2 * (grid_size - 1) + 1 ELSE grid_size END AS new_grid_size,
  CASE WHEN equation <> 'darcy2d' THEN dt / 2 END AS new_dt, CASE WHEN equation <> 'darcy2d' THEN steps * 2 END AS new_steps,
  CASE WHEN equation <> 'darcy2d' THEN save_every * 2 END AS new_save_every, CASE WHEN equation = 'darcy2d' THEN 1 ELSE 2 * steps END AS cost FROM runs""",
)
def refinement_candidates(spark, sf_dir):
    return lineage.refine(dt.runs(spark, sf_dir)).select(
        "id", "new_grid_size", "new_dt", "new_steps", "new_save_every", "cost"
    )


def configured_runs(spark, sf_dir):
    """Runs with their normalised configuration, and refinements of some that were tried before.

    Every nineteenth steady run has a grid that cannot be refined. Of the earlier refinements half
    have exactly the refined configuration, the others another seed or contrast.
    """
    runs = widen(dt.runs(spark, sf_dir))
    k = F.col("run_id")
    steady = F.col("equation") == "darcy2d"
    base = runs.select(
        "id", "run_id", "status", "needs_review", "parent_id", "equation", "viscosity", "dt", "steps", "save_every",
        "seed", "amplitude", "domain_length",
        F.when(steady & (k % 19 == 0), 400).otherwise(F.col("grid_size")).alias("grid_size"),
        F.when(k % 2 == 0, "random").alias("initial_condition"),
        F.lit(None).cast("double").alias("contrast"),
    )
    tried = base.filter((k % 6 == 0) & (F.col("status") != "queued")).select(
        F.concat(F.lit("child-"), k).alias("id"), k.alias("run_id"), F.lit("queued").alias("status"),
        F.lit(None).cast("boolean").alias("needs_review"), F.col("id").alias("parent_id"), "equation", "viscosity",
        (F.col("dt") / 2).alias("dt"), (F.col("steps") * 2).alias("steps"), (F.col("save_every") * 2).alias("save_every"),
        F.when(k % 12 == 0, F.col("seed")).otherwise(F.col("seed") + 1).alias("seed"), "amplitude", "domain_length",
        F.when(steady, 2 * (F.col("grid_size") - 1) + 1).otherwise(F.col("grid_size")).alias("grid_size"),
        "initial_condition", F.when(k % 12 != 0, 0.25).alias("contrast"),
    )
    every = base.unionByName(tried)
    usual = F.when(F.col("equation") == "burgers1d", "sine").otherwise("taylor_green")
    start = F.coalesce("initial_condition", usual)
    moving = {"viscosity": "viscosity", "dt": "dt", "steps": "steps", "save_every": "save_every", "seed": "seed",
              "amplitude": "amplitude", "initial_condition": start}
    # Records hold normalised configurations: all keys of their equation and no others.
    config = F.struct(
        "equation", "grid_size", "domain_length",
        *[F.when(~steady, F.col(c) if isinstance(c, str) else c).alias(name) for name, c in moving.items()],
        F.when(steady, F.coalesce("contrast", F.lit(0.5))).alias("contrast"),
    )
    return every.select("id", "run_id", "status", "needs_review", "parent_id", config.alias("config"))


def candidates(spark, sf_dir):
    """Finished runs; some refinements are invalid and some exist already."""
    runs = configured_runs(spark, sf_dir)
    refined = lineage.refine_configs(runs.filter(F.col("status") != "queued"))
    children = runs.select("parent_id", configs.config_key().alias("config_key"))
    return lineage.already_refined(refined, children)


def _config_sql(dt: str, steps: str, every: str, grid: str) -> str:
    return f"""CASE WHEN equation = 'darcy2d'
    THEN '{{"contrast":' || contrast || ',"domain_length":1.0,"equation":"darcy2d","grid_size":' || {grid} || '}}'
    ELSE '{{"amplitude":' || amplitude || ',"domain_length":1.0,"dt":' || CASE WHEN {dt} < 0.001 THEN round({dt} * 10000, 6) || 'E-4' ELSE ({dt})::VARCHAR END
      || ',"equation":"' || equation || '","grid_size":' || grid_size || ',"initial_condition":"' || ic || '","save_every":' || {every}
      || ',"seed":' || seed || ',"steps":' || {steps} || ',"viscosity":' || viscosity || '}}' END"""


CANDIDATE_SQL = f""", base AS (SELECT * REPLACE (CASE WHEN equation = 'darcy2d' AND run_id % 19 = 0 THEN 400 ELSE grid_size END AS grid_size),
    CASE WHEN run_id % 2 = 0 THEN 'random' WHEN equation = 'burgers1d' THEN 'sine' ELSE 'taylor_green' END AS ic, 0.5::DOUBLE AS contrast FROM runs),
tried AS (SELECT * REPLACE ('child-' || run_id AS id, id AS parent_id, dt / 2 AS dt, steps * 2 AS steps, save_every * 2 AS save_every,
    CASE WHEN run_id % 12 = 0 THEN seed ELSE seed + 1 END AS seed, CASE WHEN run_id % 12 = 0 THEN contrast ELSE 0.25 END AS contrast,
    CASE WHEN equation = 'darcy2d' THEN 2 * (grid_size - 1) + 1 ELSE grid_size END AS grid_size)
  FROM base WHERE run_id % 6 = 0 AND status <> 'queued'),
children AS (SELECT parent_id, {_config_sql("dt", "steps", "save_every", "grid_size")} AS cfg FROM (SELECT * FROM base UNION ALL SELECT * FROM tried) WHERE parent_id IS NOT NULL),
cand AS (SELECT id, status, needs_review, equation, dt, steps, save_every, grid_size, cost, invalid, CASE WHEN invalid IS NULL THEN cfg END AS cfg,
    invalid IS NULL AND EXISTS (SELECT 1 FROM children c WHERE c.parent_id = r.id AND c.cfg = r.cfg) AS has_child
  FROM (SELECT *, CASE WHEN equation = 'darcy2d' THEN 1 ELSE 2 * steps END AS cost,
      CASE WHEN equation = 'darcy2d' AND 2 * (grid_size - 1) + 1 > 513 THEN 'grid_size' END AS invalid,
      {_config_sql("dt / 2", "steps * 2", "save_every * 2", "(2 * (grid_size - 1) + 1)")} AS cfg FROM base WHERE status <> 'queued') r),
placed AS (SELECT *, row_number() OVER (ORDER BY status <> 'failed', NOT coalesce(needs_review, FALSE), id) AS pos FROM cand),
picks AS (SELECT CAST(-1 AS BIGINT) AS n, CAST(0 AS BIGINT) AS pos, CAST(0 AS BIGINT) AS used
  UNION ALL SELECT n + 1, nxt.pos, used + nxt.cost FROM picks, LATERAL (SELECT p.pos, p.cost FROM placed p
    WHERE p.pos > picks.pos AND p.invalid IS NULL AND NOT p.has_child AND picks.used + p.cost <= 1500 ORDER BY p.pos LIMIT 1) nxt WHERE n + 1 < 12)"""


@query(
    "refined_configs",
    dt.with_views("runs", recursive=True)
    + CANDIDATE_SQL
    + """ SELECT id, cfg AS candidate_json, sha256(cfg) AS config_key, invalid, cost, CASE WHEN invalid IS NOT NULL THEN NULL
    WHEN equation = 'darcy2d' THEN '{"grid_size":{"before":' || grid_size || ',"after":' || 2 * (grid_size - 1) + 1 || '}}'
    ELSE '{"dt":{"before":' || dt || ',"after":' || CASE WHEN dt / 2 < 0.001 THEN round(dt * 5000, 6) || 'E-4' ELSE (dt / 2)::VARCHAR END
      || '},"save_every":{"before":' || save_every || ',"after":' || save_every * 2 || '},"steps":{"before":' || steps || ',"after":' || steps * 2 || '}}' END AS changes
FROM cand""",
)
def refined_configs(spark, sf_dir):
    """Normalised refinement of every finished run, its identity and what it changes."""
    return candidates(spark, sf_dir).select("id", "candidate_json", "config_key", "invalid", "cost", "changes")


@query(
    "existing_children",
    dt.with_views("runs", recursive=True) + CANDIDATE_SQL + " SELECT id, has_child FROM cand",
)
def existing_children(spark, sf_dir):
    return candidates(spark, sf_dir).select("id", "has_child")


@query(
    "budgeted_proposals",
    dt.with_views("runs", recursive=True)
    + CANDIDATE_SQL
    + " SELECT k.n AS position, p.id, p.cost, k.used AS planned_steps FROM picks k JOIN placed p ON k.pos = p.pos WHERE k.n >= 0",
)
def budgeted_proposals(spark, sf_dir):
    return lineage.select_proposals(candidates(spark, sf_dir), max_runs=12, max_total_steps=1500)[
        "proposals"
    ]


@query(
    "skipped_proposals",
    dt.with_views("runs", recursive=True)
    + CANDIDATE_SQL
    + """, state AS (SELECT p.*, (SELECT max(k.used) FROM picks k WHERE k.pos < p.pos) AS used FROM placed p
  WHERE p.pos NOT IN (SELECT pos FROM picks) AND ((SELECT max(n) FROM picks) < 11 OR p.pos < (SELECT max(pos) FROM picks)))
SELECT id AS parent_id, coalesce(invalid, 'total step budget') AS reason FROM state
WHERE invalid IS NOT NULL OR (NOT has_child AND used + cost > 1500)""",
)
def skipped_proposals(spark, sf_dir):
    return lineage.select_proposals(candidates(spark, sf_dir), max_runs=12, max_total_steps=1500)[
        "skipped"
    ]


PROPOSAL_SQL = """, chosen AS (SELECT p.*, CASE WHEN equation = 'darcy2d' THEN 'Refine Darcy spacing to check manufactured-solution error reduction'
      ELSE 'Halve timestep at the same physical duration and saved times' END AS rationale,
    CASE WHEN equation = 'darcy2d' THEN '{"grid_size":{"before":' || grid_size || ',"after":' || 2 * (grid_size - 1) + 1 || '}}'
    ELSE '{"dt":{"before":' || dt || ',"after":' || CASE WHEN dt / 2 < 0.001 THEN round(dt * 5000, 6) || 'E-4' ELSE (dt / 2)::VARCHAR END
      || '},"save_every":{"before":' || save_every || ',"after":' || save_every * 2 || '},"steps":{"before":' || steps || ',"after":' || steps * 2 || '}}' END AS changes
  FROM picks k JOIN placed p ON k.pos = p.pos WHERE k.n >= 0),
hyp AS (SELECT *, '[{"type":"cites","target":"' || id || '"}]' AS hyp_links,
    json_object('criterion', 'Compare matched diagnostics and reference error', 'policy', 'refinement-v1', 'statement', rationale, 'status', 'untested')::VARCHAR AS hyp_properties FROM chosen),
hyps AS (SELECT *, 'hypothesis-' || substr(sha256('{"links":' || hyp_links || ',"properties":' || to_json(hyp_properties) || '}'), 1, 24) AS hypothesis_id FROM hyp),
props AS (SELECT *, '[{"type":"cites","target":"' || id || '"},{"type":"tests","target":"' || hypothesis_id || '"}]' AS links,
    json_object('changed_parameters', changes, 'config', cfg, 'estimated_steps', cost, 'hypothesis_id', hypothesis_id, 'parent_id', id,
      'policy', 'refinement-v1', 'rationale', rationale)::VARCHAR AS properties FROM hyps)
SELECT hypothesis_id AS id, 'Hypothesis' AS type, hyp_properties AS properties, hyp_links AS links, '' AS reasons FROM props
UNION ALL SELECT 'proposal-' || substr(sha256('{"links":' || links || ',"properties":' || to_json(properties) || '}'), 1, 24), 'Proposal', properties, links, '' FROM props"""


@query("proposal_entities", dt.with_views("runs", recursive=True) + CANDIDATE_SQL + PROPOSAL_SQL)
def proposal_entities(spark, sf_dir):
    """Hypotheses and proposals for the chosen refinements, row by row."""
    given = candidates(spark, sf_dir)
    chosen = lineage.select_proposals(given, max_runs=12, max_total_steps=1500)["proposals"]
    rows = given.join(F.broadcast(chosen.select("id")), "id")  # at most 12 ids
    rows = rows.select("id", "rationale", "cost", F.col("candidate_json").alias("config"), "changes")
    return lineage.proposal_entities(rows).select(
        "id", "type", "properties", F.to_json("links").alias("links"), F.concat_ws(",", "reasons").alias("reasons")
    )


@query(
    "finding_entities",
    dt.with_views("runs")
    + """, f AS (SELECT '[{"type":"cites","target":"' || id || '"},{"type":"tests","target":"hypothesis-' || run_id || '"}]' AS links,
  json_object('error', error, 'interpretation', 'Observation only; no automatic scientific judgment',
    'metrics', CASE WHEN needs_review IS NULL THEN '{}' ELSE '{"needs_review":' || needs_review || '}' END, 'proposal_id', 'proposal-' || run_id,
    'statement', 'Refinement ' || id || ' ended as ' || status)::VARCHAR AS properties FROM runs WHERE parent_id IS NOT NULL)
SELECT 'finding-' || substr(sha256('{"links":' || links || ',"properties":' || to_json(properties) || '}'), 1, 24) AS id,
  properties, links FROM f""",
)
def finding_entities(spark, sf_dir):
    """Findings of executed refinements with their metrics and errors, row by row."""
    outcomes = dt.runs(spark, sf_dir).filter(F.col("parent_id").isNotNull())
    out = lineage.finding_entities(
        outcomes.select(
            "id",
            "status",
            "error",
            F.to_json(F.struct("needs_review")).alias("metrics_json"),
            F.concat(F.lit("proposal-"), "run_id").alias("proposal_id"),
            F.concat(F.lit("hypothesis-"), "run_id").alias("hypothesis_id"),
        )
    )
    return out.filter(F.size("reasons") == 0).select("id", "properties", F.to_json("links").alias("links"))
