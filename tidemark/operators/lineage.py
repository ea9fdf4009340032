"""Lineage, evidence graph, entity registration and follow-up proposals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.exprs import canonical, is_safe_id, reasons
from tidemark.operators.integrity import artifact_problems, manifest_problems
from tidemark.plans.configs import STEADY, change_problems, config_json, config_key
from tidemark.session import settle, store

# Entity and link types of the evidence graph, and texts and limits of the
# proposal policy.
ENTITY_TYPES = (
    "Equation",
    "Solver",
    "Experiment",
    "InitialCondition",
    "BoundaryCondition",
    "Dataset",
    "Model",
    "Checkpoint",
    "Metric",
    "Anomaly",
    "Hypothesis",
    "Finding",
    "Proposal",
)
LINK_TYPES = (
    "solves",
    "uses",
    "starts_from",
    "has_boundary",
    "produces",
    "trained_on",
    "belongs_to",
    "measures",
    "observed_in",
    "cites",
    "supports",
    "contradicts",
    "parent_of",
    "tests",
)
GRAPH_SCHEMA_VERSION = 1
POLICY = "refinement-v1"
CRITERION = "Compare matched diagnostics and reference error"
RATIONALE_STEADY = "Refine Darcy spacing to check manufactured-solution error reduction"
RATIONALE_UNSTEADY = "Halve timestep at the same physical duration and saved times"
ANOMALY_NOTE = "Numerical evidence requiring review"
FINDING_NOTE = "Observation only; no automatic scientific judgment"
MAX_PROPOSALS = 32
MAX_PROPOSED_STEPS = 100_000


# -- lineage ----------------------------------------------------------------------


def lineage_edges(catalog: DataFrame) -> DataFrame:
    return catalog.filter(F.col("parent_id").isNotNull() & (F.col("parent_id") != "")).select(
        F.col("parent_id").alias("source"),
        F.col("id").alias("target"),
        F.lit("parent_of").alias("type"),
    )


def lineage_nodes(catalog: DataFrame) -> DataFrame:
    """All runs, and a placeholder for every parent that is not in the catalog."""
    known = catalog.select(
        "id", "status", "equation", "solver", F.lit(False).alias("missing")
    )
    absent = (
        lineage_edges(catalog)
        .select(F.col("source").alias("id"))
        .distinct()
        .join(catalog.select("id"), "id", "left_anti")
        .withColumn("missing", F.lit(True))
    )
    return known.unionByName(absent, allowMissingColumns=True)


def parent_child_metrics(catalog: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Matched metrics of a run and the run it refines, one row per metric."""
    child = catalog.filter(F.col("parent_id").isNotNull()).select("id", "parent_id", *metrics)
    parent = catalog.select(
        F.col("id").alias("parent_id"), *[F.col(m).alias(f"_p_{m}") for m in metrics]
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(m).alias("metric"),
                F.col(f"_p_{m}").cast("double").alias("before"),
                F.col(m).cast("double").alias("after"),
            )
            for m in metrics
        ]
    )
    return (
        child.join(parent, "parent_id")
        .select("id", "parent_id", F.inline(rows))
        .filter(F.col("before").isNotNull() & F.col("after").isNotNull())
        .withColumn("change", F.col("after") - F.col("before"))
    )


# -- verified evidence ------------------------------------------------------------


class UnverifiedEvidence(ValueError):
    """Some run record or artifact is not what its manifest says."""


def evidence_problems(records: DataFrame, manifests: DataFrame, listed: DataFrame, actual: DataFrame) -> DataFrame:
    """``(run_id, path, problem)``: everything that keeps a run from being evidence.

    ``manifests``: ``run_id, valid`` for each run; ``listed`` and ``actual``: ``run_id, path,
    sha256`` of artifacts, the record's own among them. Every record needs a valid manifest with
    which all its stored artifacts agree, and every manifest a record with its run's id.
    """
    run = records.select(F.col("id").alias("run_id"))
    usable = manifests.filter(F.col("valid")).select("run_id")
    about = lambda df: df.join(usable, "run_id", "left_semi")
    alone = lambda df, text: df.select(
        "run_id", F.lit(None).cast("string").alias("path"), F.lit(text).alias("problem")
    )
    return (
        artifact_problems(about(listed), about(actual))
        .unionByName(manifest_problems(manifests))
        .unionByName(alone(run.join(manifests, "run_id", "left_anti"), "no manifest"))
        .unionByName(alone(manifests.join(run, "run_id", "left_anti"), "no record"))
        .unionByName(alone(run.filter(~is_safe_id("run_id")), "unsafe id"))
    )


def verified_records(records: DataFrame, problems: DataFrame, strict: bool = False) -> DataFrame:
    """The records that graph and proposals may start from: those without a problem.

    ``strict`` refuses all evidence as soon as any of it has a problem.
    """
    if strict:
        first = problems.select("run_id", "problem").first()
        if first is not None:
            raise UnverifiedEvidence(f"Evidence failed verification: {first['run_id']}: {first['problem']}")
    bad = problems.select(F.col("run_id").alias("id")).distinct()
    return records.join(bad, "id", "left_anti")


# -- evidence graph ---------------------------------------------------------------


def _entry(
    kind: str, link: str, properties: Column, present: Column | None = None, inward: bool = False
) -> Column:
    """One node that a run record implies, with its link to the run; NULL when absent."""
    entry = F.struct(
        F.lit(kind).alias("kind"),
        F.lit(link).alias("link"),
        F.lit(inward).alias("inward"),
        properties.alias("properties"),
    )
    return entry if present is None else F.when(present, entry)


def implied_entries(records: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """``id, kind, link, inward, properties`` of everything the run records imply.

    All kinds come out of one scan: every record carries its own small array of entries.
    ``records``: catalog columns with ``boundary, initial_condition, amplitude, domain_length,
    source_sha256``; columns that a lake does not have count as NULL.
    """
    have = lambda c: F.col(c) if c in records.columns else F.lit(None).cast("string")
    failed = F.col("status") == "failed"
    flagged = F.coalesce(F.col("needs_review"), F.lit(False))
    entries = [
        _entry("Equation", "solves", canonical(name="equation")),
        _entry("Solver", "uses", canonical(name="solver")),
        _entry(
            "BoundaryCondition",
            "has_boundary",
            canonical(name=F.coalesce("boundary", F.lit("unknown"))),
        ),
        _entry(
            "InitialCondition",
            "starts_from",
            canonical(
                equation="equation",
                grid_size="grid_size",
                initial_condition="initial_condition",
                seed="seed",
                amplitude=have("amplitude"),
                domain_length=have("domain_length"),
                generator_source_sha256="source_sha256",
            ),
            F.col("initial_condition").isNotNull(),
        ),
        _entry(
            "Dataset",
            "produces",
            canonical(
                experiment_id="id",
                format=F.lit("parquet"),
                path=F.concat(F.lit("experiments/"), "id", F.lit("/fields")),
            ),
            F.col("status") == "completed",
        ),
        _entry(
            "Anomaly",
            "observed_in",
            canonical(
                experiment_id="id",
                kind=F.when(failed, "computational_failure").otherwise("sampled_diagnostic_flag"),
                error="error",
                metrics=have("metrics_json"),
                interpretation=F.lit(ANOMALY_NOTE),
            ),
            failed | flagged,
            inward=True,
        ),
        *[
            _entry(
                "Metric",
                "measures",
                canonical(experiment_id="id", name=F.lit(m), value=F.col(m).cast("string")),
                F.col(m).isNotNull(),
                inward=True,
            )
            for m in metrics
        ],
    ]
    return records.select("id", F.inline(F.array_compact(F.array(*entries))))


def _entry_id() -> Column:
    return F.concat(
        F.lower("kind"), F.lit("-"), F.substring(F.sha2("properties", 256), 1, 24)
    )


def derived_nodes(records: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Nodes that follow from run records.

    Few distinct values stand behind many runs, so equal entries are combined before the
    shuffle and before their ids are computed.
    """
    provenance = (
        F.col("provenance_json") if "provenance_json" in records.columns else F.lit(None).cast("string")
    )
    runs = records.select(
        "id",
        F.lit("Experiment").alias("type"),
        canonical(
            status="status", created_at="created_at", config="config_json", provenance=provenance
        ).alias("properties"),
    )
    implied = implied_entries(records, metrics).select("kind", "properties").distinct()
    return runs.unionByName(
        implied.select(_entry_id().alias("id"), F.col("kind").alias("type"), "properties")
    )


def derived_edges(records: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Edges that follow from run records; repeated edges are kept."""
    inward = F.col("inward")
    implied = implied_entries(records, metrics).withColumn("_node", _entry_id())
    return (
        lineage_edges(records)
        .select("source", "type", "target")
        .unionByName(
            implied.select(
                F.when(inward, F.col("_node")).otherwise(F.col("id")).alias("source"),
                F.col("link").alias("type"),
                F.when(inward, F.col("id")).otherwise(F.col("_node")).alias("target"),
            )
        )
    )


def merge_nodes(*layers: DataFrame) -> DataFrame:
    """Union of node tables; for an id in several the last table wins."""
    ranked = None
    for rank, layer in enumerate(layers):
        rows = layer.select("id", "type", "properties", F.lit(rank).alias("_rank"))
        ranked = rows if ranked is None else ranked.unionByName(rows)
    best = F.max_by(F.struct("type", "properties"), "_rank")
    return ranked.groupBy("id").agg(best.alias("_n")).select("id", "_n.type", "_n.properties")


def unresolved_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edge endpoints that are no node."""
    ends = edges.select(F.explode(F.array("source", "target")).alias("id")).distinct()
    return ends.join(nodes.select("id"), "id", "left_anti").select(
        "id", F.lit("Unresolved").alias("type"), F.lit("{}").alias("properties")
    )


def build_graph(
    records: DataFrame, entities: DataFrame | None, metrics: Sequence[str]
) -> dict[str, DataFrame]:
    """Nodes and edges of the evidence graph: derived, asserted, then unresolved.

    A derived edge ends in the node derived with it. Only parents and asserted links can point
    at nothing, so only those are looked up.
    """
    nodes, edges = derived_nodes(records, metrics), derived_edges(records, metrics)
    open_edges, known = lineage_edges(records), records.select("id")
    if entities is not None:
        nodes = merge_nodes(nodes, entities)
        asserted = entity_edges(entities)
        edges = edges.unionByName(asserted)
        open_edges, known = open_edges.select("source", "type", "target").unionByName(asserted), nodes
    return {"nodes": nodes.unionByName(unresolved_nodes(known, open_edges)), "edges": edges}


# -- entities ---------------------------------------------------------------------


def check_entities(entities: DataFrame) -> DataFrame:
    """Adds ``id`` and ``reasons`` to ``type, properties, links ARRAY<STRUCT<type,target>>``."""
    links = F.coalesce("links", F.array().cast("array<struct<type:string,target:string>>"))
    statement = F.get_json_object("properties", "$.statement")
    needs_statement = F.col("type").isin("Hypothesis", "Finding")
    tagged = entities.withColumn("links", links).withColumn(
        "reasons",
        reasons(
            (F.col("type").isin(*ENTITY_TYPES), "unknown type"),
            (F.get_json_object("properties", "$").startswith("{"), "invalid properties"),
            (
                F.forall(
                    "links",
                    lambda x: F.coalesce(
                        x["type"].isin(*LINK_TYPES) & (F.length(x["target"]) > 0), F.lit(False)
                    ),
                ),
                "unsupported link",
            ),
            (~needs_statement | (F.length(statement) > 0), "statement required"),
            (
                (F.col("type") != "Finding")
                | F.exists("links", lambda x: x["type"] == "cites"),
                "finding must cite evidence",
            ),
        ),
    )
    text = F.to_json(F.struct("links", "properties"))
    return tagged.withColumn(
        "id", F.concat(F.lower("type"), F.lit("-"), F.substring(F.sha2(text, 256), 1, 24))
    )


def register_entities(entities: DataFrame, existing: DataFrame) -> DataFrame:
    """Valid entities that are not registered yet; identical ones share an id."""
    valid = check_entities(entities).filter(F.size("reasons") == 0)
    return (
        valid.dropDuplicates(["id"])
        .join(existing.select("id"), "id", "left_anti")
        .select("id", "type", "properties", "links")
    )


def entity_edges(entities: DataFrame) -> DataFrame:
    return entities.select(F.col("id").alias("source"), F.inline("links")).select(
        "source", "type", "target"
    )


def entity_checksums(stored: DataFrame) -> DataFrame:
    """Entities whose stored text no longer has its recorded digest."""
    return stored.filter(~F.sha2("text", 256).eqNullSafe(F.col("sha256"))).select(
        "id", F.lit("checksum mismatch").alias("problem")
    )


def model_links(models: DataFrame, datasets: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """Edges model -> dataset and checkpoint -> model, matched on content digests."""
    trained = models.join(datasets, "dataset_sha256").select(
        F.col("model_id").alias("source"),
        F.lit("trained_on").alias("type"),
        F.col("dataset_id").alias("target"),
    )
    belongs = checkpoints.join(models, "checkpoint_sha256").select(
        F.col("checkpoint_id").alias("source"),
        F.lit("belongs_to").alias("type"),
        F.col("model_id").alias("target"),
    )
    return trained.unionByName(belongs)


# -- proposals --------------------------------------------------------------------


def refine(runs: DataFrame) -> DataFrame:
    """The refined configuration of every run and its cost in steps.

    Unsteady runs halve the step at the same duration and saved times; steady runs halve the
    spacing and cost one step.
    """
    steady = F.col("equation") == "darcy2d"
    return runs.withColumns(
        {
            "new_grid_size": F.when(steady, 2 * (F.col("grid_size") - 1) + 1).otherwise(
                F.col("grid_size")
            ),
            "new_dt": F.when(~steady, F.col("dt") / 2),
            "new_steps": F.when(~steady, F.col("steps") * 2),
            "new_save_every": F.when(~steady, F.col("save_every") * 2),
            "cost": F.when(steady, 1).otherwise(F.col("steps") * 2).cast("long"),
            "rationale": F.when(steady, RATIONALE_STEADY).otherwise(RATIONALE_UNSTEADY),
        }
    )


def refine_configs(runs: DataFrame) -> DataFrame:
    """Refined, normalised configurations of runs with a normalised ``config``.

    Adds ``candidate`` and ``candidate_json``, its identity ``config_key``, the reasons for which it
    is ``invalid`` (comma-separated, else null), ``changes`` (JSON text ``{key: {before, after}}``),
    ``cost`` in steps and ``rationale``. An invalid candidate has neither key nor changes.
    """
    c = F.col("config")
    steady = c["equation"] == STEADY
    double = lambda name: F.try_multiply(c[name], F.lit(2).cast("long"))
    finer = {
        "grid_size": F.when(steady, F.try_subtract(double("grid_size"), F.lit(1))).otherwise(c["grid_size"]),
        "dt": F.when(~steady, c["dt"] / 2),
        "steps": F.when(~steady, double("steps")),
        "save_every": F.when(~steady, double("save_every")),
    }
    candidate = c
    for name, value in finer.items():
        candidate = candidate.withField(name, value)
    # Stored, because every column below would repeat how the candidate is made.
    out = store(runs.withColumn("candidate", candidate))
    out = out.withColumn("_why", change_problems(F.col("candidate")))
    after = F.col("candidate")
    changed = [
        F.when(
            ~c[name].eqNullSafe(after[name]),
            F.concat(
                F.lit(f'"{name}":{{"before":'), c[name].cast("string"), F.lit(',"after":'), after[name].cast("string"), F.lit("}")
            ),
        )
        for name in sorted(finer)
    ]
    valid = F.size("_why") == 0
    return out.select(
        *[F.col(f"`{name}`") for name in runs.columns],
        F.when(valid, after).alias("candidate"),
        F.when(valid, config_json("candidate")).alias("candidate_json"),
        F.when(valid, config_key("candidate")).alias("config_key"),
        F.when(~valid, F.array_join("_why", ",")).alias("invalid"),
        F.when(valid, F.concat(F.lit("{"), F.concat_ws(",", *changed), F.lit("}"))).alias("changes"),
        F.when(steady, 1).otherwise(c["steps"] * 2).cast("long").alias("cost"),
        F.when(steady, RATIONALE_STEADY).otherwise(RATIONALE_UNSTEADY).alias("rationale"),
    )


def already_refined(candidates: DataFrame, catalog: DataFrame, key: str = "config_key") -> DataFrame:
    """Adds ``has_child``: a run with the same configuration and this parent exists."""
    children = (
        catalog.filter(F.col("parent_id").isNotNull())
        .select(F.col("parent_id").alias("id"), key)
        .distinct()
        .withColumn("has_child", F.lit(True))
    )
    return candidates.join(children, ["id", key], "left").withColumn(
        "has_child", F.coalesce("has_child", F.lit(False))
    )


def priority() -> list[Column]:
    """Failed runs first, then flagged ones, then by id."""
    return [
        (F.col("status") != "failed").alias("p1"),
        (~F.coalesce(F.col("needs_review"), F.lit(False))).alias("p2"),
        F.col("id").alias("p3"),
    ]


def evidence_priority(runs: DataFrame, count: int) -> DataFrame:
    """The ``count`` runs that deserve attention first."""
    return runs.orderBy(*priority()).limit(count)


def select_proposals(
    candidates: DataFrame,
    *,
    max_runs: int = 3,
    max_total_steps: int = 2000,
    most_runs: int = MAX_PROPOSALS,
    most_steps: int = MAX_PROPOSED_STEPS,
) -> dict[str, DataFrame]:
    """Greedy choice under a step budget, in order of evidence priority.

    ``candidates``: ``id, status, needs_review, cost, invalid, has_child``. A row can only be
    chosen if fewer than ``max_runs`` rows before it cost no more than it does: they would all
    have been chosen first. So the first ``max_runs`` rows of every cost are enough, which is
    at most ``max_runs`` x ``max_total_steps`` rows however many candidates there are, and
    Spark limits each cost before the shuffle. The choice itself is at most ``max_runs``
    top-one steps over that table.
    """
    if not 1 <= max_runs <= most_runs or not 1 <= max_total_steps <= most_steps:
        raise ValueError(f"A budget has 1 to {most_runs} runs and 1 to {most_steps} steps in all")
    keyed = candidates.withColumn("_key", F.struct(*priority()))
    usable = keyed.filter(F.col("invalid").isNull() & ~F.col("has_child"))
    nth = F.row_number().over(Window.partitionBy("cost").orderBy("_key"))
    short = store(
        usable.filter(F.col("cost") <= max_total_steps)
        .select("_key", "id", "cost")
        .withColumn("_nth", nth)
        .filter(F.col("_nth") <= max_runs)
        .drop("_nth")
    )
    picked: list = []
    left = max_total_steps
    while len(picked) < max_runs:
        rest = short.filter(F.col("cost") <= left)
        if picked:
            rest = rest.filter(F.col("_key") > _literal_key(picked[-1]["_key"]))
        row = rest.agg(F.min(F.struct("_key", "id", "cost")).alias("r")).first()["r"]
        if row is None:
            break
        picked.append(row)
        left -= row["cost"]
    spark = candidates.sparkSession
    chosen_rows = [
        (i, r["id"], r["cost"], sum(p["cost"] for p in picked[: i + 1]))
        for i, r in enumerate(picked)
    ]
    kind = candidates.schema["id"].dataType.simpleString()
    chosen = spark.createDataFrame(
        chosen_rows, f"position int, id {kind}, cost long, planned_steps long"
    )
    return {"proposals": chosen, "skipped": _skipped(keyed, picked, max_runs, max_total_steps)}


def _literal_key(key) -> Column:
    return F.struct(F.lit(key["p1"]).alias("p1"), F.lit(key["p2"]).alias("p2"), F.lit(key["p3"]).alias("p3"))


def _skipped(keyed: DataFrame, picked: list, max_runs: int, budget: int) -> DataFrame:
    """Candidates walked over before the last choice, with the reason."""
    used = F.lit(0).cast("long")
    for p in picked:
        used = used + F.when(F.col("_key") > _literal_key(p["_key"]), F.lit(p["cost"])).otherwise(0)
    walked = keyed
    if len(picked) == max_runs:
        walked = walked.filter(F.col("_key") < _literal_key(picked[-1]["_key"]))
    ids = [p["id"] for p in picked]
    rows = walked.filter(~F.col("id").isin(ids)) if ids else walked
    over = ~F.col("has_child") & (used + F.col("cost") > budget)
    return (
        rows.withColumn(
            "reason",
            F.when(F.col("invalid").isNotNull(), F.col("invalid")).when(over, "total step budget"),
        )
        .filter(F.col("reason").isNotNull())
        .select(F.col("id").alias("parent_id"), "reason")
    )


def proposal_entities(proposals: DataFrame) -> DataFrame:
    """Hypothesis and proposal entities for chosen refinements, ready to register.

    ``proposals``: ``id`` (the parent run), ``rationale, cost`` and, as JSON text, the refined
    ``config`` and its ``changes``.
    """
    cite = F.struct(F.lit("cites").alias("type"), F.col("id").alias("target"))
    hypothesis = canonical(
        statement="rationale",
        criterion=F.lit(CRITERION),
        status=F.lit("untested"),
        policy=F.lit(POLICY),
    )
    hyp = check_entities(
        proposals.select(
            "*",
            F.lit("Hypothesis").alias("type"),
            hypothesis.alias("properties"),
            F.array(cite).alias("links"),
        ).withColumnRenamed("id", "parent_id")
    )
    prop_links = F.array(
        F.struct(F.lit("cites").alias("type"), F.col("parent_id").alias("target")),
        F.struct(F.lit("tests").alias("type"), F.col("hypothesis_id").alias("target")),
    )
    prop = check_entities(
        hyp.select("parent_id", "rationale", "cost", "config", "changes", F.col("id").alias("hypothesis_id"))
        .withColumn(
            "properties",
            canonical(
                parent_id="parent_id",
                config="config",
                rationale="rationale",
                changed_parameters="changes",
                estimated_steps="cost",
                hypothesis_id="hypothesis_id",
                policy=F.lit(POLICY),
            ),
        )
        .withColumn("type", F.lit("Proposal"))
        .withColumn("links", prop_links)
    )
    columns = ["id", "type", "properties", "links", "reasons"]
    return hyp.select(*columns).unionByName(prop.select(*columns))


def finding_entities(outcomes: DataFrame) -> DataFrame:
    """Findings for executed refinements: ``id, status, proposal_id, hypothesis_id``.

    ``metrics_json`` and ``error`` of the outcome are kept where it has them.
    """
    have = lambda c: F.col(c) if c in outcomes.columns else F.lit(None).cast("string")
    return check_entities(
        outcomes.select(
            F.lit("Finding").alias("type"),
            canonical(
                statement=F.concat(
                    F.lit("Refinement "), "id", F.lit(" ended as "), "status"
                ),
                interpretation=F.lit(FINDING_NOTE),
                metrics=have("metrics_json"),
                error=have("error"),
                proposal_id="proposal_id",
            ).alias("properties"),
            F.array(
                F.struct(F.lit("cites").alias("type"), F.col("id").alias("target")),
                F.struct(F.lit("tests").alias("type"), F.col("hypothesis_id").alias("target")),
            ).alias("links"),
        )
    )
