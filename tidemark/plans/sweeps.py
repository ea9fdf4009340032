"""Parameter sweeps and benchmark study plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.exprs import reasons
from tidemark.plans.configs import config_key, normalize_configs

# Sweep and study limits.
MAX_SWEEP_RUNS = 10_000
MAX_STUDY_CASES = 48
STUDY_LIMITS = {
    "small": {"configs": 32, "runs": 256, "bytes": 2 * 1024**3},
    "large": {"configs": 256, "runs": 4096, "bytes": 16 * 1024**3},
}
MAX_STUDY_STEPS = 2_000_000
MAX_STUDY_GRID = 512
MAX_STUDY_WORKERS = 8
MAX_STUDY_REPEATS = 7
STUDY_MODES = ("buffered", "streamed")


def expand_sweeps(specs: DataFrame, max_runs: int = MAX_SWEEP_RUNS) -> DataFrame:
    """Cartesian grids of many specs at once.

    ``specs``: ``spec_id, base MAP<STRING,STRING>, parameters MAP<STRING,ARRAY<STRING>>``.
    Parameters override the base, keys run in sorted order with the last key fastest, and
    the grid size is tested before anything is expanded. A combination is decoded from its
    number by mixed radix, so there is no join and at most ``max_runs`` rows per spec;
    :func:`sweep_problems` names the specs that have more.
    """
    sizes = F.transform("keys", lambda k: F.size(F.col("parameters")[k]))
    count = F.aggregate(sizes, F.lit(1.0), lambda acc, n: acc * n)
    sized = specs.withColumn("keys", F.array_sort(F.map_keys("parameters"))).withColumns(
        {
            "sizes": sizes,
            "combinations": count,
        }
    )
    fits = (F.col("combinations") >= 1) & (F.col("combinations") <= max_runs)
    # stride of a key = product of the sizes of the keys after it
    strides = F.transform(
        "keys",
        lambda k, i: F.aggregate(
            F.slice("sizes", i + 2, F.size("sizes")), F.lit(1), lambda acc, n: acc * n
        ),
    )
    chosen = F.transform(
        "keys",
        lambda k, i: F.get(
            F.col("parameters")[k],
            F.pmod(
                F.floor(F.col("ordinal") / F.get(F.col("strides"), i)), F.get(F.col("sizes"), i)
            ).cast("int"),
        ),
    )
    return (
        sized.filter(fits)
        .withColumn("strides", strides)
        .withColumn(
            "ordinal", F.explode(F.sequence(F.lit(0), F.col("combinations").cast("int") - 1))
        )
        .withColumn(
            "raw",
            F.map_concat(
                F.map_filter("base", lambda k, v: ~F.array_contains(F.col("keys"), k)),
                F.map_from_arrays("keys", chosen),
            ),
        )
        .select("spec_id", "ordinal", "raw")
    )


def sweep_problems(specs: DataFrame, max_runs: int = MAX_SWEEP_RUNS) -> DataFrame:
    """Specs that cannot be expanded: an empty value list or too many combinations."""
    lengths = F.transform(F.map_values("parameters"), lambda v: F.coalesce(F.size(v), F.lit(0)))
    count = F.aggregate(lengths, F.lit(1.0), lambda acc, n: acc * n)
    return specs.select(
        "spec_id",
        reasons(
            (~F.exists(lengths, lambda n: n <= 0), "empty_parameter"),
            (count <= max_runs, "too_many_combinations"),
        ).alias("reasons"),
    ).filter(F.size("reasons") > 0)


def plan_sweeps(specs: DataFrame) -> DataFrame:
    """Valid, distinct configurations of every spec; one invalid member rejects its sweep.

    Duplicates after normalisation keep the smallest ordinal. All groups here are one
    spec's grid, which the limit of :func:`expand_sweeps` bounds.
    """
    # One spec becomes up to 10,000 rows: spread the small specs first. Everything after
    # keeps this partitioning, so it is the only shuffle.
    tasks = int(specs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    members = normalize_configs(expand_sweeps(specs.repartition(tasks, "spec_id")))
    whole = Window.partitionBy("spec_id")
    return (
        members.withColumn("_invalid", F.max(F.size("reasons")).over(whole))
        .filter(F.col("_invalid") == 0)
        .withColumn("config_key", config_key())
        .groupBy("spec_id", "config_key")
        .agg(
            F.min("ordinal").alias("ordinal"),
            F.first("config").alias("config"),
            F.first("output_bytes").alias("output_bytes"),
        )
    )


def study_cases(workers: Column, modes: Column, repeats: Column) -> Column:
    """All workers x modes x repeats of a study as one small array."""
    return F.flatten(
        F.transform(
            F.sequence(F.lit(0), F.greatest(repeats - 1, F.lit(0)).cast("int")),
            lambda r: F.flatten(
                F.transform(
                    workers,
                    lambda w: F.transform(
                        modes,
                        lambda m: F.struct(
                            r.alias("repeat"), w.alias("workers"), m.alias("mode")
                        ),
                    ),
                )
            ),
        )
    )


def plan_studies(studies: DataFrame, configs: DataFrame) -> DataFrame:
    """Check the budgets of benchmark studies and total their work.

    ``studies``: ``study_id, workers ARRAY<INT>, modes ARRAY<STRING>, repeats, seed, scale``.
    ``configs``: planned configurations with ``study_id`` (rows of :func:`plan_sweeps`).
    """
    work = configs.groupBy("study_id").agg(
        F.count("*").alias("configs"),
        F.sum("output_bytes").alias("bytes_per_trial"),
        F.sum("config.steps").alias("steps_per_trial"),
        F.max("config.grid_size").alias("largest_grid"),
        F.bool_or(F.col("config.equation") == "darcy2d").alias("has_steady"),
    )
    large = F.col("scale") == "large"
    limit = lambda name: F.when(large, STUDY_LIMITS["large"][name]).otherwise(
        STUDY_LIMITS["small"][name]
    )
    cases = F.size("workers") * F.size("modes") * F.col("repeats")
    totals = studies.join(work, "study_id").withColumns(
        {
            "cases": cases,
            "fresh_runs": cases * F.col("configs"),
            "integration_steps": cases * F.col("steps_per_trial"),
            "estimated_bytes": cases * F.col("bytes_per_trial"),
        }
    )
    w, modes = F.col("workers"), F.col("modes")
    return totals.withColumn(
        "reasons",
        reasons(
            (F.col("configs").between(1, limit("configs")), "config_count"),
            (
                (F.size(w) > 0)
                & (F.size(F.array_distinct(w)) == F.size(w))
                & F.array_contains(w, 1)
                & F.forall(
                    w,
                    lambda n: (n >= 1)
                    & (n <= F.least(F.lit(MAX_STUDY_WORKERS), F.col("configs"))),
                ),
                "workers",
            ),
            (
                (F.size(modes) > 0)
                & (F.size(F.array_distinct(modes)) == F.size(modes))
                & F.forall(modes, lambda m: m.isin(*STUDY_MODES)),
                "modes",
            ),
            (F.col("repeats").between(1, MAX_STUDY_REPEATS), "repeats"),
            (F.col("seed").between(0, 2**32 - 1), "seed"),
            (~F.col("has_steady"), "steady_equation"),
            (F.col("largest_grid") <= MAX_STUDY_GRID, "grid_size"),
            (F.col("cases") <= MAX_STUDY_CASES, "case_count"),
            (F.col("fresh_runs") <= limit("runs"), "fresh_runs"),
            (F.col("integration_steps") <= MAX_STUDY_STEPS, "integration_steps"),
            (F.col("estimated_bytes") <= limit("bytes"), "estimated_bytes"),
        ),
    )


def order_cases(plans: DataFrame) -> DataFrame:
    """Seeded order of the cases of every accepted study, one row per case.

    A study has at most ``MAX_STUDY_CASES`` cases, so each is ordered inside its own row. The form
    of ``case_id`` is a fixed value.
    """
    keyed = F.transform(
        study_cases(F.col("workers"), F.col("modes"), F.col("repeats")),
        lambda c: F.struct(
            F.sha2(
                F.concat_ws(":", F.col("seed"), c["repeat"], c["workers"], c["mode"]), 256
            ).alias("key"),
            c.alias("case"),
        ),
    )
    return (
        plans.filter(F.size("reasons") == 0)
        .select("study_id", F.posexplode(F.array_sort(keyed)).alias("position", "_c"))
        .select(
            "study_id",
            "position",
            "_c.case.repeat",
            "_c.case.workers",
            "_c.case.mode",
            F.format_string(
                "trial-%03d-%s-w%d-r%d",
                "position",
                "_c.case.mode",
                "_c.case.workers",
                "_c.case.repeat",
            ).alias("case_id"),
        )
    )


def paired_runs(seeds: DataFrame) -> DataFrame:
    """Baseline and mean-preserving runs per seed; odd seeds start with the second variant."""
    flags = F.when(F.col("seed") % 2 == 0, F.array(F.lit(False), F.lit(True))).otherwise(
        F.array(F.lit(True), F.lit(False))
    )
    return seeds.select("*", F.posexplode(flags).alias("position", "conserve_mean")).withColumn(
        "variant", F.when(F.col("conserve_mean"), "mean_preserving").otherwise("baseline")
    )
