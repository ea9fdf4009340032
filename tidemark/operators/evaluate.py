"""Scoring predictions and comparing them with references and persistence baselines."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.exprs import all_finite, is_finite, max_abs, mean_of, sum_sq
from tidemark.functions.ordered import join_groups, with_dense_neighbors
from tidemark.functions.skew import by_size

# Rows scored per model call and accepted distance from an expected order.
SCORE_BATCH = 64
ORDER_TOLERANCE = 0.3

# Cells of all first frames together up to which they are broadcast (32 MiB).
FIRST_FRAME_CELLS = 4 * 1024 * 1024

Step = Callable[[np.ndarray], np.ndarray]
KEYS = ("run_id", "frame")


def persistence_step(state: np.ndarray) -> np.ndarray:
    """The next frame equals this one."""
    return state


def decay_step(state: np.ndarray) -> np.ndarray:
    """The next frame is nine tenths of this one."""
    return 0.9 * state


def _schema_of(frames: DataFrame) -> str:
    kind = frames.schema["run_id"].dataType.simpleString()
    return f"run_id {kind}, frame int, kind string, values array<double>"


def score_one_step(
    frames: DataFrame, step: Step, *, mean: float = 0.0, std: float = 1.0
) -> DataFrame:
    """Predict frame k+1 from every saved frame k. ``step`` maps a batch of normalised states."""

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), SCORE_BATCH):
                part = pdf.iloc[at : at + SCORE_BATCH]
                state = (np.stack(part["values"].to_list()) - mean) / std
                out = np.asarray(step(state)) * std + mean
                yield pd.DataFrame(
                    {
                        "run_id": part["run_id"].to_numpy(),
                        "frame": part["frame"].to_numpy() + 1,
                        "kind": "one_step",
                        "values": list(out),
                    }
                )

    last = by_size(frames.groupBy("run_id").agg(F.max("frame").alias("_last")))
    inputs = frames.select(*KEYS, "values").join(last, "run_id").filter(F.col("frame") < F.col("_last"))
    return inputs.select(*KEYS, "values").mapInPandas(score, _schema_of(frames))


def score_rollout(
    frames: DataFrame, step: Step, *, mean: float = 0.0, std: float = 1.0
) -> DataFrame:
    """Repeat ``step`` from each trajectory's first frame over its saved frames.

    A rollout is sequential in time, so trajectories are what runs in parallel. Only the first
    frame of each is sent to Python and results leave in small batches.
    """

    def roll(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for run_id, steps, first in zip(pdf["run_id"], pdf["steps"], pdf["values"]):
                state = (np.asarray(first, dtype=np.float64)[None, :] - mean) / std
                numbers, values = [], []
                for frame in range(1, int(steps) + 1):
                    state = np.asarray(step(state))
                    numbers.append(frame)
                    values.append(state[0] * std + mean)
                    if len(numbers) == SCORE_BATCH:
                        yield _rollout_rows(run_id, numbers, values)
                        numbers, values = [], []
                if numbers:
                    yield _rollout_rows(run_id, numbers, values)

    lengths = frames.groupBy("run_id").agg(F.max("frame").alias("steps"))
    starts = frames.filter(F.col("frame") == 0).select("run_id", "values").join(lengths, "run_id")
    return starts.mapInPandas(roll, _schema_of(frames))


def _rollout_rows(run_id, numbers: list[int], values: list[np.ndarray]) -> pd.DataFrame:
    return pd.DataFrame({"run_id": run_id, "frame": numbers, "kind": "rollout", "values": values})


def persistence_one_step(frames: DataFrame) -> DataFrame:
    """Baseline: the previous saved frame."""
    moved = with_dense_neighbors(
        frames.select(*KEYS, "values"), ["run_id"], "frame", prev={"_before": "values"}
    ).filter(F.col("_before").isNotNull())
    return moved.select(
        *KEYS, F.lit("persistence_one_step").alias("kind"), F.col("_before").alias("values")
    )


def persistence_rollout(frames: DataFrame) -> DataFrame:
    """Baseline: the first saved frame held."""
    first = frames.filter(F.col("frame") == 0).select("run_id", F.col("values").alias("_first"))
    rest = frames.filter(F.col("frame") > 0).select(*KEYS)
    return rest.join(first, "run_id").select(
        *KEYS, F.lit("persistence_rollout").alias("kind"), F.col("_first").alias("values")
    )


def baseline_pairs(frames: DataFrame) -> DataFrame:
    """Both persistence baselines next to their reference arrays.

    The previous frame arrives as a neighbour, so it needs no join with the reference. The
    first frames, one per trajectory, are broadcast if they are small together.
    """
    narrow = frames.select(*KEYS, "values")
    previous = with_dense_neighbors(narrow, ["run_id"], "frame", prev={"_before": "values"})
    one = previous.filter(F.col("_before").isNotNull()).select(
        *KEYS,
        F.lit("persistence_one_step").alias("kind"),
        F.col("_before").alias("prediction"),
        F.col("values").alias("reference"),
    )
    first = narrow.filter(F.col("frame") == 0).select("run_id", F.col("values").alias("_first"))
    starts = by_size(first, FIRST_FRAME_CELLS, F.size("_first"))
    held = narrow.filter(F.col("frame") > 0).join(starts, "run_id")
    return one.unionByName(
        held.select(
            *KEYS,
            F.lit("persistence_rollout").alias("kind"),
            F.col("_first").alias("prediction"),
            F.col("values").alias("reference"),
        )
    )


def match(predictions: DataFrame, reference: DataFrame) -> DataFrame:
    """Pairs of predicted and reference arrays by trajectory and frame."""
    truth = reference.select(*KEYS, F.col("values").alias("reference"))
    return predictions.select(*KEYS, "kind", F.col("values").alias("prediction")).join(
        truth, list(KEYS)
    )


def frame_scores(matched: DataFrame) -> DataFrame:
    """Per-frame partial sums; field arrays end here and only scalars are shuffled."""
    p, r = F.col("_p"), F.col("_r")
    error = F.col("_e")
    arrays = matched.select(
        *KEYS,
        "kind",
        F.col("prediction").cast("array<double>").alias("_p"),
        F.col("reference").cast("array<double>").alias("_r"),
    ).withColumn("_e", F.zip_with(p, r, lambda a, b: a - b))
    n = F.size(r)
    energy_gap = 0.5 * (sum_sq(p) - sum_sq(r)) / n
    return arrays.select(
        *KEYS,
        "kind",
        n.alias("cells"),
        all_finite(p).alias("finite"),
        sum_sq(error).alias("error_sq"),
        sum_sq(r).alias("reference_sq"),
        max_abs(error).alias("max_abs"),
        F.pow(mean_of(error), 2).alias("mean_sq"),
        F.pow(energy_gap, 2).alias("energy_sq"),
    )


def field_metrics(scores: DataFrame, by: Sequence[str] = ("kind",)) -> DataFrame:
    """Error metrics of every group; NULL where a prediction was not finite."""
    finite = F.bool_and("finite")
    only = lambda c: F.when(finite, c)
    norm = F.sqrt(F.sum("reference_sq"))
    return scores.groupBy(*by).agg(
        finite.alias("finite"),
        only(F.sqrt(F.sum("error_sq") / F.sum("cells"))).alias("rmse"),
        only(F.when(norm > 0, F.sqrt(F.sum("error_sq")) / norm)).alias("relative_l2"),
        only(F.max("max_abs")).alias("max_abs_error"),
        only(F.sqrt(F.avg("mean_sq"))).alias("mean_velocity_rmse"),
        only(F.sqrt(F.avg("energy_sq"))).alias("energy_rmse"),
    )


def _void_as_a_whole(table: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """NULL the columns of every group in which any saved time was not finite."""
    whole = table.groupBy(*by).agg(F.bool_and("finite").alias("_whole"))
    kept = [F.when(F.col("_whole"), F.col(c)).alias(c) for c in columns]
    rest = [c for c in table.columns if c not in columns]
    return join_groups(table, whole, by).select(*rest, *kept)


def per_time_rmse(scores: DataFrame, by: Sequence[str] = ("kind",)) -> DataFrame:
    """RMSE per saved time over trajectories and cells.

    One prediction that is not finite voids the series of its whole group.
    """
    table = scores.groupBy(*by, "frame").agg(
        F.bool_and("finite").alias("finite"), F.sqrt(F.sum("error_sq") / F.sum("cells")).alias("rmse")
    )
    return _void_as_a_whole(table, by, ["rmse"]).drop("finite")


def mean_drifts(predictions: DataFrame, reference: DataFrame) -> DataFrame:
    """Signed changes of the spatial mean per frame: ``run_id, frame, quantity, drift``.

    One-step change: predicted mean minus the preceding reference mean. Rollout drift:
    predicted mean minus the initial reference mean. Reference drift: own mean minus initial.
    """
    means = reference.select(*KEYS, mean_of(F.col("values").cast("array<double>")).alias("m"))
    first = means.filter(F.col("frame") == 0).select("run_id", F.col("m").alias("first_mean"))
    # The preceding mean is an equi-join on the shifted frame, which spreads any trajectory.
    before = means.select("run_id", (F.col("frame") + 1).alias("frame"), F.col("m").alias("before"))
    predicted = predictions.filter(F.col("kind").isin("one_step", "rollout")).select(
        *KEYS, "kind", mean_of(F.col("values").cast("array<double>")).alias("p")
    )
    one = (
        predicted.filter(F.col("kind") == "one_step")
        .join(before, list(KEYS))
        .select(
            *KEYS,
            F.lit("one_step_mean_change").alias("quantity"),
            (F.col("p") - F.col("before")).alias("drift"),
        )
    )
    roll = (
        predicted.filter(F.col("kind") == "rollout")
        .join(first, "run_id")
        .select(
            *KEYS,
            F.lit("rollout_mean_drift").alias("quantity"),
            (F.col("p") - F.col("first_mean")).alias("drift"),
        )
    )
    own = (
        means.filter(F.col("frame") > 0)
        .join(first, "run_id")
        .select(
            *KEYS,
            F.lit("reference_mean_drift").alias("quantity"),
            (F.col("m") - F.col("first_mean")).alias("drift"),
        )
    )
    return one.unionByName(roll).unionByName(own)


def drift_metrics(drifts: DataFrame, by: Sequence[str] = ("quantity",)) -> DataFrame:
    """RMS and largest absolute drift; NULL where a drift was not finite.

    Per saved time, one such drift voids the series of its whole quantity.
    """
    # A NaN that came back from Python is NULL inside its array, and so is that frame's mean.
    finite = F.bool_and(F.coalesce(is_finite("drift"), F.lit(False)))
    table = drifts.groupBy(*by).agg(
        finite.alias("finite"),
        F.when(finite, F.sqrt(F.avg(F.col("drift") * F.col("drift")))).alias("rms"),
        F.when(finite, F.max(F.abs("drift"))).alias("max_abs"),
    )
    if "frame" not in by:
        return table
    return _void_as_a_whole(table, [c for c in by if c != "frame"], ["rms", "max_abs"])


def evaluate(frames: DataFrame, step: Step, *, mean: float = 0.0, std: float = 1.0) -> dict[str, DataFrame]:
    """All evaluation tables of one step function on reference trajectories."""
    predictions = score_one_step(frames, step, mean=mean, std=std).unionByName(
        score_rollout(frames, step, mean=mean, std=std)
    )
    scores = frame_scores(match(predictions, frames).unionByName(baseline_pairs(frames)))
    drifts = mean_drifts(predictions, frames)
    return {
        "predictions": predictions,
        "fields": field_metrics(scores),
        "per_time": per_time_rmse(scores),
        "drifts": drift_metrics(drifts),
        "drifts_per_time": drift_metrics(drifts, ("quantity", "frame")),
    }


def write_predictions(predictions: DataFrame, path: str) -> None:
    """Store predictions as float32 arrays, one directory per kind."""
    stored = predictions.withColumn("values", F.col("values").cast("array<float>"))
    stored.write.mode("errorifexists").partitionBy("kind").parquet(path)


# -- refinement studies -----------------------------------------------------------


def convergence_orders(errors: DataFrame) -> DataFrame:
    """``log2`` of the error ratio of each level and the next.

    ``errors``: ``study, level, error`` with levels 0..n-1. A study with an error that is not
    positive and finite has no orders.
    """
    ok = (F.col("error") > 0) & (F.col("error") < float("inf"))
    usable = errors.groupBy("study").agg(F.bool_and(F.coalesce(ok, F.lit(False))).alias("_ok"))
    pairs = with_dense_neighbors(errors, ["study"], "level", next={"_finer": "error"})
    return (
        pairs.filter(F.col("_finer").isNotNull())
        .join(usable.filter("_ok"), "study", "left_semi")
        .select(
            "study", "level", F.log2(F.col("error") / F.col("_finer")).alias("observed_order")
        )
    )


def refinement_report(errors: DataFrame, expected: Column) -> DataFrame:
    """Whether every observed order of a study is within 0.3 of the expected one."""
    levels = errors.groupBy("study").agg(
        F.count("*").alias("levels"), F.max(expected).alias("expected_order")
    )
    orders = convergence_orders(errors).join(levels, "study")
    near = F.abs(F.col("observed_order") - F.col("expected_order")) <= ORDER_TOLERANCE
    checked = orders.groupBy("study").agg(
        F.count("*").alias("orders"),
        F.bool_and(near).alias("near"),
        F.min("observed_order").alias("least_order"),
        F.max("observed_order").alias("most_order"),
    )
    return levels.join(checked, "study", "left").select(
        "study",
        "levels",
        "expected_order",
        "least_order",
        "most_order",
        (F.coalesce(F.col("near"), F.lit(False)) & (F.col("orders") == F.col("levels") - 1)).alias(
            "passed"
        ),
    ).withColumn("passed", F.coalesce("passed", F.lit(False)))


def validation_report(studies: DataFrame, cases: DataFrame) -> DataFrame:
    """Overall pass flag with byte totals and the largest allocation, one row."""
    passed = studies.agg(
        F.struct(
            F.bool_and("passed").alias("passed"),
            F.count("*").alias("studies"),
            F.count_if(~F.col("passed")).alias("failed_studies"),
        )
    )
    totals = cases.agg(
        F.count("*").alias("cases"),
        F.sum("stored_bytes").alias("stored_output_bytes"),
        F.max("peak_bytes").alias("peak_traced_allocation_bytes_max_case"),
    )
    return totals.withColumn("_s", passed.scalar()).select("_s.*", *totals.columns)


def best_checkpoints(losses: DataFrame) -> DataFrame:
    """Epoch with the lowest validation loss per model, the earliest on ties."""
    best = F.min(F.struct("validation_loss", "epoch"))
    return losses.groupBy("model_id").agg(best.alias("_b"), F.count("*").alias("epochs")).select(
        "model_id",
        F.col("_b.epoch").alias("best_epoch"),
        F.col("_b.validation_loss").alias("validation_loss"),
        "epochs",
    )


def paired_table(results: DataFrame, measures: Sequence[str]) -> DataFrame:
    """Baseline and mean-preserving results side by side per seed, with differences."""
    wide = results.groupBy("seed").agg(
        *[
            F.max(F.when(F.col("variant") == v, F.col(m))).alias(f"{v}_{m}")
            for v in ("baseline", "mean_preserving")
            for m in measures
        ]
    )
    return wide.withColumns(
        {f"delta_{m}": F.col(f"mean_preserving_{m}") - F.col(f"baseline_{m}") for m in measures}
    )
