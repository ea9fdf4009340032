"""Ordered access that does not put a whole key into one task.

``lag``/``lead``/``first_value`` over ``Window.partitionBy(key)`` sorts all rows of a key in
one task. Here a key's rows are split into blocks of consecutive positions, windows run per
``(key, block)``, and only one row per block crosses a block border.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.skew import by_size
from tidemark.session import settle

BLOCK_WIDTH = 4096


def _block(order: str, width: int) -> Column:
    return F.floor(F.col(order) / F.lit(width)).cast("long")


def with_neighbors(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    *,
    prev: dict[str, str] | None = None,
    next: dict[str, str] | None = None,
    first: dict[str, str] | None = None,
    width: int = BLOCK_WIDTH,
) -> DataFrame:
    """Add the previous row's, next row's or first row's columns within each key.

    ``prev``/``next``/``first`` map a new column name to a source column. ``order`` is an
    integer position, unique within a key; gaps are allowed.
    """
    prev, next, first = prev or {}, next or {}, first or {}
    keys = list(keys)
    local = Window.partitionBy(*keys, "_block").orderBy(order)
    across = Window.partitionBy(*keys).orderBy("_block")
    blocked = df.withColumn("_block", _block(order, width))

    edges = blocked.groupBy(*keys, "_block").agg(
        *[F.max_by(src, order).alias(f"_e_{new}") for new, src in prev.items()],
        *[F.min_by(src, order).alias(f"_e_{new}") for new, src in next.items()],
        *[F.min_by(src, order).alias(f"_e_{new}") for new, src in first.items()],
    )
    edges = edges.select(
        *keys,
        "_block",
        *[F.lag(f"_e_{new}").over(across).alias(f"_c_{new}") for new in prev],
        *[F.lead(f"_e_{new}").over(across).alias(f"_c_{new}") for new in next],
        *[F.first(f"_e_{new}").over(across).alias(f"_c_{new}") for new in first],
        *([F.row_number().over(across).alias("_nth")] if prev or first else []),
    )
    windowed = blocked.withColumns(
        {
            **{f"_w_{new}": F.lag(src).over(local) for new, src in prev.items()},
            **{f"_w_{new}": F.lead(src).over(local) for new, src in next.items()},
            "_pos": F.row_number().over(local),
            "_rev": F.lead(order).over(local).isNull(),
        }
    )
    joined = windowed.join(edges, [*keys, "_block"], "left")
    out = joined
    for new in prev:
        out = out.withColumn(
            new, F.when(F.col("_pos") == 1, F.col(f"_c_{new}")).otherwise(F.col(f"_w_{new}"))
        )
    for new in next:
        out = out.withColumn(
            new, F.when(F.col("_rev"), F.col(f"_c_{new}")).otherwise(F.col(f"_w_{new}"))
        )
    for new in first:
        out = out.withColumn(new, F.col(f"_c_{new}"))
    return out.select(*df.columns, *prev, *next, *first)


def with_dense_neighbors(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    *,
    prev: dict[str, str] | None = None,
    next: dict[str, str] | None = None,
    width: int = BLOCK_WIDTH,
) -> DataFrame:
    """Like :func:`with_neighbors` for positions without gaps (saved frames 0..n-1).

    The row on a block border is sent to both blocks by the scan itself, so one shuffle is
    enough even when the columns are whole field arrays.
    """
    prev, next = prev or {}, next or {}
    keys = list(keys)
    position = F.col(order)
    own = _block(order, width)
    ghosts = [F.struct(own.alias("block"), F.lit(False).alias("ghost"))]
    if prev:
        ghosts.append(
            F.when(
                F.pmod(position + 1, F.lit(width)) == 0,
                F.struct((own + 1).alias("block"), F.lit(True).alias("ghost")),
            )
        )
    if next:
        ghosts.append(
            F.when(
                F.pmod(position, F.lit(width)) == 0,
                F.struct((own - 1).alias("block"), F.lit(True).alias("ghost")),
            )
        )
    placed = df.withColumn("_at", F.explode(F.array_compact(F.array(*ghosts)))).select(
        *df.columns, F.col("_at.block").alias("_block"), F.col("_at.ghost").alias("_ghost")
    )
    local = Window.partitionBy(*keys, "_block").orderBy(order)
    out = placed.withColumns(
        {
            **{new: F.lag(src).over(local) for new, src in prev.items()},
            **{new: F.lead(src).over(local) for new, src in next.items()},
        }
    )
    return out.filter(~F.col("_ghost")).select(*df.columns, *prev, *next)


def join_groups(
    left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner"
) -> DataFrame:
    """Join on group keys where NULL is a group like any other."""
    renamed = right.withColumnsRenamed({k: f"_k_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    return left.join(renamed, same, how).drop(*[f"_k_{k}" for k in keys])


# Rank error of the sketches that bracket a median, as one part in so many.
SKETCH_PARTS = 10_000
# Points of the grid that narrows a bracket which is still too large.
GRID = 100


def _entries(measures: Sequence[str], bracket: str) -> Column:
    """``(measure, value, below)`` of every measure that is not above its bracket."""
    found = []
    for i, m in enumerate(measures):
        b = F.col(f"{bracket}{m}")
        entry = F.struct(
            F.lit(i).alias("measure"),
            F.when(F.col(m) >= b["lo"], F.col(m)).alias("value"),  # null: below the bracket
        )
        found.append(F.when(F.col(m) <= b["hi"], entry))
    return F.array_compact(F.array(*found))


def _narrowed(narrow: DataFrame, brackets: DataFrame, keys: list[str], measures: Sequence[str]) -> DataFrame:
    """Brackets of a hundredth of the ranks or so, from a sketch of what is inside the given ones."""
    grid = [i / GRID for i in range(GRID + 1)]
    joined = join_groups(narrow, by_size(brackets), keys)
    aggregates = []
    for m in measures:
        b, v = F.col(f"_b_{m}"), F.col(m)
        inside = (v >= b["lo"]) & (v <= b["hi"])
        aggregates += [
            F.count_if(v < b["lo"]).alias(f"_below_{m}"),
            F.count_if(inside).alias(f"_inside_{m}"),
            F.percentile_approx(F.when(inside, v), grid, SKETCH_PARTS).alias(f"_grid_{m}"),
            F.first(b["n"]).alias(f"_n_{m}"),
        ]
    sketched = joined.groupBy(*keys).agg(*aggregates)
    columns = []
    for m in measures:
        n, inside, cuts = (F.col(f"_{x}_{m}") for x in ("n", "inside", "grid"))
        share = lambda rank: (rank - F.col(f"_below_{m}")) / F.nullif(inside, F.lit(0))
        low = F.floor((share(F.expr(f"(_n_{m} - 1) div 2")) - 2 / SKETCH_PARTS) * GRID)
        high = F.ceil((share(F.expr(f"_n_{m} div 2 + 1")) + 2 / SKETCH_PARTS) * GRID)
        first = F.greatest(low, F.lit(0)).cast("int")
        last = F.least(high, F.lit(GRID)).cast("int")
        columns.append(
            F.struct(
                F.get(cuts, first).alias("lo"),
                F.get(cuts, last).alias("hi"),
                n.alias("n"),
                ((last - first) * inside / GRID).cast("long").alias("size"),
            ).alias(f"_b_{m}")
        )
    return sketched.select(*keys, *columns)


def exact_medians(
    df: DataFrame,
    keys: Sequence[str],
    measures: Sequence[str],
    *,
    also: Sequence[Column] = (),
    most: int = 1_000_000,
) -> DataFrame:
    """Exact medians per group without holding a group in one task.

    A first scan takes a quantile sketch of every measure. Its rank error is known, so two of its
    values bracket the middle ranks, however the values are spread: one far outlier changes nothing.
    A second scan counts what lies below the bracket and the different values inside; the middle
    ranks are then exact counts. Both scans are combined before the shuffle, and a value shared
    by a third of all rows is one row. A bracket of more than ``most`` ranks is narrowed first, by a
    sketch of its own inside.

    Returns ``<measure>_median`` per group, NULLs ignored; values have to be finite. ``also`` are
    further named aggregates, taken in the first scan.
    """
    keys = list(keys)
    narrow = df.select(*keys, *[F.col(m).cast("double").alias(m) for m in measures])
    middle = [0.5 - 2 / SKETCH_PARTS, 0.5 + 2 / SKETCH_PARTS]

    def bracket(m: str) -> Column:
        value = F.col(m).cast("double")
        cuts = F.percentile_approx(value, middle, SKETCH_PARTS)
        n = F.count(value)
        size = (n * (6 / SKETCH_PARTS)).cast("long")
        return F.struct(
            F.get(cuts, 0).alias("lo"), F.get(cuts, 1).alias("hi"), n.alias("n"), size.alias("size")
        ).alias(f"_b_{m}")

    ranges = by_size(df.groupBy(*keys).agg(*[bracket(m) for m in measures], *also))
    internal = [f"_b_{m}" for m in measures]
    brackets = ranges.select(*keys, *internal)
    wide = [F.when(F.col(f"{b}.lo") < F.col(f"{b}.hi"), F.col(f"{b}.size")) for b in internal]
    largest = F.max(F.greatest(*wide, F.lit(0), F.lit(0)))
    for _ in range(4):  # each divides a bracket by some fifty
        if (brackets.agg(largest).first()[0] or 0) <= most:
            break
        brackets = settle(_narrowed(narrow, brackets, keys, measures))
    group = [*keys, "measure"]
    placed = join_groups(narrow, by_size(brackets), keys).select(*keys, F.inline(_entries(measures, "_b_")))
    counted = placed.groupBy(*group, "value").agg(F.count("*").alias("n"))
    totals = F.array(*[F.col(f"{b}.n") for b in internal])
    counted = join_groups(counted, by_size(brackets.select(*keys, totals.alias("totals"))), keys)
    inner = Window.partitionBy(*group).orderBy(F.asc_nulls_first("value"))
    start = counted.select(
        *group,
        "value",
        "n",
        (F.sum("n").over(inner) - F.col("n")).alias("start"),
        F.get("totals", F.col("measure")).alias("total"),
    )
    low_rank, high_rank = F.expr("(total - 1) div 2"), F.expr("total div 2")
    holds = lambda rank: (F.col("start") <= rank) & (rank < F.col("start") + F.col("n"))
    picked = start.groupBy(*group).agg(
        ((F.max(F.when(holds(low_rank), F.col("value"))) + F.max(F.when(holds(high_rank), F.col("value")))) / 2).alias(
            "median"
        )
    )
    # Every group has one row of plain aggregates, which brings in groups without any value.
    kept = [c for c in ranges.columns if c not in (*keys, *internal)]
    rows = picked.unionByName(ranges.drop(*internal), allowMissingColumns=True)
    return rows.groupBy(*keys).agg(
        *[F.first(c, ignorenulls=True).alias(c) for c in kept],
        *[
            F.max(F.when(F.col("measure") == i, F.col("median"))).alias(f"{m}_median")
            for i, m in enumerate(measures)
        ],
    )


def carry_forward(
    df: DataFrame, keys: Sequence[str], order: str, value: Column, name: str, *, width: int
) -> DataFrame:
    """Last non-NULL ``value`` among the rows strictly before each row of a key."""
    keys = list(keys)
    blocked = df.withColumns({"_block": _block(order, width), "_v": value})
    local = Window.partitionBy(*keys, "_block").orderBy(order).rowsBetween(
        Window.unboundedPreceding, -1
    )
    across = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    at = F.when(F.col("_v").isNotNull(), F.col(order))
    edges = (
        blocked.groupBy(*keys, "_block")
        .agg(F.max_by("_v", at).alias("_last"))
        .select(*keys, "_block", F.last("_last", ignorenulls=True).over(across).alias("_carried"))
    )
    windowed = blocked.withColumn("_local", F.last("_v", ignorenulls=True).over(local))
    return windowed.join(edges, [*keys, "_block"], "left").select(
        *df.columns, F.coalesce("_local", "_carried").alias(name)
    )


def first_at_or_after(
    probes: DataFrame,
    points: DataFrame,
    key: str,
    time: str,
    value: str,
    name: str,
    *,
    width: int,
) -> DataFrame:
    """For every probe, ``value`` of the key's first point with ``time`` >= the probe's.

    A forward as-of join: probes and points are put in one time order, in blocks of ``width``
    time units. Only the first point of a block is carried to earlier blocks.
    """
    columns = probes.columns
    both = probes.select(*columns, F.lit(None).cast("long").alias("_v"), F.lit(0).alias("_point"))
    both = both.unionByName(
        points.select(key, time, F.col(value).cast("long").alias("_v"), F.lit(1).alias("_point")),
        allowMissingColumns=True,
    ).withColumn("_block", _block(time, width))
    local = (
        Window.partitionBy(key, "_block")
        .orderBy(time, "_point", "_v")
        .rowsBetween(0, Window.unboundedFollowing)
    )
    across = Window.partitionBy(key).orderBy("_block").rowsBetween(1, Window.unboundedFollowing)
    edges = (
        both.groupBy(key, "_block")
        .agg(F.min_by("_v", F.when(F.col("_point") == 1, F.struct(time, "_v"))).alias("_first"))
        .select(key, "_block", F.first("_first", ignorenulls=True).over(across).alias("_later"))
    )
    found = both.withColumn("_here", F.first("_v", ignorenulls=True).over(local))
    return (
        found.filter(F.col("_point") == 0)
        .join(edges, [key, "_block"], "left")
        .select(*columns, F.coalesce("_here", "_later").alias(name))
    )
