"""Mixing sources to target weights with Sainte-Lague apportionment, in DataFrame operations only.

Sizes are words. Every source has a weight and shares the total by it; a target stops at
``MOST_REPEATS`` times the source's size and the excess is shared again. A source's documents are
dealt to shards by a seeded hash; a shard's documents, in seeded order, are one stream of words.
Words are then seats: sources get them by highest quotients of their targets, and a source's
shards by highest quotients of their own words. That leaves one whole number of words for every shard.

A shard gives its whole stream as often as that number holds it and the rest by a systematic draw.
Counted from a seeded word, the stream is cut into blocks of one size, the same in all sources
whatever their own sizes; block ``k`` of ``n`` is taken ``floor((k+1)q/n) - floor(kq/n)`` times, and the
last block taken only as far as words are wanted. Sums of that have a closed form, so what a
document contributes follows from where it starts and ends in its stream, and no table of blocks
is ever made.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.skew import by_size
from tidemark.llm.common import WORD, global_rank, written
from tidemark.session import settle

MOST_REPEATS = 3
WEIGHTS = (1, 2, 3)
SHARD_WORDS = 200_000
BLOCK_WORDS = 256
SEED = 4
# Up to this many sources are broadcast; with more, rows are joined to theirs by a shuffle.
SOURCES_SENT = 100_000


def word_count(text: str | Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def apportion(
    rows: DataFrame, group: Sequence[str], key: Sequence[str], weight: str, seats: str
) -> DataFrame:
    """Sainte-Lague: ``rows`` plus ``_seats``, the seats each gets of its group's ``seats``.

    The seats of a group go to the highest quotients ``weight / (2k + 1)``; equal quotients go
    to the smaller key. With ``m`` rows and ``n`` seats, the divisors of ``n - m/2`` and
    ``n + m/2`` seats bound every row's result from below and above, so only about two quotients a
    row have to be ranked.
    """
    grouped = rows.groupBy(*group).agg(F.sum(weight).alias("_total"), F.count("*").alias("_rows"))
    half = F.col("_rows") / 2

    def at(total_seats: Column) -> Column:
        share = F.try_divide(F.col(weight) * F.greatest(total_seats, F.lit(0.0)), F.col("_total"))
        return F.floor(F.coalesce(share, F.lit(0.0)) + 0.5)

    bounded = settle(
        rows.join(grouped, list(group))
        .withColumn("_sure", F.greatest(at(F.col(seats) - half) - 1, F.lit(0)))
        .withColumn("_most", at(F.col(seats) + half) + 1)
    )
    spare = (
        bounded.filter((F.col(weight) > 0) & (F.col(seats) > 0))
        .withColumn("_k", F.explode(F.sequence("_sure", "_most")))
        .select(*group, *key, (F.col(weight) / (2 * F.col("_k") + 1)).alias("_quotient"))
    )
    order = [*map(F.col, group), F.desc("_quotient"), *map(F.col, key)]
    ranked = global_rank(spare, order, "_rank")
    first = ranked.groupBy(*group).agg(F.min("_rank").alias("_first"))
    open_seats = bounded.groupBy(*group).agg(
        (F.first(seats) - F.sum("_sure")).alias("_open")
    )
    won = (
        ranked.join(first, list(group))
        .join(open_seats, list(group))
        .filter(F.col("_rank") - F.col("_first") < F.col("_open"))
        .groupBy(*group, *key)
        .agg(F.count("*").alias("_won"))
    )
    return (
        bounded.join(won, [*group, *key], "left")
        .withColumn("_seats", F.col("_sure") + F.coalesce("_won", F.lit(0)))
        .drop("_total", "_rows", "_sure", "_most", "_won")
    )


def source_targets(
    sizes: DataFrame, *, weights: Sequence[float] = WEIGHTS, most_repeats: int = MOST_REPEATS
) -> DataFrame:
    """``(_key, source, source_size, target)``, one row per source; null is a source of its own.

    Sources are numbered by code point with null last and take the weights in turn. Sharing
    ends when no target is above its limit; each round only adds up the source table.
    """
    sources = sizes.groupBy("_key").agg(
        F.first("_source").alias("source"), F.sum("size").alias("source_size")
    )
    numbered = global_rank(sources, [F.asc_nulls_last("source")], "_number")
    turn = F.element_at(
        F.array(*(F.lit(w) for w in weights)), (F.col("_number") % len(weights) + 1).cast("int")
    )
    table = settle(numbered.withColumn("_weight", turn))
    wide = lambda c: c.cast("decimal(38,0)")  # noqa: E731  products of sums leave 64 bits
    limit = F.col("source_size") * most_repeats
    total, weight = table.agg(F.sum("source_size"), F.sum("_weight")).first()
    share, of, above = total or 0, weight or 1, -1
    while True:
        over = wide(F.col("_weight")) * F.lit(share).cast("decimal(18,0)") > wide(limit) * F.lit(
            of
        ).cast("decimal(18,0)")
        row = table.agg(
            F.count_if(over),
            F.coalesce(F.sum(F.when(over, limit)), F.lit(0)),
            F.coalesce(F.sum(F.when(~over, F.col("_weight"))), F.lit(0)),
        ).first()
        if row[0] == above or row[2] == 0:
            break
        above, share, of = row[0], (total or 0) - row[1], row[2]
    target = F.when(over, limit.cast("double")).otherwise(
        F.col("_weight") * F.lit(float(share)) / F.lit(float(of))
    )
    return table.select("_key", "source", "source_size", target.alias("target"))


def _drawn(place: Column) -> Column:
    """Words that the draw takes of a shard's first ``place`` words, counted from its seeded start."""
    block, blocks = F.col("_block"), F.greatest(F.floor(F.col("_words") / F.col("_block")), F.lit(1))
    picks = F.least(F.ceil(F.col("_extra") / block), blocks)
    at = F.least(F.floor(place / block), blocks)

    def upto(k: Column) -> Column:
        return F.floor(k * picks / blocks)

    # What lies behind the whole blocks is taken only after all of them.
    open_ = F.when(at < blocks, upto(at + 1) - upto(at)).otherwise(
        (F.col("_extra") > blocks * block).cast("long")
    )
    return F.least(upto(at) * block + open_ * (place - at * block), F.col("_extra"))


def _words_before(place: Column) -> Column:
    """Words that the mix takes of a shard's stream before word ``place``."""
    behind = F.col("_words") - F.col("_start")
    drawn = F.when(
        place <= F.col("_start"), _drawn(behind + place) - _drawn(behind)
    ).otherwise(F.col("_extra") - _drawn(behind) + _drawn(place - F.col("_start")))
    return F.col("_whole") * place + drawn


def _times(place: Column) -> Column:
    """How often the mix takes word ``place`` of a shard's stream."""
    turned = F.pmod(place - F.col("_start"), F.col("_words"))
    return (F.col("_whole") + _drawn(turned + 1) - _drawn(turned)).cast("int")


def mix(
    documents: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[float] = WEIGHTS,
    most_repeats: int = MOST_REPEATS,
    shard_words: int = SHARD_WORDS,
    block_words: int = BLOCK_WORDS,
    seed: int = SEED,
    keep_rows: bool = False,
) -> DataFrame:
    """Every row with what the mix takes of it.

    Returns the id, with ``keep_rows`` the whole input row as ``_row``, ``size``, ``source_size``, ``target`` (the
    source's), ``taken`` (words, repeats counted) and the working columns ``_at`` (where the row
    starts in its stream), ``_words`` (of the stream), ``_block``, ``_whole``, ``_extra`` and ``_start``. Null texts have size
    0 and nothing is taken of them; repeated rows lie behind each other in the stream; a table
    without words has targets 0. Other columns are only read into ``_row``, so their names may
    be those of the result.
    """
    key = F.when(F.col(source_col).isNull(), "-").otherwise(F.concat(F.lit("="), F.col(source_col)))
    wide = documents.select(
        F.col(id_col),
        F.col(source_col).cast("string").alias("_source"),
        key.alias("_key"),
        word_count(F.col(text_col)).alias("size"),
        F.xxhash64(F.col(text_col)).alias("_tie"),
        *([F.struct("*").alias("_row")] if keep_rows else []),
    )
    # The texts are counted once; only whole rows, if wanted, are read again at the end.
    sized = written(wide.drop("_row"), "sizes")
    targets = settle(source_targets(sized, weights=weights, most_repeats=most_repeats))

    shard_count = F.greatest(F.ceil(F.col("source_size") / shard_words), F.lit(1))
    place = F.xxhash64(F.col(id_col), F.lit(seed))

    # Few sources are sent to the tasks, so that the rows of a large one stay where they are.
    few_targets = by_size(targets.drop("source"), SOURCES_SENT)

    def dealt(rows: DataFrame) -> DataFrame:
        known = rows.drop("_source").join(few_targets, "_key")
        return known.withColumn("_shard", F.pmod(place, shard_count))

    shards = settle(dealt(sized).groupBy("_key", "_shard").agg(F.sum("size").alias("_words")))
    every = targets.agg(F.sum("target")).first()[0] or 0.0
    quotas = apportion(
        targets.withColumn("_mix", F.lit(0)).withColumn("_all", F.lit(int(round(every)))),
        ["_mix"],
        ["_key"],
        "target",
        "_all",
    ).select("_key", F.least("_seats", F.col("source_size") * most_repeats).alias("_of_source"))
    seats = apportion(shards.join(quotas, "_key"), ["_key"], ["_shard"], "_words", "_of_source")
    quota = F.least("_seats", F.col("_words") * most_repeats)
    whole = F.coalesce(F.floor(F.try_divide(quota, F.col("_words"))), F.lit(0))
    plan = settle(
        seats.select(
            "_key",
            "_shard",
            "_words",
            whole.alias("_whole"),
            (quota - whole * F.col("_words")).alias("_extra"),
            F.pmod(F.xxhash64("_key", "_shard", F.lit(seed)), F.greatest("_words", F.lit(1))).alias("_start"),
        )
    )

    stream = Window.partitionBy("_key", "_shard").orderBy(
        F.xxhash64(F.col(id_col), F.lit(seed + 1)), F.col(id_col), "size", "_tie"
    )
    before = stream.rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt(wide if keep_rows else sized).withColumn("_at", F.coalesce(F.sum("size").over(before), F.lit(0)))
    out = placed.join(plan, ["_key", "_shard"]).withColumn("_block", F.lit(block_words).cast("long"))
    taken = _words_before(F.col("_at") + F.col("size")) - _words_before(F.col("_at"))
    return out.select(
        F.col(id_col),
        *(["_row"] if keep_rows else []),
        "size",
        "source_size",
        "target",
        taken.cast("long").alias("taken"),
        "_at",
        "_words",
        "_block",
        "_whole",
        "_extra",
        "_start",
    )


def mixed_documents(
    documents: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    chars_col: str = "n_chars",
    **options,
) -> DataFrame:
    """The mixed corpus, with the columns of ``documents``.

    A row appears as often as its most repeated word is taken; the ``r``-th copy holds the words
    taken ``r`` times or more, with the white space before each. Copies of a text
    that is taken in full are the text itself. Rows without words appear once, since they
    weigh nothing. ``chars_col``, if there, is set to the new length.
    """
    names = documents.columns
    mixed = mix(
        documents,
        id_col=id_col,
        text_col=text_col,
        source_col=source_col,
        keep_rows=True,
        **options,
    )
    original, chars = F.col("_row").getField(text_col), names.count(chars_col)
    times = F.transform(
        F.sequence(F.lit(0), F.col("size").cast("int") - 1), lambda k: _times(F.col("_at") + k)
    )
    words = F.regexp_extract_all(original, F.lit(rf"(?s)[\x20\x09-\x0D]*{WORD}"), F.lit(0))
    copies = (
        mixed.withColumn("_times", F.when(F.col("size") > 0, times).otherwise(F.array(F.lit(1))))
        .filter(F.array_max("_times") > 0)
        .withColumn("_copy", F.explode(F.sequence(F.lit(1), F.array_max("_times"))))
    )
    whole = F.array_min("_times") >= F.col("_copy")

    def in_copy(_, k: Column) -> Column:
        return F.get("_times", k) >= F.col("_copy")

    text = F.when(whole, original).otherwise(F.array_join(F.filter(words, in_copy), ""))
    fields = {name: F.col("_row").getField(name) for name in names}
    fields[text_col] = text
    if chars:
        kind = documents.schema[chars_col].dataType
        fields[chars_col] = F.when(whole, fields[chars_col]).otherwise(F.length(text).cast(kind))
    return copies.select(*(column.alias(name) for name, column in fields.items()))
