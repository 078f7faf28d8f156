"""Ordered folds over sessions that may not fit into one task.

A plain ``Window.partitionBy(session)`` sends a whole session to one task. Here a
session is cut into blocks that are contiguous in its order; each block is folded
on its own, and only one summary row per block is folded per session. The results
equal the plain window.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnwise.session import cut_lineage

ROWS_PER_BLOCK = 65_536
#: Sessions above this are numbered in several tasks.
ROWS_PER_PART = 250_000


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def _same(left: Sequence[str], right: Sequence[str]) -> Column:
    return reduce(Column.__and__, [F.col(a).eqNullSafe(F.col(b)) for a, b in zip(left, right, strict=True)])


def large_sessions(df: DataFrame, session: str, max_rows: int = ROWS_PER_PART) -> DataFrame:
    """(`_k`, `_n`): sessions above `max_rows` rows and their sizes, written once."""
    sizes = df.groupBy(F.col(session).alias("_k")).agg(F.count(F.lit(1)).alias("_n"))
    return cut_lineage(sizes.filter(F.col("_n") > max_rows))


def spread(df: DataFrame, session: str, order: Sequence[str], parts: int | None = None) -> DataFrame:
    """Rows in `parts` ranges (as many as the session's shuffles have, if not given) of (session, order), sorted, with their place `_at` and range `_part`.

    The splitters are quantiles of a sample of the real order columns, drawn by the range
    exchange, so any orderable type and any spread of values gives ranges of about the same size; only
    rows that tie on all columns stay together. `_at` counts up inside a range.
    """
    ranged = df.repartitionByRange(*([parts] if parts else []), session, *order).sortWithinPartitions(session, *order)
    placed = cut_lineage(ranged.withColumn("_at", F.monotonically_increasing_id()))
    return placed.withColumn("_part", F.shiftright("_at", 33))


def dense_position(
    df: DataFrame,
    session: str,
    order: Sequence[str],
    out: str = "pos",
    max_rows: int = ROWS_PER_PART,
) -> DataFrame:
    """Number the rows of each session 0, 1, 2, … in `order`; the result is written once.

    Two passes over the input: one counts the rows of sessions and reads nothing but
    their key, one numbers. Sessions up to `max_rows` rows are numbered in one task each.
    Larger ones are cut at sampled splitters and numbered per range; the rows of ranges before
    are added from one small row for each session and range. For these the input is
    written first, so that the sample reads the written rows.
    """
    plain = Window.partitionBy(session).orderBy(*order)
    number = (F.row_number().over(plain) - F.lit(1)).cast("long")
    large = large_sessions(df, session, max_rows)
    total = large.agg(F.sum(F.ceil(F.col("_n") * 2 / max_rows)).alias("parts")).first()["parts"]
    if not total:
        # as many parts as a shuffle has: what is read from the result is often heavier than its bytes say
        parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        return cut_lineage(df.repartition(parts, session).withColumn(out, number))
    rows, big = cut_lineage(df), large.select("_k")
    small = rows.join(big, _same([session], ["_k"]), "left_anti").withColumn(out, number)
    placed = spread(rows.join(big, _same([session], ["_k"]), "left_semi"), session, order, int(total))
    runs = placed.groupBy(F.col(session).alias("_k"), F.col("_part").alias("_p")).agg(
        F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n")
    )
    before = Window.partitionBy("_k").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("_skip", F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first"))
    big_rows = placed.join(runs, _same([session, "_part"], ["_k", "_p"]))
    big_rows = big_rows.withColumn(out, F.col("_at") + F.col("_skip"))
    return cut_lineage(small.unionByName(big_rows.select(*small.columns)))


def _block(pos: str, rows_per_block: int) -> Column:
    return F.floor(F.col(pos) / F.lit(rows_per_block)).cast("long")


def running_sum(
    df: DataFrame,
    session: str,
    pos: str,
    sums: dict[str, Column],
    rows_per_block: int = ROWS_PER_BLOCK,
) -> DataFrame:
    """Add inclusive running sums per session in the order of `pos`."""
    key = [session, "_block"]
    parts = df.withColumn("_block", _block(pos, rows_per_block))
    parts = parts.withColumns({f"_in_{name}": expr for name, expr in sums.items()})
    before = Window.partitionBy(session).orderBy("_block").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = parts.groupBy(*key).agg(
        *[F.sum(f"_in_{name}").alias(f"_t_{name}") for name in sums]
    )
    offsets = offsets.select(
        *key,
        *[
            F.coalesce(F.sum(f"_t_{name}").over(before), F.lit(0)).alias(f"_o_{name}")
            for name in sums
        ],
    )
    inside = Window.partitionBy(*key).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    local = parts.withColumns(
        {f"_l_{name}": F.sum(f"_in_{name}").over(inside) for name in sums}
    )
    joined = local.join(offsets, key)
    out = joined.withColumns(
        {name: F.col(f"_l_{name}") + F.col(f"_o_{name}") for name in sums}
    )
    drop = ["_block"] + [f"_{tag}_{name}" for name in sums for tag in ("in", "l", "o")]
    return out.drop(*drop)


def with_previous(
    df: DataFrame,
    session: str,
    pos: str,
    columns: Sequence[str],
    prefix: str = "prev_",
    rows_per_block: int = ROWS_PER_BLOCK,
) -> DataFrame:
    """Add the values of the row before (``pos - 1``); `pos` must be dense.

    The last row of a block is sent to the next block too, so each block sees its
    own predecessor.
    """
    block = _block(pos, rows_per_block)
    copies = F.when(
        (F.col(pos) + 1) % rows_per_block == 0, F.array(block, block + 1)
    ).otherwise(F.array(block))
    spread = df.withColumn("_block", F.explode(copies))
    inside = Window.partitionBy(session, "_block").orderBy(pos)
    spread = spread.withColumns(
        {f"{prefix}{name}": F.lag(name).over(inside) for name in columns}
    )
    return spread.filter(F.col("_block") == block).drop("_block")


def value_before(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    block: Column,
    column: str,
    out: str,
) -> DataFrame:
    """Add the column's value in the row before, within `keys`; NULL for the first row.

    `block` must not decrease along `order`. The first row of a block reads the last value
    of the block before it, so a key of any size is handled in pieces. Values must not be
    NULL.
    """
    parts = df.withColumn("_block", block)
    where = [*keys, "_block"]
    ends = parts.groupBy(*where).agg(F.max_by(column, F.struct(*order)).alias("_end"))
    by_block = Window.partitionBy(*keys).orderBy("_block")
    ends = ends.withColumn("_carry", F.lag("_end").over(by_block)).drop("_end")
    inside = Window.partitionBy(*where).orderBy(*order)
    local = parts.withColumn("_lag", F.lag(column).over(inside))
    joined = local.join(ends, where)
    return joined.withColumn(out, F.coalesce("_lag", "_carry")).drop("_block", "_lag", "_carry")


def longest_run(
    df: DataFrame,
    session: str,
    pos: str,
    hit: Column,
    reset: Column,
    out: str,
    rows_per_block: int = ROWS_PER_BLOCK,
) -> DataFrame:
    """Per session, the most hits between two resets.

    A reset clears the count before its own row is looked at; rows that are neither
    leave it as it is.
    """
    key = [session, "_block"]
    inside = Window.partitionBy(*key).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    rows = df.select(
        session,
        F.col(pos).alias("_pos"),
        _block(pos, rows_per_block).alias("_block"),
        F.coalesce(hit, F.lit(False)).cast("long").alias("_hit"),
        F.coalesce(reset, F.lit(False)).alias("_reset"),
    )
    inside = Window.partitionBy(*key).orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_hits", F.sum("_hit").over(inside))
    rows = rows.withColumn(
        "_at_reset", F.max(F.when(F.col("_reset"), F.col("_hits") - F.col("_hit"))).over(inside)
    )
    blocks = rows.groupBy(*key).agg(
        F.max("_hits").alias("_total"),
        F.max("_at_reset").alias("_at_reset"),
        F.max(F.when(F.col("_at_reset").isNull(), F.col("_hits"))).alias("_lead"),
        F.max(F.col("_hits") - F.col("_at_reset")).alias("_best"),
    )
    before = Window.partitionBy(session).orderBy("_block").rowsBetween(
        Window.unboundedPreceding, -1
    )
    blocks = blocks.withColumn("_prior", F.coalesce(F.sum("_total").over(before), F.lit(0)))
    blocks = blocks.withColumn(
        "_carry",
        F.col("_prior")
        - F.coalesce(F.max(F.col("_prior") + F.col("_at_reset")).over(before), F.lit(0)),
    )
    return blocks.groupBy(session).agg(
        F.max(
            F.greatest(
                F.coalesce("_best", F.lit(0)),
                F.coalesce(F.col("_lead") + F.col("_carry"), F.lit(0)),
            )
        )
        .cast("long")
        .alias(out)
    )
