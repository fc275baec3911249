"""Running totals over long logs in two passes, so that neither a whole log nor one client's part of it is one task.

Rows are cut into blocks of time, whose bounds are quantiles of the log. Within (key, block) windows run as usual; of every
block there is one row of totals, and what is carried into a block comes from the totals of the blocks before it. As many totals as there are
blocks of a key are put in order, never the rows themselves.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = "_block"
#: Blocks of time that a log is cut into.
BLOCKS = 64


def blocked(rows: DataFrame, time: str, blocks: int = BLOCKS) -> DataFrame:
    """Adds the block of each row's time: at most so many, of about as many rows each. Rows of one instant stay together, those without a time come first.

    The bounds (fewer than `blocks` values) are taken from the rows once, so that every later reading sees the same blocks.
    """
    fractions = [k / blocks for k in range(1, blocks)]
    found = rows.agg(F.percentile_approx(time, fractions, 20 * blocks).cast("array<string>")).first()[0] if fractions else None
    bounds = list(dict.fromkeys(found or []))
    kind = rows.schema[time].dataType

    def place(low: int, high: int) -> Column:
        """The number of bounds below a time, between low and high, by halving."""
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(F.col(time) <= F.lit(bounds[middle]).cast(kind), place(low, middle)).otherwise(place(middle + 1, high))

    return rows.withColumn(BLOCK, F.when(F.col(time).isNull(), F.lit(0)).otherwise(place(0, len(bounds))))


def in_block(keys: list[str], *order: str) -> Window:
    return Window.partitionBy(*keys, BLOCK).orderBy(*order)


Carry = dict[str, tuple[Callable[[Column], Column], Column]]


def _before(totals: DataFrame, keys: list[str], carry: Carry, blocks: int) -> DataFrame:
    """Adds aggregates (sums or maxima) over the totals of the blocks before each."""
    if keys:
        earlier = Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
        return totals.withColumns({name: how(c).over(earlier) for name, (how, c) in carry.items()})
    # a whole log has so few totals that each can be handed to all later blocks; no rows have to meet in one partition
    later = totals.where(F.col(BLOCK) < blocks - 1).withColumns({f"_{name}": c for name, (_, c) in carry.items()})
    later = later.select(F.explode(F.sequence(F.col(BLOCK) + 1, F.lit(blocks - 1))).alias("_later"), *(f"_{name}" for name in carry))
    later = later.groupBy("_later").agg(*(how(F.col(f"_{name}")).alias(name) for name, (how, _) in carry.items()))
    return totals.join(F.broadcast(later), F.col(BLOCK) == F.col("_later"), "left").drop("_later")


def carried(rows: DataFrame, keys: list[str], totals: dict[str, Column], *carries: Carry, blocks: int = BLOCKS) -> DataFrame:
    """Adds to blocked rows what the blocks before theirs carry into it.

    totals are aggregates of a block; a carry is aggregated over earlier blocks from totals and from carries named before it.
    """
    sums = rows.groupBy(*keys, BLOCK).agg(*(c.alias(name) for name, c in totals.items()))
    for carry in carries:
        sums = _before(sums, keys, carry, blocks)
    own = [*keys, BLOCK]
    found = sums.select(*(F.col(k).alias(f"_of_{k}") for k in own), *(name for carry in carries for name in carry))
    same = [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in own]
    # without keys, there are no more totals than blocks
    return rows.join(found if keys else F.broadcast(found), same, "left").drop(*(f"_of_{k}" for k in own))
