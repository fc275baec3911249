"""Totals of a rank history over several groupings at once, and ranks seen over frames of days and within their day."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ladderline.model import SERIES
from ladderline.operators.series import parsed_date



def _totals() -> list[Column]:
    return [F.count("*").alias("n_rows"), F.count_distinct("product_url").alias("n_products"), F.min("rank").alias("best_rank"), F.sum("rank").cast("long").alias("rank_sum"), F.grouping_id().cast("int").alias("grouping_id")]


def dimensions(history: DataFrame) -> DataFrame:
    """The history with what it is grouped by: market, category_key and month."""
    return history.withColumn("month", F.substring("date_kst", 1, 7))


def cube(history: DataFrame, by: Sequence[str]) -> DataFrame:
    """Totals of every subset of the columns. A bit of grouping_id, first column highest, says that a column is left out."""
    return dimensions(history).cube(*by).agg(*_totals())


def rollup(history: DataFrame, by: Sequence[str]) -> DataFrame:
    """Totals of every leading part of the columns."""
    return dimensions(history).rollup(*by).agg(*_totals())


def grouping_sets(history: DataFrame, sets: Sequence[Sequence[str]]) -> DataFrame:
    """Totals of each set of columns, in one pass: a row is expanded once for each set, before it is aggregated."""
    every = reduce(lambda found, own: [*found, *(c for c in own if c not in found)], sets, [])
    return dimensions(history).groupingSets([[F.col(c) for c in own] for own in sets], *every).agg(*_totals())


def rank_trends(history: DataFrame, days: int = 7) -> DataFrame:
    """Each row's rank against its series' last days (a frame of days, so that days without a rank are missing, not skipped over): mean, best, how many, and the oldest rank of the frame.

    Rows without a readable date or rank are left out.
    """
    rows = history.withColumn("day", F.datediff(parsed_date(F.col("date_kst").cast("string")), F.lit("1970-01-01").cast("date"))).where("day is not null and rank is not null")
    frame = Window.partitionBy(*SERIES).orderBy("day").rangeBetween(-(days - 1), 0)
    return rows.select(
        *SERIES,
        "date_kst",
        "rank",
        "row_seq",
        F.round(F.avg("rank").over(frame), 6).alias("mean_rank"),
        F.min("rank").over(frame).alias("best_rank"),
        F.count("rank").over(frame).alias("days_seen"),
        F.min(F.struct("day", "row_seq", "rank")).over(frame)["rank"].alias("oldest_rank"),
    )


def day_standings(history: DataFrame, tiles: int = 10) -> DataFrame:
    """Where each row stands on its day in its market and category: share of better rows, tile, and the second best rank of the day so far down the list."""
    day = Window.partitionBy("date_kst", "market", "category_key").orderBy("rank", "product_url")
    whole = day.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return history.select(
        "date_kst",
        *SERIES,
        "rank",
        F.round(F.percent_rank().over(day), 6).alias("better_share"),
        F.round(F.cume_dist().over(day), 6).alias("cumulative_share"),
        F.ntile(tiles).over(day).alias("tile"),
        F.nth_value("rank", 2).over(day).alias("second_so_far"),
        F.nth_value("product_url", 3).over(whole).alias("third_product"),
        F.dense_rank().over(Window.partitionBy("date_kst", "market", "category_key").orderBy((F.col("rank") / 5).cast("int"))).alias("group_of_five"),
    )
