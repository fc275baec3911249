"""How long a product stayed within the first n ranks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ladderline.model import SERIES
from ladderline.operators.series import in_series, prepared, stable_order, whole_series, with_reached

COLUMNS = ["product_name", "product_url", "market", "category_key", "top_n_threshold", "streak_days", "streak_start", "streak_end", "current_rank", "is_active"]


def best_streaks(history: DataFrame, thresholds: Sequence[int] | None = None) -> DataFrame:
    """The longest streak of each series and threshold, the earliest of equals, unsorted, with what order() needs.

    A streak is a run of rows in the first n whose dates are at most a day apart; it counts rows. A run that is cut
    off by a date that can't be read does not compete. is_active says whether a run is open at the series' last valid row.
    """
    whole = whole_series()
    rows = prepared(history).withColumn("product_name", F.last("product_name").over(whole)).withColumn("last_rank", F.last("rank").over(whole))
    rows = with_reached(rows, thresholds).where(F.col("rank").isNotNull() & (F.col("date_kst") != "")).withColumn("inside", F.col("rank") <= F.col("n"))
    w = in_series("n", "threshold_pos")
    goes_on = F.col("inside") & F.lag("inside").over(w) & (F.datediff("d", F.lag("d").over(w)) <= 1)
    rows = rows.withColumns(
        {
            "begins": F.when(F.col("inside") & ~F.coalesce(goes_on, F.lit(False)), 1).otherwise(0),
            # the next row is inside too, but the step to it can't be measured
            "lost": F.coalesce(F.lead("inside").over(w), F.lit(False)) & F.datediff(F.lead("d").over(w), "d").isNull(),
            "is_active": F.last("inside").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
        }
    )
    rows = rows.withColumn("run", F.sum("begins").over(w)).where("inside")
    place = F.struct("date_kst", "row_seq")
    runs = rows.groupBy(*SERIES, "n", "threshold_pos", "run", "first_seq", "product_name", "last_rank", "is_active").agg(
        F.count("*").cast("int").alias("streak_days"),
        F.min_by("date_kst", place).alias("streak_start"),
        F.max_by("date_kst", place).alias("streak_end"),
        F.max_by("lost", place).alias("lost"),
    )
    best = F.row_number().over(Window.partitionBy(*SERIES, "n", "threshold_pos").orderBy(F.desc("streak_days"), "run"))
    found = runs.where("not lost").withColumn("best", best).where("best = 1")
    return found.withColumn("current_rank", F.when(F.col("is_active"), F.col("last_rank"))).withColumn("top_n_threshold", F.col("n"))


def order() -> list[Column]:
    return [F.desc("streak_days"), *stable_order()]


def streaks(history: DataFrame, thresholds: Sequence[int] | None = None) -> DataFrame:
    """The best streaks, longest first."""
    return best_streaks(history, thresholds).orderBy(*order()).select(*COLUMNS)


def active_streaks(history: DataFrame, thresholds: Sequence[int] | None = None) -> DataFrame:
    return streaks(history, thresholds).where("is_active")
