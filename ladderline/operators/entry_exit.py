"""Products that came into the first n ranks lately, or left them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ladderline.model import SERIES
from ladderline.operators.series import parsed_date, prepared, stable_order, with_reached

ENTRY_COLUMNS = ["product_name", "product_url", "market", "category_key", "entry_date", "entry_rank", "top_n_threshold", "current_rank"]
EXIT_COLUMNS = ["product_name", "product_url", "market", "category_key", "exit_date", "last_rank_in_top_n", "top_n_threshold", "days_in_top_n"]
#: The cutoff where the latest date can't be read.
NO_CUTOFF = "2000-01-01"


def facts(history: DataFrame, thresholds: Sequence[int] | None = None, lookback_days: int = 7) -> DataFrame:
    """By series and threshold: the latest row, the first and last row inside, how many are inside; and the latest date of all."""
    place = F.struct("date_kst", "row_seq")
    rows = with_reached(prepared(history), thresholds)
    inside = F.when(F.col("rank") <= F.col("n"), F.struct("date_kst", "row_seq", "rank"))
    found = rows.groupBy(*SERIES, "n", "threshold_pos", "first_seq").agg(
        F.max_by(F.struct("date_kst", "rank", "product_name"), place).alias("latest"),
        F.min(inside).alias("first"),
        F.max(inside).alias("last"),
        F.count(inside).cast("int").alias("days"),
    )
    # one row, whatever the history
    dates = history.where(F.coalesce(F.col("date_kst"), F.lit("")) != "").agg(F.max("date_kst").alias("latest_date"))
    dates = dates.withColumn("cutoff", F.coalesce(F.date_format(F.date_sub(parsed_date(F.col("latest_date")), lookback_days), "yyyy-MM-dd"), F.lit(NO_CUTOFF)))
    return found.where("first is not null").crossJoin(F.broadcast(dates)).withColumn("top_n_threshold", F.col("n")).withColumn("product_name", F.col("latest.product_name"))


def order(date: str) -> list[Column]:
    """Latest first."""
    return [F.desc(date), *stable_order()]


def entries_of(known: DataFrame) -> DataFrame:
    """Series that first got inside within the lookback and are inside on the latest date of the whole history, unsorted.

    A latest rank that can't be read counts as 0.
    """
    found = known.withColumn("current_rank", F.coalesce("latest.rank", F.lit(0)))
    found = found.where((F.col("first.date_kst") >= F.col("cutoff")) & (F.col("latest.date_kst") == F.col("latest_date")) & (F.col("current_rank") <= F.col("n")))
    return found.withColumns({"entry_date": F.col("first.date_kst"), "entry_rank": F.col("first.rank")})


def exits_of(known: DataFrame) -> DataFrame:
    """Series that were inside within the lookback but are not on the latest date of the whole history, unsorted.

    The exit's date is the last one inside; series whose latest rank can't be read are left out.
    """
    found = known.where("latest.rank is not null")
    still = (F.col("latest.date_kst") == F.col("latest_date")) & (F.col("latest.rank") <= F.col("n"))
    found = found.where(~still & (F.col("last.date_kst") >= F.col("cutoff")))
    return found.withColumns({"exit_date": F.col("last.date_kst"), "last_rank_in_top_n": F.col("last.rank"), "days_in_top_n": F.col("days")})


def new_entries(history: DataFrame, thresholds: Sequence[int] | None = None, lookback_days: int = 7) -> DataFrame:
    return entries_of(facts(history, thresholds, lookback_days)).orderBy(*order("entry_date")).select(*ENTRY_COLUMNS)


def exits(history: DataFrame, thresholds: Sequence[int] | None = None, lookback_days: int = 7) -> DataFrame:
    return exits_of(facts(history, thresholds, lookback_days)).orderBy(*order("exit_date")).select(*EXIT_COLUMNS)


def latest_rows(history: DataFrame) -> DataFrame:
    """The last row of each series: its date and rank."""
    place = F.struct("date_kst", "row_seq")
    return prepared(history).groupBy(*SERIES).agg(F.max_by("date_kst", place).alias("date_kst"), F.max_by("rank", place).alias("rank"))
