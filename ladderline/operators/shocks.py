"""Jumps of a product's rank between neighbouring days."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ladderline.model import SERIES
from ladderline.operators.series import in_series, parsed_date, prepared

COLUMNS = ["product_name", "product_url", "market", "category_key", "date", "previous_date", "previous_rank", "new_rank", "change", "change_type"]


def _all_shocks(history: DataFrame, threshold: int) -> DataFrame:
    w = in_series()
    rows = prepared(history).withColumns({"previous_rank": F.lag("rank").over(w), "previous_date": F.lag("date_kst").over(w), "previous_d": F.lag("d").over(w)})
    rows = rows.where(F.datediff("d", "previous_d") <= 2).withColumn("change", F.col("previous_rank") - F.col("rank")).where(F.abs("change") >= threshold)
    return rows.withColumns({"date": F.col("date_kst"), "new_rank": F.col("rank"), "change_type": F.when(F.col("change") > 0, "improved").otherwise("dropped")})


def order() -> list[Column]:
    return [F.desc(F.abs("change")), F.col("date"), F.col("first_seq"), F.col("row_seq"), *map(F.col, SERIES)]


def _in_order(rows: DataFrame) -> DataFrame:
    return rows.orderBy(*order()).select(*COLUMNS)


def with_recency(history: DataFrame, threshold: int = 3, days: int = 7) -> DataFrame:
    """All shocks, unsorted; is_recent says whether one is of the last days, counted from the latest shock (all are if its date can't be read)."""
    found = _all_shocks(history, threshold)
    # one row, whatever the history
    latest = found.agg(F.max("date").alias("latest")).select(F.date_format(F.date_sub(parsed_date(F.col("latest")), days), "yyyy-MM-dd").alias("cutoff"))
    return found.crossJoin(F.broadcast(latest)).withColumn("is_recent", F.col("cutoff").isNull() | (F.col("date") >= F.col("cutoff")))


def shocks(history: DataFrame, threshold: int = 3) -> DataFrame:
    """Neighbouring rows at most two days apart whose ranks differ by the threshold or more, largest first.

    A row whose rank or date can't be read breaks both of its pairs. A positive change is an improvement.
    """
    return _in_order(_all_shocks(history, threshold))


def recent_shocks(history: DataFrame, threshold: int = 3, days: int = 7) -> DataFrame:
    """Shocks of the last days, largest first."""
    return _in_order(with_recency(history, threshold, days).where("is_recent"))


def improvements(history: DataFrame, threshold: int = 3) -> DataFrame:
    return shocks(history, threshold).where("change_type = 'improved'")


def drops(history: DataFrame, threshold: int = 3) -> DataFrame:
    return shocks(history, threshold).where("change_type = 'dropped'")
