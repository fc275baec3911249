"""What all analyses of rank series share: cleaned dates and ranks, and one partitioning by series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ladderline.model import DEFAULT_THRESHOLDS, SERIES


def parsed_date(text: Column) -> Column:
    """A date of four-digit year, month and day, padded or not; null for anything else."""
    return F.when(text.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), F.try_to_date(text, "y-M-d"))


def whole_rank(rank: Column, kind: T.DataType) -> Column:
    """A rank as int(): fractions of numbers are cut off, texts have to be whole numbers, anything else is null."""
    if isinstance(kind, T.StringType):
        return F.when(rank.rlike(r"^\s*[+-]?\d+\s*$"), F.trim(rank).try_cast("int"))
    return rank.try_cast("int")


def cleaned(history: DataFrame) -> DataFrame:
    """Rows with clean keys, date_kst, d (a date or null), rank, product_name and row_seq."""
    rows = history if "row_seq" in history.columns else history.withColumn("row_seq", F.monotonically_increasing_id())
    kind = history.schema["rank"].dataType
    text = F.coalesce(F.col("date_kst").cast("string"), F.lit(""))
    keys = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in SERIES]
    return rows.select(*keys, text.alias("date_kst"), parsed_date(text).alias("d"), whole_rank(F.col("rank"), kind).alias("rank"), F.coalesce("product_name_raw", F.lit("")).alias("product_name"), "row_seq")


def prepared(history: DataFrame) -> DataFrame:
    """The cleaned rows, dealt out by series.

    first_seq is the place of the series' first row; it decides ties between series. Every later window and
    aggregate is by series (and threshold), so that this exchange is the only one; windows by series alone share one sort.
    """
    return cleaned(history).repartition(*SERIES).withColumn("first_seq", F.min("row_seq").over(whole_series()))


def in_series(*more: str) -> Window:
    return Window.partitionBy(*SERIES, *more).orderBy("date_kst", "row_seq")


def whole_series(*more: str) -> Window:
    """All rows of a series, in the order of in_series(), so that both are of one sort."""
    return in_series(*more).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def with_thresholds(rows: DataFrame, thresholds: Sequence[int] | None) -> DataFrame:
    """Each row once for every threshold, with the threshold's place in the list; no list or an empty one means the defaults."""
    known = list(thresholds or DEFAULT_THRESHOLDS)
    both = F.array(*(F.struct(F.lit(k).alias("threshold_pos"), F.lit(int(n)).alias("n")) for k, n in enumerate(known)))
    return rows.withColumn("t", F.explode(both)).select("*", "t.*").drop("t")


def with_reached(rows: DataFrame, thresholds: Sequence[int] | None) -> DataFrame:
    """Prepared rows once for every threshold that their series has ever been within; at others a series has no runs and no entries."""
    rows = rows.withColumn("_reached", F.min("rank").over(whole_series())).where(F.col("_reached") <= max(map(int, thresholds or DEFAULT_THRESHOLDS)))
    return with_thresholds(rows, thresholds).where(F.col("_reached") <= F.col("n")).drop("_reached")


def stable_order() -> list[Column]:
    """Ties follow the series' first row, then the threshold list; the keys make the order total."""
    return [F.col("first_seq"), F.col("threshold_pos"), *map(F.col, SERIES)]
