"""The stored tables: rank history (append without duplicates) and run log."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.utils import AnalysisException

from ladderline.model import FETCH_LOG, RANK_HISTORY, RUN_LOG

KEY_COLUMNS = ["date_kst", "market", "category_key", "rank", "product_url"]
#: How many items a page may have.
LEAST_ITEMS, MOST_ITEMS = 1, 100
#: Files of the history are laid out by what queries filter on.
PARTITIONS = ["market", "category_key"]
#: Most folders that an append names in its filter; beyond, it joins.
MOST_FOLDERS = 200


def row_key() -> Column:
    """MD5 of the key columns with a bar between them, nulls as empty texts."""
    return F.md5(F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in KEY_COLUMNS)))


def read_history(spark: SparkSession, path: str, market: str | None = None, category_key: str | None = None, days: int | None = None) -> DataFrame:
    """The stored history, empty where nothing is stored. days is accepted and has no effect, as in the former API."""
    try:
        rows = spark.read.schema(RANK_HISTORY).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = spark.createDataFrame([], RANK_HISTORY)
    return filtered(rows, market, category_key)


def filtered(rows: DataFrame, market: str | None = None, category_key: str | None = None) -> DataFrame:
    """Rows with a date; an empty or missing filter value means no filter."""
    rows = rows.where(F.col("date_kst").isNotNull())
    if market:
        rows = rows.where(F.col("market") == market)
    return rows.where(F.col("category_key") == category_key) if category_key else rows


def unique_dates(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("date_kst") != "").select("date_kst").distinct().orderBy("date_kst")


def new_rows(snapshots: DataFrame, stored: DataFrame) -> DataFrame:
    """Snapshots whose key is neither stored nor that of an earlier snapshot. The first of equal keys wins.

    Snapshots without row_seq are numbered in their order. The stored keys are anti-joined by Spark's choice of join.
    """
    rows = snapshots if "row_seq" in snapshots.columns else snapshots.withColumn("row_seq", F.monotonically_increasing_id())
    rows = rows.withColumn("row_key", row_key())
    first = F.row_number().over(Window.partitionBy("row_key").orderBy("row_seq"))
    keys = stored.select(row_key().alias("row_key")) if "row_key" not in stored.columns else stored.select(F.coalesce("row_key", row_key()).alias("row_key"))
    return rows.withColumn("_nth", first).where("_nth = 1").drop("_nth").join(keys, "row_key", "left_anti")


def snapshot_rows(snapshots: DataFrame) -> DataFrame:
    """Snapshots as rows of the history: its columns in its order, missing ones null, a missing brand empty."""
    absent = {f.name: F.lit(None).cast(f.dataType) for f in RANK_HISTORY if f.name not in snapshots.columns}
    return snapshots.withColumns(absent).withColumn("brand_raw", F.coalesce("brand_raw", F.lit(""))).select(*[F.col(f.name).cast(f.dataType) for f in RANK_HISTORY])


def _could_match(spark: SparkSession, path: str, snapshots: DataFrame) -> DataFrame:
    """The stored rows that can have a key of the snapshots: those of its markets and categories, which are folders, and its dates, which
    files have bounds of. The keys hold all three, so that nothing else has to be read. A join prunes where there are too many folders to name."""
    stored = read_history(spark, path)
    found = snapshots.agg(F.min("date_kst").alias("first"), F.max("date_kst").alias("last"), F.count_if(F.col("date_kst").isNull()).alias("undated")).first()
    if not found["undated"] and found["first"] is not None:
        stored = stored.where(F.col("date_kst").between(found["first"], found["last"]))
    folders = snapshots.select(*PARTITIONS).distinct()
    named = folders.limit(MOST_FOLDERS + 1).collect()
    if len(named) > MOST_FOLDERS:
        return stored.join(folders, PARTITIONS, "left_semi")
    same = (reduce(and_, (F.col(c).eqNullSafe(F.lit(row[c])) for c in PARTITIONS)) for row in named)
    return stored.where(reduce(or_, same, F.lit(False)))


def append_snapshots(spark: SparkSession, path: str, snapshots: DataFrame) -> int:
    """Appends what is new and returns how many rows that is; nothing is written if there is none."""
    added = snapshot_rows(new_rows(snapshots, _could_match(spark, path, snapshots)))
    # new rows come after the stored ones, whatever their own numbers; the largest number comes from the files' statistics
    base = (read_history(spark, path).agg(F.max("row_seq")).first()[0] or 0) + 1
    added = added.withColumn("row_seq", F.col("row_seq") + base).persist()
    try:
        count = added.count()
        if count:
            added.write.partitionBy(*PARTITIONS).mode("append").parquet(path)
        return count
    finally:
        added.unpersist()


def _read_log(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def read_run_logs(spark: SparkSession, path: str) -> DataFrame:
    return _read_log(spark, path, RUN_LOG)


def append_run_log(spark: SparkSession, path: str, rows: DataFrame) -> None:
    """Run logs are appended as they are, duplicates included."""
    rows.select(*[F.col(f.name).cast(f.dataType) for f in RUN_LOG]).write.mode("append").parquet(path)


def read_fetch_log(spark: SparkSession, path: str) -> DataFrame:
    return _read_log(spark, path, FETCH_LOG)


def append_fetch_log(spark: SparkSession, path: str, rows: DataFrame) -> None:
    rows.select(*[F.col(f.name).cast(f.dataType) for f in FETCH_LOG]).write.mode("append").parquet(path)


def requests_on(log: DataFrame, date_kst: str) -> int:
    """How many successful requests a fetch log, whose times are in UTC, has on a day in KST."""
    return log.where("success").where(F.date_format(F.col("ts") + F.expr("interval 9 hours"), "yyyy-MM-dd") == date_kst).count()


def with_brand(rows: DataFrame, keywords: list[str]) -> DataFrame:
    """Opt-in filter: brand or name contains one of the keywords, whatever the case. No keywords, no filter."""
    if not keywords:
        return rows
    text = F.lower(F.concat_ws(" ", "brand_raw", "product_name_raw"))
    return rows.where(F.exists(F.array(*(F.lit(k.lower()) for k in keywords)), lambda k: F.contains(text, k)))


def page_faults(rows: DataFrame, least: int = LEAST_ITEMS, most: int = MOST_ITEMS) -> DataFrame:
    """Opt-in check: pages (run, category, date) with too few or too many items, or items without rank, name or URL. Rows without a run_id column are of one run."""
    lacks = F.col("rank").isNull() | (F.coalesce("product_name_raw", F.lit("")) == "") | (F.coalesce("product_url", F.lit("")) == "")
    run = ["run_id"] if "run_id" in rows.columns else []
    pages = rows.groupBy(*run, "date_kst", "market", "category_key").agg(F.count("*").alias("n_items"), F.count_if(lacks).alias("n_incomplete"))
    return pages.where((F.col("n_incomplete") > 0) | ~F.col("n_items").between(least, most))
