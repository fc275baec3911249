"""Rank histories derived from the star-schema tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _numbered(rows: DataFrame, by: list[Column]) -> DataFrame:
    """Adds row_seq: days since 1970, rank and market order in one number, so that no global sort is needed."""
    day = F.datediff(F.to_date("date_kst"), F.lit("1970-01-01").cast("date")).cast("long")
    return rows.withColumn("row_seq", day * 100_000_000 + F.col("rank").cast("long") * 10 + sum(by, F.lit(0)))


def rank_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users ranked by value within each day (UTC+9) and event type."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("ts", "user_id", "event_type", "value")
    daily = events.groupBy(F.date_format(F.col("ts") + F.expr("interval 9 hours"), "yyyy-MM-dd").alias("date_kst"), F.col("event_type").alias("market"), "user_id").agg(F.sum(F.col("value").cast("decimal(18,2)")).alias("total"))
    rank = F.row_number().over(Window.partitionBy("date_kst", "market").orderBy(F.desc("total"), "user_id"))
    rows = daily.select(
        "date_kst",
        "market",
        F.lit("all").alias("category_key"),
        rank.cast("int").alias("rank"),
        F.concat(F.lit("User "), F.col("user_id").cast("string")).alias("product_name_raw"),
        F.concat(F.lit("https://example.com/u/"), F.col("user_id").cast("string")).alias("product_url"),
    )
    order = [F.when(F.col("market") == m, k).otherwise(0) for k, m in enumerate(("click", "error", "purchase", "signup", "view"))]
    return _numbered(rows, order)


def rank_brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands ranked by revenue within each ship date."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_partkey", "l_shipdate", "l_extendedprice")
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_brand")
    daily = items.join(parts, F.col("l_partkey") == F.col("p_partkey")).groupBy(F.date_format("l_shipdate", "yyyy-MM-dd").alias("date_kst"), "p_brand").agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("total"))
    rank = F.row_number().over(Window.partitionBy("date_kst").orderBy(F.desc("total"), "p_brand"))
    rows = daily.select(
        "date_kst",
        F.lit("brands").alias("market"),
        F.lit("all").alias("category_key"),
        rank.cast("int").alias("rank"),
        F.col("p_brand").alias("product_name_raw"),
        F.concat(F.lit("https://example.com/b/"), F.col("p_brand")).alias("product_url"),
    )
    return _numbered(rows, [])
