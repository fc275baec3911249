"""Mergeable sketches of a rank history or an event log: distinct keys (HLL), quantiles (KLL), frequent items.

A sketch is a binary column of fixed size that Spark builds, stores and merges; a table of sketches by key and day answers questions about any
range of days without the rows. Merging gives the same kind of sketch as building from the rows at once, within the same error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Relative standard error of distinct counts: 1.04 / sqrt(2^12). Counts of a few hundred keys and fewer are exact.
LG_K, DISTINCT_ERROR = 12, 1.04 / 64
#: Size of quantile sketches, and how far (as a share of all rows) a quantile's rank may be off in 99 of 100 cases. Up to K values are kept exactly.
KLL_K, RANK_ERROR = 800, 0.0034
#: Items that a frequency sketch tracks; a count is off by no more than the rows over this number.
TRACKED = 1_000
FIELDS = ["n_rows", "distinct_keys", "quantiles", "frequent"]


def sketched(rows: DataFrame, by: list[str], key: Column, value: Column, item: Column) -> DataFrame:
    """Sketches by group: of distinct keys, of a value's distribution, and of how often items occur. Nulls of each are left out."""
    return rows.groupBy(*by).agg(
        F.count("*").alias("n_rows"),
        F.hll_sketch_agg(key, LG_K).alias("distinct_keys"),
        F.kll_sketch_agg_double(value.cast("double"), KLL_K).alias("quantiles"),
        F.call_function("approx_top_k_accumulate", item, F.lit(TRACKED)).alias("frequent"),
    )


def merged(sketches: DataFrame, by: list[str]) -> DataFrame:
    """The sketches of coarser groups; by may be empty, for all rows."""
    return sketches.groupBy(*by).agg(
        F.sum("n_rows").alias("n_rows"),
        F.hll_union_agg("distinct_keys").alias("distinct_keys"),
        F.kll_merge_agg_double("quantiles").alias("quantiles"),
        F.call_function("approx_top_k_combine", F.col("frequent"), F.lit(TRACKED)).alias("frequent"),
    )


def estimates(sketches: DataFrame, fractions: list[float], most: int) -> DataFrame:
    """What the sketches say: distinct keys, the values at these fractions, and the most frequent items with their counts."""
    quantiles = F.when(F.kll_sketch_get_n_double("quantiles") > 0, F.kll_sketch_get_quantile_double("quantiles", F.array(*map(F.lit, fractions))))
    return sketches.select(
        *(c for c in sketches.columns if c not in FIELDS),
        "n_rows",
        F.hll_sketch_estimate("distinct_keys").alias("distinct_keys"),
        quantiles.alias("quantiles"),
        F.call_function("approx_top_k_estimate", F.col("frequent"), F.lit(most)).alias("frequent"),
    )


def counted(rows: DataFrame, by: list[str], item: Column) -> DataFrame:
    """What sketches estimate, exactly: distinct items (a null is none), and how many rows the most frequent one has (a null is one)."""
    items = rows.groupBy(*by, item.alias("_item")).agg(F.count("*").alias("_n"))
    return items.groupBy(*by).agg(F.count("_item").alias("distinct_keys"), F.max("_n").alias("most_frequent"))


def around(fraction: float, steps: int = 8) -> list[float]:
    """Fractions half an error apart on both sides of one, and itself: what nearest() may choose from."""
    return [fraction + k * RANK_ERROR / 2 for k in range(-steps, steps + 1)]


def nearest(rows: DataFrame, by: list[str], value: Column, found: DataFrame, fraction: float) -> DataFrame:
    """by, quantile and off: of the values in a group's `quantiles`, the one whose rank, counted over the rows, is nearest to the fraction, and how far (as a share of the rows with a value) it is off.

    A sketch is within its error in 99 of 100 cases; the counts say so in every case. Groups without a value have nulls.
    """
    keys = [f"_key_{k}" for k in by]
    few = F.broadcast(found.select(*(F.col(k).alias(n) for k, n in zip(by, keys, strict=True)), "quantiles"))
    met = rows.select(*by, value.cast("double").alias("_value")).join(few, [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(by, keys, strict=True)])
    n = len(around(fraction))
    share = lambda met: F.avg(F.when(F.col("_value").isNotNull(), met.cast("double")))
    ranks = met.groupBy(*by).agg(F.first("quantiles").alias("_all"), *(share(F.col("_value") < F.get("quantiles", F.lit(k))).alias(f"_below{k}") for k in range(n)), *(share(F.col("_value") <= F.get("quantiles", F.lit(k))).alias(f"_upto{k}") for k in range(n)))
    off = [F.greatest(F.col(f"_below{k}") - fraction, fraction - F.col(f"_upto{k}"), F.lit(0.0)) for k in range(n)]
    best = F.array_min(F.array(*(F.when(F.col(f"_upto{k}").isNotNull(), F.struct(o.alias("off"), F.get("_all", F.lit(k)).alias("quantile"))) for k, o in enumerate(off))))
    return ranks.select(*by, best.alias("_best")).select(*by, "_best.quantile", "_best.off")


def store_sketches(sketches: DataFrame, path: str, day: str) -> None:
    """Stores sketches by their day column; a day that is stored again is replaced, other days stay."""
    sketches.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(path)


def read_sketches(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
