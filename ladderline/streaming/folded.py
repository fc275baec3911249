"""Standings and shocks of a stream by whole batches: each batch is merged with the state of the batch before in built-in expressions.

The state is two tables, written anew with every batch: a row for each series (its first number, best rank and latest row), and for each series and threshold that it has
ever been within, the summary of its runs (run_summaries) and its entries. A batch that is replayed starts from the state of the batch
before it, which is kept until the batch after it is done. Rows that are older than the last one of their series are left out, as in standings.
No row goes to Python; standings.standings() is the form for series that expire, and for few series with many small batches.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ladderline.model import DEFAULT_THRESHOLDS, SERIES
from ladderline.operators import run_summaries
from ladderline.operators.series import cleaned, parsed_date, with_thresholds
from ladderline.streaming.ranks import SHOCKS
from ladderline.streaming.sinks import BATCH, committed_batches, read_batches, write_batch
from ladderline.streaming.standings import STANDING

_LATEST = "struct<date_kst:string,row_seq:bigint,product_name:string,rank:int>"
_SEEN = "struct<date_kst:string,row_seq:bigint,rank:int>"
SERIES_STATE = ", ".join([*(f"{c} string" for c in SERIES), f"first_seq long, best_rank int, latest {_LATEST}"])
FACTS = {"first_inside": _SEEN, "last_inside": _SEEN, "rows_inside": "bigint"}
TOPS_STATE = ", ".join([*(f"{c} string" for c in SERIES), "n int, threshold_pos int", *(f"{c} {kind}" for c, kind in (run_summaries.SUMMARY | FACTS).items())])


def _state(spark: SparkSession, path: str, name: str, schema: str, before: int | None = None) -> DataFrame:
    """The state after the last committed batch (before one)."""
    ids = [k for k in committed_batches(spark, f"{path}/{name}") if before is None or k < before]
    return spark.read.schema(schema).parquet(f"{path}/{name}/{BATCH}={ids[-1]}") if ids else spark.createDataFrame([], schema)


def _forget(spark: SparkSession, path: str, name: str, batch: int) -> None:
    """Removes the states that neither readers nor a replay of this batch need."""
    for k in [k for k in committed_batches(spark, f"{path}/{name}") if k < batch][:-1]:
        where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}/{BATCH}={k}")
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def _fresh(rows: DataFrame, series: DataFrame) -> DataFrame:
    """A batch's rows and a row for every known series, by series, with the series' state; rows that are not newer than it are left out."""
    state = F.struct("first_seq", "best_rank", "latest").alias("state")
    known = series.select(*SERIES, state)
    both = rows.withColumn("state", F.lit(None).cast(known.schema["state"].dataType)).unionByName(known, allowMissingColumns=True)
    whole = Window.partitionBy(*SERIES).orderBy("date_kst", "row_seq").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    both = both.withColumn("before", F.max("state").over(whole)).withColumn("own", F.col("state").isNull())
    at = F.struct("date_kst", "row_seq")
    return both.where(~F.col("own") | F.col("before").isNull() | (at > F.struct("before.latest.date_kst", "before.latest.row_seq")))


def _next_series(fresh: DataFrame) -> DataFrame:
    latest = F.when(F.col("own"), F.struct("date_kst", "row_seq", "product_name", "rank")).otherwise(F.col("state.latest")).cast(_LATEST)
    return fresh.groupBy(*SERIES).agg(F.min(F.coalesce("state.first_seq", "row_seq")).alias("first_seq"), F.min(F.coalesce("state.best_rank", "rank")).alias("best_rank"), F.max(latest).alias("latest"))


def _tops_of(fresh: DataFrame, thresholds: Sequence[int]) -> DataFrame:
    """Summaries and entries of a batch's rows, of the series and thresholds that the series has been within by now. Before its first row inside, no row of a series matters to its runs."""
    best = F.least(F.col("before.best_rank"), F.min(F.when(F.col("own"), F.col("rank"))).over(Window.partitionBy(*SERIES).orderBy("date_kst", "row_seq").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    rows = fresh.withColumn("best", best).where("own").where(F.col("best") <= max(thresholds))
    rows = rows.withColumn("first_seq", F.least("before.first_seq", F.min("row_seq").over(Window.partitionBy(*SERIES)))).drop("before", "state")
    rows = with_thresholds(rows, thresholds).where(F.col("best") <= F.col("n"))
    found = run_summaries.summarised_rows(rows.withColumn("block", F.lit(""))).drop("block")
    seen = F.when(F.col("rank") <= F.col("n"), F.struct("date_kst", "row_seq", "rank"))
    facts = rows.groupBy(*SERIES, "n", "threshold_pos").agg(F.min(seen).alias("first_inside"), F.max(seen).alias("last_inside"), F.count(seen).alias("rows_inside"))
    return found.join(facts, [*SERIES, "n", "threshold_pos"])


def _merged_tops(tops: DataFrame) -> DataFrame:
    keys = [*SERIES, "n", "threshold_pos"]
    facts = tops.groupBy(*keys).agg(F.min("first_inside").alias("first_inside"), F.max("last_inside").alias("last_inside"), F.sum("rows_inside").alias("rows_inside"))
    return run_summaries.in_one(tops).join(facts, keys)


def keep_folded(path: str, thresholds: Sequence[int] | None = None) -> Callable[[DataFrame, int], None]:
    """For foreachBatch over a stream of a rank history: brings the state at the path up to the batch. A batch that is replayed replaces its state."""
    known = list(thresholds or DEFAULT_THRESHOLDS)

    def fold(rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        fresh = _fresh(cleaned(rows), _state(spark, path, "series", SERIES_STATE, batch))
        tops = _state(spark, path, "tops", TOPS_STATE, batch)
        write_batch(_merged_tops(tops.unionByName(_tops_of(fresh, known))), f"{path}/tops", batch)
        write_batch(_next_series(fresh), f"{path}/series", batch)
        for name in ("tops", "series"):
            _forget(spark, path, name, batch)

    return fold


def latest_folded(spark: SparkSession, path: str, thresholds: Sequence[int] | None = None) -> DataFrame:
    """The standing of every series and threshold, as standings.latest_standings() gives it. A batch counts once both of its tables are committed, series last."""
    done = committed_batches(spark, f"{path}/series")
    before = done[-1] + 1 if done else 0
    keys = [*SERIES, "n", "threshold_pos"]
    tops = _state(spark, path, "tops", TOPS_STATE, before)
    best = run_summaries.with_best(tops).select(*keys, "first_inside", "last_inside", "rows_inside", F.col("last.inside").alias("inside"), "_best")
    series = with_thresholds(_state(spark, path, "series", SERIES_STATE, before), thresholds)
    values = {
        "product_name": F.col("latest.product_name"),
        "latest_date": F.col("latest.date_kst"),
        "latest_rank": F.col("latest.rank"),
        "is_active": F.coalesce("inside", F.lit(False)),
        "streak_days": F.coalesce(-F.col("_best.minus_days"), F.lit(0)),
        "streak_start": F.col("_best.start"),
        "streak_end": F.col("_best.end"),
        "first_date": F.col("first_inside.date_kst"),
        "first_rank": F.col("first_inside.rank"),
        "last_date": F.col("last_inside.date_kst"),
        "last_rank": F.col("last_inside.rank"),
        "rows_inside": F.coalesce("rows_inside", F.lit(0)),
        "expired": F.lit(False),
    }
    found = series.join(best, keys, "left").withColumns(values)
    return found.select(*(F.col(f.name).cast(f.dataType) for f in STANDING))


_LAST = ", ".join([*(f"{c} string" for c in SERIES), "date_kst string, row_seq long, rank int"])


def keep_shocks(path: str, threshold: int = 3) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: each batch's shocks in a folder of its own, between neighbouring rows of a series in it and the last row of the batches before. Rows without row_seq are numbered in their order."""

    def step(rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        known = _state(spark, path, "last", _LAST, batch).withColumns({"d": parsed_date(F.col("date_kst")), "own": F.lit(False)})
        both = cleaned(rows).withColumn("own", F.lit(True)).unionByName(known, allowMissingColumns=True)
        # a state comes before the rows of its date; older rows come before it, and are left out
        w = Window.partitionBy(*SERIES).orderBy("date_kst", "own", "row_seq")
        both = both.withColumn("known", F.coalesce(F.max(~F.col("own")).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), F.lit(False)))
        both = both.withColumn("reached", F.coalesce(F.max(~F.col("own")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)), F.lit(False))).where(F.col("reached") | ~F.col("known"))
        write_batch(both.groupBy(*SERIES).agg(F.max(F.struct("date_kst", "own", "row_seq", "rank")).alias("_l")).select(*SERIES, "_l.date_kst", "_l.row_seq", "_l.rank"), f"{path}/last", batch)
        found = both.withColumns({"previous_rank": F.lag("rank").over(w), "previous_date": F.lag("date_kst").over(w), "previous_d": F.lag("d").over(w)}).where("own")
        change = F.col("previous_rank") - F.col("rank")
        found = found.where((F.datediff("d", "previous_d") <= 2) & (F.abs(change) >= threshold)).select("product_name", *SERIES, F.col("date_kst").alias("date"), "previous_date", "previous_rank", F.col("rank").alias("new_rank"), change.alias("change"), F.when(change > 0, "improved").otherwise("dropped").alias("change_type"))
        write_batch(found, f"{path}/shocks", batch)
        _forget(spark, path, "last", batch)

    return step


def folded_shocks(spark: SparkSession, path: str) -> DataFrame:
    return read_batches(spark, f"{path}/shocks", SHOCKS).drop(BATCH)
