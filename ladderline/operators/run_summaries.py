"""Summaries of runs within the first n ranks, by series and block of dates, that are stored and merged instead of reading history again.

A summary of the valid rows of a series in a block says which row is first and last and whether they are inside, which run touches the first row
(head), which touches the last (tail), and which is the best of those in between. Two neighbouring blocks merge
into the summary of both: a run that touches the seam is joined, kept apart, or lost, as the step between the two rows says. Merging
is associative, so that any split of the dates gives the same streaks, and a new day costs a summary of that day.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ladderline.model import DEFAULT_THRESHOLDS, SERIES
from ladderline.operators.series import cleaned

#: A run; its first fields put the best run first: most days, then the earliest start. whole: it is all of the block's valid rows.
_RUN = "struct<minus_days:int,start:string,start_seq:bigint,end:string,lost:boolean,whole:boolean>"
_EDGE = "struct<date_kst:string,row_seq:bigint,d:date,inside:boolean>"
SUMMARY = {"rows": "bigint", "first": _EDGE, "last": _EDGE, "head": _RUN, "tail": _RUN, "best": _RUN, "first_seq": "bigint", "low": "struct<date_kst:string,row_seq:bigint>", "latest": "struct<date_kst:string,row_seq:bigint,product_name:string,rank:int>"}
_KEYS = [*SERIES, "n", "threshold_pos"]


def month(date_kst: Column) -> Column:
    """The block of a date: its month. A block has to keep the order of dates."""
    return F.substring(date_kst, 1, 7)


def _run(minus_days: Column, start: Column, start_seq: Column, end: Column, lost: Column, whole: Column) -> Column:
    return F.struct(minus_days.alias("minus_days"), start.alias("start"), start_seq.alias("start_seq"), end.alias("end"), lost.alias("lost"), whole.alias("whole"))


def summarised(history: DataFrame, thresholds: Sequence[int] | None = None, block: Callable[[Column], Column] = month) -> DataFrame:
    """One row a series, threshold and block, with the summary's fields. All steps are by series, over one exchange."""
    return summarised_series(cleaned(history).withColumn("block", block(F.col("date_kst"))), [F.struct(F.lit(k).alias("threshold_pos"), F.lit(int(n)).alias("n")) for k, n in enumerate(thresholds or DEFAULT_THRESHOLDS)])


def summarised_series(rows: DataFrame, thresholds: Sequence[Column]) -> DataFrame:
    """The summaries of cleaned rows with their blocks, one for each threshold. A row is sorted once, whatever the number of thresholds, which meet only in the summaries."""
    # a hash and a struct: keys that are the same in all rows would be taken for constants, and exchange and sort would not be seen to fit
    by = ["_hash", "_series"]
    rows = rows.withColumns({"_hash": F.xxhash64(*SERIES), "_series": F.struct(*SERIES, "block")}).drop(*SERIES, "block").repartition("_hash")
    valid = F.col("rank").isNotNull() & (F.col("date_kst") != "")
    w = Window.partitionBy(*by, "valid").orderBy("date_kst", "row_seq")
    here, at = F.struct("date_kst", "row_seq"), F.struct("date_kst", "row_seq", F.col("nth").alias("nth"))
    rows = rows.withColumn("valid", valid).withColumns({"nth": F.row_number().over(w), "before": F.lag("rank").over(w), "after": F.lead("rank").over(w), "d_before": F.lag("d").over(w), "d_after": F.lead("d").over(w)})
    inside = lambda rank, t: F.coalesce(F.col(rank) <= t["n"], F.lit(False))
    goes_on, stays = F.datediff("d", "d_before") <= 1, F.datediff("d_after", "d") <= 1
    begins = {f"begin{k}": F.when(F.col("valid") & inside("rank", t) & ~(inside("before", t) & F.coalesce(goes_on, F.lit(False))), at) for k, t in enumerate(thresholds)}
    rows = rows.withColumns(begins).withColumns({c: F.last(c, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)) for c in begins})
    edge = F.when(F.col("valid"), F.struct("date_kst", "row_seq", "d", "rank"))
    kept = {"rows": F.sum(F.col("valid").cast("long")), "first": F.min(edge), "last": F.max(edge), "first_seq": F.min("row_seq"), "low": F.min(here), "latest": F.max(F.struct("date_kst", "row_seq", "product_name", "rank"))}
    for k, t in enumerate(thresholds):
        begin = F.col(f"begin{k}")
        ends = F.col("valid") & inside("rank", t) & ~(inside("after", t) & F.coalesce(stays, F.lit(False)))
        lost = inside("after", t) & F.datediff("d_after", "d").isNull()
        is_first, is_last = begin["nth"] == 1, F.col("after").isNull()
        run = _run((begin["nth"] - F.col("nth") - 1).cast("int"), begin["date_kst"], begin["row_seq"], F.col("date_kst"), lost, is_first & is_last)
        kept |= {f"head{k}": F.min(F.when(ends & is_first, run)), f"tail{k}": F.min(F.when(ends & is_last, run)), f"best{k}": F.min(F.when(ends & ~is_first & ~is_last & ~lost, run))}
    found = rows.groupBy(*by).agg(*(v.alias(c) for c, v in kept.items()))
    own_edge = lambda c, t: F.when(F.col(c).isNotNull(), F.struct(*(F.col(c)[x].alias(x) for x in ("date_kst", "row_seq", "d")), (F.col(c)["rank"] <= t["n"]).alias("inside")))
    each = F.array(*(F.struct(t["n"].alias("n"), t["threshold_pos"].alias("threshold_pos"), own_edge("first", t).alias("first"), own_edge("last", t).alias("last"), *(F.col(f"{c}{k}").alias(c) for c in ("head", "tail", "best"))) for k, t in enumerate(thresholds)))
    found = found.select("_series", "rows", "first_seq", "low", "latest", F.explode(each).alias("t")).select("_series.*", "rows", "first_seq", "low", "latest", "t.*")
    return found.select(*_KEYS, "block", *(F.col(c).cast(kind).alias(c) for c, kind in SUMMARY.items()))


def summarised_rows(rows: DataFrame) -> DataFrame:
    """The summaries of prepared rows with their thresholds and blocks."""
    valid = F.col("rank").isNotNull() & (F.col("date_kst") != "")
    rows = rows.withColumn("valid", valid).withColumn("inside", valid & (F.col("rank") <= F.col("n")))
    by = [*_KEYS, "block", "valid"]
    w = Window.partitionBy(*by).orderBy("date_kst", "row_seq")
    goes_on = F.col("inside") & F.lag("inside").over(w) & (F.datediff("d", F.lag("d").over(w)) <= 1)
    rows = rows.withColumns(
        {
            "begins": F.when(F.col("inside") & ~F.coalesce(goes_on, F.lit(False)), 1).otherwise(0),
            "lost": F.coalesce(F.lead("inside").over(w), F.lit(False)) & F.datediff(F.lead("d").over(w), "d").isNull(),
            "is_first": F.row_number().over(w) == 1,
            "is_last": F.lead("valid").over(w).isNull(),
        }
    ).withColumn("run", F.when(F.col("inside"), F.sum("begins").over(w)))
    place, edge = F.struct("date_kst", "row_seq"), F.struct("date_kst", "row_seq", "d", "inside")
    runs = rows.groupBy(*by, "run").agg(
        F.count("*").alias("rows"),
        F.min(place).alias("low"),
        F.max(F.struct("date_kst", "row_seq", "product_name", "rank")).alias("latest"),
        F.min("first_seq").alias("first_seq"),
        F.min(edge).alias("first"),
        F.max(edge).alias("last"),
        F.max_by("lost", place).alias("lost"),
        F.bool_or("is_first").alias("is_first"),
        F.bool_or("is_last").alias("is_last"),
    )
    run = F.when(F.col("run").isNotNull(), _run((-F.col("rows")).cast("int"), F.col("low.date_kst"), F.col("low.row_seq"), F.col("last.date_kst"), F.col("lost"), F.col("is_first") & F.col("is_last")))
    inner = ~F.col("is_first") & ~F.col("is_last") & ~F.col("lost")
    found = runs.withColumn("own", run).groupBy(*_KEYS, "block").agg(
        F.sum(F.when(F.col("valid"), F.col("rows")).otherwise(0)).alias("rows"),
        F.min(F.when(F.col("valid"), F.col("first"))).alias("first"),
        F.max(F.when(F.col("valid"), F.col("last"))).alias("last"),
        F.min(F.when(F.col("is_first"), F.col("own"))).alias("head"),
        F.min(F.when(F.col("is_last"), F.col("own"))).alias("tail"),
        F.min(F.when(inner, F.col("own"))).alias("best"),
        F.min("first_seq").alias("first_seq"),
        F.min("low").alias("low"),
        F.max("latest").alias("latest"),
    )
    return found.select(*_KEYS, "block", *(F.col(c).cast(kind).alias(c) for c, kind in SUMMARY.items()))


def merged(a: Column, b: Column) -> Column:
    """The summary of a block and the one after it."""
    both = F.coalesce(a["last"]["inside"] & b["first"]["inside"], F.lit(False))
    gap = F.datediff(b["first"]["d"], a["last"]["d"])
    joins, cut = both & F.coalesce(gap <= 1, F.lit(False)), both & gap.isNull()
    a_whole, b_whole = (F.coalesce(x["whole"], F.lit(False)) for x in (a["tail"], b["head"]))
    put = lambda run, lost, whole: _run(run["minus_days"], run["start"], run["start_seq"], run["end"], lost, whole)
    no = F.lit(False)
    one = _run(a["tail"]["minus_days"] + b["head"]["minus_days"], a["tail"]["start"], a["tail"]["start_seq"], b["head"]["end"], b["head"]["lost"], a_whole & b_whole)
    # a run that filled its block touches only the outer edge of both
    head = F.when(joins & a_whole, one).when(a_whole, put(a["head"], cut, no)).otherwise(a["head"])
    tail = F.when(joins & b_whole, one).when(b_whole, put(b["tail"], no, no)).otherwise(b["tail"])
    closed = [
        F.when(joins & ~a_whole & ~b_whole & ~b["head"]["lost"], put(one, no, no)),
        F.when(~joins & ~a_whole & ~cut & a["tail"].isNotNull(), put(a["tail"], no, no)),
        F.when(~joins & ~b_whole & b["head"].isNotNull() & ~b["head"]["lost"], put(b["head"], no, no)),
    ]
    neither = {"rows": a["rows"] + b["rows"], "first": a["first"], "last": b["last"], "head": head, "tail": tail, "best": F.least(a["best"], b["best"], *closed)}
    always = {"first_seq": F.least(a["first_seq"], b["first_seq"]), "low": F.least(a["low"], b["low"]), "latest": F.greatest(a["latest"], b["latest"])}
    fields = {c: F.when(a["rows"] == 0, b[c]).when(b["rows"] == 0, a[c]).otherwise(v) for c, v in neither.items()} | always
    return F.struct(*(fields[c].cast(kind).alias(c) for c, kind in SUMMARY.items()))


def in_one(summaries: DataFrame) -> DataFrame:
    """One summary a series and threshold, from those of blocks that do not overlap, merged in their order (as many as a series has blocks)."""
    kind = f"struct<{','.join(f'{c}:{k}' for c, k in SUMMARY.items())}>"
    one = F.struct(*(F.col(c) for c in SUMMARY)).cast(kind)
    ordered = F.array_sort(F.collect_list(F.struct(F.col("low").alias("at"), one.alias("s"))))
    found = summaries.groupBy(*_KEYS).agg(ordered.alias("_all"))
    folded = F.aggregate(F.slice("_all", 2, F.size("_all")), F.get("_all", F.lit(0))["s"], lambda total, x: merged(total, x["s"]))
    return found.select(*_KEYS, folded.alias("_s")).select(*_KEYS, "_s.*")


def with_best(found: DataFrame) -> DataFrame:
    """Adds _best, the best run of a series' whole summary, or null."""
    # a run that is still open to the left or right competes as it stands, unless the step after it lost it
    runs = [F.col("best"), F.when(~F.col("head.lost"), F.col("head")), F.col("tail")]
    best = F.least(*(F.when(r.isNotNull(), F.struct(*(r[c].alias(c) for c in ("minus_days", "start", "start_seq", "end")))) for r in runs))
    return found.withColumn("_best", best)


def best_streaks(summaries: DataFrame) -> DataFrame:
    """The best streak of each series and threshold, with what streaks.order() needs; the same rows as from the history.

    Only the summaries of series with a run in some block are brought together; the others have no streak, and their blocks end none.
    """
    with_runs = summaries.where("head is not null or tail is not null or best is not null").select(*_KEYS).distinct()
    found = with_best(in_one(summaries.join(with_runs, _KEYS, "left_semi"))).where("_best.minus_days is not null")
    active = F.col("last.inside")
    return found.select(
        *SERIES,
        "n",
        "threshold_pos",
        "first_seq",
        F.col("latest.product_name").alias("product_name"),
        (-F.col("_best.minus_days")).alias("streak_days"),
        F.col("_best.start").alias("streak_start"),
        F.col("_best.end").alias("streak_end"),
        active.alias("is_active"),
        F.when(active, F.col("latest.rank")).alias("current_rank"),
        F.col("n").alias("top_n_threshold"),
    )


def store_block(spark: SparkSession, path: str, block: str, history: DataFrame, thresholds: Sequence[int] | None = None) -> None:
    """Stores the summaries of one block's rows (a day, a month); storing a block again replaces it."""
    summarised(history, thresholds, lambda _: F.lit(block)).drop("block").write.mode("overwrite").parquet(f"{path}/block={block}")


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    schema = ", ".join([*(f"{c} string" for c in SERIES), "n int", "threshold_pos int", *(f"{c} {kind}" for c, kind in SUMMARY.items()), "block string"])
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
