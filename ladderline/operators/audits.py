"""What a log of requests says about budgets, failures and waits.

Requests are counted within keys (host, client, run), or over the whole log where none are given. Counts run in two passes (scans.py), so that
neither a long log nor a busy client is one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ladderline.operators.scans import BLOCK, BLOCKS, blocked, carried, in_block

_ORDER = ("ts", "event_id")


def budget_audit(events: DataFrame, by: list[str], budget: int = 25, blocks: int = BLOCKS) -> DataFrame:
    """Each successful request's number within its day (and keys), and what is left of the day's budget."""
    keys = [*by, "day"]
    rows = blocked(events.where("success").withColumn("day", F.to_date("ts")), "ts", blocks)
    rows = carried(rows.withColumn("_nth", F.row_number().over(in_block(keys, *_ORDER))), keys, {"_rows": F.count("*")}, {"_earlier": (F.sum, F.col("_rows"))}, blocks=blocks)
    n = F.col("_nth") + F.coalesce("_earlier", F.lit(0))
    rows = rows.withColumn("requests", n.cast("int")).drop("_nth", "_earlier", BLOCK)
    return rows.withColumns({"remaining": F.greatest(F.lit(0), F.lit(budget) - F.col("requests")), "exhausted": F.col("requests") >= budget})


def circuit_audit(events: DataFrame, by: list[str], limit: int = 5, blocks: int = BLOCKS) -> DataFrame:
    """Consecutive failures after each request, and why the circuit would be open.

    A success ends a run of failures. The first reason that applies stands: status 403, a reason that names a captcha or
    a block, one that names robots, and the limit of consecutive failures.

    A run's length is the failures so far less those at the last success, both of which carry over from block to block.
    """
    keys, w = list(by), in_block(list(by), *_ORDER)
    failed = ~F.col("success")
    reason = F.lower(F.coalesce("reason", F.lit("")))
    named = F.when(F.col("status_code") == 403, "blocked").when(F.contains(reason, F.lit("captcha")) | F.contains(reason, F.lit("blocked")), "blocked").when(F.contains(reason, F.lit("robots")), "stopped_by_robots")
    rows = blocked(events, "ts", blocks).withColumn("_named", F.when(failed, named))
    rows = rows.withColumn("_failures", F.sum(failed.cast("int")).over(w)).withColumn("_at_success", F.max(F.when(F.col("success"), F.col("_failures"))).over(w))
    none = F.lit(0)
    leading = F.max(F.when(F.col("_at_success").isNull(), F.col("_failures")))
    totals = {"_sum": F.sum(failed.cast("int")), "_last": F.max("_at_success"), "_leading": leading, "_inner": F.max(F.col("_failures") - F.col("_at_success")), "_reasons": F.count("_named")}
    open_run = F.coalesce("_failures_before", none) - F.coalesce("_success_before", none)
    opens = (F.col("_reasons") > 0) | (F.coalesce("_inner", none) >= limit) | ((F.coalesce("_leading", none) > 0) & (open_run + F.coalesce("_leading", none) >= limit))
    rows = carried(
        rows,
        keys,
        totals,
        {"_failures_before": (F.sum, F.col("_sum"))},
        {"_success_before": (F.max, F.coalesce("_failures_before", none) + F.col("_last"))},
        {"_opened_before": (F.max, opens)},
        blocks=blocks,
    )
    total = F.col("_failures") + F.coalesce("_failures_before", none)
    at_success = F.coalesce(F.coalesce("_failures_before", none) + F.col("_at_success"), F.col("_success_before"), none)
    rows = rows.withColumns({"consecutive_failures": (total - at_success).cast("int"), "total_failures": total.cast("int")})
    rows = rows.withColumn("stop_reason", F.when(failed, F.coalesce("_named", F.when(F.col("consecutive_failures") >= limit, "stopped_by_failures"))))
    rows = rows.withColumn("is_open", F.max(F.col("stop_reason").isNotNull()).over(w) | F.coalesce("_opened_before", F.lit(False)))
    return rows.drop(BLOCK, "_named", "_failures", "_at_success", "_failures_before", "_success_before", "_opened_before")


def wait_audit(events: DataFrame, by: list[str], delay: float = 3.0, blocks: int = BLOCKS) -> DataFrame:
    """How long each request would have had to wait for the one before; the first waits the whole delay."""
    keys = list(by)
    rows = blocked(events, "ts", blocks).withColumn("_previous", F.lag("ts").over(in_block(keys, *_ORDER)))
    rows = carried(rows, keys, {"_last": F.max("ts")}, {"_last_before": (F.max, F.col("_last"))}, blocks=blocks)
    seconds = lambda c: c.cast("timestamp").cast("double")
    gap = seconds(F.col("ts")) - seconds(F.coalesce("_previous", "_last_before"))
    return rows.withColumn("gap_s", gap).withColumn("wait_s", F.greatest(F.lit(0.0), F.lit(delay) - F.coalesce("gap_s", F.lit(0.0)))).drop(BLOCK, "_previous", "_last_before")


def guard_stats(events: DataFrame, by: list[str], budget: int = 25, limit: int = 5) -> DataFrame:
    """Totals by key (at least one): requests, successes, blocked ones, the highest run of failures, days on which the budget ran out."""
    if not by:
        raise ValueError("totals need the columns that requests are counted by")
    keys = list(by)
    totals = circuit_audit(events, keys, limit).groupBy(*keys).agg(
        F.count("*").alias("total_requests"),
        F.count_if("success").alias("successful_requests"),
        F.count_if(F.col("stop_reason") == "blocked").alias("blocked_requests"),
        F.max("consecutive_failures").alias("longest_failures"),
        F.max("is_open").alias("circuit_opened"),
    )
    days = budget_audit(events, keys, budget).groupBy(*keys, "day").agg(F.max("requests").alias("n")).groupBy(*keys).agg(F.count_if(F.col("n") >= budget).alias("exhausted_days"))
    return totals.join(days, keys, "left").withColumn("exhausted_days", F.coalesce("exhausted_days", F.lit(0).cast("long")))


def last_failures(events: DataFrame, n: int = 5) -> DataFrame:
    """The last failures, oldest first."""
    return events.where(~F.col("success")).orderBy(F.desc("ts"), F.desc("event_id")).limit(n).orderBy("ts", "event_id")


def quota_rows(pages: DataFrame, target: int = 100) -> DataFrame:
    """Items that a category keeps when its pages are read in order until the target is met; columns category_key, page_no, pos."""
    n = F.row_number().over(Window.partitionBy("category_key").orderBy("page_no", "pos"))
    return pages.withColumn("nth", n.cast("int")).where(F.col("nth") <= target)


def market_totals(results: DataFrame) -> DataFrame:
    """Items and successful categories by market."""
    return results.groupBy("market").agg(F.sum("items_collected").alias("items"), F.count_if("success").alias("succeeded"), F.count("*").alias("categories"))


def run_totals(results: DataFrame) -> DataFrame:
    """Items of a whole run, in one row."""
    return results.agg(F.coalesce(F.sum("items_collected"), F.lit(0)).cast("long").alias("total_items"), F.count("*").alias("categories"))
