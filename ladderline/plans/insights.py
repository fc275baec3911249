"""The summary of a rank history, and its text report."""

from __future__ import annotations

import re
import sys
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ladderline.functions.text import shortened, signed
from ladderline.model import SERIES
from ladderline.operators import entry_exit, shocks, streaks
from ladderline.sources.store import filtered

#: Rows of each list of the summary, and of each section of the report.
LIMITS = {"active_streaks": 20, "longest_streaks": 20, "recent_shocks": 20, "biggest_improvements": 10, "biggest_drops": 10, "new_entries": 20, "recent_exits": 20}
REPORT_ROWS = 10
#: The lines of the report. A section has a heading, a line for the case that it is empty, and two lines a row.
TITLE, RULE = "Rankings at a glance", "~" * 48
SECTIONS = {
    "active_streaks": ("Holding on", "  (nobody is holding on)"),
    "recent_shocks": ("Jumps and falls", "  (ranks are calm)"),
    "new_entries": ("Newcomers", "  (nobody came in)"),
    "recent_exits": ("Gone", "  (nobody left)"),
}
ROW_FORMATS = {
    "active_streaks": ("      %d days running among the first %d, rank %d at present", ("streak_days", "top_n_threshold", "current_rank")),
    "recent_shocks": ("      %s: from rank %d to rank %d on %s", ("signed_change", "previous_rank", "new_rank", "date")),
    "new_entries": ("      among the first %d since %s, from rank %d to rank %d at present", ("top_n_threshold", "entry_date", "entry_rank", "current_rank")),
    "recent_exits": ("      %d days among the first %d, the last of them %s at rank %d", ("days_in_top_n", "top_n_threshold", "exit_date", "last_rank_in_top_n")),
}
#: Of each list: what it is taken from, which of its rows, the number and the date that the union shows.
_LISTS = {
    "active_streaks": ("streaks", "is_active", "streak_days", "streak_end"),
    "longest_streaks": ("streaks", "true", "streak_days", "streak_end"),
    "recent_shocks": ("shocks", "is_recent", "change", "date"),
    "biggest_improvements": ("shocks", "change > 0", "change", "date"),
    "biggest_drops": ("shocks", "change < 0", "change", "date"),
    "new_entries": ("entries", "true", "entry_rank", "entry_date"),
    "recent_exits": ("exits", "true", "days_in_top_n", "exit_date"),
}


def _sources(history: DataFrame, market: str | None, category_key: str | None, thresholds: Sequence[int] | None, shock_threshold: int, lookback_days: int) -> dict[str, tuple[DataFrame, list[Column]]]:
    """What the lists are taken from, unsorted, and the order of its rows."""
    rows = filtered(history, market, category_key)
    facts = entry_exit.facts(rows, thresholds, lookback_days)
    return {
        "streaks": (streaks.best_streaks(rows, thresholds), streaks.order()),
        "shocks": (shocks.with_recency(rows, shock_threshold, lookback_days), shocks.order()),
        "entries": (entry_exit.entries_of(facts), entry_exit.order("entry_date")),
        "exits": (entry_exit.exits_of(facts), entry_exit.order("exit_date")),
    }


def summary(history: DataFrame, market: str | None = None, category_key: str | None = None, thresholds: Sequence[int] | None = None, shock_threshold: int = 3, lookback_days: int = 7) -> dict[str, DataFrame]:
    """Seven lazy lists, each sorted and cut by Spark's own top-k."""
    columns = {"streaks": streaks.COLUMNS, "shocks": shocks.COLUMNS, "entries": entry_exit.ENTRY_COLUMNS, "exits": entry_exit.EXIT_COLUMNS}
    sources = _sources(history, market, category_key, thresholds, shock_threshold, lookback_days)
    return {name: sources[of][0].where(condition).orderBy(*sources[of][1]).limit(LIMITS[name]).select(*columns[of]) for name, (of, condition, _, _) in _LISTS.items()}


def summary_union(history: DataFrame, market: str | None = None, category_key: str | None = None, thresholds: Sequence[int] | None = None, shock_threshold: int = 3, lookback_days: int = 7) -> DataFrame:
    """The lists as one table: section, product, market, threshold or change, and the date that the row is about.

    Lists of one source are cut from it together: a row is marked with each list that it may be in, and ranked within each, which Spark
    limits to the first rows of every partition before it shuffles them.
    """
    out = None
    for of, (rows, order) in _sources(history, market, category_key, thresholds, shock_threshold, lookback_days).items():
        own = {name: rest for name, (source, *rest) in _LISTS.items() if source == of}
        marks = F.array_compact(F.array(*(F.when(F.expr(condition), F.struct(F.lit(name).alias("section"), F.col(number).cast("long").alias("value"), F.col(date).alias("date"), F.lit(LIMITS[name]).alias("most"))) for name, (condition, number, date) in own.items())))
        marked = rows.withColumn("mark", F.explode(marks)).withColumn("section", F.col("mark.section"))
        nth = F.row_number().over(Window.partitionBy("section").orderBy(*order))
        part = marked.withColumn("nth", nth).where(F.col("nth") <= max(LIMITS.values())).where(F.col("nth") <= F.col("mark.most"))
        part = part.select("section", "product_name", *SERIES, "mark.value", "mark.date")
        out = part if out is None else out.unionByName(part)
    return out


def report_lines(lists: dict[str, DataFrame], most: int = REPORT_ROWS) -> DataFrame:
    """The rows of the report's sections: section, nth (from 1), and two lines of text."""
    out = None
    for name in SECTIONS:
        form, fields = ROW_FORMATS[name]
        rows = lists[name].limit(most)
        if "change" in rows.columns:
            rows = rows.withColumn("signed_change", signed(F.col("change")))
        # a rank that can't be shown is written as None
        text = F.concat(*(x for part, field in zip(re.split("%[ds]", form), [*fields, None], strict=True) for x in (F.lit(part), *([F.coalesce(F.col(field).cast("string"), F.lit("None"))] if field else ()))))
        head = F.concat(F.lit("  * "), shortened(F.col("product_name")), F.lit(" on "), F.col("market"))
        # the lists are sorted, and at most `most` rows: numbering them needs one small task
        part = rows.select(head.alias("head"), text.alias("detail")).withColumn("nth", F.row_number().over(Window.orderBy(F.monotonically_increasing_id())))
        part = part.select(F.lit(name).alias("section"), "nth", "head", "detail")
        out = part if out is None else out.unionByName(part)
    return out


def report(lists: dict[str, DataFrame]) -> str:
    """The text of the four sections; at most REPORT_ROWS rows of each reach the driver."""
    found: dict[str, list] = {name: [] for name in SECTIONS}
    for row in report_lines(lists).collect():
        found[row["section"]].append(row)
    lines = [RULE, TITLE, RULE, ""]
    for name, (title, empty) in SECTIONS.items():
        rows = sorted(found[name], key=lambda r: r["nth"])
        lines += [title, *(line for r in rows for line in (r["head"], r["detail"])), *([] if rows else [empty]), ""]
    return "\n".join([*lines, RULE])


def print_report(history: DataFrame, lists: dict[str, DataFrame] | None = None, **options: object) -> None:
    """Prints the report of these lists, or of the history's summary; what the console can't encode is replaced."""
    text = report(lists if lists is not None else summary(history, **options))
    try:
        print(text)
    except UnicodeEncodeError:
        code = sys.stdout.encoding or "ascii"
        print(text.encode(code, errors="replace").decode(code))
