"""Streaks, shocks, entries and exits: worked examples, odd rows, and a plain restatement on random series."""

import random
from datetime import date, datetime, timedelta

import pytest

from ladderline.operators import series
from ladderline.operators.entry_exit import exits, new_entries
from ladderline.operators.shocks import improvements, recent_shocks, shocks
from ladderline.operators.streaks import active_streaks, streaks
from ladderline.plans import insights
from ladderline.plans.insights import report, summary

SCHEMA = "date_kst string, market string, category_key string, product_url string, product_name_raw string, rank string, row_seq long"


def history(spark, rows, kind="string"):
    """Rows of (product, date, rank)."""
    full = [(d, "amazon_us", "beauty", f"https://example.com/{p}", f"Product {p.upper()}", None if r is None else str(r) if kind == "string" else r, k) for k, (p, d, r) in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA.replace("rank string", f"rank {kind}"))


def january(*pairs):
    return [(p, f"2024-01-{d:02d}", r) for p, d, r in pairs]


STREAKS = january(("a", 1, 3), ("a", 2, 2), ("a", 3, 4), ("a", 4, 5), ("a", 5, 3), ("b", 1, 8), ("b", 2, 4), ("b", 3, 10))


def test_streaks(spark):
    found = {(r.product_url[-1], r.top_n_threshold): (r.streak_days, r.streak_start, r.streak_end, r.is_active, r.current_rank) for r in streaks(history(spark, STREAKS), [5, 10]).collect()}
    assert found == {
        ("a", 5): (5, "2024-01-01", "2024-01-05", True, 3),
        ("b", 5): (1, "2024-01-02", "2024-01-02", False, None),
        ("a", 10): (5, "2024-01-01", "2024-01-05", True, 3),
        ("b", 10): (3, "2024-01-01", "2024-01-03", True, 10),
    }


def test_streak_order_is_stable(spark):
    rows = streaks(history(spark, STREAKS), [10, 5]).collect()
    assert [(r.product_url[-1], r.top_n_threshold) for r in rows] == [("a", 10), ("a", 5), ("b", 10), ("b", 5)]
    assert active_streaks(history(spark, STREAKS), [5]).count() == 1


def test_an_unreadable_date_loses_the_run(spark):
    rows = january(("a", 1, 1), ("a", 2, 1), ("a", 3, 1)) + [("a", "2024-01-03x", 1), ("a", "2024-02-01", 1)]
    r = streaks(history(spark, rows), [5]).first()
    assert (r.streak_days, r.streak_start) == (1, "2024-02-01")


SHOCKS = january(("a", 1, 20), ("a", 2, 5), ("b", 1, 3), ("b", 2, 15), ("c", 1, 10), ("c", 2, 11))


def test_shocks(spark):
    found = [(r.product_url[-1], r.change, r.change_type) for r in shocks(history(spark, SHOCKS), 3).collect()]
    assert found == [("a", 15, "improved"), ("b", -12, "dropped")]
    assert shocks(history(spark, SHOCKS), 20).count() == 0 and improvements(history(spark, SHOCKS)).count() == 1


def test_gaps_and_bad_ranks_break_pairs(spark):
    rows = january(("a", 1, 1), ("a", 3, 9), ("a", 6, 30), ("a", 7, None), ("a", 8, 50), ("a", 9, "7.9"), ("a", 10, " 7 "), ("a", 11, 1))
    assert [(r.date, r.change) for r in shocks(history(spark, rows)).collect()] == [("2024-01-03", -8), ("2024-01-11", 6)]
    assert [(r.new_rank) for r in shocks(history(spark, [("a", "2024-1-5", 9.9), ("a", "2024-1-6", 1.2)], "double")).collect()] == [1]


def test_recent_shocks_count_from_the_last_shock(spark):
    rows = january(("a", 1, 20), ("a", 2, 5), ("b", 20, 30), ("b", 21, 1), ("c", 28, 1), ("c", 29, 1))
    assert [r.date for r in recent_shocks(history(spark, rows), 3, 7).collect()] == ["2024-01-21"]


ENTRIES = january(("a", 1, 5), ("a", 7, 3), ("b", 5, 8), ("b", 7, 6), ("c", 1, 7), ("c", 3, 15))


def test_entries_and_exits(spark):
    h = history(spark, ENTRIES)
    assert [(r.product_url[-1], r.entry_date, r.entry_rank, r.current_rank) for r in new_entries(h, [10], 7).collect()] == [("b", "2024-01-05", 8, 6), ("a", "2024-01-01", 5, 3)]
    assert [(r.product_url[-1], r.exit_date, r.last_rank_in_top_n, r.days_in_top_n) for r in exits(h, [10], 7).collect()] == [("c", "2024-01-01", 7, 1)]
    assert new_entries(h, [10], 1).count() == 0


def test_an_unreadable_latest_rank(spark):
    h = history(spark, january(("a", 6, 5), ("a", 7, None)))
    assert [(r.current_rank) for r in new_entries(h, [10]).collect()] == [0]
    assert exits(h, [10]).count() == 0


def test_empty_history(spark):
    lists = summary(history(spark, []))
    assert all(rows.count() == 0 for rows in lists.values())
    assert "(nobody came in)" in report(lists)


def test_report(spark):
    text = report(summary(history(spark, STREAKS)))
    assert all(heading in text for heading, _ in insights.SECTIONS.values()) and "5 days running among the first 5, rank 3 at present" in text and "(nobody left)" not in text
    assert "+15: from rank 20 to rank 5 on" in report(summary(history(spark, SHOCKS)))


def test_one_exchange_by_series(spark, capsys):
    streaks(history(spark, STREAKS)).explain()
    plan = capsys.readouterr().out
    assert plan.count("Exchange hashpartitioning") == 1


def parse(text):
    try:
        return datetime.strptime(text, "%Y-%m-%d").date()
    except ValueError:
        return None


def whole(rank):
    try:
        return int(rank)
    except (TypeError, ValueError):
        return None


def plain_streak(rows, n):
    """(days, start, end, active) of one series by walking over it."""
    runs, run, last = [], [], None
    for d, r in rows:
        if not d or r is None:
            continue
        if r <= n:
            if run:
                gap = (parse(d) - parse(last)).days if parse(d) and parse(last) else None
                if gap is None:
                    run = []
                elif gap > 1:
                    runs.append(run)
                    run = []
            run.append(d)
        else:
            runs.append(run)
            run = []
        last = d
    runs.append(run)
    best = max(runs, key=len)
    return (len(best), best[0], best[-1], bool(run)) if best else None


def test_random_series(spark):
    rng = random.Random(5)
    rows = []
    for p in "abcdefghijklmnopqrst":
        day = date(2024, 1, 1)
        for _ in range(rng.randint(1, 25)):
            day += timedelta(days=rng.choice([0, 1, 1, 1, 2, 3]))
            rows.append((p, rng.choice([str(day)] * 12 + [f"{day.year}-{day.month}-{day.day}", "N/A", ""]), rng.choice([rng.randint(1, 12)] * 10 + [None, "3.7", "x"])))
    rng.shuffle(rows)
    series = {}
    for p, d, r in rows:
        series.setdefault(p, []).append((d, whole(r)))
    series = {p: sorted(s, key=lambda x: x[0]) for p, s in series.items()}
    h = history(spark, rows)
    found = {(r.product_url[-1], r.top_n_threshold): (r.streak_days, r.streak_start, r.streak_end, r.is_active) for r in streaks(h, [3, 8]).collect()}
    assert found == {(p, n): s for p, rs in series.items() for n in (3, 8) if (s := plain_streak(rs, n))}
    jumps = sorted((p, d, a - b) for p, rs in series.items() for (c, a), (d, b) in zip(rs, rs[1:], strict=False) if a is not None and b is not None and parse(c) and parse(d) and (parse(d) - parse(c)).days <= 2 and abs(a - b) >= 3)
    assert sorted((r.product_url[-1], r.date, r.change) for r in shocks(h).collect()) == jumps
    latest = max(d for _, d, _ in rows)
    cutoff = str(parse(latest) - timedelta(days=7)) if parse(latest) else "2000-01-01"
    inside = {p: [(d, r) for d, r in rs if r is not None and r <= 8] for p, rs in series.items()}
    entries = {p for p, i in inside.items() if i and i[0][0] >= cutoff and series[p][-1][0] == latest and (series[p][-1][1] or 0) <= 8}
    assert {r.product_url[-1] for r in new_entries(h, [8]).collect()} == entries
    gone = {p: len(i) for p, i in inside.items() if i and series[p][-1][1] is not None and not (series[p][-1][0] == latest and series[p][-1][1] <= 8) and i[-1][0] >= cutoff}
    assert {r.product_url[-1]: r.days_in_top_n for r in exits(h, [8]).collect()} == gone


@pytest.mark.parametrize("thresholds", [None, []])
def test_no_thresholds_mean_the_defaults(spark, thresholds):
    assert {r.top_n_threshold for r in streaks(history(spark, STREAKS), thresholds).collect()} == {5, 10, 100}


def test_series_that_were_never_inside_are_left_out_before_thresholds(spark):
    """Rows are not carried through windows by threshold that their series never reached."""
    rows = [("2024-01-01", "m", "c", 1, "a", "a", 0), ("2024-01-02", "m", "c", 50, "a", "a", 1), ("2024-01-01", "m", "c", 7, "b", "b", 2), ("2024-01-01", "m", "c", 900, "c", "c", 3), ("2024-01-01", "m", "c", None, "d", "d", 4)]
    history = spark.createDataFrame(rows, "date_kst string, market string, category_key string, rank int, product_name_raw string, product_url string, row_seq long")
    found = series.with_reached(series.prepared(history), [5, 10]).collect()
    assert sorted((r.product_url, r.row_seq, r.n) for r in found) == [("a", 0, 5), ("a", 0, 10), ("a", 1, 5), ("a", 1, 10), ("b", 2, 10)]
