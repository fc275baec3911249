"""Scans in two passes, joins by time and run summaries against brute force, over any blocks."""

import random
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from ladderline.operators import audits, run_summaries, streaks, time_joins
from ladderline.operators.scans import BLOCK, blocked

START = datetime(2024, 3, 31)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def request_log(seed, n=200):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        success = rng.random() < 0.45
        status, reason = (200, None) if success else rng.choice([(500, "timeout"), (500, None), (500, ""), (503, "slow"), *([(403, None), (429, "captcha_x"), (None, "robots_disallowed")] if rng.random() < 0.04 else [])])
        rows.append((k, START + timedelta(seconds=rng.randint(0, 40) * 3600), rng.choice(["a", "a", "a", "b", None]), success, status, reason))
    return rows


def requests(spark, rows):
    return spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, client string, success boolean, status_code int, reason string").repartition(3)


def brute_audits(rows, keyed, limit, budget, delay):
    out, logs, days = {}, {}, {}
    for k, ts, client, success, status, reason in sorted(rows, key=lambda r: (r[1], r[0])):
        key = client if keyed else 0
        log = logs.setdefault(key, {"total": 0, "run": 0, "open": False, "last": None})
        log["run"] = 0 if success else log["run"] + 1
        log["total"] += not success
        stop = None
        if not success:
            reason = (reason or "").lower()
            stop = "blocked" if status == 403 or "captcha" in reason or "blocked" in reason else "stopped_by_robots" if "robots" in reason else "stopped_by_failures" if log["run"] >= limit else None
        log["open"] = log["open"] or stop is not None
        gap = None if log["last"] is None else (ts - log["last"]).total_seconds()
        log["last"] = ts
        nth = None
        if success:
            nth = days[key, ts.date()] = days.get((key, ts.date()), 0) + 1
        out[k] = (log["run"], log["total"], stop, log["open"], max(0.0, delay - (gap or 0.0)), nth, None if nth is None else max(0, budget - nth))
    return out


@pytest.mark.parametrize(("blocks", "by"), [(1, []), (7, []), (64, []), (3, ["client"]), (64, ["client"])])
def test_audits_over_blocks(spark, blocks, by):
    rows = request_log(blocks)
    log = requests(spark, rows)
    circuit = {r.event_id: (r.consecutive_failures, r.total_failures, r.stop_reason, r.is_open) for r in audits.circuit_audit(log, by, 3, blocks).collect()}
    waits = {r.event_id: r.wait_s for r in audits.wait_audit(log, by, 5000.0, blocks).collect()}
    budgets = {r.event_id: (r.requests, r.remaining) for r in audits.budget_audit(log, by, 10, blocks).collect()}
    expected = brute_audits(rows, bool(by), 3, 10, 5000.0)
    assert len(circuit) == len(rows)
    assert {k: (*circuit[k], waits[k], *budgets.get(k, (None, None))) for k in circuit} == expected


def test_a_whole_log_is_never_one_partition(spark):
    log = requests(spark, request_log(1))
    for audit in (audits.circuit_audit(log, []), audits.wait_audit(log, []), audits.budget_audit(log, [])):
        assert "SinglePartition" not in plan_of(audit) and "CartesianProduct" not in plan_of(audit)
        assert set(audit.columns) >= set(log.columns) and not [c for c in audit.columns if c.startswith("_")]


def test_blocks_keep_the_order_and_are_even(spark):
    rows = blocked(spark.createDataFrame([(k % 997, START + timedelta(seconds=(k * k) % 9973)) for k in range(4000)], "k int, ts timestamp_ntz"), "ts", 16)
    found = rows.groupBy(BLOCK).agg(F.min("ts").alias("low"), F.max("ts").alias("high"), F.count("*").alias("n")).orderBy(BLOCK).collect()
    assert 14 <= len(found) <= 16 and all(a.high < b.low for a, b in zip(found, found[1:], strict=False)) and max(r.n for r in found) < 2.5 * 4000 / 16
    one = blocked(spark.createDataFrame([(None,), (START,), (START,)], "ts timestamp_ntz"), "ts", 8)
    assert len({r[BLOCK] for r in one.where("ts is not null").collect()}) == 1 and blocked(one.drop(BLOCK).limit(0), "ts", 8).count() == 0


@pytest.mark.parametrize("blocks", [1, 3, 64])
def test_asof_join(spark, blocks):
    rng = random.Random(blocks)
    at = lambda: rng.choice([None, *(START + timedelta(minutes=m) for m in range(0, 300, 5))])
    left = [(k, rng.choice(["a", "a", "b", "c", None]), at()) for k in range(150)]
    right = [(rng.choice(["a", "a", "b", None]), at(), k, rng.choice([None, "x", "y"])) for k in range(80)]
    l, r = spark.createDataFrame(left, "k int, key string, at timestamp_ntz"), spark.createDataFrame(right, "key string, ts timestamp_ntz, n int, v string")
    found = time_joins.asof_join(l, r, ["key"], "at", "ts", ["n", "v"], blocks)
    expected = []
    for k, key, t in left:
        best = max(((ts, n, v) for own, ts, n, v in right if own == key and ts is not None and t is not None and ts <= t), key=lambda x: x[:2], default=(None, None, None)) if key is not None else (None, None, None)
        expected.append((k, key, t, *best[1:]))
    assert sorted(map(tuple, found.collect()), key=str) == sorted(expected, key=str)
    assert not any(x in plan_of(found) for x in ("NestedLoop", "Cartesian", "SinglePartition"))
    # a whole table without keys, and names that clash
    whole = time_joins.asof_join(l.where("at is not null"), r, [], "at", "ts", ["n"], blocks).collect()
    assert all(x.n == max(((ts, n) for _, ts, n, _ in right if ts is not None and ts <= x["at"]), default=(None, None))[1] for x in whole)
    with pytest.raises(ValueError, match="key"):
        time_joins.asof_join(l, r, ["key"], "at", "ts", ["key"])


@pytest.mark.parametrize("kind", ["timestamp_ntz", "long", "double"])
def test_interval_join(spark, kind):
    rng = random.Random(5)
    value = lambda v: None if v is None else START + timedelta(seconds=v) if kind == "timestamp_ntz" else float(v) if kind == "double" else int(v)
    instant = lambda: value(rng.choice([None, *(rng.choice([rng.randint(-50, 50), rng.uniform(0, 4000), rng.randint(0, 10**6)]) for _ in range(8))]))
    points = [(k, rng.choice("aab"), instant()) for k in range(120)]
    intervals = [(k, rng.choice("aac"), instant(), instant()) for k in range(120)]
    p, i = spark.createDataFrame(points, f"k int, key string, at {kind}"), spark.createDataFrame(intervals, f"i int, key string, low {kind}, high {kind}")
    hit = lambda t, a, b: None not in (t, a, b) and a <= t <= b
    for on in ([], ["key"]):
        found = time_joins.interval_join(p, i, on, "at", "low", "high", ["i"])
        expected = sorted((k, n) for k, pk, t in points for n, ik, a, b in intervals if hit(t, a, b) and (not on or pk == ik))
        assert sorted((r.k, r.i) for r in found.collect()) == expected
        assert not any(x in plan_of(found) for x in ("NestedLoop", "Cartesian"))
    assert time_joins.interval_join(p, i.limit(0), [], "at", "low", "high", ["i"]).count() == 0


def test_pairs_of_a_full_bin_are_spread(spark, monkeypatch):
    """Few input partitions, and copies of one instant and one interval: blocks and parts bound what meets in one row and in one task."""
    for name, size in (("POINTS_A_BLOCK", 3), ("BLOCKS_A_PART", 2), ("INTERVALS_A_PART", 4)):
        monkeypatch.setattr(time_joins, name, size)
    points = spark.createDataFrame([(k, 500 + (k % 40 if k % 2 else 0)) for k in range(200)], "k int, at long").coalesce(1)
    intervals = spark.createDataFrame([(k, 500, 500 + (k % 3) * 10) for k in range(30)], "i int, low long, high long").coalesce(1)
    found = time_joins.interval_join(points, intervals, [], "at", "low", "high", ["i"]).withColumn("task", F.spark_partition_id()).collect()
    assert sorted((r.k, r.i) for r in found) == sorted((k, i) for k in range(200) for i in range(30) if 500 <= 500 + (k % 40 if k % 2 else 0) <= 500 + (i % 3) * 10)
    sizes = Counter(r.task for r in found)
    assert len(sizes) >= 8 and max(sizes.values()) < len(found) / 3


def test_pairs_wait_in_memory_by_interval_and_tasks_grow_with_intervals(spark, monkeypatch):
    """A merge join keeps the pairs of a row of its left side until all are made: those of a block of points would be as many as its bin has intervals."""
    monkeypatch.setattr(time_joins, "INTERVALS_A_TASK", 2, raising=False)
    points, intervals = spark.range(50).selectExpr("id AS k", "id AS at"), spark.range(100).selectExpr("id AS i", "id DIV 3 AS low", "id DIV 3 + 9 AS high")
    found = time_joins.interval_join(points, intervals, [], "at", "low", "high", ["i"])
    node = found._jdf.queryExecution().sparkPlan()
    while node.children().size() == 1:
        node = node.children().apply(0)
    left, right = (node.children().apply(n).output().mkString(" ") for n in (0, 1))
    assert node.nodeName() == "SortMergeJoin" and "_taken" in left and "_points" in right and "_points" not in left
    assert found.rdd.getNumPartitions() == 50
    assert sorted((r.k, r.i) for r in found.collect()) == sorted((k, i) for k in range(50) for i in range(100) if i // 3 <= k <= i // 3 + 9)


def test_interval_join_keeps_columns_of_any_type(spark):
    points = spark.createDataFrame([(1, None, {"a": 1}, [None, 2], ("x", None)), (2, "t", None, None, None), (None, "n", {}, [], ("y", 1))], "at long, name string, m map<string,int>, l array<int>, s struct<a:string,b:int>")
    intervals = spark.createDataFrame([(0, 1, None, None), (1, 2, "u", [1])], "low long, high long, t string, a array<int>")
    rows = lambda df: sorted(map(str, df.collect()))
    whole = points.where("at IS NOT NULL")
    expected = whole.where("at = 1").selectExpr("*", "CAST(NULL AS string) AS t", "CAST(NULL AS array<int>) AS a").union(whole.selectExpr("*", "'u' AS t", "array(1) AS a"))
    found = time_joins.interval_join(points, intervals, [], "at", "low", "high", ["t", "a"])
    assert found.columns == expected.columns and rows(found) == rows(expected)
    assert rows(time_joins.interval_join(points, intervals, [], "at", "low", "high", [])) == rows(expected.drop("t", "a"))


def histories(seed, n=300):
    """Ranks with gaps, repeated and unreadable dates, missing ranks and changing names."""
    rng = random.Random(seed)
    dates = [f"2024-0{m}-{d:02d}" for m in (1, 2) for d in range(1, 15)] + ["2024-01-05 ?", "2024-01-3", "2024-02-31", ""]
    rows = [(rng.choice(dates), rng.choice([None, *range(1, 14)]), f"name{k}", rng.choice(["a", "a", "b", "c"]), k) for k in range(n)]
    return [(d, "m", "c", r, name, f"https://x/{p}", k) for d, r, name, p, k in rows]


HISTORY = "date_kst string, market string, category_key string, rank int, product_name_raw string, product_url string, row_seq long"


@pytest.mark.parametrize("split", ["substring(d, 1, 4)", "substring(d, 1, 7)", "substring(d, 1, 9)", "d", "CASE WHEN d < '2024-01-05' THEN 'a' WHEN d < '2024-01-06' THEN 'b' ELSE 'c' END"])
def test_streaks_of_any_split_are_those_of_the_history(spark, split):
    for seed, n in ((1, 300), (2, 40), (3, 90)):
        history = spark.createDataFrame(histories(seed, n), HISTORY)
        rows = lambda df: sorted(map(str, df.select(*streaks.COLUMNS, "first_seq", "threshold_pos").collect()))
        found = run_summaries.summarised(history, [3, 8], lambda c: F.expr(split.replace("d,", "date_kst,").replace("d <", "date_kst <") if split != "d" else "date_kst"))
        assert rows(run_summaries.best_streaks(found)) == rows(streaks.best_streaks(history, [3, 8]))


def test_summaries_of_all_thresholds_take_one_exchange_and_one_sort(spark):
    history = spark.createDataFrame(histories(1, 300), HISTORY).withColumn("category_key", F.lit("all"))
    for thresholds in ([3], [3, 8, 8, 10]):
        for block in (run_summaries.month, lambda _: F.lit("x")):
            plan = plan_of(run_summaries.summarised(history, thresholds, block))
            assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Sort [") == 1


def test_only_series_with_runs_are_brought_together(spark):
    rows = [("2024-01-0" + str(d), "m", "c", r, "name", f"https://x/{k}", d * 100 + k) for d in range(1, 5) for k, r in enumerate([3 if d != 3 else 50, *[40] * 30])]
    days = run_summaries.summarised(spark.createDataFrame(rows, HISTORY), [5], lambda d: d)
    sizes = []
    brought, in_one = run_summaries.in_one, lambda s: (sizes.append(s.count()), brought(s))[1]
    run_summaries.in_one = in_one
    try:
        found = run_summaries.best_streaks(days).collect()
    finally:
        run_summaries.in_one = brought
    assert days.count() == 4 * 31 and sizes == [4]
    assert [(r.product_url, r.streak_days, r.streak_start, r.is_active) for r in found] == [("https://x/0", 2, "2024-01-01", True)]


def test_merging_is_associative(spark):
    history = spark.createDataFrame(histories(7, 120), HISTORY)
    days = run_summaries.summarised(history, [3, 8], lambda d: F.substring(d, 1, 9)).persist()
    bounds = sorted({r.low.date_kst for r in days.collect()})
    fields = lambda df: sorted(map(str, df.collect()))
    whole = fields(run_summaries.in_one(days))
    for cut in bounds[1:]:
        parts = [run_summaries.in_one(days.where(condition)) for condition in (F.col("low.date_kst") < cut, F.col("low.date_kst") >= cut)]
        assert fields(run_summaries.in_one(parts[0].unionByName(parts[1]))) == whole
    days.unpersist()


def test_a_day_that_is_stored_again_replaces_itself(spark, tmp_path):
    path, history = str(tmp_path / "runs"), spark.createDataFrame(histories(4, 150), HISTORY)
    assert run_summaries.best_streaks(run_summaries.read_blocks(spark, path)).count() == 0
    for name, condition in (("1", "date_kst < '2024-02'"), ("2", "date_kst >= '2024-02'"), ("2", "date_kst >= '2024-02'")):
        run_summaries.store_block(spark, path, name, history.where(condition), [5])
    rows = lambda df: sorted(map(str, df.select(*streaks.COLUMNS).collect()))
    assert rows(run_summaries.best_streaks(run_summaries.read_blocks(spark, path))) == rows(streaks.best_streaks(history, [5]))
