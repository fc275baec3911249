"""Stored tables, audits, collection with a made-up transport, and streaming forms."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from ladderline.model import Category, Settings
from ladderline.operators import audits
from ladderline.plans.collect import KST, Answer, Guard, RunLog, run_collection
from ladderline.sources import store
from ladderline.streaming import ranks

ROW = "date_kst string, market string, category_key string, category_url string, rank int, product_name_raw string, brand_raw string, product_url string, run_id string, parse_status string, notes string"


def rows(spark, *found):
    return spark.createDataFrame([(d, "m", "c", "u", r, n, None, p, "run", "ok", "") for d, r, n, p in found], ROW).coalesce(1)


def test_row_keys(spark):
    key = spark.createDataFrame([("2024-01-01", "amazon_us", "beauty", 1, "https://x/a")], "date_kst string, market string, category_key string, rank int, product_url string").select(store.row_key()).first()[0]
    assert key == "250be2d81fc2918352f36e2a29917019"


def test_append_without_duplicates(spark, tmp_path):
    path = str(tmp_path / "history")
    assert store.read_history(spark, path).count() == 0
    assert store.append_snapshots(spark, path, rows(spark, ("2024-01-01", 1, "first", "a"), ("2024-01-01", 1, "again", "a"), ("2024-01-01", 2, "b", "b"))) == 2
    assert store.append_snapshots(spark, path, rows(spark, ("2024-01-01", 1, "later", "a"), ("2024-01-02", 1, "a", "a"))) == 1
    assert store.append_snapshots(spark, path, rows(spark, ("2024-01-02", 1, "a", "a"))) == 0
    found = store.read_history(spark, path, "m", "c", days=1).orderBy("row_seq").collect()
    assert [(r.date_kst, r.product_name_raw, r.brand_raw) for r in found] == [("2024-01-01", "first", ""), ("2024-01-01", "b", ""), ("2024-01-02", "a", "")]
    assert [r.date_kst for r in store.unique_dates(store.read_history(spark, path)).collect()] == ["2024-01-01", "2024-01-02"]
    assert store.read_history(spark, path, "other").count() == 0 and store.read_history(spark, path, "").count() == 3


def test_filters_that_are_off_by_default(spark):
    h = rows(spark, ("2024-01-01", 1, "Lip Mask", "a"), ("2024-01-01", None, "Cream", "b"))
    assert store.with_brand(h, []).count() == 2 and store.with_brand(h, ["MASK"]).count() == 1
    assert [(r.n_items, r.n_incomplete) for r in store.page_faults(h).collect()] == [(2, 1)]


def requests(spark, *found):
    return spark.createDataFrame([(k, datetime(2024, 1, 1) + timedelta(seconds=2 * k), s == 200, s, r) for k, (s, r) in enumerate(found)], "event_id long, ts timestamp_ntz, success boolean, status_code int, reason string").withColumn("client", F.lit("c"))


def test_circuit(spark):
    audit = lambda *found, limit=5: [(r.consecutive_failures, r.total_failures, r.stop_reason, r.is_open) for r in audits.circuit_audit(requests(spark, *found), ["client"], limit).orderBy("event_id").collect()]
    assert audit((500, ""), (500, ""), (200, "")) == [(1, 1, None, False), (2, 2, None, False), (0, 2, None, False)]
    assert audit((500, ""), (500, ""), (500, ""), limit=3)[-1] == (3, 3, "stopped_by_failures", True)
    assert audit((403, ""), (200, "")) == [(1, 1, "blocked", True), (0, 1, None, True)]
    assert audit((429, "blocking_status_code_429"))[0][2] is None and audit((200, ""), (500, "captcha_indicator:x"))[-1][2] == "blocked"


def test_budget_waits_and_stats(spark):
    log = requests(spark, (200, ""), (200, ""), (500, ""), (200, ""))
    assert [(r.requests, r.remaining, r.exhausted) for r in audits.budget_audit(log, [], 3).orderBy("event_id").collect()] == [(1, 2, False), (2, 1, False), (3, 0, True)]
    assert [r.wait_s for r in audits.wait_audit(log, ["client"], 3.0).orderBy("event_id").collect()] == [3.0, 1.0, 1.0, 1.0]
    stats = audits.guard_stats(log, ["client"], 3).first()
    assert (stats.total_requests, stats.successful_requests, stats.longest_failures, stats.exhausted_days) == (4, 3, 1, 1)
    assert [r.event_id for r in audits.last_failures(log).collect()] == [2]
    with pytest.raises(ValueError, match="columns"):
        audits.guard_stats(log, [])
    # the whole log is one client
    assert [r.consecutive_failures for r in audits.circuit_audit(log, []).orderBy("event_id").collect()] == [0, 0, 1, 0]


def page(ranks, after=None):
    cards = "".join(f'<div data-asin="{r}"><span class="zg-bdg-text">#{r}</span><a class="a-link-normal" href="/dp/{r}"><span><div>Product {r}</div></span></a></div>' for r in ranks)
    return f"<body>{cards}" + (f'<li class="a-last"><a href="{after}">next</a></li>' if after else "") + "</body>"


class Web:
    def __init__(self, pages):
        self.pages, self.asked, self.slept, self.time = pages, [], [], datetime(2024, 1, 1, tzinfo=KST)

    def __call__(self, url):
        self.asked.append(url)
        answer = self.pages[url]
        return answer.pop(0) if isinstance(answer, list) else answer

    def sleep(self, seconds):
        self.slept.append(seconds)
        self.time += timedelta(seconds=seconds)


def guard(web, **settings):
    base = {"categories": (Category("https://s.com/a", "a", "amazon_us"), Category("https://s.com/b", "b", "amazon_us"))}
    return Guard(Settings(**(base | settings)), web, sleep=web.sleep, now=lambda: web.time)


def test_collection(spark, tmp_path):
    web = Web({"https://s.com/a": Answer(200, page([1, 2], "/a2")), "https://s.com/a2": Answer(200, page([3, 4])), "https://s.com/b": [Answer(503, ""), Answer(200, page([1]))]})
    g = guard(web, top_n_target=3)
    paths = [str(tmp_path / x) for x in "hrf"]
    out = run_collection(spark, g, *paths)
    assert (out["status"], out["added"], g.used) == ("success", 4, 3) and [r.success for r in out["results"]] == [True, True]
    assert sorted((r.category_key, r.rank) for r in store.read_history(spark, paths[0]).collect()) == [("a", 1), ("a", 2), ("a", 3), ("b", 1)]
    assert 5.0 in web.slept and g.fetch_log(spark).count() == 4
    web.pages["https://s.com/b"] = Answer(200, page([1]))
    assert run_collection(spark, g, *paths)["added"] == 0
    logs = store.read_run_logs(spark, paths[1]).orderBy("started_at_kst").collect()
    assert [(r.status, r.requests_used, r.blocked_reason, r.notes) for r in logs] == [("success", 3, "", "Collected 4 items"), ("success", 6, "", "Collected 4 items")]
    log = store.read_fetch_log(spark, paths[2])
    assert log.count() == 7 and store.requests_on(log, "2024-01-01") == 6 and store.requests_on(log, "2024-01-02") == 0


def test_the_budget_is_that_of_a_day(spark, tmp_path):
    """It is counted from the stored log by a new process, and starts anew with a new day."""
    paths = [str(tmp_path / x) for x in "hrf"]
    web = Web({"https://s.com/a": Answer(200, page([1])), "https://s.com/b": Answer(200, page([2]))})
    assert run_collection(spark, guard(web, max_requests_per_day=3), *paths)["status"] == "success"
    second = guard(web, max_requests_per_day=3)
    assert run_collection(spark, second, *paths)["status"] == "stopped_by_budget" and len(web.asked) == 3
    assert second.remaining == 0
    web.time += timedelta(days=1)
    assert second.remaining == 3
    assert run_collection(spark, guard(web, max_requests_per_day=3), *paths)["status"] == "success" and len(web.asked) == 5


def test_the_log_is_written_after_an_error(spark, tmp_path):
    paths = [str(tmp_path / x) for x in "hrf"]
    web = Web({"https://s.com/a": Answer(200, page([1]))})  # a KeyError for the second
    with pytest.raises(KeyError):
        run_collection(spark, guard(web), *paths)
    assert store.read_fetch_log(spark, paths[2]).count() == 1 and store.read_history(spark, paths[0]).count() == 1
    assert [r.status for r in store.read_run_logs(spark, paths[1]).collect()] == ["failed"]


def test_run_log_states():
    log = RunLog("r", lambda: datetime(2024, 1, 1, 12, tzinfo=KST))
    log.start()
    assert (log.status, log.started_at_kst, log.ended_at_kst) == ("success", "2024-01-01T12:00:00+09:00", "")
    log.update_requests(4)
    log.record_block("blocked")
    log.end("partial", "one")
    log.end("blocked", "two")
    assert log.to_row() == ("r", "2024-01-01T12:00:00+09:00", "2024-01-01T12:00:00+09:00", "blocked", 4, "blocked", "one; two")
    with pytest.raises(ValueError, match="status"):
        log.end("done")


def test_appending_reads_its_own_folders_and_dates(spark, tmp_path):
    path = str(tmp_path / "history")
    frame = spark.createDataFrame([(f"2024-01-{d:02d}", m, "c", "u", 1, "n", None, "p", "run", "ok", "") for d in range(1, 9) for m in ("m1", "m2")], ROW)
    assert store.append_snapshots(spark, path, frame) == 16
    plan = store._could_match(spark, path, frame.where("market = 'm2' and date_kst < '2024-01-03'"))
    assert plan.count() == 2
    scan = plan._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [(market" in scan and "GreaterThanOrEqual(date_kst" in scan


def test_crawl_delays_and_robots_cache():
    web = Web({"https://s.com/a": Answer(200, "x")})
    for respect, least in ((True, 60.0), (False, 0.0)):
        g = guard(web, respect_robots_crawl_delay=respect)
        g.robots = lambda host: "User-agent: *\nCrawl-delay: 60"
        web.slept.clear()
        g.fetch("https://s.com/a")
        assert (web.slept[0] == 60.0) is respect and web.slept[0] >= least
        assert g._texts
        g.clear_robots()
        assert not g._texts


@pytest.mark.parametrize(("answer", "status", "asked"), [(Answer(403, ""), "blocked", 1), (Answer(404, "<p>no ranking</p>"), "failed", 2), (Answer(200, "<body>robot check</body>"), "blocked", 1)])
def test_collection_stops(spark, tmp_path, answer, status, asked):
    web = Web({"https://s.com/a": answer, "https://s.com/b": answer})
    out = run_collection(spark, guard(web), *(str(tmp_path / x) for x in "hrf"))
    assert (out["status"], len(web.asked), out["added"]) == (status, asked, 0)


def test_collection_keeps_rows_when_the_budget_ends(spark, tmp_path):
    web = Web({"https://s.com/a": Answer(200, page([1], "/a2"))})
    out = run_collection(spark, guard(web, max_requests_per_day=1), *(str(tmp_path / x) for x in "hrf"))
    assert (out["status"], out["added"]) == ("stopped_by_budget", 1)


def test_robots_are_respected():
    web = Web({})
    g = guard(web)
    g.robots = lambda host: "User-agent: *\nDisallow: /a"
    assert g.fetch("https://s.com/a") == (None, "robots_disallowed") and web.asked == []


STREAM = "date_kst string, market string, category_key string, product_url string, product_name_raw string, rank int"


def drained(spark, stream, name, mode="append"):
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name).collect()


def test_streaming_forms(spark, tmp_path):
    path = str(tmp_path / "in")
    found = [("2024-01-01", 9), ("2024-01-02", 2), ("2024-01-02", 2), ("2024-01-05", 20)]
    spark.createDataFrame([(d, "m", "c", "p", "P", r) for d, r in found], STREAM).coalesce(1).write.parquet(path)
    stream = spark.readStream.schema(STREAM).parquet(path)
    assert len(drained(spark, ranks.new_rows(stream), "fresh")) == 3
    jumps = drained(spark, ranks.streaming_shocks(stream), "jumps")
    assert [(r.date, r.previous_date, r.change, r.change_type) for r in jumps] == [("2024-01-02", "2024-01-01", 7, "improved")]
    assert stream.select(F.lit(1)).isStreaming
