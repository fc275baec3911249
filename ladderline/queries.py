"""The queries over rank histories, pages and request events, each with its SQL twin."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ladderline.functions import ranking_pages, text
from ladderline.functions.urls import crawl_delay, resolve_url, robots_allowed
from ladderline.model import Category, Settings
from ladderline.operators import audits, entry_exit
from ladderline.operators import shocks as shock_ops
from ladderline.operators import streaks as streak_ops
from ladderline.plans import collect
from ladderline.plans.insights import report_lines, summary, summary_union
from ladderline.sources import config, store
from ladderline.sources.adapters import rank_brands, rank_events
from ladderline.sources.pages import rendered_pages

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

_DAILY_EVENTS = "SELECT strftime(ts + INTERVAL 9 HOUR, '%Y-%m-%d') AS date_kst, event_type AS market, user_id, sum(CAST(value AS DECIMAL(18,2))) AS total FROM events GROUP BY 1, 2, 3"
_EVENT_RANKS = f"""SELECT date_kst, market, 'all' AS category_key, CAST(row_number() OVER (PARTITION BY date_kst, market ORDER BY total DESC, user_id) AS INTEGER) AS rank,
 'User ' || user_id AS product_name_raw, 'https://example.com/u/' || user_id AS product_url FROM ({_DAILY_EVENTS})"""
_SEQ = "date_diff('day', DATE '1970-01-01', CAST(date_kst AS DATE)) * 100000000 + rank * 10"
EVENTS_SQL = f"SELECT *, {_SEQ} + CASE market WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 WHEN 'view' THEN 4 ELSE 0 END AS row_seq FROM ({_EVENT_RANKS})"
_BRAND_RANKS = """SELECT date_kst, 'brands' AS market, 'all' AS category_key, CAST(row_number() OVER (PARTITION BY date_kst ORDER BY total DESC, p_brand) AS INTEGER) AS rank,
 p_brand AS product_name_raw, 'https://example.com/b/' || p_brand AS product_url
 FROM (SELECT strftime(l_shipdate, '%Y-%m-%d') AS date_kst, p_brand, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS total FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"""
BRANDS_SQL = f"SELECT *, {_SEQ} AS row_seq FROM ({_BRAND_RANKS})"
_KEYS = "product_url, market, category_key"


_DAY = "CASE WHEN regexp_full_match(date_kst, '[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}') THEN TRY_CAST(date_kst AS DATE) END"


def shocks_sql(history: str) -> str:
    """Unreadable ranks and dates are null and break both pairs of their row."""
    return f"""SELECT product_name_raw AS product_name, {_KEYS}, date_kst AS date, pd AS previous_date, pr AS previous_rank, rank AS new_rank, pr - rank AS change,
 CASE WHEN pr > rank THEN 'improved' ELSE 'dropped' END AS change_type
 FROM (SELECT *, lag(rank) OVER w AS pr, lag(date_kst) OVER w AS pd, lag(day) OVER w AS pday FROM (SELECT *, {_DAY} AS day FROM ({history})) WINDOW w AS (PARTITION BY {_KEYS} ORDER BY date_kst, row_seq))
 WHERE date_diff('day', pday, day) <= 2 AND abs(pr - rank) >= 3"""


def streaks_sql(history: str) -> str:
    """Names and last ranks come from all rows, runs from rows with a date and a rank; a run that is cut off by an unreadable date is lost."""
    whole = "ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING"
    named = f"""SELECT *, {_DAY} AS day, last_value(product_name_raw) OVER w AS name, last_value(rank) OVER w AS lr FROM ({history})
 WINDOW w AS (PARTITION BY {_KEYS} ORDER BY date_kst, row_seq {whole})"""
    steps = f"""SELECT *, rank <= n AS ins, coalesce(rank <= n AND lag(rank <= n) OVER w AND date_diff('day', lag(day) OVER w, day) <= 1, false) AS goes,
 coalesce(lead(rank <= n) OVER w, false) AND date_diff('day', day, lead(day) OVER w) IS NULL AS lost,
 last_value(rank <= n) OVER (PARTITION BY {_KEYS}, n ORDER BY date_kst, row_seq {whole}) AS act
 FROM ({named}) CROSS JOIN (SELECT CAST(unnest([5, 10, 100]) AS INTEGER) AS n) WHERE rank IS NOT NULL AND date_kst <> '' WINDOW w AS (PARTITION BY {_KEYS}, n ORDER BY date_kst, row_seq)"""
    islands = f"SELECT *, sum(CASE WHEN ins AND NOT goes THEN 1 ELSE 0 END) OVER (PARTITION BY {_KEYS}, n ORDER BY date_kst, row_seq) AS isl FROM ({steps})"
    runs = f"""SELECT {_KEYS}, n, isl, CAST(count(*) AS INTEGER) AS days, arg_min(date_kst, (date_kst, row_seq)) AS s, arg_max(date_kst, (date_kst, row_seq)) AS e,
 arg_max(lost, (date_kst, row_seq)) AS lost, any_value(act) AS act, any_value(lr) AS lr, any_value(name) AS name FROM ({islands}) WHERE ins GROUP BY {_KEYS}, n, isl"""
    return f"""SELECT name AS product_name, {_KEYS}, n AS top_n_threshold, days AS streak_days, s AS streak_start, e AS streak_end,
 CASE WHEN act THEN lr END AS current_rank, act AS is_active
 FROM (SELECT *, row_number() OVER (PARTITION BY {_KEYS}, n ORDER BY days DESC, isl) AS best FROM ({runs}) WHERE NOT lost) WHERE best = 1"""


def _ordered_streaks_sql(history: str, where: str) -> str:
    """The first twenty in stable order: first row of the series, then the threshold."""
    return f"""SELECT x.* FROM ({streaks_sql(history)}) x JOIN (SELECT {_KEYS}, min(row_seq) AS first_seq FROM ({history}) GROUP BY ALL) f USING ({_KEYS})
 WHERE {where} ORDER BY streak_days DESC, first_seq, top_n_threshold, {_KEYS} LIMIT 20"""


def _facts_sql(history: str) -> str:
    return f"""SELECT {_KEYS}, n, arg_max(product_name_raw, row_seq) AS name, max(date_kst) AS last_date, arg_max(rank, row_seq) AS last_rank,
 min(date_kst) FILTER (rank <= n) AS first_in, arg_min(rank, row_seq) FILTER (rank <= n) AS first_rank,
 max(date_kst) FILTER (rank <= n) AS last_in, arg_max(rank, row_seq) FILTER (rank <= n) AS last_in_rank, CAST(count(*) FILTER (rank <= n) AS INTEGER) AS days,
 any_value(latest) AS latest, any_value(strftime(CAST(latest AS DATE) - INTERVAL 7 DAY, '%Y-%m-%d')) AS cutoff
 FROM ({history}) CROSS JOIN (SELECT CAST(unnest([5, 10, 100]) AS INTEGER) AS n) CROSS JOIN (SELECT max(date_kst) AS latest FROM ({history})) GROUP BY {_KEYS}, n"""


def entries_sql(history: str) -> str:
    return f"""SELECT name AS product_name, {_KEYS}, first_in AS entry_date, first_rank AS entry_rank, n AS top_n_threshold, last_rank AS current_rank
 FROM ({_facts_sql(history)}) WHERE first_in >= cutoff AND last_date = latest AND last_rank <= n"""


def exits_sql(history: str) -> str:
    return f"""SELECT name AS product_name, {_KEYS}, last_in AS exit_date, last_in_rank AS last_rank_in_top_n, n AS top_n_threshold, days AS days_in_top_n
 FROM ({_facts_sql(history)}) WHERE last_in >= cutoff AND NOT (last_date = latest AND last_rank <= n)"""


def _recent_sql(history: str) -> str:
    return f"WITH s AS ({shocks_sql(history)}) SELECT * FROM s WHERE date >= (SELECT strftime(CAST(max(date) AS DATE) - INTERVAL 7 DAY, '%Y-%m-%d') FROM s)"


def _top_shocks_sql(history: str, where: str, n: int, source: str = "") -> str:
    return f"""SELECT x.* FROM ({source or shocks_sql(history)}) x JOIN (SELECT {_KEYS}, min(row_seq) AS first_seq FROM ({history}) GROUP BY ALL) f USING ({_KEYS})
 WHERE {where} ORDER BY abs(change) DESC, date, first_seq, {_KEYS} LIMIT {n}"""


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def added(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLE_SQL[name or f.__name__] = sql
        return f

    return added


def _over(name: str, sql: str, f: Callable[[DataFrame], DataFrame], source: Query = rank_events) -> None:
    query(sql, name)(lambda spark, sf_dir: f(source(spark, sf_dir)))


_over("rank_events", EVENTS_SQL, lambda h: h)
_over("rank_brands", BRANDS_SQL, lambda h: h, rank_brands)
_over("shocks", shocks_sql(EVENTS_SQL), shock_ops.shocks)
_over("recent_shocks", _recent_sql(EVENTS_SQL), shock_ops.recent_shocks)
_over("improvements_top10", _top_shocks_sql(EVENTS_SQL, "change > 0", 10), lambda h: shock_ops.improvements(h).limit(10))
_over("drops_top10", _top_shocks_sql(EVENTS_SQL, "change < 0", 10), lambda h: shock_ops.drops(h).limit(10))
_over("streaks", streaks_sql(EVENTS_SQL), streak_ops.streaks)
_over("streaks_active_top20", _ordered_streaks_sql(EVENTS_SQL, "is_active"), lambda h: summary(h)["active_streaks"])
_over("streaks_longest_top20", _ordered_streaks_sql(EVENTS_SQL, "true"), lambda h: summary(h)["longest_streaks"])
_over("new_entries", entries_sql(EVENTS_SQL), entry_exit.new_entries)
_over("exits", exits_sql(EVENTS_SQL), entry_exit.exits)
_over("brand_streaks", streaks_sql(BRANDS_SQL), streak_ops.streaks, rank_brands)
_over("brand_shocks", shocks_sql(BRANDS_SQL), shock_ops.shocks, rank_brands)


def _section(name: str, rows: str, value: str, date: str) -> str:
    return f"SELECT '{name}' AS section, product_name, {_KEYS}, CAST({value} AS BIGINT) AS value, {date} AS date FROM ({rows})"


def _top_facts_sql(rows: str, date: str) -> str:
    return f"""SELECT x.* FROM ({rows}) x JOIN (SELECT {_KEYS}, min(row_seq) AS first_seq FROM ({EVENTS_SQL}) GROUP BY ALL) f USING ({_KEYS})
 ORDER BY {date} DESC, first_seq, top_n_threshold, {_KEYS} LIMIT 20"""


_over(
    "summary_union",
    " UNION ALL ".join(
        [
            _section("active_streaks", _ordered_streaks_sql(EVENTS_SQL, "is_active"), "streak_days", "streak_end"),
            _section("longest_streaks", _ordered_streaks_sql(EVENTS_SQL, "true"), "streak_days", "streak_end"),
            _section("recent_shocks", _top_shocks_sql(EVENTS_SQL, "true", 20, _recent_sql(EVENTS_SQL)), "change", "date"),
            _section("biggest_improvements", _top_shocks_sql(EVENTS_SQL, "change > 0", 10), "change", "date"),
            _section("biggest_drops", _top_shocks_sql(EVENTS_SQL, "change < 0", 10), "change", "date"),
            _section("new_entries", _top_facts_sql(entries_sql(EVENTS_SQL), "entry_date"), "entry_rank", "entry_date"),
            _section("recent_exits", _top_facts_sql(exits_sql(EVENTS_SQL), "exit_date"), "days_in_top_n", "exit_date"),
        ]
    ),
    summary_union,
)
# stored tables
_ROW_KEY = "md5(date_kst || '|' || market || '|' || category_key || '|' || rank || '|' || product_url)"
_over("row_keys", f"SELECT row_seq, {_ROW_KEY} AS row_key FROM ({EVENTS_SQL})", lambda h: h.select("row_seq", store.row_key().alias("row_key")))


def _again(h: DataFrame) -> DataFrame:
    """The rows, and after them all of them again under another name."""
    return h.unionByName(h.withColumn("product_name_raw", F.lit("again")).withColumn("row_seq", F.col("row_seq") + 10**15))


_over("dedup_append", f"SELECT row_seq, product_name_raw, {_ROW_KEY} AS row_key FROM ({EVENTS_SQL}) WHERE market <> 'view'", lambda h: store.new_rows(_again(h), h.where("market = 'view'")).select("row_seq", "product_name_raw", "row_key"))
_over("history_by_market", f"SELECT * FROM ({EVENTS_SQL}) WHERE market = 'view'", lambda h: store.filtered(h, "view"))
_over("history_by_category", f"SELECT * FROM ({BRANDS_SQL}) WHERE category_key = 'all'", lambda h: store.filtered(h, "", "all"), rank_brands)
_over("unique_dates", f"SELECT DISTINCT date_kst FROM ({EVENTS_SQL})", store.unique_dates)
_over(
    "latest_rows",
    f"SELECT {_KEYS}, max(date_kst) AS date_kst, arg_max(rank, row_seq) AS rank FROM ({EVENTS_SQL}) GROUP BY {_KEYS}",
    entry_exit.latest_rows,
)
_over("brand_filter", f"SELECT * FROM ({BRANDS_SQL}) WHERE contains(lower(product_name_raw), '#12') OR contains(lower(product_name_raw), 'brand#3')", lambda h: store.with_brand(h.withColumn("brand_raw", F.lit("")), ["#12", "BRAND#3"]).drop("brand_raw"), rank_brands)
_over("page_faults", f"SELECT date_kst, market, category_key, count(*) AS n_items, CAST(0 AS BIGINT) AS n_incomplete FROM ({EVENTS_SQL}) GROUP BY ALL HAVING count(*) NOT BETWEEN 20 AND 60", lambda h: store.page_faults(h, 20, 60))
_over(
    "quota_rows",
    f"SELECT category_key, page_no, pos, CAST(nth AS INTEGER) AS nth FROM (SELECT *, row_number() OVER (PARTITION BY category_key ORDER BY page_no, pos) AS nth FROM (SELECT market || date_kst AS category_key, rank // 10 AS page_no, rank AS pos FROM ({EVENTS_SQL}))) WHERE nth <= 30",
    lambda h: audits.quota_rows(h.select(F.concat("market", "date_kst").alias("category_key"), F.floor(F.col("rank") / 10).cast("int").alias("page_no"), F.col("rank").alias("pos")), 30),
)


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as requests: an error is a failure, a user is a client."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "event_type")
    return events.select("event_id", "ts", "user_id", (F.col("event_type") != "error").alias("success"), F.lit(None).cast("int").alias("status_code"), F.lit(None).cast("string").alias("reason"))


_REQUESTS = "SELECT event_id, ts, user_id, event_type <> 'error' AS success FROM events"
_RUNS = f"SELECT *, sum(CAST(success AS INTEGER)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM ({_REQUESTS})"
_CIRCUIT = f"""SELECT *, CASE WHEN NOT success AND consecutive_failures >= 5 THEN 'stopped_by_failures' END AS stop_reason FROM (
 SELECT *, CAST(sum(CAST(NOT success AS INTEGER)) OVER (PARTITION BY user_id, run ORDER BY ts, event_id) AS INTEGER) AS consecutive_failures,
 CAST(sum(CAST(NOT success AS INTEGER)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS total_failures FROM ({_RUNS}))"""
_OPEN = f"SELECT *, max(stop_reason IS NOT NULL) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS is_open FROM ({_CIRCUIT})"
_over("budget_audit", f"SELECT event_id, CAST(n AS INTEGER) AS requests, CAST(greatest(0, 25 - n) AS INTEGER) AS remaining, n >= 25 AS exhausted FROM (SELECT event_id, row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts, event_id) AS n FROM ({_REQUESTS}) WHERE success)", lambda r: audits.budget_audit(r, []).select("event_id", "requests", "remaining", "exhausted"), _requests)
_over("circuit_audit", f"SELECT event_id, consecutive_failures, total_failures, stop_reason, is_open FROM ({_OPEN})", lambda r: audits.circuit_audit(r, ["user_id"]).select("event_id", "consecutive_failures", "total_failures", "stop_reason", "is_open"), _requests)
_over(
    "wait_audit",
    f"SELECT event_id, round(greatest(0, 86400 - coalesce(epoch(ts) - lag(epoch(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id), 0)), 3) AS wait_s FROM ({_REQUESTS})",
    lambda r: audits.wait_audit(r, ["user_id"], 86400.0).select("event_id", F.round("wait_s", 3).alias("wait_s")),
    _requests,
)
_over(
    "guard_stats",
    f"""SELECT t.*, coalesce(d.exhausted_days, 0) AS exhausted_days FROM (SELECT user_id, count(*) AS total_requests, count(*) FILTER (success) AS successful_requests, CAST(0 AS BIGINT) AS blocked_requests,
 max(consecutive_failures) AS longest_failures, max(is_open) AS circuit_opened FROM ({_OPEN}) GROUP BY user_id) t
 LEFT JOIN (SELECT user_id, count(*) FILTER (n >= 3) AS exhausted_days FROM (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n FROM ({_REQUESTS}) WHERE success GROUP BY ALL) GROUP BY user_id) d USING (user_id)""",
    lambda r: audits.guard_stats(r, ["user_id"], 3),
    _requests,
)
_over("last_failures", f"SELECT event_id, user_id FROM ({_REQUESTS}) WHERE NOT success ORDER BY ts DESC, event_id DESC LIMIT 5", lambda r: audits.last_failures(r).select("event_id", "user_id"), _requests)
_over(
    "market_totals",
    f"SELECT market, CAST(sum(n) AS BIGINT) AS items, count(*) FILTER (n > 40) AS succeeded, count(*) AS categories FROM (SELECT market, date_kst, count(*) AS n FROM ({EVENTS_SQL}) GROUP BY ALL) GROUP BY market",
    lambda h: audits.market_totals(h.groupBy("market", "date_kst").agg(F.count("*").alias("items_collected")).withColumn("success", F.col("items_collected") > 40)),
)


# scalar functions
def _table(name: str) -> Query:
    return lambda spark, sf_dir: spark.read.parquet(f"{sf_dir}/{name}.parquet")


_SPACE = r"[\s\p{Z}\x0b\x1c-\x1f\x{85}]"
_over("clean_text", rf"SELECT doc_id, trim(regexp_replace(text, '{_SPACE}+', ' ', 'g')) AS text FROM documents", lambda d: d.select("doc_id", text.clean_text(F.col("text")).alias("text")), _table("documents"))
_NUMBER = "TRY_CAST(nullif(regexp_extract({t}, '{p}', 1), '') AS INTEGER)"
_over(
    "rank_number",
    "SELECT doc_id, coalesce(" + ", ".join(_NUMBER.format(t="text", p=p) for p in (r"#(\d+)", r"(\d+)位", r"(\d+)등", r"^(\d+)$", r"(\d+)")) + ") AS rank FROM documents",
    lambda d: d.select("doc_id", text.rank_number(F.col("text")).alias("rank")),
    _table("documents"),
)
_over("url_authority", "SELECT page_id, nullif(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1), '') AS authority FROM pages", lambda p: p.select("page_id", text.url_authority(F.col("url")).alias("authority")), _table("pages"))
_over("robots_url", "SELECT page_id, regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*') || '/robots.txt' AS robots_url FROM pages", lambda p: p.select("page_id", text.robots_url(F.col("url")).alias("robots_url")), _table("pages"))
_BODY = """CASE WHEN strpos(lower({h}), '<body') > 0 AND strpos(reverse(lower({h})), '>ydob/<') > 0
 AND strpos(substr({h}, strpos(lower({h}), '<body')), '>') > 0
 THEN substr({h}, strpos(lower({h}), '<body') + strpos(substr({h}, strpos(lower({h}), '<body')), '>'),
  greatest(0, length({h}) - strpos(reverse(lower({h})), '>ydob/<') - 5 - strpos(lower({h}), '<body') - strpos(substr({h}, strpos(lower({h}), '<body')), '>'))) ELSE {h} END"""
_over("body_content", f"SELECT page_id, {_BODY.format(h='html')} AS body FROM pages", lambda p: p.select("page_id", text.body_content(F.col("html")).alias("body")), _table("pages"))
_MARKED = "SELECT page_id, page_id % 600 AS status, CASE WHEN page_id % 3 = 0 THEN replace(html, '<body>', '<body>Too Many Requests') WHEN page_id % 3 = 1 THEN html || 'Access Denied' ELSE html END AS html FROM pages"
_INDICATORS = " ".join(f"WHEN contains(b, '{x}') THEN 'captcha_indicator:{x}'" for x in text.CAPTCHA_INDICATORS)


@query(f"SELECT page_id, CASE WHEN status IN (403, 429, 503) THEN 'blocking_status_code_' || status {_INDICATORS} END AS reason FROM (SELECT page_id, status, lower({_BODY.format(h='html')}) AS b FROM ({_MARKED}))")
def blocking_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = F.when(F.col("page_id") % 3 == 0, F.replace("html", F.lit("<body>"), F.lit("<body>Too Many Requests"))).when(F.col("page_id") % 3 == 1, F.concat("html", F.lit("Access Denied"))).otherwise(F.col("html"))
    return _table("pages")(spark, sf_dir).select("page_id", text.blocking_reason(F.col("page_id") % 600, html).alias("reason"))


_over("kst_date", "SELECT event_id, strftime(ts + INTERVAL 9 HOUR, '%Y-%m-%d') AS date_kst, strftime(ts + INTERVAL 9 HOUR, '%Y-%m-%dT%H:%M:%S') || '+09:00' AS at_kst FROM events", lambda e: e.select("event_id", text.kst_date(F.col("ts")).alias("date_kst"), text.kst_timestamp(F.col("ts")).alias("at_kst")), _table("events"))
_over(
    "run_log_status",
    "SELECT event_id, CASE event_type WHEN 'view' THEN 'stopped_by_budget' WHEN 'click' THEN 'stopped_by_robots' WHEN 'error' THEN 'blocked' WHEN 'signup' THEN CASE WHEN event_id % 3 > 0 THEN 'success' ELSE 'failed' END ELSE 'failed' END AS status FROM events",
    lambda e: e.select("event_id", text.run_status(F.expr("CASE event_type WHEN 'view' THEN 'stopped_by_budget' WHEN 'click' THEN 'robots_disallowed' WHEN 'error' THEN 'blocked' WHEN 'signup' THEN '' ELSE 'timeout' END"), F.col("event_id") % 3).alias("status")),
    _table("events"),
)
_over(
    "retry_plan",
    "SELECT event_id, (event_id % 5 < 3) AND (event_id % 600) IN (429, 502, 503, 504) AS retry, CAST(5 * pow(2, event_id % 5) AS DOUBLE) AS backoff_s FROM events",
    lambda e: e.select("event_id", text.should_retry(F.col("event_id") % 600, F.col("event_id") % 5).alias("retry"), text.backoff_delay(F.col("event_id") % 5).alias("backoff_s")),
    _table("events"),
)
_over(
    "run_id_time",
    "SELECT event_id, date_trunc('second', ts) AS at FROM events",
    lambda e: e.select("event_id", text.run_id_time(F.concat(F.date_format("ts", "yyyyMMdd_HHmmss"), F.lit("_0a1b2c3d"))).cast("timestamp_ntz").alias("at")),
    _table("events"),
)
_over(
    "report_fields",
    f"SELECT row_seq, substr(product_name_raw || repeat('x', 40), 1, 40) || '...' AS name, CASE WHEN rank % 7 - 3 > 0 THEN '+' ELSE '' END || (rank % 7 - 3) AS change, 'a; ' || market AS notes FROM ({EVENTS_SQL})",
    lambda h: h.select("row_seq", text.shortened(F.concat("product_name_raw", F.repeat(F.lit("x"), 40))).alias("name"), text.signed(F.col("rank") % 7 - 3).alias("change"), text.joined_notes(F.lit("a"), F.lit(""), F.col("market")).alias("notes")),
)


# ranking pages
def _parsed(tier: str) -> Query:
    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        pages = rendered_pages(rank_events(spark, sf_dir)).where(F.col("tier") == tier)
        ranking_pages.register(spark)
        pages.createOrReplaceTempView(f"ranking_pages_{tier}")
        return spark.sql(f"SELECT date_kst, market, p.status, p.rank, p.product_name_raw, p.product_url, p.brand_raw FROM ranking_pages_{tier} r, LATERAL parse_ranking(r.html, r.base_url, r.site, r.top_n) p")

    return f


_SECOND = "market IN ('error', 'purchase')"
_ID = "regexp_extract(product_url, '([^/]+)$', 1)"
for _no, _tier in enumerate(("primary", "fallback", "heuristic")):
    _first_url = "'https://shop.example.com/u/'" if _tier == "primary" else "'https://shop.example.com/dp/'"
    query(
        f"""SELECT date_kst, market, '{"ok" if _tier == "primary" else "partial"}' AS status, rank, product_name_raw,
 CASE WHEN {_SECOND} THEN 'https://shop.example.com/products/' || {_ID} || '/' ELSE {_first_url} || {_ID} END AS product_url,
 CASE WHEN {_SECOND} THEN 'B' || {_ID} END AS brand_raw FROM ({EVENTS_SQL}) WHERE rank <= 100 AND day(CAST(date_kst AS DATE)) % 3 = {_no}""",
        f"parsed_{_tier}",
    )(_parsed(_tier))


@query(f"SELECT tier, status, count(*) AS n_pages, CAST(sum(n) AS BIGINT) AS n_items FROM (SELECT CASE day(CAST(date_kst AS DATE)) % 3 WHEN 0 THEN 'primary' WHEN 1 THEN 'fallback' ELSE 'heuristic' END AS tier, CASE day(CAST(date_kst AS DATE)) % 3 WHEN 0 THEN 'ok' ELSE 'partial' END AS status, count(*) AS n FROM ({EVENTS_SQL}) WHERE rank <= 100 GROUP BY date_kst, market) GROUP BY ALL")
def parse_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = rendered_pages(rank_events(spark, sf_dir)).select("tier", ranking_pages.parsed_page("html", "base_url", "site", "top_n").alias("page"))
    return pages.groupBy("tier", F.col("page.status").alias("status")).agg(F.count("*").alias("n_pages"), F.sum(F.size("page.items")).alias("n_items"))


_HREFS = """SELECT page_id, url, CAST(pos AS INTEGER) AS pos, CASE pos % 4 WHEN 0 THEN href WHEN 1 THEN substr(href, 2) WHEN 2 THEN '?from=' || pos ELSE '//other.example.com' || href END AS href
 FROM (SELECT page_id, url, unnest(hrefs) AS href, unnest(range(0, len(hrefs))) AS pos FROM (SELECT page_id, url, regexp_extract_all(html, 'href="([^"]*)"', 1) AS hrefs FROM pages))"""


@query(
    f"""SELECT page_id, pos, href, CASE pos % 4 WHEN 0 THEN regexp_extract(url, '^[a-z]+://[^/?#]*') || href WHEN 1 THEN regexp_extract(url, '^[a-z]+://[^?#]*/') || href
 WHEN 2 THEN regexp_extract(url, '^[^?#]*') || href ELSE regexp_extract(url, '^[a-z]+:') || href END AS resolved FROM ({_HREFS})"""
)
def page_links_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every link of the pages, as seen from its page: rooted ones as they are, and made relative, a query alone, and without a scheme."""
    links = _table("pages")(spark, sf_dir).select("page_id", "url", F.posexplode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("pos", "href"))
    k = F.col("pos") % 4
    own = F.when(k == 0, F.col("href")).when(k == 1, F.substring("href", 2, 1 << 20)).when(k == 2, F.concat(F.lit("?from="), F.col("pos").cast("string"))).otherwise(F.concat(F.lit("//other.example.com"), F.col("href")))
    return links.withColumn("href", own).select("page_id", "pos", "href", resolve_url("url", "href").alias("resolved"))


SITE = "https://shop.example.com"


def _literal(value: object) -> str:
    return "NULL" if value is None else "'" + str(value).replace("'", "''") + "'"


# histories whose rows can't all be read
def _faulty(h: DataFrame) -> DataFrame:
    """Ranks as texts, some of them fractions, words or missing; some dates unpadded, unreadable or empty; names and keys kept."""
    k = F.col("row_seq") % 97
    rank = F.when(k == 3, None).when(k == 4, F.lit("n/a")).when(k == 5, F.concat(F.col("rank").cast("string"), F.lit(".5"))).when(k == 6, F.concat(F.lit(" "), F.col("rank").cast("string"))).otherwise(F.col("rank").cast("string"))
    date = F.when(k == 7, "N/A").when(k == 8, "").when(k == 9, F.regexp_replace("date_kst", "-0", "-")).otherwise(F.col("date_kst"))
    return h.withColumns({"rank": rank, "date_kst": date})


_FAULTY = f"""SELECT * REPLACE (CASE WHEN row_seq % 97 IN (3, 4, 5) THEN NULL ELSE rank END AS rank,
 CASE row_seq % 97 WHEN 7 THEN 'N/A' WHEN 8 THEN '' WHEN 9 THEN regexp_replace(date_kst, '-0', '-', 'g') ELSE date_kst END AS date_kst) FROM ({EVENTS_SQL})"""
_over("faulty_streaks", streaks_sql(_FAULTY), lambda h: streak_ops.streaks(_faulty(h)))
_over("faulty_shocks", shocks_sql(_FAULTY), lambda h: shock_ops.shocks(_faulty(h)))
_over(
    "page_faults_incomplete",
    f"SELECT date_kst, market, category_key, count(*) AS n_items, count(*) FILTER (rank IS NULL) AS n_incomplete FROM ({_FAULTY}) GROUP BY ALL HAVING count(*) FILTER (rank IS NULL) > 0 OR count(*) NOT BETWEEN 1 AND 100",
    lambda h: store.page_faults(_faulty(h).withColumn("rank", F.expr("try_cast(rank AS int)")).withColumn("rank", F.when(F.col("row_seq") % 97 == 5, None).otherwise(F.col("rank")))),
)


# the report
def _nth(rows: str, order: str, most: int = 10) -> str:
    return f"SELECT *, row_number() OVER (ORDER BY {order}) AS nth FROM ({rows}) QUALIFY nth <= {most}"


def _with_first(rows: str) -> str:
    return f"SELECT x.*, first_seq FROM ({rows}) x JOIN (SELECT {_KEYS}, min(row_seq) AS first_seq FROM ({EVENTS_SQL}) GROUP BY ALL) f USING ({_KEYS})"


_HEAD = "'  * ' || substr(product_name, 1, 40) || '...' || ' on ' || market AS head"
_over(
    "report_lines",
    f"""SELECT 'active_streaks' AS section, nth, {_HEAD}, printf('      %d days running among the first %d, rank %d at present', streak_days, top_n_threshold, current_rank) AS detail
 FROM ({_nth(_with_first(streaks_sql(EVENTS_SQL)) + " WHERE is_active", f"streak_days DESC, first_seq, top_n_threshold, {_KEYS}")})
 UNION ALL SELECT 'recent_shocks', nth, {_HEAD}, printf('      %s%d: from rank %d to rank %d on %s', CASE WHEN change > 0 THEN '+' ELSE '' END, change, previous_rank, new_rank, date)
 FROM ({_nth(_with_first(_recent_sql(EVENTS_SQL)), f"abs(change) DESC, date, first_seq, {_KEYS}")})
 UNION ALL SELECT 'new_entries', nth, {_HEAD}, printf('      among the first %d since %s, from rank %d to rank %d at present', top_n_threshold, entry_date, entry_rank, current_rank)
 FROM ({_nth(_with_first(entries_sql(EVENTS_SQL)), f"entry_date DESC, first_seq, top_n_threshold, {_KEYS}")})
 UNION ALL SELECT 'recent_exits', nth, {_HEAD}, printf('      %d days among the first %d, the last of them %s at rank %d', days_in_top_n, top_n_threshold, exit_date, last_rank_in_top_n)
 FROM ({_nth(_with_first(exits_sql(EVENTS_SQL)), f"exit_date DESC, first_seq, top_n_threshold, {_KEYS}")})""",
    lambda h: report_lines(summary(h)),
)


# stores, appended to and read again
def _scratch(spark: SparkSession, name: str) -> str:
    """A new folder where all executors can read and write: that of spark.checkpoint.dir, or a local one in local mode."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = f"file://{tempfile.mkdtemp(prefix='ladderline-')}"
    return f"{where}/{name}-{uuid.uuid4().hex}"


@query(f"SELECT date_kst, market, category_key, rank, product_name_raw, '' AS brand_raw, product_url, {_ROW_KEY} AS row_key, CASE WHEN date_kst < '2024-01-16' THEN 1 ELSE 2 END AS append FROM ({EVENTS_SQL})")
def stored_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store that is opened empty, appended to in two overlapping parts, and read back: later rows have later numbers."""
    history, path = rank_events(spark, sf_dir), _scratch(spark, "history")
    store.append_snapshots(spark, path, history.where("date_kst < '2024-01-16'"))
    last = store.read_history(spark, path).agg(F.max("row_seq")).first()[0] or 0
    store.append_snapshots(spark, path, history.withColumn("product_name_raw", F.concat("product_name_raw", F.lit(""))))
    rows = store.read_history(spark, path)
    return rows.select("date_kst", "market", "category_key", "rank", "product_name_raw", "brand_raw", "product_url", "row_key", F.when(F.col("row_seq") <= last, 1).otherwise(2).alias("append"))


_RUN_LOGS = "SELECT 'run' || user_id AS run_id, 'failed' AS status, CAST(user_id % 7 AS INTEGER) AS requests_used, CASE WHEN user_id % 2 = 0 THEN 'blocked' ELSE '' END AS blocked_reason, 'n' || user_id AS notes FROM (SELECT DISTINCT user_id FROM events)"


@query(f"SELECT * FROM ({_RUN_LOGS}) UNION ALL SELECT * FROM ({_RUN_LOGS})")
def run_logs_appended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run logs appended twice are there twice."""
    users = _table("events")(spark, sf_dir).select("user_id").distinct()
    text_of = lambda c: F.concat(F.lit(c), F.col("user_id").cast("string"))
    logs = users.select(text_of("run").alias("run_id"), F.lit("a").alias("started_at_kst"), F.lit("b").alias("ended_at_kst"), F.lit("failed").alias("status"), (F.col("user_id") % 7).alias("requests_used"), F.when(F.col("user_id") % 2 == 0, "blocked").otherwise("").alias("blocked_reason"), text_of("n").alias("notes"))
    path = _scratch(spark, "run-log")
    for _ in range(2):
        store.append_run_log(spark, path, logs)
    return store.read_run_logs(spark, path).drop("started_at_kst", "ended_at_kst")


_over("run_totals", f"SELECT CAST(count(*) AS BIGINT) AS total_items, count(DISTINCT (market, date_kst)) AS categories FROM ({EVENTS_SQL})", lambda h: audits.run_totals(h.groupBy("market", "date_kst").agg(F.count("*").alias("items_collected"))))
_over("markets_together", f"SELECT * FROM ({EVENTS_SQL}) WHERE market IN ('view', 'click')", lambda h: store.filtered(h, "view").unionByName(store.filtered(h, "click")))
_MARKETS = ("click", "error", "purchase", "signup", "view")
_SETTINGS = Settings(categories=tuple(Category(f"{SITE}/{m}", f"{m}-{k}", m) for m in _MARKETS for k in (1, 2)))


def _item_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items with the category that their page belongs to, of one market's first category each."""
    known = config.category_table(spark, replace(_SETTINGS, categories=tuple(c for m in _MARKETS[:3] for c in config.categories(_SETTINGS, m, f"{m}-1"))))
    return rank_events(spark, sf_dir).drop("category_key").join(known.withColumnRenamed("market", "of"), F.col("market") == F.col("of")).select("row_seq", "market", "category_key", "category_url")


query(f"SELECT row_seq, market, market || '-1' AS category_key, '{SITE}/' || market AS category_url FROM ({EVENTS_SQL}) WHERE market IN ('click', 'error', 'purchase')", "item_categories")(_item_categories)


# requests: redirects, reasons, delays, robots
_HOPS = "CASE event_id % 5 WHEN 0 THEN ['https://x/ok', 'https://x/blocked?sorry'] WHEN 1 THEN ['https://x/sorry/captcha'] WHEN 2 THEN ['https://x/ok'] WHEN 3 THEN [] ELSE ['https://x/captcha', 'https://x/errors/1'] END"


@query("SELECT event_id, CASE WHEN event_id % 600 IN (403, 429, 503) THEN 'blocking_status_code_' || event_id % 600 WHEN event_id % 5 = 0 THEN 'suspicious_redirect:/blocked' WHEN event_id % 5 IN (1, 4) THEN 'suspicious_redirect:/captcha' WHEN event_id % 2 = 0 THEN 'captcha_indicator:robot check' END AS reason FROM events")
def redirect_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    hops = F.expr(_HOPS.replace("[]", "array()").replace("[", "array(").replace("]", ")"))
    html = F.when(F.col("event_id") % 2 == 0, "<body>Robot Check</body>").otherwise("<body>fine</body>")
    return _table("events")(spark, sf_dir).select("event_id", text.blocking_reason(F.col("event_id") % 600, html, hops).alias("reason"))


_REASONED = """SELECT *, CASE WHEN NOT success THEN CASE event_id % 4 WHEN 0 THEN 403 ELSE 500 END END AS status_code,
 CASE WHEN NOT success THEN CASE event_id % 4 WHEN 1 THEN 'captcha_indicator:x' WHEN 2 THEN 'robots_disallowed' ELSE '' END END AS reason FROM (SELECT event_id, ts, user_id, event_type <> 'error' AS success FROM events)"""
_STOPS = f"""SELECT *, CASE WHEN success THEN NULL WHEN status_code = 403 THEN 'blocked' WHEN contains(reason, 'captcha') THEN 'blocked' WHEN contains(reason, 'robots') THEN 'stopped_by_robots' WHEN cf >= 2 THEN 'stopped_by_failures' END AS stop_reason
 FROM (SELECT *, sum(CAST(NOT success AS INTEGER)) OVER (PARTITION BY user_id, run ORDER BY ts, event_id) AS cf
 FROM (SELECT *, sum(CAST(success AS INTEGER)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM ({_REASONED})))"""


def _reasoned(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed, k = ~F.col("success"), F.col("event_id") % 4
    return _requests(spark, sf_dir).withColumns({"status_code": F.when(failed, F.when(k == 0, 403).otherwise(500)), "reason": F.when(failed, F.when(k == 1, "captcha_indicator:x").when(k == 2, "robots_disallowed").otherwise(""))})


query(f"SELECT event_id, stop_reason, max(stop_reason IS NOT NULL) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS is_open FROM ({_STOPS})", "circuit_reasons")(lambda spark, sf_dir: audits.circuit_audit(_reasoned(spark, sf_dir), ["user_id"], 2).select("event_id", "stop_reason", "is_open"))
_over(
    "request_delays",
    "SELECT event_id, true AS in_range, CAST(CASE WHEN event_id % 3 = 0 THEN 10 + event_id % 4 END AS DOUBLE) AS crawl_delay_used FROM events",
    lambda e: e.select("event_id", F.when(F.col("event_id") % 3 == 0, 10.0 + F.col("event_id") % 4).alias("asked")).withColumn("delay", text.request_delay(F.col("asked"))).select("event_id", F.when(F.col("asked").isNull(), F.col("delay").between(3, 8)).otherwise(F.lit(True)).alias("in_range"), F.when(F.col("asked").isNotNull(), F.col("delay")).alias("crawl_delay_used")),
    _table("events"),
)
_over(
    "crawl_delays",
    "SELECT event_id, CASE event_id % 4 WHEN 0 THEN CAST(event_id % 9 AS DOUBLE) WHEN 1 THEN CAST(greatest(event_id % 9, 2) AS DOUBLE) WHEN 2 THEN NULL ELSE CAST(3.5 AS DOUBLE) END AS delay FROM events",
    lambda e: e.select(
        "event_id",
        crawl_delay(
            F.when(F.col("event_id") % 4 == 0, F.format_string("User-agent: *\nDisallow:\nCrawl-delay: %d\n\nUser-agent: other\nCrawl-delay: 50", F.col("event_id") % 9))
            .when(F.col("event_id") % 4 == 1, F.format_string("user-agent: Ladder\ncrawl-delay: %d\ncrawl-delay: 2\ncrawl-delay: soon", F.col("event_id") % 9))
            .when(F.col("event_id") % 4 == 2, "User-agent: other\nCrawl-delay: 50")
            .otherwise("User-agent: x\nUser-agent: *\nCrawl-delay: 3.5"),
            F.lit("ladderline/1.0"),
        ).alias("delay"),
    ),
    _table("events"),
)
_over(
    "robots_allowed",
    "SELECT event_id, CASE WHEN event_id % 5 = 4 THEN true WHEN event_id % 5 = 3 THEN event_id % 10 >= 5 ELSE event_id % 3 <> 0 END AS allowed FROM events",
    lambda e: e.select(
        "event_id",
        robots_allowed(
            F.when(F.col("event_id") % 5 == 4, None).when(F.col("event_id") % 5 == 3, "User-agent: other\nDisallow:\n\nUser-agent: ladderline\nAllow: /a/open\nDisallow: /a").otherwise("User-agent: *\nDisallow: /private"),
            F.lit("ladderline/1.0"),
            F.when(F.col("event_id") % 5 == 3, F.when(F.col("event_id") % 10 >= 5, f"{SITE}/a/open/1").otherwise(f"{SITE}/a/1")).otherwise(F.when(F.col("event_id") % 3 == 0, f"{SITE}/private/x").otherwise(f"{SITE}/x/private")),
        ).alias("allowed"),
    ),
    _table("events"),
)
_over("new_run_ids", "SELECT event_id, strftime(ts + INTERVAL 9 HOUR, '%Y%m%d_%H%M%S') AS at, true AS has_form FROM events", lambda e: e.withColumn("id", text.new_run_id(F.col("ts"))).select("event_id", F.substring("id", 1, 15).alias("at"), F.col("id").rlike(r"^\d{8}_\d{6}_[0-9a-f]{8}$").alias("has_form")), _table("events"))


# selectors, and the web pages whose HTML has the last name that each asks for
_SELECTORS = "\n UNION ALL ".join(
    f"SELECT {_literal(m)} AS market, {_literal(t)} AS tier, {_literal(n)} AS name, {_literal(config.selector(m, t, n))} AS css, {_literal(config.selector_attribute(m, t, n))} AS attr"
    for m, tiers in ranking_pages.SELECTORS.items()
    for t in ("primary", "fallback")
    for n in tiers[t]
    if n != "pagination"
)


@query(f"SELECT s.*, (SELECT count(*) FROM pages WHERE contains(lower(html), regexp_extract(lower(css), '([a-z0-9_-]+)[^a-z0-9_-]*$', 1))) AS n_pages FROM ({_SELECTORS}) s")
def selector_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    selectors = config.selector_table(spark).where("name <> 'pagination'").select("market", "tier", "name", F.coalesce("css", "alt_css").alias("css"), "attr")
    asked = selectors.select("market", "tier", "name", F.regexp_extract(F.lower("css"), "([a-z0-9_-]+)[^a-z0-9_-]*$", 1).alias("last"))
    # some twenty selectors, whatever the pages
    met = _table("pages")(spark, sf_dir).select(F.lower("html").alias("low")).join(F.broadcast(asked), F.contains("low", "last")).groupBy("market", "tier", "name").agg(F.count("*").alias("n_pages"))
    return selectors.join(met, ["market", "tier", "name"], "left").na.fill(0, ["n_pages"])


# pages that lack a rank, have more cards than asked for, go on, or have nested boxes
def _pages_of(tier: str, change: Callable[[DataFrame], DataFrame]) -> Query:
    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        pages = change(rendered_pages(rank_events(spark, sf_dir)).where(F.col("tier") == tier))
        parsed = pages.withColumn("page", ranking_pages.parsed_page("html", "base_url", "site", "top_n"))
        return parsed.select("date_kst", "market", F.col("page.status").alias("status"), "page.next_page_url", F.posexplode("page.items").alias("pos", "item")).select("date_kst", "market", "status", "next_page_url", "pos", "item.rank", "item.product_name_raw")

    return f


def _page_rows_sql(day: int, status: str, rank: str = "rank", extra: str = "", pos: str = "rank - 1", next_page: str = "NULL") -> str:
    return f"SELECT date_kst, market, '{status}' AS status, CAST({next_page} AS VARCHAR) AS next_page_url, CAST({pos} AS INTEGER) AS pos, CAST({rank} AS INTEGER) AS rank, product_name_raw FROM ({EVENTS_SQL}) WHERE rank <= 100 AND day(CAST(date_kst AS DATE)) % 3 = {day} {extra}"


_no_ranks = lambda p: p.withColumn("html", F.regexp_replace("html", r"#\d+|\d+位", "new"))
query(_page_rows_sql(0, "ok"), "parsed_positions")(_pages_of("primary", _no_ranks))
query(_page_rows_sql(0, "ok", extra="AND rank <= 7"), "parsed_card_limit")(_pages_of("primary", lambda p: p.withColumn("top_n", F.lit(7))))
query(_page_rows_sql(2, "partial", extra="AND rank <= 7"), "parsed_item_limit")(_pages_of("heuristic", lambda p: p.withColumn("top_n", F.lit(7))))
_LINKS = '<li class="a-last"><a href="?pg=2">on</a></li><a class="next-page" href="/list/3">on</a>'
query(_page_rows_sql(0, "ok", next_page=f"CASE WHEN {_SECOND} THEN '{SITE}/list/3' ELSE '{SITE}/list/?pg=2' END"), "parsed_next_page")(_pages_of("primary", lambda p: p.withColumn("html", F.replace("html", F.lit("</body>"), F.lit(_LINKS + "</body>")))))
#: An outer box with two class patterns counts for each of them; boxes inside it do not count.
_nested = lambda p: p.where(F.col("site") == "cosme_jp").withColumn("html", F.regexp_replace("html", '<section class="entry-item">(.*?)</section>', '<div class="ranking-item"><section class="entry-item">$1</section></div>'))
query(
    f"SELECT *, CAST(row_number() OVER (PARTITION BY date_kst, market ORDER BY k, rank) - 1 AS INTEGER) AS pos FROM (SELECT r.* EXCLUDE (pos), k FROM ({_page_rows_sql(2, 'partial', extra=f'AND {_SECOND}')}) r CROSS JOIN (SELECT unnest([1, 2]) AS k)) QUALIFY pos < 100".replace("SELECT *, CAST(row_number", "SELECT * EXCLUDE (k), CAST(row_number"),
    "parsed_nested_boxes",
)(_pages_of("heuristic", _nested))


@query(
    f"""SELECT market, market AS category_key, '{SITE}/' || market AS category_url, rank, product_name_raw, '{SITE}/u/' || {_ID} AS product_url, 'ok' AS parse_status,
 'success' AS run_status, CAST(n AS INTEGER) AS requests_used, CAST(n AS BIGINT) AS fetches
 FROM ({EVENTS_SQL}) CROSS JOIN (SELECT count(DISTINCT (market, rank > 10)) AS n FROM ({EVENTS_SQL}) WHERE date_kst = '2024-01-03' AND market IN ('click', 'signup') AND rank <= 20)
 WHERE date_kst = '2024-01-03' AND market IN ('click', 'signup') AND rank <= 15"""
)
def collected_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run of two categories over rendered pages, each in two parts: stored rows, the run's status, and the requests that the logs have."""
    rows = rank_events(spark, sf_dir).where("date_kst = '2024-01-03' AND market IN ('click', 'signup')")
    parts = {}
    for part, condition in (("/2", "rank BETWEEN 11 AND 20"), ("", "rank <= 10")):
        for r in rendered_pages(rows.where(condition).withColumn("date_kst", F.lit("2024-01-03"))).select("market", "html").collect():  # two small pages
            more = f"{SITE}/{r['market']}/2" in parts
            parts[f"{SITE}/{r['market']}{part}"] = r["html"] if part or not more else r["html"].replace("</body>", f'<li class="a-last"><a href="/{r["market"]}/2">on</a></li></body>')
    categories = tuple(Category(f"{SITE}/{m}", m, "amazon_us") for m in ("click", "signup"))
    guard = collect.Guard(Settings(categories=categories, top_n_target=15), lambda url: collect.Answer(200, parts[url]), sleep=lambda s: None)
    paths = [_scratch(spark, name) for name in ("history", "run-log", "fetch-log")]
    collect.run_collection(spark, guard, *paths)
    run = store.read_run_logs(spark, paths[1]).select(F.col("status").alias("run_status"), "requests_used")
    fetches = store.read_fetch_log(spark, paths[2]).agg(F.count("*").alias("fetches"))
    history = store.read_history(spark, paths[0]).select(F.col("category_key").alias("market"), "category_key", "category_url", "rank", "product_name_raw", "product_url", "parse_status")
    return history.crossJoin(F.broadcast(run)).crossJoin(F.broadcast(fetches))  # both are one row
