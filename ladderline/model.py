"""Schemas and settings."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

#: The stored rank history. row_seq is the order of appending, row_key the key that duplicates share.
RANK_HISTORY = T.StructType(
    [
        T.StructField("date_kst", T.StringType()),
        T.StructField("market", T.StringType()),
        T.StructField("category_key", T.StringType()),
        T.StructField("category_url", T.StringType()),
        T.StructField("rank", T.IntegerType()),
        T.StructField("product_name_raw", T.StringType()),
        T.StructField("brand_raw", T.StringType()),
        T.StructField("product_url", T.StringType()),
        T.StructField("run_id", T.StringType()),
        T.StructField("parse_status", T.StringType()),
        T.StructField("notes", T.StringType()),
        T.StructField("row_seq", T.LongType()),
        T.StructField("row_key", T.StringType()),
    ]
)
RUN_LOG = T.StructType(
    [
        T.StructField("run_id", T.StringType()),
        T.StructField("started_at_kst", T.StringType()),
        T.StructField("ended_at_kst", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("requests_used", T.IntegerType()),
        T.StructField("blocked_reason", T.StringType()),
        T.StructField("notes", T.StringType()),
    ]
)
FETCH_LOG = T.StructType(
    [
        T.StructField("run_id", T.StringType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("url", T.StringType()),
        T.StructField("host", T.StringType()),
        T.StructField("attempt", T.IntegerType()),
        T.StructField("status_code", T.IntegerType()),
        T.StructField("success", T.BooleanType()),
        T.StructField("reason", T.StringType()),
        T.StructField("response_time_ms", T.DoubleType()),
        T.StructField("bytes", T.LongType()),
    ]
)
#: What a series of ranks belongs to.
SERIES = ["product_url", "market", "category_key"]
DEFAULT_THRESHOLDS = (5, 10, 100)
PARSE_STATUSES = ("ok", "partial", "failed")
#: How a run may end. A run that has not ended counts as a success so far.
RUN_STATUSES = ("success", "partial", "failed", "stopped_by_robots", "stopped_by_budget", "blocked")


@dataclass(frozen=True)
class Category:
    url: str
    category_key: str
    market: str


@dataclass(frozen=True)
class Settings:
    """Limits of collection and of the insights, with the defaults of the configuration file."""

    max_requests_per_day: int = 25
    min_delay: float = 3.0
    max_delay: float = 8.0
    max_retries: int = 3
    base_backoff: float = 5.0
    backoff_multiplier: float = 2.0
    max_consecutive_failures: int = 5
    top_n_target: int = 100
    thresholds: tuple[int, ...] = DEFAULT_THRESHOLDS
    shock_threshold: int = 3
    lookback_days: int = 7
    brand_filter: bool = False
    brand_keywords: tuple[str, ...] = ()
    user_agent: str = "ladderline/1.0"
    respect_robots_crawl_delay: bool = True
    categories: tuple[Category, ...] = field(default_factory=tuple)
