"""Settings and selectors from YAML files."""

from __future__ import annotations

from pathlib import Path

import yaml
from pyspark.sql import DataFrame, SparkSession

from ladderline.functions.ranking_pages import SELECTORS
from ladderline.functions.text import BLOCKING_STATUS_CODES, CAPTCHA_INDICATORS, REDIRECT_PATTERNS
from ladderline.model import DEFAULT_THRESHOLDS, Category, Settings
from ladderline.sources.store import LEAST_ITEMS, MOST_ITEMS


def project_root(start: str | Path = ".") -> Path:
    """The nearest folder upwards that holds a config.yaml, or else the working directory."""
    here = Path(start).resolve()
    return next((p for p in (here, *here.parents) if (p / "config.yaml").exists()), Path.cwd())


def settings_of(found: dict) -> Settings:
    """Settings from a loaded file. Categories need a url, a category_key and a market; all else has a default."""
    limits, collection, insights = (found.get(k) or {} for k in ("compliance", "collection", "insights"))
    delays, retry, brand = limits.get("delay_range_s") or {}, limits.get("retry") or {}, collection.get("brand_filter") or {}
    return Settings(
        max_requests_per_day=limits.get("daily_budget", 25),
        min_delay=float(delays.get("min", 3)),
        max_delay=float(delays.get("max", 8)),
        max_retries=retry.get("max_retries", 3),
        base_backoff=float(retry.get("backoff_base_s", 5)),
        backoff_multiplier=float(retry.get("backoff_multiplier", 2)),
        max_consecutive_failures=limits.get("consecutive_failure_limit", 5),
        top_n_target=collection.get("top_n_target", 100),
        thresholds=tuple(insights.get("top_n_thresholds") or DEFAULT_THRESHOLDS),
        shock_threshold=insights.get("rank_shock_threshold", 3),
        lookback_days=insights.get("lookback_days", 7),
        brand_filter=bool(brand.get("enabled", False)),
        brand_keywords=tuple(brand.get("keywords") or ()),
        user_agent=limits.get("user_agent", Settings.user_agent),
        respect_robots_crawl_delay=bool(limits.get("respect_robots_crawl_delay", True)),
        categories=tuple(Category(c["url"], c["category_key"], c["market"]) for c in found.get("categories") or ()),
    )


def load_settings(path: str | Path) -> Settings:
    with open(path, encoding="utf-8") as file:
        return settings_of(yaml.safe_load(file) or {})


def categories(settings: Settings, market: str | None = None, key: str | None = None) -> list[Category]:
    return [c for c in settings.categories if (not market or c.market == market) and (not key or c.category_key == key)]


def category_table(spark: SparkSession, settings: Settings) -> DataFrame:
    """The categories as a small dimension table."""
    return spark.createDataFrame([(c.url, c.category_key, c.market) for c in settings.categories], "category_url string, category_key string, market string")


def selector(market: str, tier: str, name: str, known: dict | None = None) -> str | None:
    """The selector of a field: its text, or the css or else the alt_css of its settings."""
    found = (known or SELECTORS).get(market, {}).get(tier, {}).get(name)
    return found.get("css") or found.get("alt_css") if isinstance(found, dict) else found


def selector_with_fallback(market: str, name: str, known: dict | None = None) -> str | None:
    return selector(market, "primary", name, known) or selector(market, "fallback", name, known)


def selector_attribute(market: str, tier: str, name: str, known: dict | None = None) -> str | None:
    found = (known or SELECTORS).get(market, {}).get(tier, {}).get(name)
    return found.get("attr") if isinstance(found, dict) else None


def market_selectors(market: str, known: dict | None = None) -> dict:
    """All tiers of a market; empty for an unknown one."""
    return (known or SELECTORS).get(market) or {}


def heuristic(market: str, name: str, known: dict | None = None) -> object:
    """A pattern of the market's heuristics, or None."""
    return (market_selectors(market, known).get("heuristic") or {}).get(name)


def common_patterns(known: dict | None = None) -> dict:
    """What marks a blocked answer on any market: the file's section, or the built-in values where no file is given."""
    if known is None:
        return {"blocking_status_codes": list(BLOCKING_STATUS_CODES), "captcha_indicators": list(CAPTCHA_INDICATORS), "suspicious_redirect_patterns": list(REDIRECT_PATTERNS)}
    return known.get("common") or {}


def validation_rules(known: dict | None = None) -> dict:
    """How many items a page may have: the file's section, or the built-in values where no file is given."""
    return {"min_items_per_page": LEAST_ITEMS, "max_items_per_page": MOST_ITEMS} if known is None else known.get("validation") or {}


def selector_table(spark: SparkSession, known: dict | None = None) -> DataFrame:
    """Every selector as a row: market, tier, name, css, alt_css, attr."""
    rows = []
    for market, tiers in (known or SELECTORS).items():
        for tier in ("primary", "fallback"):
            for name, found in (tiers.get(tier) or {}).items() if isinstance(tiers, dict) else ():
                how = found if isinstance(found, dict) else {"css": found}
                rows.append((market, tier, name, how.get("css"), how.get("alt_css"), how.get("attr")))
    return spark.createDataFrame(rows, "market string, tier string, name string, css string, alt_css string, attr string")
