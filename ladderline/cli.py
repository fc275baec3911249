"""python -m ladderline.cli: validates a configuration, or reports on stored history."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from ladderline.model import Settings
from ladderline.plans.insights import print_report
from ladderline.sources.config import categories, load_settings
from ladderline.sources.store import read_history


def described(settings: Settings, market: str | None = None) -> str:
    """What a run with these settings would do."""
    own = categories(settings, market)
    lines = [f"{settings.max_requests_per_day} requests a day, {settings.min_delay:g} to {settings.max_delay:g} s apart", f"{settings.max_retries} retries, {settings.max_consecutive_failures} failures in a row at most", f"{len(own)} categories, {settings.top_n_target} items each"]
    return "\n".join([*lines, *(f"  {c.market}/{c.category_key}: {c.url}" for c in own)])


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("--dry-run", action="store_true", help="show the configuration and stop")
    parser.add_argument("--insights-only", action="store_true", help="report on the stored history")
    parser.add_argument("--market", choices=["amazon_us", "cosme_jp"])
    parser.add_argument("--config", default="config.yaml")
    parser.add_argument("--history", default="data/rank_history")
    found = parser.parse_args(args)
    settings = load_settings(found.config)
    if found.dry_run:
        print(described(settings, found.market))
        return 0
    if not found.insights_only:
        parser.error("collection needs a transport: call ladderline.plans.collect.run_collection with one")
    spark = SparkSession.builder.appName("ladderline").getOrCreate()
    rows = read_history(spark, found.history)
    print_report(rows, market=found.market, thresholds=settings.thresholds, shock_threshold=settings.shock_threshold, lookback_days=settings.lookback_days)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
