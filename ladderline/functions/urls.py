"""URL and robots.txt functions: crawl delays in built-in functions, and what Spark lacks as Arrow-batched UDFs over the standard library."""

from __future__ import annotations

import re
from urllib.parse import urljoin
from urllib.robotparser import RobotFileParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def joined_url(base: str | None, url: str | None) -> str:
    """The URL as seen from the base; empty for an empty one, and as it is where it can't be read."""
    if not url:
        return ""
    try:
        return urljoin(base or "", url)
    except ValueError:
        return url


@F.pandas_udf(T.StringType())
def resolve_url(base: pd.Series, url: pd.Series) -> pd.Series:
    return pd.Series([joined_url(b, u) for b, u in zip(base, url, strict=True)])


def crawl_delay_of(robots: str | None, agent: str) -> float | None:
    """The longest Crawl-delay in sections for this agent. The last User-agent line before it decides whether it applies; what is no decimal number is left out."""
    own, applies, longest = agent.lower(), False, None
    for name, _, value in (line.strip().partition(":") for line in (robots or "").lower().splitlines()):
        value = value.strip()
        if name == "user-agent":
            applies = value == "*" or value in own
        elif name == "crawl-delay" and applies:
            if re.match(_NUMBER, value):
                longest = max(float(value), longest if longest is not None else float(value))
    return longest


_LINE_ENDS = "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{85}\\x{2028}\\x{2029}]"
_BLANKS = " \t\n\r\x0b\x0c"
_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?$"


def crawl_delay(robots: Column, agent: Column) -> Column:
    """crawl_delay_of() as a fold over the lines, in built-in functions."""
    lines = F.split(F.lower(F.coalesce(robots, F.lit(""))), _LINE_ENDS)
    own = F.lower(agent)

    def step(state: Column, line: Column) -> Column:
        text = F.btrim(line, F.lit(_BLANKS))
        name = F.substring_index(text, ":", 1)
        value = F.btrim(F.substr(text, F.length(name) + 2), F.lit(_BLANKS))
        applies = F.when(name == "user-agent", (value == "*") | F.contains(own, value)).otherwise(state["applies"])
        delay = F.when((name == "crawl-delay") & state["applies"] & value.rlike(_NUMBER), value.try_cast("double"))
        return F.struct(applies.alias("applies"), F.greatest(state["longest"], delay).alias("longest"))

    return F.aggregate(lines, F.struct(F.lit(False).alias("applies"), F.lit(None).cast("double").alias("longest")), step, lambda state: state["longest"])


def is_allowed(robots: str | None, agent: str, url: str) -> bool:
    """Whether robots.txt lets the agent fetch the URL; without a robots.txt everything is allowed."""
    if robots is None:
        return True
    parser = RobotFileParser()
    parser.parse(robots.splitlines())
    return parser.can_fetch(agent, url)


@F.pandas_udf(T.BooleanType())
def robots_allowed(robots: pd.Series, agent: pd.Series, url: pd.Series) -> pd.Series:
    return pd.Series([is_allowed(r, a, u) for r, a, u in zip(robots, agent, url, strict=True)])
