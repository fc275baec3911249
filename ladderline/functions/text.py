"""Scalar functions as expressions."""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What marks a blocked answer.
BLOCKING_STATUS_CODES = (403, 429, 503)
CAPTCHA_INDICATORS = ("captcha", "robot check", "verify you are human", "access denied", "access blocked", "rate limited", "too many requests", "ip blocked")
REDIRECT_PATTERNS = ("/errors/", "/blocked", "/captcha", "sorry")
RETRY_STATUS_CODES = (429, 502, 503, 504)


def clean_text(text: Column) -> Column:
    """White space of any kind and length becomes one space, and none at the ends; null becomes empty."""
    return F.coalesce(F.trim(F.regexp_replace(text, r"(?U)[\s\x1c-\x1f]+", " ")), F.lit(""))


@lru_cache(maxsize=1)
def _decimal_digits() -> tuple[str, str]:
    """All decimal digits beyond ASCII, and what each stands for."""
    found = [c for c in map(chr, range(128, sys.maxunicode + 1)) if unicodedata.category(c) == "Nd"]
    return "".join(found), "".join(str(unicodedata.decimal(c)) for c in found)


def plain_digits(text: Column) -> Column:
    """Decimal digits of any script as 0 to 9."""
    return F.translate(text, *_decimal_digits())


def rank_number(text: Column) -> Column:
    """The rank in a text: #n, n位, n등, a lone number, or the first number, whichever form comes first in this list."""
    stripped = F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")
    forms = (r"(?U)#(\d+)", r"(?U)(\d+)位", r"(?U)(\d+)등", r"(?U)^(\d+)$", r"(?U)(\d+)")
    return F.coalesce(*(plain_digits(F.nullif(F.regexp_extract(stripped, p, 1), F.lit(""))).try_cast("int") for p in forms))


def url_authority(url: Column) -> Column:
    """Host with port and user, as written; null where the URL has none."""
    return F.try_parse_url(url, F.lit("AUTHORITY"))


def robots_url(url: Column) -> Column:
    return F.concat(F.try_parse_url(url, F.lit("PROTOCOL")), F.lit("://"), url_authority(url), F.lit("/robots.txt"))


def body_content(html: Column) -> Column:
    """From the end of the first body tag to the last closing one; the whole text where either is absent."""
    low = F.lower(html)
    opened = F.locate("<body", low)
    closed = F.length(html) - F.locate(">ydob/<", F.reverse(low)) - 5
    begins = F.call_function("locate", F.lit(">"), html, F.greatest(opened, F.lit(1)))
    found = (opened > 0) & (F.locate(">ydob/<", F.reverse(low)) > 0) & (begins > 0)
    return F.when(found, F.substring(html, begins + 1, F.greatest(F.lit(0), closed - begins - 1))).otherwise(html)


def _first_contained(text: Column, needles: tuple[str, ...]) -> Column:
    return F.try_element_at(F.filter(F.array(*map(F.lit, needles)), lambda x: F.contains(text, x)), F.lit(1))


def blocking_reason(status_code: Column, html: Column, redirects: Column | None = None) -> Column:
    """Why an answer counts as blocked, or null: its status, a redirect it went through, or a phrase in its body."""
    indicator = _first_contained(F.lower(body_content(html)), CAPTCHA_INDICATORS)
    out = F.when(status_code.isin(*BLOCKING_STATUS_CODES), F.concat(F.lit("blocking_status_code_"), status_code.cast("string")))
    if redirects is not None:
        # the first pattern of the first redirect that has one
        hits = F.filter(F.transform(redirects, lambda u: _first_contained(u, REDIRECT_PATTERNS)), lambda p: p.isNotNull())
        out = out.when(F.size(hits) > 0, F.concat(F.lit("suspicious_redirect:"), F.try_element_at(hits, F.lit(1))))
    return out.when(indicator.isNotNull(), F.concat(F.lit("captcha_indicator:"), indicator))


def run_status(stop_reason: Column, items: Column) -> Column:
    """A run's status from the reason that it was stopped for, or else from whether it collected anything."""
    named = lambda word: F.contains(stop_reason, F.lit(word))
    stopped = F.when(named("budget"), "stopped_by_budget").when(named("robots"), "stopped_by_robots").when(named("blocked"), "blocked").otherwise("failed")
    return F.when(F.coalesce(stop_reason, F.lit("")) != "", stopped).when(items > 0, "success").otherwise("failed")


def should_retry(status_code: Column, attempt: Column, max_retries: int = 3) -> Column:
    return (attempt < max_retries) & status_code.isin(*RETRY_STATUS_CODES)


def backoff_delay(attempt: Column, base: float = 5.0, multiplier: float = 2.0) -> Column:
    return F.lit(base) * F.pow(F.lit(multiplier), attempt)


def request_delay(crawl_delay: Column, least: float = 3.0, most: float = 8.0) -> Column:
    """A random delay in the range, or the crawl delay where that is longer."""
    return F.greatest(F.lit(least) + F.rand() * (most - least), F.coalesce(crawl_delay, F.lit(0.0)))


def kst_date(ts: Column) -> Column:
    return F.date_format(F.convert_timezone(F.lit("UTC"), F.lit("Asia/Seoul"), ts.cast("timestamp_ntz")), "yyyy-MM-dd")


def kst_timestamp(ts: Column) -> Column:
    return F.concat(F.date_format(F.convert_timezone(F.lit("UTC"), F.lit("Asia/Seoul"), ts.cast("timestamp_ntz")), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+09:00"))


def new_run_id(ts: Column) -> Column:
    """Date and time in KST and eight random hexadecimal digits."""
    at = F.convert_timezone(F.lit("UTC"), F.lit("Asia/Seoul"), ts.cast("timestamp_ntz"))
    return F.concat_ws("_", F.date_format(at, "yyyyMMdd_HHmmss"), F.substring(F.replace(F.expr("uuid()"), F.lit("-"), F.lit("")), 1, 8))


def run_id_time(run_id: Column) -> Column:
    """The time in a run id; null where it has none."""
    parts = F.split(run_id, "_")
    return F.try_to_timestamp(F.concat_ws("_", F.get(parts, F.lit(0)), F.get(parts, F.lit(1))), F.lit("yyyyMMdd_HHmmss"))


def joined_notes(*notes: Column) -> Column:
    return F.concat_ws("; ", *(F.nullif(n, F.lit("")) for n in notes))


def shortened(name: Column, size: int = 40) -> Column:
    return F.concat(F.left(name, F.lit(size)), F.lit("..."))


def signed(change: Column) -> Column:
    return F.concat(F.when(change > 0, "+").otherwise(""), change.cast("string"))
