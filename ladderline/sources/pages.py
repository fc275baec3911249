"""Ranking pages rendered from a rank history, so that the parsers can be held against the rows they came from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASE_URL = "https://shop.example.com/list/"
#: Markets of the history that are rendered in the second site's mark-up; all others get the first's.
SECOND_SITE = ("error", "purchase")
TIERS = ("primary", "fallback", "heuristic")


def _card(site: str, tier: int) -> Column:
    """The mark-up of one item; rank, name and id are filled in."""
    forms = {
        ("amazon_us", 0): '<div data-asin="{i}"><span class="zg-bdg-text">#{r}</span><a class="a-link-normal" href="../u/{i}"><span><div>{n}</div></span></a></div>',
        ("amazon_us", 1): '<div class="a-cardui"><span class="zg-badge-text">#{r}</span><div class="p13n-sc-truncate-desktop-type2">{n}</div><a href="/dp/{i}">see</a></div>',
        ("amazon_us", 2): '<li data-asin="{i}"><b class="badge">#{r}</b><a href="/dp/{i}">{n}</a></li>',
        ("cosme_jp", 0): '<div class="ranking-product-item"><span class="ranking-number">{r}位</span><p class="product-name"><a>{n}</a></p><a class="product-link" href="/products/{i}/">see</a><p class="brand-name">B{i}</p></div>',
        ("cosme_jp", 1): '<li class="product-item"><span class="rank">{r}</span><h3 class="product-title"><a href="/products/{i}/">{n}</a></h3><span class="brand-name">B{i}</span></li>',
        ("cosme_jp", 2): '<section class="entry-item"><b class="num">{r}位</b><a href="/products/{i}/">{n}</a><i class="brand">B{i}</i></section>',
    }
    out = F.lit(forms[site, tier])
    for mark, value in (("{i}", F.col("id")), ("{r}", F.col("rank").cast("string")), ("{n}", F.col("product_name_raw"))):
        out = F.replace(out, F.lit(mark), value)
    return out


def rendered_pages(history: DataFrame, top_n: int = 100) -> DataFrame:
    """A page for each date and market: html, base_url, site (whose mark-up), tier (by day of month) and top_n. A page has at most top_n items."""
    rows = history.where(F.col("rank") <= top_n).withColumn("id", F.regexp_extract("product_url", "([^/]+)$", 1))
    rows = rows.withColumn("site", F.when(F.col("market").isin(*SECOND_SITE), "cosme_jp").otherwise("amazon_us")).withColumn("tier_no", F.dayofmonth(F.to_date("date_kst")) % 3)
    card = F.coalesce(*(F.when((F.col("site") == s) & (F.col("tier_no") == t), _card(s, t)) for s in ("amazon_us", "cosme_jp") for t in range(3)))
    pages = rows.groupBy("date_kst", "market", "site", "tier_no").agg(F.array_sort(F.collect_list(F.struct("rank", card.alias("card")))).alias("cards"))
    html = F.concat(F.lit("<html><head><title>Ranking</title></head><body>\n"), F.concat_ws("\n", F.col("cards.card")), F.lit("\n</body></html>"))
    tier = F.element_at(F.array(*map(F.lit, TIERS)), F.col("tier_no") + 1)
    return pages.select("date_kst", "market", "site", tier.alias("tier"), html.alias("html"), F.lit(BASE_URL).alias("base_url"), F.lit(top_n).alias("top_n"))
